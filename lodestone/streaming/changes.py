"""Continuous queries with Structured Streaming: change feeds, observers, windows and stateful scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CREATE, UPDATE, DELETE = "create", "update", "delete"


def change_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, kind, before, after): the change events between two states of a table, images as JSON."""
    pack = lambda df, n: df.select(key, F.to_json(F.struct(*df.columns)).alias(n))
    both = pack(before, "before").join(pack(after, "after"), key, "full")
    kind = F.when(F.col("before").isNull(), CREATE).when(F.col("after").isNull(), DELETE).otherwise(UPDATE)
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(key, kind.alias("kind"), "before", "after")


class ChangeBus:
    """Handlers of change events by kind, fed by a streaming frame with a ``kind`` column (or by a batch frame)."""

    def __init__(self):
        self._handlers: dict[str | None, list[Callable[[DataFrame], None]]] = {}

    def subscribe(self, kind: str, handler: Callable[[DataFrame], None]) -> None:
        self._handlers.setdefault(kind, []).append(handler)

    def subscribe_all(self, handler: Callable[[DataFrame], None]) -> None:
        self._handlers.setdefault(None, []).append(handler)

    def unsubscribe(self, handler: Callable[[DataFrame], None]) -> None:
        for found in self._handlers.values():
            while handler in found:
                found.remove(handler)

    def publish(self, events: DataFrame) -> None:
        """Give each handler the events of its kind."""
        for kind, handlers in self._handlers.items():
            part = events if kind is None else events.filter(F.col("kind") == kind)
            for h in handlers:
                h(part)

    def attach(self, stream: DataFrame, checkpoint: str):
        """A streaming query that publishes every micro-batch."""
        return stream.writeStream.foreachBatch(lambda df, _: self.publish(df)).option("checkpointLocation", checkpoint).start()


def maintain(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """A query that keeps a derived table up to date batch by batch; ``apply`` gets the batch and its number, so it can be idempotent."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def event_time(df: DataFrame, ts: str, lateness: str = "10 minutes") -> DataFrame:
    """``ts`` as a timestamp with a watermark; a zone-less timestamp cannot carry one."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling(df: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    """(window_start, keys, n): counts by fixed windows, for batch and streaming frames alike."""
    return df.groupBy(F.window(F.col(ts).cast("timestamp") if not df.isStreaming else F.col(ts), width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding(df: DataFrame, ts: str, width: str, step: str, *keys: str) -> DataFrame:
    return df.groupBy(F.window(F.col(ts).cast("timestamp") if not df.isStreaming else F.col(ts), width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """(key, session_start, session_end, n): runs of events with no pause of ``gap``."""
    out = df.groupBy(key, F.session_window(F.col(ts).cast("timestamp") if not df.isStreaming else F.col(ts), gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def velocity_alerts(stream: DataFrame, agent: str, ts: str, width: str, threshold: int) -> DataFrame:
    """Agents with more than ``threshold`` events in a window, while the stream goes on."""
    return tumbling(stream, ts, width, agent).filter(F.col("n") > threshold)


def running_reputation(stream: DataFrame, agent: str, ts: str, success: str) -> DataFrame:
    """(agent, alpha, beta, score, last_updated) after each micro-batch, by keyed state; ``ts`` long microseconds.

    The state holds the two counts' excess over the prior and the time of the
    last observation, and decays as :func:`lodestone.operators.trust.reputation` does.
    """
    import pandas as pd

    from lodestone.operators.trust import HALF_LIFE

    def step(key, batches, state):
        a, b, last = state.get if state.exists else (0.0, 0.0, None)
        rows = pd.concat(list(batches)).sort_values(ts)
        for t, good in zip(rows[ts], rows[success]):
            fade = 0.5 ** (max(0, t - last) / HALF_LIFE) if last is not None else 1.0
            a, b, last = a * fade + bool(good), b * fade + (not good), max(t, last or t)
        state.update((float(a), float(b), int(last)))
        yield pd.DataFrame({"agent": [key[0]], "alpha": [1 + a], "beta": [1 + b], "score": [(1 + a) / (2 + a + b)], "last_updated": [int(last)]})

    kind = stream.schema[agent].dataType.simpleString()
    return stream.groupBy(agent).applyInPandasWithState(step, f"agent {kind}, alpha double, beta double, score double, last_updated long", "a double, b double, last long", "update", "NoTimeout")
