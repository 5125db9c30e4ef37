"""Anomalies in ledgers, ranking of context and impact of changes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import estimated_tokens


def velocity(events: DataFrame, agent: str, ts: str, window_seconds: int) -> DataFrame:
    """Each event with the number of its agent's events from its time to ``window_seconds`` later, itself included. ``ts`` in microseconds."""
    w = Window.partitionBy(agent).orderBy(ts).rangeBetween(0, window_seconds * 1_000_000)
    return events.withColumn("in_window", F.count("*").over(w))


def velocity_spikes(events: DataFrame, agent: str, ts: str, window_seconds: int, threshold: int) -> DataFrame:
    """(agent, start, count): windows with more than ``threshold`` events, the next one looked for behind them.

    Skipping depends on what came before, so an agent's candidates go through in
    order; only events that begin a full window are candidates.
    """
    kind = events.schema[agent].dataType.simpleString()
    w = Window.partitionBy(agent).orderBy(ts)
    full = velocity(events, agent, ts, window_seconds).withColumn("_n", F.row_number().over(w)).filter(F.col("in_window") > threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, free = [], 0
        for n, t, count in pdf.sort_values("_n")[["_n", ts, "in_window"]].itertuples(index=False):
            if n >= free:
                out.append((pdf[agent].iloc[0], t, count))
                free = n + count
        return pd.DataFrame(out, columns=["agent", "start", "count"])

    return full.select(agent, ts, "_n", "in_window").groupBy(agent).applyInPandas(run, f"agent {kind}, start long, count long")


def ping_pong(ledger: DataFrame, seq: str, agent: str, min_cycles: int = 3) -> DataFrame:
    """(first_seq, a, b, cycles): maximal runs in which two agents alternate, a first, for ``min_cycles`` pairs or more.

    ``seq`` has no gaps, so neighbours come from joins on it. A run is found
    from the places where the alternation breaks: no two neighbours of a run
    are alike and every entry equals the one two before it.
    """
    e = ledger.select(F.col(seq).alias("s"), F.col(agent).alias("x"))
    shift = lambda k, n: e.select((F.col("s") + k).alias("s"), F.col("x").alias(n))
    near = e.join(shift(1, "p1"), "s", "left").join(shift(2, "p2"), "s", "left")
    alternates = F.coalesce((F.col("x") == F.col("p2")) & (F.col("x") != F.col("p1")), F.lit(False))
    going = near.filter(alternates).select("s")  # s continues the run of s - 1
    # run of consecutive numbers: those whose predecessor is missing begin one, those whose successor is missing end one
    starts = going.join(going.select((F.col("s") + 1).alias("s")), "s", "left_anti").select(F.col("s").alias("first"))
    stops = going.join(going.select((F.col("s") - 1).alias("s")), "s", "left_anti").select(F.col("s").alias("last"))
    number = lambda df, c: df.withColumn("_k", F.row_number().over(Window.orderBy(c)))
    runs = number(starts, "first").join(number(stops, "last"), "_k").select((F.col("first") - 2).alias("first_seq"), (F.col("last") - F.col("first") + 3).alias("n"))
    runs = runs.filter(F.col("n") >= 2 * min_cycles)
    a, b = (e.select((F.col("s") - k).alias("first_seq"), F.col("x").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return runs.join(a, "first_seq").join(b, "first_seq").select("first_seq", "a", "b", F.floor(F.col("n") / 2).cast("long").alias("cycles"))


def rank_context(candidates: DataFrame, query: str, active: str | None = None, pinned: list[str] | None = None, budget: int = 4000, max_results: int = 20) -> DataFrame:
    """Candidates (path, symbol, excerpt) by keyword score within a token budget: path, score, confidence, tokens.

    A query word in the path gives 2, in the symbol 1.25, in the excerpt 0.75;
    the active path 2, pinned ones 1, test files 0.25 more.
    """
    words = [w for w in re.split(r"\W+", query.lower()) if w]
    has = lambda c, w, points: F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)), points).otherwise(0.0)
    score: Column = F.lit(0.0)
    for w in words:
        score = score + has(F.col("path"), w, 2.0) + has(F.col("symbol"), w, 1.25) + has(F.col("excerpt"), w, 0.75)
    if active:
        score = score + F.when(F.lower("path") == active.lower(), 2.0).otherwise(0.0)
    if pinned:
        score = score + F.when(F.lower("path").isin([p.lower() for p in pinned]), 1.0).otherwise(0.0)
    score = score + F.when(F.contains(F.lower("path"), F.lit("test")), 0.25).otherwise(0.0)
    confidence = F.least(F.lit(1.0), score / (len(words) * 3.5)) if words else F.lit(0.0)
    scored = candidates.select("path", score.alias("score"), confidence.alias("confidence"), F.greatest(F.lit(1), F.floor((F.length(F.coalesce("excerpt", F.lit(""))) + 3) / 4)).cast("long").alias("tokens")).filter("score > 0")
    best = scored.orderBy(F.desc("score"), "path").limit(max_results)
    w = Window.orderBy(F.desc("score"), "path")  # over max_results rows
    run = best.withColumn("_sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return run.filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def rank_files(files: DataFrame, query: str, budget: int) -> DataFrame:
    """(path, confidence, tokens): files whose path has query words; the budget cuts in path order, then they go by confidence."""
    words = [w for w in re.split(r"\W+", query.lower()) if w]
    matched = sum((F.when(F.contains(F.lower("path"), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    found = files.select("path", (matched / max(len(words), 1)).alias("confidence"), estimated_tokens(F.col("content")).alias("tokens")).filter("confidence > 0")
    run = found.withColumn("_sum", F.sum("tokens").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter(F.col("_sum") <= budget).drop("_sum").orderBy(F.desc("confidence"), "path")


def direct_impact(deps: DataFrame, signals: DataFrame, target: str, max_results: int = 100) -> DataFrame:
    """(path, coverage, score): direct dependents of ``target`` with 1 - coverage, highest first."""
    hit = deps.filter(F.lower("target_path") == target.lower()).select(F.col("source_path").alias("path")).distinct()
    cover = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("coverage", F.lit(0.0))))
    scored = hit.join(signals.select("path", "coverage"), "path", "left").select("path", cover.alias("coverage"), (1 - cover).alias("score"))
    return scored.orderBy(F.desc("score"), F.lower("path")).limit(max_results)


def impact_report(deps: DataFrame, target: str) -> DataFrame:
    """(target, dependents, risk, envelope): over 10 dependents 0.8 and e2e, over 3 0.4 and integration, else 0.1 and unit."""
    n = F.col("dependents")
    found = deps.filter(F.lower("target_path") == target.lower()).agg(F.count("*").alias("dependents"))
    return found.select(F.lit(target).alias("target"), n, F.when(n > 10, 0.8).when(n > 3, 0.4).otherwise(0.1).alias("risk"), F.when(n > 10, "e2e").when(n > 3, "integration").otherwise("unit").alias("envelope"))
