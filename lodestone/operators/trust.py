"""Hash-chained ledgers, their verification, agents, audit and reputation."""

from __future__ import annotations

import hashlib
import hmac
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Half-life of reputation in microseconds: 30 days.
HALF_LIFE = 30 * 24 * 3600 * 1_000_000


def chain(entries: DataFrame, seq: str = "seq", payload: str = "payload") -> DataFrame:
    """Add ``payload_hash`` (SHA-256) and ``prev_hash`` (the one of the entry before; the first has none: empty).

    A ledger is one sequence, and its order is needed only for the neighbour's
    hash: the entry before is found by joining on ``seq`` - 1, so nothing goes
    to one task. ``seq`` has no gaps.
    """
    hashed = entries.withColumn("payload_hash", F.sha2(F.col(payload), 256))
    before = hashed.select((F.col(seq) + 1).alias(seq), F.col("payload_hash").alias("prev_hash"))
    return hashed.join(before, seq, "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit("")))


def append(ledger: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """``ledger`` with ``rows`` chained behind it in that order; the batch, not the ledger, is put in sequence."""
    last = ledger.agg(F.max("seq").alias("n"), F.max_by("payload_hash", "seq").alias("h")).first()
    n, h = last["n"] or 0, last["h"] or ""
    new = rows.withColumn("seq", F.row_number().over(Window.orderBy(order)) + F.lit(n))
    new = chain(new).withColumn("prev_hash", F.when(F.col("seq") == n + 1, F.lit(h)).otherwise(F.col("prev_hash")))
    return ledger.unionByName(new.select(*ledger.columns))


def may_append(entries: DataFrame, agents: DataFrame) -> DataFrame:
    """Add ``allowed`` and ``reason``: key validity window, economic value within the agent's ceiling, required co-signers registered and other.

    entries: agent_id, ts, value, cosigners (array); agents: agent_id, valid_from, valid_to, ceiling, needs_cosign (0: none).
    """
    known = entries.join(agents, "agent_id", "left")
    # one row for each co-signature, then back: registered agents other than the author
    signed = entries.select("seq", "agent_id", F.explode_outer("cosigners").alias("c")).join(agents.select(F.col("agent_id").alias("c")), "c", "left_semi").filter("c <> agent_id").groupBy("seq").agg(F.count_distinct("c").alias("good_cosigners"))
    known = known.join(signed, "seq", "left").withColumn("good_cosigners", F.coalesce("good_cosigners", F.lit(0)))
    reason = (
        F.when(F.col("valid_from").isNull(), "unknown agent")
        .when(~F.col("ts").between(F.col("valid_from"), F.col("valid_to")), "outside the key's validity")
        .when(F.col("value") > F.col("ceiling"), "over the authority ceiling")
        .when(F.col("good_cosigners") < F.col("needs_cosign"), "co-signature missing")
    )
    return known.select(*entries.columns, reason.isNull().alias("allowed"), reason.alias("reason"))


def verify(ledger: DataFrame, seq: str = "seq", payload: str = "payload") -> DataFrame:
    """(entries, valid, first_bad): hashes recomputed, numbers without gaps from 1, links to the entry before."""
    before = ledger.select((F.col(seq) + 1).alias(seq), F.col("payload_hash").alias("_before"))
    linked = ledger.join(before, seq, "left")
    ok = (F.col("payload_hash") == F.sha2(F.col(payload), 256)) & F.when(F.col(seq) == 1, F.col("prev_hash") == "").otherwise(F.coalesce(F.col("prev_hash") == F.col("_before"), F.lit(False)))
    found = linked.agg(F.count("*").alias("entries"), F.max(seq).alias("top"), F.count_distinct(seq).alias("numbers"), F.min(F.when(~F.coalesce(ok, F.lit(False)), F.col(seq))).alias("first_bad"))
    return found.select("entries", (F.col("first_bad").isNull() & (F.coalesce("top", F.lit(0)) == F.col("entries")) & (F.col("numbers") == F.col("entries"))).alias("valid"), "first_bad")


def sign(key: bytes, prev: str, digest: str, seq: int) -> str:
    """HMAC-SHA-256 over previous hash, payload hash and sequence number."""
    return hmac.new(key, f"{prev}|{digest}|{seq}".encode(), hashlib.sha256).hexdigest()


@F.pandas_udf(T.BooleanType())
def signature_ok(key: pd.Series, prev: pd.Series, digest: pd.Series, seq: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([k is not None and s is not None and hmac.compare_digest(sign(bytes(k), p or "", d or "", int(n)), s) for k, p, d, n, s in zip(key, prev, digest, seq, signature)])


def register(agents: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with those of ``new`` whose signature holds; ``at``, the order of registration, goes on after the last.

    Both: agent_id, public_key, valid_from, valid_to, signature, at. The
    signature is :func:`sign` of agent_id and "valid_from:valid_to" with
    number 0. Nulls in what is signed make it fail.
    """
    span = F.concat_ws(":", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))
    whole = F.col("agent_id").isNotNull() & F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull()
    good = new.filter(whole & signature_ok("public_key", "agent_id", span, F.lit(0), "signature"))
    last = agents.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
    return agents.unionByName(good.withColumn("at", F.col("at") + F.lit(last)).select(*agents.columns))


def agent_of(agents: DataFrame, agent_id: str) -> DataFrame:
    """The agent's last registration; no row where there is none."""
    return agents.filter(F.col("agent_id") == agent_id).orderBy(F.desc("at")).limit(1)


def _event_hash() -> Column:
    """SHA-256 over event_id and ts (8 bytes each, big-endian), kind (4 bytes), agent_id, details and the hash before."""
    number = lambda c, size: F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 2 * size, "0"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    return F.unhex(F.sha2(F.concat(number("event_id", 8), number("ts", 8), number("kind", 4), text("agent_id"), text("details"), F.col("previous_hash")), 256))


AUDIT = "event_id long, ts long, kind int, agent_id string, details string, previous_hash binary, hash binary"


def audit_append(log: DataFrame, events: DataFrame) -> DataFrame:
    """The audit log with a batch of events (ts, kind, agent_id, details) chained behind it, by time.

    Every hash covers the one before, so the batch, not the log, goes through
    one task.
    """
    end = log.agg(F.max("event_id").alias("n"), F.max_by("hash", "event_id").alias("h")).first()
    first, before = end["n"] or 0, bytes(end["h"] or bytes(32))

    def run(batches):
        n, h = first, before
        for pdf in batches:
            out = []
            for ts, kind, agent, details in pdf.itertuples(index=False):
                n += 1
                previous, h = h, hashlib.sha256(struct.pack(">qqi", n, ts, kind) + (agent or "").encode() + (details or "").encode() + h).digest()
                out.append((n, ts, kind, agent, details, previous, h))
            yield pd.DataFrame(out, columns=["event_id", "ts", "kind", "agent_id", "details", "previous_hash", "hash"])

    ordered = events.select(F.col("ts").cast("long"), F.col("kind").cast("int"), "agent_id", "details").repartition(1).sortWithinPartitions("ts", "kind", "agent_id", "details")
    return log.unionByName(ordered.mapInPandas(run, AUDIT))


def audit_verify(log: DataFrame) -> DataFrame:
    """(events, valid, first_bad): each hash recomputed and each link checked, by a join on the number before."""
    before = log.select((F.col("event_id") + 1).alias("event_id"), F.col("hash").alias("_before"))
    linked = log.join(before, "event_id", "left")
    link = F.col("previous_hash") == F.when(F.col("event_id") == 1, F.unhex(F.lit("00" * 32))).otherwise(F.col("_before"))
    ok = F.coalesce(link & (F.col("hash") == _event_hash()), F.lit(False))
    found = linked.agg(F.count("*").alias("events"), F.min(F.when(~ok, F.col("event_id"))).alias("first_bad"))
    return found.select("events", F.col("first_bad").isNull().alias("valid"), "first_bad")


def export_deltas(ledger: DataFrame, from_seq: int) -> DataFrame:
    return ledger.filter(F.col("seq") >= from_seq)


def import_deltas(ledger: DataFrame, deltas: DataFrame) -> DataFrame:
    """The ledger with the deltas' entries that it does not have."""
    top = ledger.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return ledger.unionByName(deltas.filter(F.col("seq") > top).select(*ledger.columns))


def sync_preflight(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(common, local_ahead, remote_ahead, compatible): what a sync of two fragments would move."""
    from lodestone.operators.diff import ledger_diff

    d = ledger_diff(local, remote)
    return d.select("common", F.col("left_only").alias("local_ahead"), F.col("right_only").alias("remote_ahead"), ((F.col("left_only") == 0) | (F.col("right_only") == 0)).alias("compatible"))


def reputation(observations: DataFrame, agent: str, ts: str, success: Column, weight: Column | None = None) -> DataFrame:
    """(agent, score, confidence, last_updated, ratings, alpha, beta) after all observations; ``ts`` in microseconds.

    Updates are Beta counts whose excess over the prior 1 halves every 30 days.
    Applied one by one that is a sum of weights discounted to the last
    observation, so it aggregates in one pass whatever an agent's history.
    """
    w = F.lit(1.0) if weight is None else weight
    o = observations.select(F.col(agent).alias("agent"), F.col(ts).alias("_t"), success.alias("_s"), w.alias("_w"))
    ends = o.groupBy("agent").agg(F.max("_t").alias("_end"))
    aged = o.join(ends, "agent").withColumn("_d", F.col("_w") * F.pow(F.lit(0.5), (F.col("_end") - F.col("_t")) / F.lit(float(HALF_LIFE))))
    total = lambda c: F.lit(1.0) + F.sum(F.when(c, F.col("_d")).otherwise(0.0))
    out = aged.groupBy("agent").agg(F.max("_t").alias("last_updated"), F.count("*").alias("ratings"), total(F.col("_s")).alias("alpha"), total(~F.col("_s")).alias("beta"))
    both = F.col("alpha") + F.col("beta")
    return out.select("agent", (F.col("alpha") / both).alias("score"), (1 - F.lit(2.0) / (both + 1)).alias("confidence"), "last_updated", "ratings", "alpha", "beta")


def reputation_of(scores: DataFrame, agents: DataFrame, agent: str = "agent") -> DataFrame:
    """(agent, score): the latest score of each of ``agents``; 0.5 for those without one."""
    latest = scores.groupBy(agent).agg(F.max_by("score", "last_updated").alias("score"))
    return agents.select(agent).join(latest, agent, "left").select(agent, F.coalesce("score", F.lit(0.5)).alias("score"))
