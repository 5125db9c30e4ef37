"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows get a seeded hash, are ranked by it within their source, and are ordered
by fractional rank ``(2 * rank - 1) / (2 * rows of the source)``. Equal cuts of
that order give shards whose sizes differ by one row at most and whose source
mixture follows the corpus.

No source goes to one task: ranks come from buckets of the hash's leading bits
plus the counts of earlier buckets, and positions from buckets of the
fractional rank plus the counts of earlier buckets. Only the key columns move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, materialise, table


def shard_rows(docs: DataFrame, keys: list[str], source: str, shards: int, seed: int = 17, rows_per_bucket: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """Assign each row of ``docs`` a ``shard`` (0 to ``shards`` - 1) and a gapless ``slot`` in it.

    Returns the columns ``keep`` (all, if None) with ``shard`` int and ``slot``
    long. ``keys`` seed the shuffle and should tell rows apart; rows alike in
    them are ordered by the kept columns. Rows with a null source form a source
    of their own, null keys hash like any value, an empty table gives no rows.
    A column of ``docs`` named like a new one is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("shard", "slot")]
    names = {x: free_name(docs, x) for x in ("src", "h", "b", "before", "n", "r", "f", "p")}
    src, h, b, before, n, r, f, p = (names[x] for x in ("src", "h", "b", "before", "n", "r", "f", "p"))
    tagged = docs.select(*kept, F.col(source).alias(src), F.xxhash64(F.lit(seed), *keys).alias(h))
    total = docs.count()
    buckets = max(64, -(-total // rows_per_bucket))
    # order-preserving: the hash's high 32 bits as a number from 0, scaled to the buckets
    tagged = tagged.withColumn(b, ((F.shiftright(h, 32) + F.lit(2**31)) * F.lit(buckets) / F.lit(2**32)).cast("int"))
    counts = tagged.groupBy(src, b).agg(F.count("*").alias(n))
    by_source = Window.partitionBy(src)
    counts = counts.select(
        src, b,
        F.coalesce(F.sum(n).over(by_source.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before),
        F.sum(n).over(by_source).alias(n),
    )
    ties = [x for x in kept if docs.schema[x].dataType.typeName() not in ("map", "variant")]
    inside = Window.partitionBy(src, b).orderBy(h, *ties)
    at = tagged.withColumn(r, F.row_number().over(inside)).alias("x").join(counts.alias("c"), F.col(f"x.{src}").eqNullSafe(F.col(f"c.{src}")) & (F.col(f"x.{b}") == F.col(f"c.{b}")))
    rank = F.col(r) + F.col(before)
    at = at.select(*[F.col(f"x.{c}") for c in (*kept, src, h)], (F.lit(2) * rank - 1).alias(r), (F.lit(2) * F.col(n)).alias(n))
    # fraction r / n compared exactly: the bucket by integer division, inside it the double, then source and hash
    at = at.withColumn(p, F.expr(f"int({r} * {buckets} div {n})")).withColumn(f, F.col(r) / F.col(n))
    placed = materialise(at, "sharding")
    per = placed.groupBy(p).agg(F.count("*").alias(n))
    per = per.select(p, F.coalesce(F.sum(n).over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = Window.partitionBy(p).orderBy(f, src, h, *ties)
    at = placed.drop(n).withColumn(n, F.row_number().over(inside) - 1).join(per, p)
    position = F.col(n) + F.col(before)
    # shard s holds the positions from s * total // shards on
    shard = F.expr(f"(({n} + {before} + 1) * {shards} - 1) div {max(total, 1)}")
    return at.select(*kept, shard.cast("int").alias("shard"), (position - F.expr(f"(((({n} + {before} + 1) * {shards} - 1) div {max(total, 1)}) * {total}) div {shards}")).cast("long").alias("slot"))


def op1_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(rows, ["doc_id"], "source", 16, keep=["doc_id", "source", "size", "text_crc32"])
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
