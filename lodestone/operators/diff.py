"""Differences between versions of tables, schemas and ledgers, and fusion of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.trust import verify


def schema_diff(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """(table, column, change, left_type, right_type): tables and columns of one side, and changed types."""
    spark = next(iter([*left.values(), *right.values()])).sparkSession
    rows = []
    for t in sorted({*left, *right}):
        if t not in left or t not in right:
            rows.append((t, None, "left_only" if t in left else "right_only", None, None))
            continue
        a, b = ({f.name: f.dataType.simpleString() for f in side[t].schema} for side in (left, right))
        for c in sorted({*a, *b}):
            if a.get(c) != b.get(c):
                rows.append((t, c, "left_only" if c not in b else "right_only" if c not in a else "type_changed", a.get(c), b.get(c)))
    return spark.createDataFrame(rows, "table string, column string, change string, left_type string, right_type string")


def table_changes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, change): matching, modified, left_only or right_only; rows are compared whole, NULLs alike."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    pack = lambda df, n: df.select(key, F.struct(*shared).alias(n), F.lit(1).alias(f"{n}_in")) if shared else df.select(key, F.lit(0).alias(n), F.lit(1).alias(f"{n}_in"))
    both = pack(left, "l").join(pack(right, "r"), key, "full")
    change = F.when(F.col("r_in").isNull(), "left_only").when(F.col("l_in").isNull(), "right_only").when(F.col("l").eqNullSafe(F.col("r")), "matching").otherwise("modified")
    return both.select(key, change.alias("change"))


def table_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row with the number of rows of each kind of change."""
    n = lambda kind: F.count(F.when(F.col("change") == kind, 1)).alias(kind)
    return table_changes(left, right, key).agg(n("matching"), n("modified"), n("left_only"), n("right_only"))


def ledger_diff(left: DataFrame, right: DataFrame, seq: str = "seq", digest: str = "payload_hash") -> DataFrame:
    """(common, diverges_at, left_only, right_only): the common prefix of two ledgers and what follows it."""
    a = left.select(F.col(seq).alias("s"), F.col(digest).alias("a"))
    b = right.select(F.col(seq).alias("s"), F.col(digest).alias("b"))
    both = a.join(b, "s", "full")
    first = both.agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("s"))).alias("diverges_at"))
    n = lambda c, name: F.count(F.when(F.col(c).isNotNull() & (F.col("s") >= F.col("diverges_at")), 1)).alias(name)
    # one row; where nothing diverges every sequence number is common
    return both.crossJoin(F.broadcast(first)).groupBy("diverges_at").agg(F.count(F.when(F.col("diverges_at").isNull() | (F.col("s") < F.col("diverges_at")), 1)).alias("common"), n("a", "left_only"), n("b", "right_only")).select("common", "diverges_at", "left_only", "right_only")


def fuse(sources: dict[str, DataFrame], max_rows: int | None = None, alias: str = "source") -> DataFrame:
    """All sources' rows with the name of theirs; missing columns are NULL; ``max_rows`` holds for each source."""
    parts = [(df if max_rows is None else df.limit(max_rows)).withColumn(alias, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def discover(arcs: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """(table, sources, columns): the tables of all sources and who has them."""
    spark = next(df for tables in arcs.values() for df in tables.values()).sparkSession
    rows = [(a, t, len(df.columns)) for a, tables in arcs.items() for t, df in tables.items()]
    found = spark.createDataFrame(rows, "source string, table string, columns int")
    return found.groupBy("table").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"), F.max("columns").alias("columns"))


def fused_query(arcs: dict[str, dict[str, DataFrame]], table: str, max_rows: int | None = None) -> DataFrame:
    """The table over all sources that have it."""
    return fuse({a: tables[table] for a, tables in arcs.items() if table in tables}, max_rows)


def validate(ledger: DataFrame, agents: DataFrame, anchors: DataFrame) -> DataFrame:
    """(agent_id, trusted, chain_ok): signers against the trusted anchors (agent_id, public_key), and whether the ledger's chain holds."""
    known = anchors.select("agent_id", "public_key", F.lit(True).alias("trusted")).distinct()
    chain = verify(ledger).select(F.col("valid").alias("chain_ok"))  # one row
    out = agents.join(known, ["agent_id", "public_key"], "left").select("agent_id", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return out.crossJoin(F.broadcast(chain))


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
