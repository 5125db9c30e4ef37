"""Vector and hybrid search: exact top-k, radius, reranking, an inverted-file index and reciprocal rank fusion."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.durable import cut
from lodestone.functions.scalars import as_vector, cosine_distance, dot, euclidean, text_score

COSINE, EUCLIDEAN, DOT = "cosine", "euclidean", "dot"


def distance(metric: str, a: Column, b: Column) -> Column:
    return {COSINE: cosine_distance, EUCLIDEAN: euclidean, DOT: dot}[metric](a, b)


@dataclass(frozen=True)
class VectorSearch:
    """Searches over a table with a key and an ``array<float>`` column. Smaller is nearer, but for dot products larger."""

    df: DataFrame
    key: str
    vector: str
    metric: str = COSINE
    condition: Column | None = None

    def where(self, condition: Column) -> VectorSearch:
        return VectorSearch(self.df, self.key, self.vector, self.metric, condition if self.condition is None else self.condition & condition)

    def _scored(self, query: list[float], check: bool = True) -> DataFrame:
        df = self.df if self.condition is None else self.df.filter(self.condition)
        v = F.col(self.vector)
        scored = df.filter(v.isNotNull())
        if check:  # a vector of another dimension is an error
            d = distance(self.metric, v, as_vector(query))
            d = F.when(F.size(v) == len(query), d).otherwise(F.raise_error(F.lit(f"a stored vector does not have {len(query)} dimensions")).cast("double"))
        else:
            d = distance(self.metric, v, as_vector(query))
        return scored.withColumn("distance", d)

    @property
    def _order(self) -> list[Column]:
        return [F.desc("distance") if self.metric == DOT else F.asc("distance"), F.asc(self.key)]

    def nearest(self, query: list[float], k: int, *columns: str) -> DataFrame:
        """The exact ``k`` nearest, ties by key; each task keeps its own k."""
        out = self._scored(query).orderBy(*self._order).limit(k)
        return out.select(self.key, "distance", *columns)

    def within(self, query: list[float], limit: float, *columns: str) -> DataFrame:
        """All within that distance (for dot products: of that product or more)."""
        near = F.col("distance") >= limit if self.metric == DOT else F.col("distance") <= limit
        return self._scored(query).filter(near).select(self.key, "distance", *columns)

    def rerank(self, query: list[float], k: int, scorer: Column, oversample: int = 4, *columns: str) -> DataFrame:
        """The ``k`` with the lowest ``scorer`` among the ``k * oversample`` nearest."""
        near = self._scored(query).orderBy(*self._order).limit(k * oversample)
        return near.withColumn("score", scorer).orderBy(F.asc("score"), F.asc(self.key)).limit(k).select(self.key, "distance", "score", *columns)

    def enrich(self, hits: DataFrame, source: DataFrame) -> DataFrame:
        """The rows of ``source`` for hits, which are k at most."""
        return source.join(hits, self.key)


def batch_nearest(queries: DataFrame, df: DataFrame, key: str, vector: str, k: int, metric: str = COSINE, block: int = 256) -> DataFrame:
    """(query, key, distance, rank): the exact ``k`` nearest rows for each row of ``queries`` (key, vector).

    The queries, a stated set, go to the tasks in blocks of bounded size; each
    task gives its own k nearest a query, and those meet by query.
    """
    spark = df.sparkSession
    blocks, held = [], []
    for r in queries.select(key, vector).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            blocks.append(spark.sparkContext.broadcast(held))
            held = []
    if held:
        blocks.append(spark.sparkContext.broadcast(held))

    def measure(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if metric == DOT:
            return -(q @ x.T)
        if metric == COSINE:
            return 1 - (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None], 1e-300)
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))

    def run(batches):
        best: dict = {}
        for pdf in batches:
            pdf = pdf[pdf[vector].notna()]
            if not len(pdf):
                continue
            x, keys = np.stack(pdf[vector].to_numpy()).astype(np.float64), pdf[key].to_numpy()
            for b in blocks:
                d = measure(np.array([v for _, v in b.value], dtype=np.float64), x)
                for (q, _), row in zip(b.value, d):
                    at = np.lexsort((keys, row))[:k]
                    best[q] = sorted([*best.get(q, []), *zip(row[at].tolist(), keys[at].tolist())])[:k]
        yield pd.DataFrame([(q, i, d) for q, found in best.items() for d, i in found], columns=["query", "key", "distance"])

    kind = df.schema[key].dataType.simpleString()
    local = df.select(key, vector).mapInPandas(run, f"query {kind}, key {kind}, distance double")
    w = Window.partitionBy("query").orderBy("distance", "key")
    ranked = local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumn("distance", -F.col("distance")) if metric == DOT else ranked


@dataclass(frozen=True)
class InvertedFile:
    """An approximate index: every row stored by its nearest centroid; a query reads the ``probes`` nearest cells.

    Centroids come from a bounded sample (``SAMPLE`` rows with the smallest key
    hashes); all rows are indexed. There are as many cells as the square root
    of the rows, ``SAMPLE`` / 10 at most, and as many probes as the sample's
    own neighbours need for a recall of ``RECALL``. Rows are added or deleted
    by writing their cells anew.
    """

    cells: DataFrame
    centroids: np.ndarray
    key: str
    vector: str
    probes: int = 6
    SAMPLE = 20_000
    RECALL = 0.97
    #: Bytes of query vectors, once for every probe, up to which they go to all tasks; more meet the cells by a shuffle.
    BROADCAST_BYTES = 64 << 20

    @staticmethod
    def build(df: DataFrame, key: str, vector: str, cells: int | None = None, rounds: int = 12, seed: int = 7) -> InvertedFile:
        rows = df.filter(F.col(vector).isNotNull()).select(key, vector)
        sample = rows.withColumn("_h", F.xxhash64(F.lit(seed), key)).orderBy("_h", key).limit(InvertedFile.SAMPLE).select(vector).toPandas()[vector]
        if cells is None:
            cells = max(1, min(math.isqrt(rows.count()), InvertedFile.SAMPLE // 10))
        x = np.stack(sample.to_numpy()).astype(np.float64) if len(sample) else np.zeros((1, 1))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            at = (x @ c.T).argmax(axis=1)
            order = np.argsort(at, kind="stable")
            used, first = np.unique(at[order], return_index=True)
            m = np.add.reduceat(x[order], first)
            c[used] = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        probes = InvertedFile._needed(x, c, x[rng.choice(len(x), min(200, len(x)), replace=False)])
        return InvertedFile(cut(InvertedFile._assign(rows, key, vector, c, 1), "cells"), c, key, vector, probes)

    @staticmethod
    def _needed(x: np.ndarray, c: np.ndarray, asked: np.ndarray, k: int = 10) -> int:
        """The probes with which the sample finds ``RECALL`` of the ``k`` nearest of some of its own rows."""
        k = min(k + 1, len(x))
        near = np.argpartition(-(asked @ x.T), k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)  # of each cell, for each row asked
        at = np.sort(np.take_along_axis(place, (x @ c.T).argmax(axis=1)[near], axis=1).ravel())
        return int(at[min(len(at) - 1, math.ceil(InvertedFile.RECALL * len(at)) - 1)]) + 1

    def save(self, path: str) -> None:
        """Write the index as three tables: cells, sorted by cell, centroids and settings."""
        spark = self.cells.sparkSession
        self.cells.sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(self.centroids)], "cell long, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        spark.createDataFrame([(self.key, self.vector, self.probes)], "key string, vector string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedFile:
        found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # SAMPLE / 10 rows at most by default
        s = spark.read.parquet(f"{path}/settings").first()
        return InvertedFile(spark.read.parquet(f"{path}/cells"), np.array([r["centroid"] for r in found]), s["key"], s["vector"], s["probes"])

    def merge(self, other: InvertedFile) -> InvertedFile:
        """This index with the rows of another one, which win where both have a key."""
        return self.upsert(other.cells.select(F.col(other.key).alias(self.key), F.col(other.vector).alias(self.vector)))

    @staticmethod
    def _assign(rows: DataFrame, key: str, vector: str, c: np.ndarray, probes: int) -> DataFrame:
        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                near = np.argsort(-(x @ c.T), axis=1)[:, :probes]
                yield pd.DataFrame({"cell": near.ravel(), key: np.repeat(pdf[key].to_numpy(), near.shape[1]), vector: [v for v in pdf[vector] for _ in range(near.shape[1])]})

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, vector).mapInPandas(run, f"cell long, `{key}` {kind}, `{vector}` array<float>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query, key, distance, rank) by cosine distance for rows (key, vector) of ``queries``."""
        probes = min(probes or self.probes, len(self.centroids))
        asked = self._assign(queries.filter(F.col(self.vector).isNotNull()), self.key, self.vector, self.centroids, probes).select("cell", F.col(self.key).alias("query"), F.col(self.vector).alias("_q"))
        if queries.count() * probes * self.centroids.shape[1] * 8 <= self.BROADCAST_BYTES:
            asked = F.broadcast(asked)
        found = self.cells.join(asked, "cell").select("query", F.col(self.key).alias("key"), cosine_distance(F.col(self.vector), F.col("_q")).alias("distance"))
        w = Window.partitionBy("query").orderBy("distance", "key")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def upsert(self, rows: DataFrame) -> InvertedFile:
        new = self._assign(rows, self.key, self.vector, self.centroids, 1)
        kept = self.cells.join(rows.select(self.key), self.key, "left_anti").select("cell", self.key, self.vector)
        return replace(self, cells=cut(kept.unionByName(new), "cells"))

    def delete(self, condition: Column) -> InvertedFile:
        return replace(self, cells=cut(self.cells.filter(~F.coalesce(condition, F.lit(False))), "cells"))


def hybrid(df: DataFrame, key: str, vector: str, text: str, query: list[float], terms: list[str], k: int, metric: str = COSINE, constant: int = 60) -> DataFrame:
    """(key, score, vector_rank, text_rank): the ``k`` best by reciprocal rank fusion of the 3k best by vector and by text.

    A rank that a row does not have counts as 0. Ties go by vector rank, text rank (none last) and key.
    """
    top = 3 * k
    by_vector = VectorSearch(df, key, vector, metric).nearest(query, top)
    w = Window.orderBy(F.desc("distance") if metric == DOT else F.asc("distance"), key)  # over 3k rows
    by_vector = by_vector.select(key, F.row_number().over(w).alias("vector_rank"))
    by_text = df.select(key, text_score(F.col(text), terms).alias("_s")).filter("_s > 0").orderBy(F.desc("_s"), key).limit(top)
    by_text = by_text.select(key, F.row_number().over(Window.orderBy(F.desc("_s"), key)).alias("text_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + constant), F.lit(0.0))
    both = by_vector.join(by_text, key, "full").withColumn("score", part("vector_rank") + part("text_rank"))
    best = both.orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank"), key).limit(k)
    return best.select(key, "score", F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.coalesce("text_rank", F.lit(0)).alias("text_rank"))
