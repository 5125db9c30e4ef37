"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer numpy network.

Tokens are runs of letters, of digits or of one kind of other characters, A-Z
lowered, hashed to buckets. Every bucket has a sparse random index vector; its
context vector sums the index vectors of the tokens next to it over the whole
corpus. A document is the weighted mean of its tokens' vectors (rare tokens
weigh more), with a few shares that repetition and length show in. The network
learns from labelled rows; its temperature comes from labelled rows it has not
learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, free_name, materialise, table, tidied

BUCKETS, DIMS, NONZERO = 1 << 13, 32, 4
#: Labelled rows that the network learns from at most: those with the smallest hashes.
MAX_LEARNT = 40_000
EXTRA = 5
CHUNK_BYTES = 4 << 20


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's nonzero entries."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def _kinds() -> np.ndarray:
    """0 blank, 1 letters and non-ASCII, 2 digits, from 3 on: each other ASCII character for itself."""
    out = np.arange(256, dtype=np.int16) + 3
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[65:91] = 1
    out[97:123] = 1
    out[128:] = 1
    out[48:58] = 2
    return out


def tokenise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and lengths in bytes of all tokens, and each text's number of tokens."""
    raw = np.frombuffer(b"\n".join([x.lower() for x in texts]) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    kind = _kinds()[raw]
    first = np.flatnonzero((kind != np.r_[np.int16(0), kind[:-1]]) & (kind != 0))
    last = np.flatnonzero((kind != np.r_[kind[1:], np.int16(0)]) & (kind != 0))
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    size = last - first + 1
    # a byte's share of its token's hash depends on its distance from the token's start
    place = np.arange(len(raw)) - np.repeat(np.r_[0, first], np.diff(np.r_[0, first, len(raw)]))
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93))
    mixed ^= mixed >> np.uint64(29)
    mixed[kind == 0] = 0
    total = np.add.reduceat(mixed, first) * np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    bucket = ((total * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - 13)).astype(np.int64)
    counts = np.diff(np.r_[0, np.searchsorted(first, ends)])
    return bucket, size, counts


def _parts(texts: list[bytes]):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """Each bucket's vector, already weighted, from the whole corpus: (BUCKETS, DIMS) float32, 1 MB."""

    def run(batches):
        where, sign = index_vectors()
        total, seen = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS)
        for batch in batches:
            for part in _parts(_texts(batch.column(0))):
                bucket, _, counts = tokenise(part)
                seen += np.bincount(bucket, minlength=BUCKETS)
                inside = np.ones(len(bucket), dtype=bool)  # has a left neighbour in the same text
                starts = np.cumsum(counts) - counts
                inside[starts[counts > 0]] = False
                at = np.flatnonzero(inside)
                for a, b in ((bucket[at], bucket[at - 1]), (bucket[at - 1], bucket[at])):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIMS + where[b, k], weights=sign[b, k], minlength=BUCKETS * DIMS)
        rows = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(np.c_[total.reshape(BUCKETS, DIMS), seen][rows]), pa.list_(pa.float64()))], ["bucket", "v"])

    parts = docs.select(text).mapInArrow(tidied(run), "bucket long, v array<double>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(DIMS + 1)]).toArrow()  # BUCKETS rows at most
    full = np.zeros((BUCKETS, DIMS + 1))
    full[sums["bucket"].to_numpy()] = np.stack([sums[f"v{k}"].to_numpy() for k in range(DIMS + 1)], axis=1) if sums.num_rows else 0
    context, seen = full[:, :DIMS], full[:, DIMS]
    where, sign = index_vectors()
    own = np.zeros((BUCKETS, DIMS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], where), sign)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    share = seen / max(seen.sum(), 1.0)
    return ((unit(context) + unit(own)) * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """(texts, DIMS + EXTRA) float32: mean token vectors and shares of a document."""
    out = []
    for part in _parts(texts):
        bucket, size, counts = tokenise(part)
        rows = np.zeros((len(part), DIMS + EXTRA), dtype=np.float32)
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            n = counts[some]
            rows[some, :DIMS] = np.add.reduceat(vectors[bucket], starts, axis=0) / n[:, None]
            doc = np.repeat(np.arange(len(some)), n)
            mean_size = np.add.reduceat(size, starts) / n
            distinct = np.bincount(np.unique(doc * BUCKETS + bucket) // BUCKETS, minlength=len(some)) / n
            # a run of four equal to one before it in the same text: repeated lines and passages; four buckets are 52 bits
            run = np.zeros(max(0, len(bucket) - 3), dtype=np.int64)
            for k in range(4):
                run = run * BUCKETS + bucket[k : len(bucket) - 3 + k]
            inside = np.flatnonzero(doc[3:] == doc[: len(run)])
            run, of = run[inside], doc[inside]
            order = np.lexsort((run, of))
            again = np.r_[False, (run[order][1:] == run[order][:-1]) & (of[order][1:] == of[order][:-1])][: len(order)]
            repeated = np.bincount(of[order][again], minlength=len(some)) / n
            rows[some, DIMS:] = np.stack([np.log(n) / 10, mean_size / 10, distinct, repeated, np.log(n) / np.sqrt(n)], axis=1)
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, DIMS + EXTRA), np.float32)


class Network:
    """Two layers, trained by Adam on weighted cross-entropy; ``scale`` divides the logit by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.std = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(DIMS + EXTRA), np.ones(DIMS + EXTRA))
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.scale = 1.0
        if not len(x) or y.min() == y.max():  # nothing to tell apart: the share of good rows everywhere
            self.w[2][:] = 0.0
            share = (y.sum() + 1.0) / (len(y) + 2.0)
            self.w[3][:] = np.log(share / (1 - share))
            return
        calibrate = rng.random(len(x)) < 0.2
        if calibrate.all() or not calibrate.any():
            calibrate = np.arange(len(x)) % 5 == 0
        a, b = self._scaled(x[~calibrate]), y[~calibrate]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(a))
            for at in range(0, len(a), 256):
                xs, ys = a[order[at : at + 256]], b[order[at : at + 256]]
                h = np.tanh(xs @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - ys) / len(xs)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [xs.T @ dh + 1e-4 * self.w[0], dh.sum(axis=0), h.T @ d + 1e-4 * self.w[2], np.array([d.sum()])]
                step += 1
                rate = 0.01 * (1 - 0.9 * epoch / epochs)
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        z, t = self._logit(x[calibrate]), y[calibrate]
        tried = np.exp(np.linspace(np.log(0.05), np.log(5), 200))
        loss = [np.mean(np.logaddexp(0, s * z) - t * s * z) for s in tried]
        self.scale = float(tried[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self._logit(x), -500, 500)))


def score_quality(docs: DataFrame, labels: DataFrame, key: str, text: str, held: Column, label: str = "quality", max_learnt: int = MAX_LEARNT) -> DataFrame:
    """(doc_id, held_out, score): for every row the probability that its label is 1; only the text enters a score.

    Rows that ``held`` marks teach nothing (null: they may teach). Of the
    others with one label, those ``max_learnt`` with the smallest hashes of the
    key do; vectors come from all rows. Null texts are empty; equal texts
    score alike whatever stands beside them; contradicting labels teach nothing; without labels all score 0.5.
    """
    bound_batches(docs.sparkSession)
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text))

    def run(batches):
        for batch in batches:
            rows = pool(_texts(batch.column(2)), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(rows), pa.list_(pa.float32()))], ["doc_id", "held_out", "v"])

    kind = docs.schema[key].dataType.simpleString()
    pooled = docs.select(F.col(key).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col(text).alias(free_name(docs, "text"))).mapInArrow(tidied(run), f"doc_id {kind}, held_out boolean, v array<float>")
    pooled = materialise(pooled, "pooled")
    marks = labels.groupBy(F.col(key).alias("doc_id")).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo = hi").select("doc_id", F.col("lo").cast("double").alias("y"))
    taught = pooled.filter("not held_out").join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "v").limit(max_learnt).select("v", "y").toArrow()
    x = np.array(taught["v"].to_pylist(), dtype=np.float64).reshape(-1, DIMS + EXTRA)
    network = Network(x, taught["y"].to_numpy())

    def apply(batches):
        for batch in batches:
            rows = batch.column(2).values.to_numpy().reshape(-1, DIMS + EXTRA) if batch.num_rows else np.zeros((0, DIMS + EXTRA))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(network.predict(rows.astype(np.float64)))], ["doc_id", "held_out", "score"])

    return pooled.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double")


def op7_quality_classifier(spark, sf_dir):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), "doc_id", "text", held)
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
