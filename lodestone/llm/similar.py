"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one. Shingles have one order for all, those known to be common
last. Two sets as similar as that share one of the first ``n - ceil(0.8 n) + 1``
shingles of each, and at the first one they share, sizes and places leave room
for the overlap (prefix and position filters; both lose nothing). Pairs that
pass are compared on whole sets, made again from the texts.

Groups of shingles with few members give all their pairs at once. Larger ones
go in rounds: the pairs of ever more pivots with the members that aren't linked
to them so far, so that a set of near copies costs about its size and all pairs
that aren't linked otherwise are compared.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, light, materialise, tidied
from lodestone.llm.simhash import components

#: Similarity of a link as a fraction; members of a group whose pairs are all given at once; the growth of pivots.
ALIKE = (4, 5)
SMALL_GROUP, PIVOTS = 16, 8
#: Shingles counted at a time, and how many of the commonest are ordered by count. They touch costs, not results.
COUNTED, COMMON = 2 << 20, 500_000


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes, ascending, of UTF-8 ``text``'s word shingles (A-Z lowered); fewer words make one shingle."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    grams = map(b" ".join, zip(*(found[k:] for k in range(size)))) if len(found) >= size else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams), dtype=np.uint64, count=max(1, len(found) - size + 1)))


def _texts(batch):
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        yield i, t.as_buffer().to_pybytes() if t.is_valid else b""


def read(docs: DataFrame, size: int) -> DataFrame:
    """From (id, text): a row (doc_id, set) for each, and rows (token, n) of shingles that several sets have, by block of texts."""
    from xxhash import xxh3_128_digest

    def run(batches):
        held, total, seen = [], 0, set()

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys, n = keys[n > 1].view(np.int64), n[n > 1]
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n)], ["doc_id", "set", "token", "n"])

        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            ids, sets = [], []
            for i, t in _texts(batch):
                s = shingles(t, size)
                name = xxh3_128_digest(s.tobytes())
                ids.append(i)
                sets.append(name)
                if name not in seen:
                    seen.add(name)
                    held.append(s)
                    total += len(s)
                if total >= COUNTED:
                    yield counted()
                    held, total, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())], ["doc_id", "set", "token", "n"])
        if held:
            yield counted()

    return docs.mapInArrow(tidied(run), "doc_id long, set binary, token long, n long")


def prefixes(docs: DataFrame, size: int, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, id, n, place): of each text's shingles the first ones in order. ``keys`` (ascending) with ``counts``: the common ones."""
    common = docs.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches):
        keys, counts = common.value
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            parts = []
            for i, t in _texts(batch):
                s = shingles(t, size)
                n = len(s)
                first = n - -(-ALIKE[0] * n // ALIKE[1]) + 1
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    s = s[np.argsort(np.where(keys[at] == s, counts[at], 0), kind="stable")]
                parts.append((s[:first], np.full(first, i), np.full(first, n, np.int32), np.arange(first, dtype=np.int32)))
            token, i, n, place = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(i), pa.array(n), pa.array(place)], ["token", "id", "n", "place"])

    return docs.mapInArrow(tidied(run), "token long, id long, n int, place int")


def pairs(ids: np.ndarray, n: np.ndarray, place: np.ndarray, linked: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one group, in a fixed order: the pairs of the members ``low`` to ``high`` with later ones that may be similar and aren't linked."""
    one, two = [], []
    for p in range(low, min(high, len(ids) - 1)):
        rest = slice(p + 1, None)
        room = np.minimum(n[p] - place[p], n[rest] - place[rest])
        may = (linked[rest] != linked[p]) & (sum(ALIKE) * room.astype(np.int64) >= ALIKE[0] * (n[rest].astype(np.int64) + n[p]))
        hit = ids[rest][may]
        one.append(np.full(len(hit), ids[p]))
        two.append(hit)
    empty = np.zeros(0, dtype=np.int64)
    one, two = (np.concatenate([empty, *x]) for x in (one, two))
    return np.minimum(one, two), np.maximum(one, two)


def candidates(entries: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b), a < b: pairs of ``entries`` (token, id, n, place, linked) of one token, with a pivot of rank ``low`` to ``high`` where it has many."""

    def run(batches):
        held = None

        def found(cols):
            cuts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1], True])
            out = [np.zeros((2, 0), dtype=np.int64)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x > SMALL_GROUP:
                    out.append(np.stack(pairs(*(c[x:y] for c in cols[1:]), low, high)))
                elif y - x > 1 and not low:
                    out.append(np.stack(pairs(*(c[x:y] for c in cols[1:]), 0, SMALL_GROUP)))
            a, b = np.unique(np.concatenate(out, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(5)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut >= 100_000:
                yield found([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield found(held)

    dealt = entries.select("token", "id", "n", "place", "linked").repartition("token").sortWithinPartitions("token", "id", "n", "place")
    return dealt.mapInArrow(tidied(run), "a long, b long").filter("a <> b").distinct()


def similar(docs: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """Those pairs of ``found`` (a, b) whose whole texts in ``docs`` (id, text) are similar."""

    def run(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, size).tobytes() for _, t in _texts(batch)], pa.binary())], ["id", "hashes"])

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(ALIKE[1] * both >= ALIKE[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = light(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    sets = materialise(docs.join(needed, "id", "left_semi").select("id", "text").mapInArrow(tidied(run), "id long, hashes binary"), "sets")
    x, y = (sets.select(F.col("id").alias(k), F.col("hashes").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return found.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(compare), "a long, b long").distinct()


def near_copies(docs: DataFrame, key: str, text: str, size: int = 5, seeds: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): all rows with an id, each with the smallest id of its linked set.

    ``seeds`` (doc_id, component_id) are sets that another method found. Their
    members are compared with what names them before anything else, and those
    that are similar need no more links. Results don't depend on it.
    ``key`` is an integer. Rows of one id are one document: they link what
    either is linked to. Null texts have no words; texts without words are equal.
    """
    bound_batches(docs.sparkSession)
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    told = materialise(read(rows, size), "told")
    prints = told.filter("doc_id is not null").select("doc_id", "set")
    reps = materialise(prints.groupBy("set").agg(F.min("doc_id").alias("rep")), "reps")
    common = told.filter("doc_id is null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    keys, counts = common["token"].to_numpy().view(np.uint64), common["n"].to_numpy()
    order = np.argsort(keys)
    # copies have no part in what follows: only ids that stand for a set
    named = prints.join(reps, "set")
    copies = light(named.groupBy("doc_id").agg(F.max(F.col("rep") == F.col("doc_id")).alias("own")).filter("not own").select(F.col("doc_id").alias("id")), "copies")
    single = rows.join(copies, "id", "left_anti").select("id", "text")
    entries = materialise(prefixes(single, size, keys[order], counts[order]), "prefixes")

    def known(rows: DataFrame) -> DataFrame:
        """``rows`` with the component that each id is known to be in."""
        sofar = components(edges).select(F.col("node").alias("id"), F.col("component").alias("linked"))
        return rows.join(light(sofar, "linked"), "id", "left").withColumn("linked", F.coalesce("linked", "id"))

    if seeds is None:
        now, edges = entries.withColumn("linked", F.col("id")), None
    else:
        told = seeds.filter("doc_id <> component_id").select(F.col("component_id").cast("long").alias("a"), F.col("doc_id").cast("long").alias("b")).distinct()
        edges = materialise(similar(single, materialise(told.join(reps.select(F.col("rep").alias("b")), "b", "left_semi").select("a", "b"), "pairs"), size), "edges")
        now = known(entries)
    found = similar(single, materialise(candidates(now, 0, 1), "pairs"), size)
    edges = materialise(found if edges is None else edges.unionByName(found), "edges")
    sizes = entries.groupBy("token").agg(F.count("*").alias("members")).filter(F.col("members") > SMALL_GROUP)
    sizes = light(sizes, "large")
    most = sizes.agg(F.coalesce(F.max("members"), F.lit(0))).first()[0]
    if most:
        large = materialise(entries.join(sizes.select("token"), "token", "left_semi"), "large-groups")
        low = 1
        while low < most:
            found = materialise(candidates(known(large), low, low * PIVOTS), "pairs")
            if not found.isEmpty():
                edges = materialise(edges.unionByName(similar(single, found, size)), "edges")
            low *= PIVOTS
    # ids that stand for one set and have another: ties between what stands for each
    many = prints.groupBy("doc_id").agg(F.min("set").alias("x"), F.max("set").alias("y")).filter("x <> y").select("doc_id")
    ties = named.join(many, "doc_id").filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    linked = components(edges.unionByName(ties))
    classes = materialise(reps.join(linked, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("component", "rep").alias("component_id")), "classes")
    return prints.join(classes, "set").select("doc_id", "component_id")
