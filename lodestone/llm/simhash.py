"""SimHash near-duplicate detection with sharded vantage-point trees.

Fingerprints of 64 bits link at ``radius`` differing bits or fewer. Two trees
partition the distinct fingerprints by Hamming distance, one over each half of
the bits, because two linked fingerprints differ by ``radius // 2`` bits at
most in one half. A tree's levels have vantage points, fingerprints of the data, each
seen through a mask of its own in that half. Distances on disjoint masks add up, so by the triangle inequality the
distance vectors of two fingerprints linked in that half differ by
``radius // 2`` in sum at most: with 3 bits, by one step at one level or not at
all. A leaf is a distance vector. Every fingerprint has one home leaf and is
also sent over the boundaries it may be linked across, upwards only, as the
other one of the pair is at home there. All other branches are pruned.

Inside a leaf each home fingerprint is compared exactly with all that are
there. A leaf gives a star for each of its linked sets rather than all pairs;
connected components over the stars follow with large-star and small-star
rounds, in tables on the shared folder.
"""

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, discard, free_name, light, materialise, table, tidied

#: Groups of up to this size are compared by offset, larger ones by flooding.
SMALL_GROUP = 96


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of UTF-8 ``text``: A-Z lowered, word shingles, XXH64, majority of each bit.

    Repeated shingles count each time; fewer words than ``size`` make one
    shingle; no words give zero.
    """
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return 0
    if len(found) < size:
        return xxh64_intdigest(b" ".join(found), seed)
    grams = map(b" ".join, zip(*(found[k:] for k in range(size))))
    n = len(found) - size + 1
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row's whole text; null texts have no words."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidied(run), f"doc_id {kind}, fp long")


def mask_bits(fingerprints_in_all: int) -> int:
    """Bits of a level's mask: fewer, and so more levels, for more fingerprints. Leaves stay small; results don't change."""
    return 4 if fingerprints_in_all < 50_000_000 else 2


def vantage_points(prints: DataFrame, bits: int) -> int:
    """The bits of all levels' vantage points: each level looks through its mask at a fingerprint of its own from ``prints`` (fp)."""
    levels = 64 // bits
    found = [r["fp"] for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(levels).collect()] or [0]
    seen = 0
    for k in range(levels):
        seen |= found[k % len(found)] & (((1 << bits) - 1) << (k * bits))
    return seen


def routed(fps: np.ndarray, bits: int, vantage: int = 0):
    """Rows (leaf uint64, at home, position in ``fps``) of both trees, for radius 2 or 3."""
    leaves, home, where = [], [], []
    levels = 32 // bits
    base = bits + 1
    for half in range(2):
        away = ((fps ^ np.uint64(vantage)) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        code = np.full(len(fps), half, dtype=np.uint64)
        steps = []
        for level in range(levels):
            d = np.bitwise_count((away >> np.uint64(level * bits)) & np.uint64((1 << bits) - 1)).astype(np.uint64)
            steps.append((d, np.uint64((2 * base**level) % 2**64)))
            code = code + d * steps[-1][1]
        leaves.append(code)
        home.append(np.ones(len(fps), dtype=bool))
        where.append(np.arange(len(fps)))
        for d, weight in steps:
            over = np.flatnonzero(d < bits)
            leaves.append(code[over] + weight)
            home.append(np.zeros(len(over), dtype=bool))
            where.append(over)
    return np.concatenate(leaves), np.concatenate(home), np.concatenate(where)


class Sets:
    """Union-find over positions; the root is the smallest position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                return r
            r = s


def flood(fps: np.ndarray, home: np.ndarray, radius: int):
    """Linked pairs that span the linked sets of one large leaf: breadth first, each member visited once.

    Members already reached are not compared again, so that a set of near
    copies costs about its size, not its square.
    """
    left_home, left_away = np.flatnonzero(home), np.flatnonzero(~home)
    one, two = [], []
    while len(left_home):
        front = left_home[:1]
        left_home = left_home[1:]
        start = front[0]
        while len(front):
            now, front = front[:64], front[64:]
            from_home = now[home[now]]
            near = _near(fps, now, left_home, radius)
            reached = [left_home[near]]
            left_home = left_home[~near]
            if len(from_home) and len(left_away):
                near = _near(fps, from_home, left_away, radius)
                reached.append(left_away[near])
                left_away = left_away[~near]
            new = np.concatenate(reached)
            if len(new):
                one.append(np.full(len(new), start))
                two.append(new)
                front = np.concatenate([front, new])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(one), np.concatenate(two)) if one else (empty, empty)


def _near(fps: np.ndarray, some: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    out = np.zeros(len(others), dtype=bool)
    for at in range(0, len(others), 1 << 15):
        part = fps[others[at : at + (1 << 15)]]
        for x in fps[some]:
            out[at : at + (1 << 15)] |= np.bitwise_count(part ^ x) <= radius
    return out


def stars(leaf: np.ndarray, home: np.ndarray, fps: np.ndarray, reps: np.ndarray, radius: int):
    """(smallest rep, other rep) of the linked sets of whole leaves, given sorted by leaf with those at home first."""
    n = len(leaf)
    sets = Sets(n)
    first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    sizes = np.diff(np.r_[first, n])
    big = sizes > SMALL_GROUP
    for a, m in zip(first[big], sizes[big]):
        x, y = flood(fps[a : a + m], home[a : a + m], radius)
        sets.union(x + a, y + a)
    left = np.repeat(np.where(big, 0, sizes), sizes) - (np.arange(n) - np.repeat(first, sizes)) - 1  # members after this one
    at = np.flatnonzero(home & (left > 0))
    for k in range(1, SMALL_GROUP):
        at = at[left[at] >= k]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + k]) <= radius]
        sets.union(hit, hit + k)
    root = sets.roots(np.arange(n))
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, root, reps)
    a, b = low[root], reps
    links = np.stack([a, b])[:, a != b]
    return np.unique(links, axis=1)


def linked(reps: DataFrame, radius: int, bits: int) -> DataFrame:
    """(a, b) long, a < b: stars over the linked fingerprints of ``reps`` (fp, rep)."""
    if radius not in (2, 3):
        raise ValueError("the trees prune for a radius of 2 or 3")

    vantage = vantage_points(reps, bits)

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                fps, rep = (batch.column(k).slice(at, 50_000).to_numpy() for k in range(2))
                leaf, home, where = routed(fps.view(np.uint64), bits, vantage)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), pa.array(~home), pa.array(fps[where]), pa.array(rep[where])], ["leaf", "away", "fp", "rep"])

    def link(batches):
        held = None
        out = []
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut >= 200_000:
                out.append(stars(held[0][:cut], ~held[1][:cut].astype(bool), held[2][:cut].view(np.uint64), held[3][:cut], radius))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            out.append(stars(held[0], ~held[1].astype(bool), held[2].view(np.uint64), held[3], radius))
        if out:
            a, b = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    spread = reps.select("fp", "rep").mapInArrow(tidied(route), "leaf long, away boolean, fp long, rep long")
    return spread.repartition("leaf").sortWithinPartitions("leaf", "away").mapInArrow(tidied(link), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for nodes that have one and aren't it.

    Alternates large-star and small-star until the edges stay as they are.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen


def near_duplicates(docs: DataFrame, key: str, text: str, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): all rows, each with the smallest id of its linked set.

    Rows of one id are one document: they link what either is linked to. Rows
    with a null id are named by the component of their fingerprint (null if all
    that have it have no id) and link nothing. Ids may be of any type that has
    an order. Texts without words share the fingerprint zero. Other columns are
    ignored; an empty table gives an empty one.
    """
    prints = materialise(fingerprints(docs, key, text, size), "fingerprints")
    reps = materialise(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    # links and their components are between fingerprints; names come last
    edges = linked(reps.select("fp", F.col("fp").alias("rep")), radius, mask_bits(reps.count()))
    # rows of one id with several fingerprints tie those together
    many = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("doc_id", "a")
    ties = prints.join(many, "doc_id").select("a", F.col("fp").alias("b")).distinct()
    found = components(edges.unionByName(ties))
    sets = reps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("set"))
    names = sets.groupBy("set").agg(F.min("rep").alias("component_id"))
    classes = materialise(sets.join(names, "set").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, key: str, text: str, size: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each linked set: the one with the smallest id, once. Rows with a null id stay."""
    return one_of_each(docs, key, text, near_duplicates(docs, key, text, size, radius).filter("doc_id is not null"))


def one_of_each(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``found`` (doc_id, component_id), the one it is named by; null ids stay."""
    k, n = free_name(docs, "key"), free_name(docs, "row")
    gone = light(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(k)).distinct(), "gone")
    out = docs.join(gone, docs[key] == gone[k], "left_anti")
    # rows of one id that stay: seldom any, so the texts are not shuffled for them
    again = light(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(k)).agg(F.count("*").alias(n)).filter(F.col(n) > 1).select(k), "again")
    if again.isEmpty():
        return out
    several = out.join(again, out[key] == again[k], "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(text))).filter(F.col(n) == 1).drop(n)
    return out.join(again, out[key] == again[k], "left_anti").unionByName(several)


def op4_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, "doc_id", "text")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
