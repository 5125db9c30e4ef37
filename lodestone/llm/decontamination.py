"""Benchmark decontamination with suffix arrays of the training texts.

The training words of a task become shards of some hundred thousand words. Each
shard gets a suffix array over its words (prefix doubling), in which every
benchmark suffix is binary-searched; the range it ends at holds all places of
the verbatim match. Matches on one diagonal join to the longest verbatim match
at that place. The benchmark goes to the tasks in blocks of bounded size, each
looked up against every shard, so neither side has to fit in memory whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.common import bound_batches, free_name, table, tidied

#: Words in a suffix array; a longer document makes a larger shard of its own.
SHARD_WORDS = 400_000
#: Bytes of benchmark text in a block; a longer item makes a larger block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes between words (all but 0-9, A-Z, a-z and those of non-ASCII characters); A-Z go to a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_list(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Block:
    """Benchmark items as numbered words, with their distinct windows.

    A window is ``width`` consecutive words; an item of fewer words, but not
    none, is one window.
    """

    def __init__(self, items: list[tuple[object, bytes]], width: int):
        number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], int] = {}
        found = []  # (window, item, place among all items' words, place in the item)
        first = 0
        for k, (_, text) in enumerate(items):
            ids = [number.setdefault(w, len(number)) for w in word_list(text)]
            for j in range(max(1, len(ids) - width + 1)):
                if window := tuple(ids[j : j + width]):
                    found.append((windows.setdefault(window, len(windows)), k, first + j, j))
            first += len(ids) + 1
        self.names = [i for i, _ in items]
        self.vocabulary = list(number)
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.words = np.full((len(windows), width), -1, dtype=np.int64)
        for k, w in enumerate(windows):
            self.words[k, : len(w)] = w
        rows = np.array(found, dtype=np.int64).reshape(-1, 4)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        self.item, self.place, self.start = rows[:, 1], rows[:, 2], rows[:, 3]
        #: the occurrences of window q are rows first[q] to first[q + 1]
        self.first = np.searchsorted(rows[:, 0], np.arange(len(windows) + 1))

    def within(self, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """The windows all of whose words ``number`` has, and their words by its numbers (0 beyond a window's end)."""
        to = np.array([*(number.get(w, -1) for w in self.vocabulary), 0], dtype=np.int64)
        words = to[self.words]
        has = np.flatnonzero((words >= 0).all(axis=1))
        return has, words[has]


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions with a token above 0, sorted by the ``depth`` tokens from there on (prefix doubling); 0 ends every match."""
    n = len(tokens)
    places = np.flatnonzero(tokens)
    rank = np.zeros(n + depth, dtype=np.int64)
    rank[:n] = tokens
    have, order = 1, np.arange(len(places))
    while True:
        step = min(have, depth - have) if have < depth else 0
        key = rank[places] * (int(rank.max()) + 1) + rank[places + step] if step else rank[places]
        order = np.argsort(key, kind="quicksort" if step else "stable")
        if have + step >= depth:
            return places[order]
        ranked = key[order]
        new = np.zeros(n + depth, dtype=np.int64)
        new[places[order]] = np.cumsum(np.r_[1, ranked[1:] != ranked[:-1]]) if len(ranked) else 0
        rank = new
        have += step


def search(tokens: np.ndarray, array: np.ndarray, words: np.ndarray, lengths: np.ndarray):
    """For each query (its first ``lengths`` of ``words``) the range of ``array`` whose suffixes begin with it."""
    depth = words.shape[1]
    padded = np.r_[tokens, np.zeros(depth, dtype=tokens.dtype)]
    spread = np.arange(depth)
    used = spread[None, :] < lengths[:, None]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(array), dtype=np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            at = array[np.minimum(mid, len(array) - 1)]
            differ = np.where(used, padded[at[:, None] + spread].astype(np.int64) - words, 0)
            first = (differ != 0).argmax(axis=1)
            sign = differ[np.arange(len(words)), first]
            right = open_ & ((sign < 0) | (upper & (sign == 0)))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)

    if not len(array) or not len(words):
        return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    return bound(False), bound(True)


def _shards(texts):
    """(first document, word lists) of consecutive documents with SHARD_WORDS words together."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        found = word_list(t)
        held.append(found)
        size += len(found)
        if size >= SHARD_WORDS:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _longest(places: np.ndarray, windows: np.ndarray, block: Block, width: int):
    """(first word, length, row of the item's last window) of the longest verbatim match that ends with each hit.

    ``places`` ascend, each with the window that occurs there. Hits one word
    apart in the text and in an item are one match. A shorter item matches as a
    whole, so one of those with equal text will do.
    """
    short = block.lengths[windows] < width
    for p, q in zip(places[short].tolist(), windows[short].tolist()):
        yield p, int(block.lengths[q]), int(block.first[q])
    before, begun, last = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), -2
    for p, q in zip(places[~short].tolist(), windows[~short].tolist()):
        here = block.place[block.first[q] : block.first[q + 1]]
        begin = np.full(len(here), p)
        if p == last + 1:
            at = np.minimum(np.searchsorted(before, here - 1), len(before) - 1)
            begin = np.where(before[at] == here - 1, begun[at], p)
        best = int(begin.argmin())
        yield int(begin[best]), p - int(begin[best]) + width, int(block.first[q]) + best
        before, begun, last = here, begin, p


class Shard:
    """The words of some documents, numbered from 1 (0 ends a document), with their suffix array."""

    def __init__(self, held: list[list[bytes]], depth: int):
        self.number: dict[bytes, int] = defaultdict(count(1).__next__)
        self.counts = np.array([len(x) for x in held])
        self.ends = np.cumsum(self.counts + 1)
        self.starts = self.ends - self.counts - 1
        self.tokens = np.zeros(int(self.ends[-1]), dtype=np.int32)
        for a, found in zip(self.starts, held):
            self.tokens[a : a + len(found)] = list(map(self.number.__getitem__, found))
        self.array = suffix_array(self.tokens, depth)

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Places, ascending, and windows of ``block`` that occur there."""
        has, words = block.within(self.number)
        lo, hi = search(self.tokens, self.array, words, block.lengths[has])
        n = hi - lo
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        places, windows = self.array[at], np.repeat(has, n)
        order = np.lexsort((windows, places))
        return places[order], windows[order]


def _match(held: list[list[bytes]], blocks, width: int):
    """For the documents of a shard: numbers of words, covered runs with their longest match, items found by document."""
    shard = Shard(held, width)
    covered = np.zeros(len(shard.tokens) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in held]
    matches = []
    for block in blocks:
        places, windows = shard.hits(block)
        if not len(places):
            continue
        np.add.at(covered, places, 1)
        np.add.at(covered, places + block.lengths[windows], -1)
        doc = np.searchsorted(shard.ends, places, side="right")
        for d, q in np.unique(np.stack([doc, windows]), axis=1).T.tolist():
            items[d].update(block.names[i] for i in block.item[block.first[q] : block.first[q + 1]].tolist())
        for start, n, row in _longest(places, windows, block, width):
            whole = min(n, width)  # words of the window that the row is of
            matches.append((start, n, block.names[block.item[row]], int(block.start[row]) - (n - whole)))
    edge = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(covered[:-1]) > 0).astype(np.int8), 0]))
    first, last = edge[::2], edge[1::2]
    best: dict[int, tuple] = {}
    for m in matches:
        run = int(np.searchsorted(first, m[0], side="right")) - 1
        if run not in best or (m[1], -m[0]) > (best[run][1], -best[run][0]):
            best[run] = m
    runs: list[list] = [[] for _ in held]
    for k, (x, y) in enumerate(zip(first.tolist(), last.tolist())):
        d = int(np.searchsorted(shard.ends, x, side="right"))
        a = int(shard.starts[d])
        start, length, item, item_start = best[k]
        runs[d].append({"start": x - a, "end": y - a, "match_start": start - a, "match_words": length, "item": item, "item_start": item_start})
    return shard.counts, runs, items


#: A run of covered words and the longest verbatim match in it; ``item`` has the type of the benchmark's ids.
SPAN = ("start", "end", "match_start", "match_words", "item", "item_start")


def _blocks(benchmark: DataFrame, item: str, item_text: str, width: int) -> list:
    """The benchmark as broadcast blocks of bounded size."""
    sc = benchmark.sparkSession.sparkContext
    blocks, held, size = [], [], 0
    for r in benchmark.select(F.col(item).alias("item"), F.coalesce(item_text, F.lit("")).alias("text")).toLocalIterator():
        raw = r["text"].encode()
        held.append((r["item"], raw))
        size += len(raw)
        if size >= BLOCK_BYTES:
            blocks.append(sc.broadcast(Block(held, width)))
            held, size = [], 0
    if held:
        blocks.append(sc.broadcast(Block(held, width)))
    return blocks


def _opened(blocks):
    """The blocks one after another, one in memory at a time where there are several."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, keep: list[str], width: int = 10) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``spans`` and ``items``.

    spans: maximal runs of words inside an occurrence of a benchmark window:
    first word, the one after the last, and the longest verbatim match in it
    (its first word, words, item and the item's first word; ties: the first).
    items: ids whose windows occur, ascending, in the benchmark's own type (an
    item without an id hits, but has no name to list). Null texts have no
    words; equal rows are judged each for itself; columns of ``docs`` with the
    new names are replaced; an empty benchmark finds nothing. A very long text
    makes a shard of its own.
    """
    kept = [c for c in keep if c.lower() not in ("n_words", "spans", "items")]
    bound_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item, item_text, width)
    kind = benchmark.schema[item].dataType
    span = pa.struct([(c, to_arrow_type(kind) if c == "item" else pa.int64()) for c in SPAN])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            for first, words in _shards(t.as_py() or b"" for t in texts):
                counts, runs, items = _match(words, _opened(blocks), width)
                part = batch.slice(first, len(words))
                named = [sorted(x for x in s if x is not None) for s in items]
                new = [pa.array(counts.astype(np.int64)), pa.array(runs, pa.list_(span)), pa.array(named, pa.list_(span.field("item").type))]
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + new, [*kept, "n_words", "spans", "items"])

    of = lambda c: kind.simpleString() if c == "item" else "long"
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"n_words long, spans array<struct<{','.join(f'{c}:{of(c)}' for c in SPAN)}>>, items array<{of('item')}>"])
    return docs.select(*kept, F.col(text).alias(free_name(docs, "match"))).mapInArrow(tidied(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item.

    Only the texts go to Python; a row's other columns stay where they are,
    whatever their names. A null text holds nothing; equal rows are judged
    alike; an empty benchmark removes nothing.
    """
    bound_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item, item_text, width)

    def found(batches):
        for texts in batches:
            out = []
            for _, words in _shards(t.as_py() or b"" for t in texts.cast(pa.binary())):
                out += [len(r) > 0 for r in _match(words, _opened(blocks), width)[1]]
            yield pa.array(out, pa.bool_())

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.filter(~F.arrow_udf(found, "boolean")(F.col(text)))


def op8_decontamination(spark, sf_dir):
    found = find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "text", "item_id", "text", ["doc_id"])
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(g) AS n, g FROM (SELECT item_id, w[k : k + 9] AS g FROM i, unnest(range(1, greatest(2, len(w) - 8))) u(k) WHERE len(w) > 0)),
places AS (SELECT r, k, n, w[k : k + n - 1] AS g FROM d, unnest(range(1, len(w) + 1)) u(k), (SELECT DISTINCT n FROM win) l WHERE k + n - 1 <= len(w)),
hits AS (SELECT r, k, p.n, item_id FROM places p JOIN win USING (g)),
covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM hits, unnest(range(k, k + n)) u(x) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
