"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

A text is split by the tokenizer's pattern; each distinct piece of a partition
is encoded once. A piece is rows (word, position, token), one for each byte at
first. A recursive query joins neighbours to the merge table and contracts each
word's lowest-ranked pair, leftmost first, until no word has a pair. Decoding
joins ids to the vocabulary and aggregates the bytes in order.

A long piece is cut into segments that overlap by half. Contraction looks at
neighbours only, so a sequence of tokens is the contraction of its bytes if and
only if each two neighbours in it are that of theirs: a token that both of two
overlapping segments have, at the same place, joins them exactly. Where two
have no such token, new segments begin at a token of the first one.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, free_name, table, tidied

#: Bytes of distinct pieces that one recursive query contracts; a segment that is longer has a query of its own.
QUERY_BYTES = 1 << 18
#: Rows that the rounds of one recursive query add up to at most, and its most rounds; unfinished words go on in another.
QUERY_ROWS, ROUNDS = 6 << 20, 24
#: Distinct pieces whose ids a task keeps, and their bytes.
CACHE_WORDS, CACHE_BYTES = 400_000, 32 << 20
#: Tokens that one decoding query handles; a longer text makes several queries.
DECODE_TOKENS = 500_000
#: Longer pieces are cut into segments of twice this length, one beginning every so many bytes.
STEP = 64
#: Characters of texts split at a time.
TEXT_BYTES = 2 << 20

# One pair of each word a round. A row knows its right neighbour, so a round needs no sort: the word's lowest rank,
# leftmost, comes from an aggregate, the row after the contracted pair from a join.
_CONTRACT = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, npos, ntok, 0 AS round, FALSE AS done FROM state
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT s.w, s.pos, s.tok, s.npos, s.ntok, s.round, m.id FROM step s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.ntok WHERE NOT s.done AND s.round < $rounds),
    lowest AS MATERIALIZED (SELECT w, min(id::BIGINT * 4294967296 + pos) AS best, arg_min(npos, id::BIGINT * 4294967296 + pos) AS gone FROM pairs GROUP BY w),
    contracted AS MATERIALIZED (
      SELECT b.w, (b.best // 4294967296)::INTEGER AS merged, (b.best % 4294967296)::INTEGER AS at, b.gone, c.npos, c.ntok FROM lowest b LEFT JOIN pairs c ON c.w = b.w AND c.pos = b.gone)
    SELECT c.w, c.pos, CASE WHEN c.pos = a.at THEN a.merged ELSE c.tok END, CASE WHEN c.pos = a.at THEN a.npos ELSE c.npos END,
      CASE WHEN c.pos = a.at THEN a.ntok WHEN c.npos = a.at THEN a.merged ELSE c.ntok END, c.round + 1, a.at IS NULL
    FROM pairs c JOIN contracted a ON a.w = c.w WHERE c.pos IS DISTINCT FROM a.gone)
)
SELECT w, pos, tok, npos, ntok, done FROM step WHERE done OR round = $rounds"""

_DECODE = """
SELECT hex_of.d AS d, unhex(string_agg(hex_of.bytes, '' ORDER BY hex_of.pos)) AS bytes
FROM (SELECT ids.d, ids.pos, vocab.bytes FROM ids JOIN vocab ON vocab.id = ids.id) hex_of GROUP BY hex_of.d"""


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, read on the driver; under 1 MB for 50k tokens, and sent with the task."""
    with open(path, "rb") as f:
        return f.read()


def _cut(start: int, end: int, step: int) -> list[list]:
    """Segments without ids, each half over the next."""
    return [[a, min(a + 2 * step, end), None] for a in range(start, max(end - step, start + 1), step)]


def _batches(places: list[int], words: list[bytes]):
    """``places`` of words in runs of QUERY_BYTES."""
    held, size = [], 0
    for k in places:
        held.append(k)
        size += len(words[k])
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Codec:
    """Encodes and decodes with one DuckDB connection. ``ranks_file``: lines of a base64 token and its rank, which is its id."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):  # every way to make the token of two
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        # queries are bounded, so nothing is spilled: an executor's own folder is no place for it
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.con.execute("SET preserve_insertion_order = false")
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(merged, pa.int32())})
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([k.hex() for k in ranks])})
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.con.register("given", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.ranks = ranks
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def fixpoint(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and where each word's begin, by recursive queries until every word is at its fixpoint."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes) - sizes
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos, tok = (np.arange(len(raw)) - starts[w]).astype(np.int32), self.byte[raw]
        more = pos + 1 < sizes[w]  # the last byte of a word has no neighbour: -1
        left = pa.table({"w": w, "pos": pos, "tok": tok, "npos": np.where(more, pos + 1, -1).astype(np.int32), "ntok": np.where(more, np.r_[tok[1:], 0], -1).astype(np.int32)})
        done = []
        while left.num_rows:
            rounds = max(1, min(ROUNDS, QUERY_ROWS // left.num_rows))
            self.con.register("state", left)
            out = self.con.sql(_CONTRACT.replace("$rounds", str(rounds))).to_arrow_table()
            self.con.unregister("state")
            flags = out["done"].to_numpy()
            done.append([out[c].to_numpy()[flags] for c in ("w", "pos", "tok")])
            left = out.filter(pc.invert(out["done"])).drop_columns("done")
        w, pos, tok = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(w.astype(np.int64) << 32 | pos)
        return tok[order].astype("<u4"), np.searchsorted(w[order], np.arange(len(words) + 1))

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian integers: short words at once, long ones by segments."""
        out: list = [None] * len(words)
        for some in _batches([k for k, x in enumerate(words) if len(x) <= 2 * STEP], words):
            ids, first = self.fixpoint([words[k] for k in some])
            raw, first = ids.tobytes(), (4 * first).tolist()
            for k, a, b in zip(some, first, first[1:]):
                out[k] = raw[a:b]
        long = {k: _cut(0, len(x), STEP) for k, x in enumerate(words) if len(x) > 2 * STEP}
        turn = 0
        while long:
            todo = [(s, words[k][s[0] : s[1]]) for k, own in long.items() for s in own if s[2] is None]
            for some in _batches(list(range(len(todo))), [x for _, x in todo]):
                ids, first = self.fixpoint([todo[k][1] for k in some])
                for k, a, b in zip(some, first, first[1:]):
                    todo[k][0][2] = ids[a:b]
            long = {k: self.joined(own, turn) if len(own) > 1 else own for k, own in long.items()}
            for k in [k for k, own in long.items() if len(own) == 1 and own[0][2] is not None]:
                out[k] = long.pop(k)[0][2].tobytes()
            turn += 1
        return out

    def joined(self, own: list[list], turn: int) -> list[list]:
        """A word's overlapping segments (start, end, ids) joined; where two have no token in common, with new ones, yet without ids."""
        ends = [s[0] + np.cumsum(self.size[s[2]]) for s in own]
        tokens = [e * 4096 + self.size[s[2]] for e, s in zip(ends, own)]  # a token's place and length as one number
        cuts: list[int | None] = []
        for one, two in zip(tokens, tokens[1:]):
            both = np.intersect1d(one, two, assume_unique=True) // 4096
            both = both[both >= (cuts[-1] or 0)] if cuts else both
            cuts.append(int(both[0]) if len(both) else None)
        blocks, parts, first = [], [], 0
        for k, s in enumerate(own):
            low = cuts[k - 1] if k > first else s[0]
            apart = k == len(cuts) or cuts[k] is None
            high = s[1] if apart else cuts[k]
            parts.append(s[2][(ends[k] > low) & (ends[k] <= high)])
            if apart:
                blocks.append(([own[first][0], s[1], np.concatenate(parts)], k == first))
                parts, first = [], k + 1
        # A block's tail goes on through the next one, or through all that follow and are but a segment each: text that
        # repeats itself takes its alignment from where it began.
        out, k = [blocks[0][0]], 0
        while k + 1 < len(blocks):
            last = k + 1
            while last + 1 < len(blocks) and blocks[last][1]:
                last += 1
            start, end, ids = blocks[k][0]
            places = start + np.cumsum(self.size[ids]) - self.size[ids]
            again = int(places[min(np.searchsorted(places, end - (STEP << turn)), len(places) - 1)])
            out += _cut(again, blocks[last][0][1], self.step(ids[np.searchsorted(places, again) :], STEP << max(0, turn - 3)))
            out += [x for x, _ in blocks[last + 1 : last + 2]]
            k = last + 1
        return out

    def step(self, ids: np.ndarray, far: int) -> int:
        """How far apart to begin segments after a block that ends with ``ids``: a multiple of their period, if they have one."""
        middle = ids[:-2]
        for m in range(1, len(middle) // 2 + 1):
            if np.array_equal(middle[m:], middle[:-m]):
                period = int(self.size[middle[:m]].sum())
                return -(-far // period) * period
        return far

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of ``pieces`` among the known ones."""
        if len(self.known) + len(pieces) > CACHE_WORDS or self.known_bytes > CACHE_BYTES:
            self.known, self.known_bytes = {}, 0
        new = []
        for x in pieces:
            if x not in self.known:
                rank = self.ranks.get(x.encode())  # a piece that is a token needs no query
                if rank is None:
                    new.append(x)
                else:
                    self.known[x] = rank.to_bytes(4, "little")
        self.known_bytes += sum(map(len, new))
        for word, ids in zip(new, self.contract([x.encode() for x in new])):
            self.known[word] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, held, size = [], [], 0
        for k, t in enumerate(texts):
            held.append(self.split(t))
            size += len(t)
            if size >= TEXT_BYTES or k == len(texts) - 1:
                self.learn({x for pieces in held for x in pieces})
                get = self.known.__getitem__
                out += [b"".join(map(get, pieces)) for pieces in held]
                held, size = [], 0
        return out

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence, aggregated in order."""
        ids = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)
        of = np.repeat(np.arange(len(encoded), dtype=np.int32), [len(x) // 4 for x in encoded])
        parts: list[list[bytes]] = [[] for _ in encoded]
        for at in range(0, len(ids), DECODE_TOKENS):
            some = slice(at, at + DECODE_TOKENS)
            self.con.register("ids", pa.table({"d": of[some], "pos": np.arange(len(ids[some]), dtype=np.int32), "id": ids[some]}))
            found = self.con.sql(_DECODE).to_arrow_table()
            self.con.unregister("ids")
            for d, x in zip(found["d"].to_pylist(), found["bytes"].to_pylist()):
                parts[d].append(x)
        return [b"".join(x) for x in parts]


def _ids(codec: Codec, texts: list) -> list[bytes]:
    return codec.encode([(t or b"").decode() for t in texts])


def _bytes(codec: Codec, encoded: list) -> list[bytes]:
    return codec.decode([x or b"" for x in encoded])


def encode(docs: DataFrame, text: str, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``ids`` (binary: little-endian unsigned 32-bit integers) of the whole text; null is empty.

    A column of ``docs`` named ``ids`` is replaced; equal rows are encoded each.
    """
    return _mapped(docs, text, keep, {"ids": _ids}, ranks_path, pattern)


def decode(docs: DataFrame, ids: str, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``decoded`` (binary) of the id sequences; null is empty."""
    return _mapped(docs, ids, keep, {"decoded": _bytes}, ranks_path, pattern)


def transcode(docs: DataFrame, text: str, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """:func:`encode`, then :func:`decode` of the ids alone, by one codec a task: columns ``keep``, ``ids``, ``decoded``."""
    return _mapped(docs, text, keep, {"ids": _ids, "decoded": _bytes}, ranks_path, pattern)


def _mapped(docs: DataFrame, column: str, keep: list[str], works: dict, ranks_path: str, pattern: str) -> DataFrame:
    """``keep`` with a binary column for each of ``works``, which get the column before them."""
    kept = [c for c in keep if c.lower() not in works]
    ranks = read_ranks(ranks_path)
    bound_batches(docs.sparkSession)

    def run(batches):
        codec = None
        for batch in batches:
            codec = codec or Codec(ranks, pattern)
            given = batch.column(batch.num_columns - 1).cast(pa.binary())
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [given.slice(at, 1000).to_pylist()]
                for work in works.values():
                    made.append(work(codec, made[-1]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x, pa.binary()) for x in made[1:])], [*kept, *works])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} binary" for c in works)])
    return docs.select(*kept, F.col(column).alias(free_name(docs, "in"))).mapInArrow(tidied(run), schema)


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = transcode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", path, pattern, ["doc_id"])
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
