"""Language-model scoring: a probabilistic suffix tree over bytes, beside a smoothed word count model.

The tree's symbols are classes of bytes of the normalised text (A-Z lowered,
words joined by one blank, one end). Contexts are up to six symbols long. A
context is a candidate if it makes up ``p_min`` of the training text, which
bounds the tree by six over ``p_min`` whatever the corpus; it is retained if
its next-symbol counts diverge from its suffix's distribution by more than they
cost to write down. Distributions are smoothed toward the suffix's. A text's
probability is the product over its bytes, each predicted from the longest
retained suffix of what is before it, and within its class by the class's byte
counts. Known words are more than their last symbols tell, so each token's
probability mixes the tree's, at ``tree_share``, with one over known tokens: a
second tree, whose symbols are classes of words (first and last symbol) and
whose contexts are the class before, times the token's share of its class. Both
sum to one over all tokens, and so does the mixture.

Word counts cover the whole corpus. Each chunk of the input sends its distinct words
(as 64-bit hashes) with counts, and gets back the corpus counts of just those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, give_back, materialise, table, tidied

#: Symbol classes of bytes. 0 end, 1 blank, 2-27 letters, 28 digits, 29 stop, 30 comma, 31 other ASCII signs,
#: 32 controls, 33 the byte C3, 34-36 other lead bytes by length, 37-52 continuation bytes by their low four bits.
#: Contexts have up to DEPTH symbols; the last DIRECT of them index a table, the ones before follow from state to state.
SYMBOLS, DEPTH, DIRECT = 53, 6, 4
CHUNK_BYTES = 1 << 19
#: The tree's share in a token's probability.
TREE_SHARE = 0.25
#: Bytes of text in a chunk, which one task holds with its word table.
HELD_BYTES = 64 << 20
#: Classes of tokens: the end, and first and last symbol of a word.
CLASSES = SYMBOLS * SYMBOLS + 1


def symbol_table() -> np.ndarray:
    out = np.full(256, 31, dtype=np.int32)
    out[:32] = 32
    out[127] = 32
    out[10], out[32], out[46], out[44] = 0, 1, 29, 30
    out[97:123] = np.arange(2, 28)
    out[48:58] = 28
    out[128:192] = 37 + (np.arange(128, 192) & 15)
    out[192:224], out[224:240], out[240:] = 34, 35, 36
    out[0xC3] = 33
    return out


def _split(texts: list[bytes]):
    """Lists of words of the texts, some MB at a time: (first text, word lists)."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t.lower().split())
        size += len(t)
        if size >= CHUNK_BYTES:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _hashes(held: list[list[bytes]]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((h for w in held for h in map(xxh64_intdigest, w)), dtype=np.uint64, count=sum(map(len, held)))


def _symbols(held: list[list[bytes]]):
    """Bytes and symbols of the texts, each after DEPTH ends, and the places to predict. A token is a word and a blank, or the end."""
    pad = b"\n" * DEPTH
    parts = [pad + b" ".join([*w, b"\n"]) for w in held]
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(x) for x in parts])
    starts = np.cumsum(sizes) - sizes
    real = np.ones(len(raw), dtype=bool)
    for k in range(DEPTH):
        real[starts + k] = False
    return raw, symbol_table()[raw], np.flatnonzero(real)


def _codes(s: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` symbols up to each place as one number."""
    out = np.zeros(len(at), dtype=np.int64 if SYMBOLS**length >= 2**31 else np.int32)
    for k in range(length - 1, -1, -1):
        out *= SYMBOLS
        out += s[at - k]
    return out


def _classes(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token ends among the symbols to predict, and its class; the class before the first token is the end's, 0."""
    ends = np.flatnonzero(target <= 1)
    starts = np.r_[0, ends[:-1] + 1]
    return ends, np.where(ends == starts, 0, target[starts].astype(np.int64) * SYMBOLS + target[np.maximum(ends - 1, 0)] + 1)


def gather(docs: DataFrame) -> DataFrame:
    """What the corpus says, by kind, from (chunk, held, text): (kind, chunk, key, n).

    0: a chunk's distinct words (hash) with their training count, which may be
    0; 1: training counts of context and symbol; 2: of bytes; 3: training
    texts; 4: training counts of a token's class and the one before it.
    """

    def merged(parts):
        """The sorted keys of the parts and their sums; the first part, which may be large, is not sorted again."""
        keys, n = parts[0]
        if len(parts) == 1:
            return keys, n
        more, count = np.concatenate([x[0] for x in parts[1:]]), np.concatenate([x[1] for x in parts[1:]])
        parts.clear()
        order = np.argsort(more, kind="stable")
        more, count = more[order], count[order]
        first = np.flatnonzero(np.r_[True, more[1:] != more[:-1]]) if len(more) else np.zeros(0, dtype=np.int64)
        more, count = more[first], np.add.reduceat(count, first) if len(first) else count
        at = np.searchsorted(keys, more)
        old = keys[np.minimum(at, len(keys) - 1)] == more if len(keys) else np.zeros(len(more), dtype=bool)
        n[at[old]] += count[old]
        keys = np.insert(keys, at[~old], more[~old])
        return keys, np.insert(n, at[~old], count[~old])

    def told(chunk, words, grams, pairs, texts, seen):
        rows = [(0, *merged(words))] if words else []
        words.clear()
        rows += [(1, *merged(grams)), (4, *merged(pairs))] if grams else []
        grams.clear()
        rows += [(2, np.flatnonzero(seen), seen[seen > 0]), (3, np.zeros(1, np.int64), np.array([texts]))]
        for kind, keys, n in rows:
            for at in range(0, len(keys), 1 << 18):
                k = keys[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), chunk, np.int64)), pa.array(k.view(np.int64)), pa.array(n[at : at + (1 << 18)].astype(np.int64))], ["kind", "chunk", "key", "n"])

    def parts(batches):
        """The batches cut where the chunk changes, and into 2000 rows."""
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                for at in range(a, b, 2000):
                    yield int(chunks[a]), batch.slice(at, min(2000, b - at))

    def run(batches):
        now = None
        for chunk, batch in parts(b for b in batches if b.num_rows):
            if chunk != now:
                if now is not None:
                    yield from told(now, words, grams, pairs, texts, seen)
                now, words, grams, pairs, texts, seen = chunk, [], [], [], 0, np.zeros(256, dtype=np.int64)
            trains = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            texts += int(trains.sum())
            for first, held in _split(raw):
                learn = trains[first : first + len(held)]
                every = _hashes(held)
                keys, where = np.unique(every, return_inverse=True)
                words.append((keys, np.bincount(where, weights=np.repeat(learn, [len(w) for w in held]), minlength=len(keys)).astype(np.int64)))
                learnt = [w for w, x in zip(held, learn) if x]
                if learnt:
                    data, s, at = _symbols(learnt)
                    grams.append(np.unique(_codes(s, at, DEPTH + 1), return_counts=True))
                    seen += np.bincount(data[at], minlength=256)
                    kinds = _classes(s[at])[1]
                    pairs.append(np.unique(np.r_[0, kinds[:-1]] * CLASSES + kinds, return_counts=True))
                if len(words) >= 5:
                    words, grams, pairs = [merged(words)], [merged(x) for x in [grams] if x], [merged(x) for x in [pairs] if x]
        if now is not None:
            yield from told(now, words, grams, pairs, texts, seen)

    return docs.mapInArrow(tidied(run), "kind int, chunk long, key long, n long")


class SuffixTree:
    """The retained contexts and their smoothed next-symbol log10 probabilities; state 0 is the empty context."""

    def __init__(self, root: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], byte_counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], weight: float = 12.0):
        """``root``: counts of symbols. ``levels``: for each length the contexts, ascending, and their rows of counts. ``pairs``: codes of class pairs, counts."""
        codes, n = pairs
        used = np.unique(np.r_[0, codes // CLASSES, codes % CLASSES])
        self.number = np.full(CLASSES, len(used), dtype=np.int64)  # a class that is not known gets one more row and column
        self.number[used] = np.arange(len(used))
        counts = np.zeros((len(used) + 1, len(used) + 1))
        counts[self.number[codes // CLASSES], self.number[codes % CLASSES]] = n
        of, before = counts.sum(axis=0), counts.sum(axis=1, keepdims=True)
        share = of / max(of.sum(), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(counts > 0, counts * np.log(counts / before / share), 0.0).sum(axis=1)
            cost = 0.5 * (counts > 0).sum(axis=1) * np.log(np.maximum(before[:, 0], 2))
            after = np.where((gain > cost)[:, None], (counts + 20.0 * share) / (before + 20.0), share)
            #: log10 of the probability of a class after another, over the class's tokens
            self.after = np.where(of > 0, np.log10(after) - np.log10(of), -np.inf).astype(np.float32)
        probs = [((root + 0.5) / (root.sum() + 0.5 * SYMBOLS))[None, :]]
        codes = [np.zeros(1, dtype=np.int64)]
        diverge = [np.ones(1, dtype=bool)]
        for k, (contexts, counts) in enumerate(levels, 1):
            total = counts.sum(axis=1, keepdims=True)
            above = probs[-1][np.searchsorted(codes[-1], contexts % SYMBOLS ** (k - 1))]  # a suffix is no rarer, so it is there
            probs.append((counts + weight * above) / (total + weight))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(counts > 0, counts * np.log(counts / total / above), 0.0).sum(axis=1)
            cost = 0.5 * (counts > 0).sum(axis=1) * np.log(np.maximum(total[:, 0], 2))
            diverge.append(gain > cost)
            codes.append(contexts)
        for k in range(len(levels), 1, -1):  # suffixes of retained contexts are states too
            diverge[k - 1][np.searchsorted(codes[k - 1], np.unique(codes[k][diverge[k]] % SYMBOLS ** (k - 1)))] = True
        self.contexts = [c[d] for c, d in zip(codes[1:], diverge[1:])]
        self.log10 = np.log10(np.concatenate([p[d] for p, d in zip(probs, diverge)])).astype(np.float32)
        kinds = symbol_table()
        size, in_class = np.bincount(kinds, minlength=SYMBOLS), np.bincount(kinds, weights=byte_counts, minlength=SYMBOLS)
        single = np.isin(kinds, [0, 1, *range(2, 28), 29, 30, 33])
        self.residual = np.where(single, 0.0, np.log10((byte_counts + 1.0) / (in_class + size)[kinds])).astype(np.float32)

    def automaton(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The state of every code of DIRECT symbols, and for each longer length the state that one more symbol leads to."""
        direct = np.zeros(SYMBOLS**DIRECT, dtype=np.int32)
        steps, at, last, first = [], 1, np.zeros(1, dtype=np.int64), 0
        for k, contexts in enumerate(self.contexts, 1):
            here = np.arange(at, at + len(contexts))
            if k <= DIRECT:
                direct.reshape(-1, SYMBOLS**k)[:, contexts] = here
            else:  # a context that is not longer leads to itself
                table = np.repeat(np.arange(len(self.log10), dtype=np.int32), SYMBOLS)
                table[(first + np.searchsorted(last, contexts % SYMBOLS ** (k - 1))) * SYMBOLS + contexts // SYMBOLS ** (k - 1)] = here
                steps.append(table)
            last, first, at = contexts, at, at + len(contexts)
        return direct, steps

    def score(self, held: list[list[bytes]], automaton: tuple[np.ndarray, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token of the texts, given as their words, by its bytes; and of one training token of its class."""
        direct, steps = automaton
        data, s, at = _symbols(held)
        state = direct[_codes(s, at - 1, DIRECT)]
        for k, table in enumerate(steps, DIRECT + 1):
            state = table[state * SYMBOLS + s[at - k]]
        target = s[at]
        each = self.log10.ravel()[state * SYMBOLS + target] + self.residual[data[at]]
        ends, kinds = _classes(target)
        kinds = self.number[kinds]
        return np.add.reduceat(each.astype(np.float64), np.r_[0, ends[:-1] + 1]), self.after[np.r_[self.number[0], kinds[:-1]], kinds]


def learn_tree(gathered: DataFrame, p_min: float) -> SuffixTree:
    """The tree from :func:`gather`'s rows; at most DEPTH / p_min contexts come to the driver."""
    grams = gathered.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
    every = grams.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("key") % SYMBOLS ** (k + 1)).alias("key")) for k in range(DEPTH + 1)])).alias("x"), "n").groupBy("x.k", "x.key").agg(F.sum("n").alias("n"))
    every = materialise(every, "contexts")
    total = every.filter("k = 0").agg(F.sum("n")).first()[0] or 0
    common = every.groupBy("k", F.floor(F.col("key") / SYMBOLS).alias("context")).agg(F.sum("n").alias("c")).filter(F.col("c") >= max(1.0, p_min * total))
    kept = every.withColumn("context", F.floor(F.col("key") / SYMBOLS)).join(common, ["k", "context"]).select("k", "key", "n").toArrow()
    k, key, n = (kept[c].to_numpy() for c in ("k", "key", "n"))
    root = np.zeros(SYMBOLS)
    root[key[k == 0]] = n[k == 0]
    levels = []
    for d in range(1, DEPTH + 1):
        contexts, where = np.unique(key[k == d] // SYMBOLS, return_inverse=True)
        counts = np.zeros((len(contexts), SYMBOLS))
        counts[where, key[k == d] % SYMBOLS] = n[k == d]
        levels.append((contexts, counts))
    byte_counts = np.zeros(256)
    for r in gathered.filter("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).collect():
        byte_counts[r["key"]] = r["n"]
    pairs = gathered.filter("kind = 4").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # CLASSES squared at most
    return SuffixTree(root, levels, byte_counts, (pairs["key"].to_numpy(), pairs["n"].to_numpy()))


def score_texts(docs: DataFrame, key: str, text: str, held: Column, p_min: float = 2e-5, tree_share: float = TREE_SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states) of every row's whole text.

    ``held`` marks the rows that nothing is learnt from (null: learnt from).
    Tokens are words and one end. base_score: word counts with add-one
    smoothing over the words known and one unknown; score: the model's.
    Both are log10. Null texts are empty, equal rows count each, other columns
    are ignored. ``docs`` should be a stable input such as a table: it is read
    three times, and a row that changes its partition between is an error.
    A chunk is a run of rows of a partition, ``HELD_BYTES`` of text by the
    partitions' mean lengths; a longer text makes a longer one.
    """
    bound_batches(docs.sparkSession)
    mean = docs.groupBy(F.spark_partition_id()).agg(F.avg(F.octet_length(F.coalesce(F.col(text), F.lit("")))).alias("m")).agg(F.max("m")).first()[0]
    per_chunk = max(1, int(HELD_BYTES / max(1.0, mean or 0.0)))
    # a row's number in its partition is in the low 33 bits
    chunk = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.floor((F.monotonically_increasing_id() % (1 << 33)) / per_chunk)
    rows = docs.select(F.col(key).alias("doc_id"), chunk.alias("chunk"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("text"))
    gathered = materialise(gather(rows.select("chunk", "held", "text")), "gathered")
    tree = docs.sparkSession.sparkContext.broadcast(learn_tree(gathered, p_min))
    by_key = Window.partitionBy("key")
    counts = gathered.filter("kind = 0").select("chunk", "key", F.sum("n").over(by_key).alias("c"), (F.min("chunk").over(by_key) == F.col("chunk")).alias("first"))
    counts = materialise(counts, "counts")
    texts = gathered.filter("kind = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = counts.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n_all, distinct = known[0] + texts, known[1] + (texts > 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        model = tree.value
        automaton = model.automaton()
        keys, c = right["key"].to_numpy().view(np.uint64), right["c"].to_numpy()
        del right
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        del order
        sums: list[list[np.ndarray]] = [[], [], [], []]
        for batch in left.to_batches(max_chunksize=2000):
            for _, words in _split([t or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]):
                h = _hashes(words)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                if len(h) and not np.array_equal(keys[at], h):
                    raise RuntimeError("a text is not in the partition that it was counted in: the input is not stable")
                n = np.array([len(w) for w in words])
                ends = np.cumsum(n + 1)  # of texts among tokens: an end follows the words
                count = np.full(len(h) + len(n), texts, dtype=np.float64)
                count[np.setdiff1d(np.arange(len(count)), ends - 1, assume_unique=True)] = c[at]
                tree_log, each = model.score(words, automaton)
                tree_log += np.log10(tree_share)
                with np.errstate(divide="ignore"):
                    known_log = np.log10(count * (1 - tree_share)) + each
                mixed = np.maximum(tree_log, known_log) + np.log10(1 + 10.0 ** -np.abs(tree_log - known_log))
                for k, values in enumerate((np.log10(count + 1), count > 0, mixed)):
                    sums[k].append(np.add.reduceat(values.astype(np.float64), ends - n - 1))
                sums[3].append(n)
        del keys, c, automaton
        give_back()
        log_sum, hit, score, n = (np.concatenate(x) for x in sums)
        n_tokens = n + 1
        base = log_sum - n_tokens * np.log10(n_all + distinct + 1.0)
        return pa.table({
            "doc_id": left["doc_id"], "held_out": left["held"], "n_tokens": n_tokens.astype(np.int64), "n_known": hit.astype(np.int64),
            "train_tokens": np.full(len(n), n_all, dtype=np.int64), "base_score": base, "score": score.astype(np.float64), "n_states": np.full(len(n), len(model.log10), dtype=np.int64),
        })

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_states long"
    return rows.groupBy("chunk").cogroup(counts.select("chunk", "key", "c").groupBy("chunk")).applyInArrow(run, schema)


def op6_lm_scoring(spark, sf_dir):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", held)
