"""Chat formatting at token level.

Each segment of a conversation (role, text) is encoded by itself, without
special tokens, after its control strings are escaped. Reserved ids mark turns:

    START role SEP text END   (for every turn)

The loss mask comes from prefix sums of segment lengths: it covers the tokens
of the assistant texts and nothing else. :func:`read_back` decodes the ids
alone and undoes the escapes.
"""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import table

#: Written forms of the reserved ids, in the order of their ids.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
#: A control string in content would need ``<|``. One more backslash goes between the two, one goes on reading back.
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, read on the driver; under 1 MB for 50k tokens, and sent with the task."""
    with open(path, "rb") as f:
        return f.read()


def load_encoding(ranks_file: bytes, pattern: str):
    """A tiktoken encoding with those ranks and no special tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def assemble(turns: list[tuple[str, str]], encoding, first_reserved: int, learn_role: str = "assistant"):
    """Token ids and loss mask (uint8) of the turns, each a (role, text)."""
    start, sep, end = (np.array([first_reserved + k], dtype=np.uint32) for k in range(3))
    segments, learnt = [], []
    for role, text in turns:
        segments += [start, np.array(encoding.encode_ordinary(escape(role)), dtype=np.uint32), sep, np.array(encoding.encode_ordinary(escape(text)), dtype=np.uint32), end]
        learnt += [0, 0, 0, int(role == learn_role), 0]
    if not segments:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    ends = np.cumsum([len(s) for s in segments])
    steps = np.zeros(ends[-1] + 1, dtype=np.int64)  # +1 where a learnt segment begins, -1 where it ends
    flags = np.array(learnt)
    np.add.at(steps, ends - [len(s) for s in segments], flags)
    np.add.at(steps, ends, -flags)
    return np.concatenate(segments), np.cumsum(steps[:-1]).astype(np.uint8)


def read_back(ids, mask, encoding, first_reserved: int):
    """(turns, learnt texts, formatted text) from ids and mask alone."""
    start, sep, end = range(first_reserved, first_reserved + 3)
    turns, learnt, parts, at = [], [], [], 0
    marks = np.flatnonzero(ids >= first_reserved)
    role = None
    for m in marks:
        piece = encoding.decode_bytes(ids[at:m].tolist()).decode("utf-8") if m > at else ""
        kind = ids[m]
        if kind == sep:
            role = unescape(piece)
        elif kind == end:
            turns.append((role, unescape(piece)))
            if m > at and mask[at]:
                learnt.append(turns[-1][1])
        parts += [piece, CONTROLS[kind - first_reserved]]
        at = m + 1
    return turns, learnt, "".join(parts)


def format_conversations(rows: DataFrame, ranks_path: str, pattern: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row for each conversation: id, ids array<int>, loss_mask binary, first_reserved int.

    Rows go by turn (nulls first), ties by role and text; repeated rows stay
    turns of their own. A null role or text is empty, rows with a null id form
    one conversation, other columns are ignored.
    """
    ranks = read_ranks(ranks_path)
    order = F.struct(F.col(turn).alias("k"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(order)).alias("turns"))
    id_type = dict(whole.dtypes)["conv_id"]
    whole = whole.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))

    def run(batches):
        encoding = load_encoding(ranks, pattern)
        first = encoding.n_vocab
        for batch in batches:
            ids, masks = [], []
            for turns in batch.column(1).to_pylist():
                a, b = assemble([(x["role"], x["text"]) for x in turns], encoding, first, learn_role)
                ids.append(a.astype(np.int32))
                masks.append(b.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.binary()), pa.array([first] * len(ids), pa.int32())], ["conv_id", "ids", "loss_mask", "first_reserved"])

    return whole.mapInArrow(run, f"conv_id {id_type}, ids array<int>, loss_mask binary, first_reserved int")


def digest(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What the ids and masks of :func:`format_conversations` say, read back from them."""
    ranks, id_type = read_ranks(ranks_path), dict(formatted.dtypes)["conv_id"]

    def run(batches):
        encoding = load_encoding(ranks, pattern)
        for batch in batches:
            rows = []
            for ids, mask, first in zip(batch.column("ids"), batch.column("loss_mask"), batch.column("first_reserved")):
                turns, learnt, text = read_back(ids.values.to_numpy(), mask.as_py(), encoding, first.as_py())
                loss = "".join(learnt)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "<|im_end|><|im_start|>assistant ok"


def op3_chat_format(spark, sf_dir):
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digest(format_conversations(rows.unionByName(probe), path, pattern), path, pattern)


OP3_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) + {sum(map(len, CONTROLS))} AS chars FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
