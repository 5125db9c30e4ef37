"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns documents; the last one returns their tokens. Null texts are empty
texts; rows that are alike in all columns are judged alike, save that
near-dedup keeps one of them; columns beside those named here go through as
they are, whatever their names; an empty table gives an empty table. No stage
cuts a long text.
"""

from __future__ import annotations

import contextvars
import functools

import public_tokenizers
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontamination, quality_rules, secrets, simhash, similar
from lodestone.llm.common import bound_batches, discard, materialise, noting, table


#: The inner tables of the stage that ran last in this context.
_used: contextvars.ContextVar[tuple] = contextvars.ContextVar("used", default=())


def _stage(work):
    """``work`` with its predecessor's inner tables discarded first: a stage's output is written before the next begins."""

    @functools.wraps(work)
    def run_stage(spark, docs, sf_dir):
        for made in _used.get():
            discard(made)
        bound_batches(spark)
        made: list = []
        with noting(made):
            out = work(spark, docs, sf_dir)
        _used.set(tuple(made))
        return out

    return run_stage


@_stage
def quality(spark, docs, sf_dir):
    """Documents that the risk-controlled quality rules keep."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang")
    return quality_rules.judge(whole, table(spark, sf_dir, "labels"), "doc_id", "text", "lang", ["row"]).filter("kept").select("row.*")


@_stage
def near_dedup(spark, docs, sf_dir):
    """One document of each group linked by a five-word-shingle similarity of 0.8 or more: the one with the smallest id.

    SimHash fingerprints of five-word shingles give the first candidates;
    prefix and position filters add those that lie beyond its radius. All are
    compared on their whole texts.
    """
    near = materialise(simhash.near_duplicates(docs.filter("doc_id is not null"), "doc_id", "text", size=5), "fingerprint-sets")
    found = materialise(similar.near_copies(docs, "doc_id", "text", seeds=near), "near-copies")
    return simhash.one_of_each(docs, "doc_id", "text", found)


@_stage
def decontamination_stage(spark, docs, sf_dir):
    """Documents without a ten-word passage of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def secret_scan(spark, docs, sf_dir):
    """All documents, with all secrets but proven examples cut out of the text and its length brought up to date."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    found = secrets.scan_secrets(whole, "text", "source", "doc_id", ["row"], example_share=0.5)
    clean = F.when(F.size("live_spans") > 0, secrets.redact(F.col("row.text"), F.col("live_spans"))).otherwise(F.col("row.text"))
    length = F.when(F.size("live_spans") > 0, F.length(clean).cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": clean, "n_chars": length}
    return found.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


@_stage
def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and whether they decode to the text's bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    out = byte_bpe.transcode(docs.select("doc_id", "text", digest), "text", path, pattern, ["doc_id", "digest"])
    same = F.sha2("decoded", 256) == F.col("digest")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_scan),
    ("byte_bpe", encode),
]

#: Fingerprints, exact binomial tests and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
