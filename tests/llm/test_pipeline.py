"""The pipeline, stage by stage, against the operators' contracts."""

import random

import pandas as pd

import corpus_pipeline
from lodestone.llm.common import materialise
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        seen.append(docs)
    frames = [d.toPandas() for d in seen]
    for f in frames[1:5]:
        assert list(f.columns) == list(frames[0].columns)
    start, good, single, clean, safe, tokens = frames
    base = {i: brute.quality(t) for i, t in zip(start.doc_id, start.text)}
    assert all(base[i][0] >= 20 and 100 * base[i][4] <= 30 * base[i][0] for i in good.doc_id)
    labels = pd.read_parquet(f"{SF}/labels.parquet").merge(start[["doc_id"]])
    fine = [i for i in labels[labels.quality == 1].doc_id if base[i][0] >= 20 and 100 * base[i][4] <= 30 * base[i][0]]
    assert len(set(fine) & set(good.doc_id)) >= 0.95 * len(fine)
    groups = brute.simhash(list(zip(good.doc_id, good.text)))
    assert set(single.doc_id) <= set(good.doc_id) and single.text.is_unique
    assert {groups[i][1] for i in good.doc_id} >= {groups[i][1] for i in single.doc_id}
    assert single.doc_id.map(lambda i: groups[i][1]).is_unique
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    windows = brute.windows(zip(bench.item_id, bench.text))
    assert set(clean.doc_id) == {i for i, t in zip(single.doc_id, single.text) if not brute.contamination(t, windows)[1]}
    assert set(safe.doc_id) == set(clean.doc_id) and (safe.text.str.len() == safe.n_chars).all()
    assert set(tokens.doc_id) == set(safe.doc_id) and tokens.round_trip.all()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_near_dedup_is_exact(spark):
    """Five-word shingles with a similarity of 0.8: all such pairs, in large groups too, and no others."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for g in range(3):
        text = [word() for _ in range(60 + 200 * g)]
        for _ in range(60):  # edits of one text, most of them similar to some but not to all others
            copy = list(text)
            for _ in range(rng.randrange(4 * (g + 1))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    line = " ".join(word() for _ in range(12))
    rows += [f"{word()} {line} {word()}" for _ in range(40)] + ["x y", "X  y", "x z", "", None]
    rng.shuffle(rows)
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    least = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((least[a], least[b]))
                least = [x if v == y else v for v in least]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == set(least)


def test_secrets_in_copies(spark):
    """A credential in equal texts of three sources, or in many texts of one, is cut out; one that half of all sources write about stays."""
    copied, hot, example = "ghp_" + "A1" * 18, "AKIA" + "B2C3" * 4, "f" * 40
    rows = [(i, f"key {copied} end", f"src{i}") for i in range(3)]
    rows += [(100 + i, f"key {hot} of {i}", "src0") for i in range(120)]
    rows += [(300 + i, f"text {i} names {example} too", f"src{i}") for i in range(6)]
    rows += [(400 + i, "nothing", f"src{i}") for i in range(10)] + [(500, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, SF).collect()}
    assert all(out[i] == "key [SECRET] end" for i in range(3))
    assert all(out[100 + i] == f"key [SECRET] of {i}" for i in range(120))
    assert all(out[300 + i] == f"text {i} names {example} too" for i in range(6))
