"""The pipeline's stages against what they promise, and run() against a brute-force version."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm.toxicity import score_toxicity

from .test_neardup import jaccard, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf).cache())
    return out


def test_columns(stages):
    assert all(sorted(d.columns) == sorted(COLUMNS) for d in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "packing"]


def test_run_equals_brute_force(spark, stages):
    docs, clean, distinct, near, mixed, packed = stages
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    toxic = {r["doc_id"] for r in score_toxicity(docs, labels).filter("toxic").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    least = {}
    for r in clean.collect():
        least[r["text"]] = min(r["doc_id"], least.get(r["text"], r["doc_id"]))
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(least.values())
    sets = {r["doc_id"]: shingles(r["text"]) for r in distinct.collect()}
    kept = {r["doc_id"] for r in near.collect()}
    ids = sorted(kept)
    assert not [1 for i, a in enumerate(ids) for b in ids[:i] if jaccard(sets[a], sets[b]) > 0.55]
    assert all(max(jaccard(sets[g], s) for k, s in sets.items() if k != g) > 0.3 for g in set(sets) - kept)
    tokens = Counter()
    for r in near.collect():
        tokens[r["source"]] += len(r["text"].split())
    rate = {s: sum(tokens.values()) / len(tokens) / n for s, n in tokens.items()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for r in near.collect():
        assert copies[r["doc_id"]] - int(rate[r["source"]]) in (0, 1)
    want = sorted(len(r["text"].split()) for r in mixed.collect())
    size = Counter()
    for r in packed.collect():
        size[r["pack_id"]] += r["n_tokens"]
    assert sum(size.values()) == sum(want) and max(size.values()) <= 2048
    ran = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in ran) == sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in packed.collect())


def test_stages_take_odd_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(30_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (7, long, "en", "src0", 1), (8, long, "en", "src0", 1), (7, long, "en", "src0", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd), odd, odd.limit(0)):
        d = docs
        for i, (_, f) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{id(docs)}-{i}")
            f(spark, d, sf).write.parquet(path)
            d = spark.read.parquet(path)
