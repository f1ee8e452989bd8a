"""Fingerprints, token ids and toxicity: round trips, brute force and held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import toxicity
from millrace.llm.fingerprints import fingerprint, similarity
from millrace.llm.tokenids import TOKENIZER, CapacityTree, best_fit_decreasing, encoder_at, pack_token_ids, write_packed
from millrace.llm.toxicity import BlockMaxIndex, fit_toxicity, keep_clean, score_toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


# fingerprints


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        base = rng.choices(vocabulary, k=80)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: 80 - 6 * i] + rng.choices(vocabulary, k=6 * i)))]
    sig = {r[0]: r[2] for r in fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), samples=1024).collect()}
    off = []
    for i in range(12):
        a, b = Counter(rows[2 * i][1].split()), Counter(rows[2 * i + 1][1].split())
        want = sum((a & b).values()) / sum((a | b).values())
        off.append(np.mean(np.array(sig[2 * i]) == np.array(sig[2 * i + 1])) - want)
    assert max(map(abs, off)) < 0.06 and abs(np.mean(off)) < 0.02


def test_fingerprint_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (None, "some words"), (4, "Some words"), (4, "Some words"), (5, "a " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("signature", F.lit("mine"))
    got = fingerprint(df, samples=16).collect()
    assert [r["n_terms"] for r in got] == [0, 0, 0, 2, 2, 2, 1]
    assert all(r["signature"] is None for r in got[:3]) and got[3]["signature"] == got[4]["signature"] == got[5]["signature"]
    assert fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 0, 4])], "a array<int>, b array<int>").select(similarity(F.col("a"), F.col("b"))).first()[0]
    assert same == 0.75


def test_fingerprint_ignores_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    a = {tuple(map(str, r)) for r in fingerprint(docs.repartition(1)).collect()}
    assert a == {tuple(map(str, r)) for r in fingerprint(docs.repartition(9)).collect()}


# token ids


@pytest.fixture(scope="module")
def bpe():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_plain_encoding(bpe):
    import pyarrow as pa

    rng = random.Random(4)
    odd = ["", None, " ", "\n", "a\n b", "a \n\n b  c", "tab\tx", "é\nà", "<|endoftext|>", "x  ", " lead", "日本 語\n字", "nb sp", "it's we'll", "12 345,6", "a b c", "\r\n x"]
    odd += ["".join(rng.choices(["a", "b", " ", "\n", "é", "1", ".", "　", "語", "'s"], k=40)) for _ in range(400)]
    ids, cuts = encoder_at(TOKENIZER).encode(pa.array(odd))
    for i, t in enumerate(odd):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == bpe.encode_ordinary(t or ""), repr(t)


def test_round_trip_of_documents(spark, bpe):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    edge = spark.createDataFrame([(None, "null key"), (9001, None), (9002, ""), (9003, "x y " * 5000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(edge).withColumn("row", F.lit("clash"))
    rows = pack_token_ids(docs, capacity=512).collect()
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["input_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == 512 and cu[0] == 0 and cu[-1] == r["n_tokens"] and r["position_resets"] == cu[:-1] and (ids[cu[-1] :] == 50256).all()
        for k, (a, z) in enumerate(zip(cu, cu[1:])):
            parts.setdefault(r["doc_ids"][k], {})[r["doc_starts"][k]] = ids[a:z].tolist()
    for d, t in docs.select("doc_id", "text").collect():
        want = bpe.encode_ordinary(t or "")
        got = [x for s in sorted(parts.get(d, {})) for x in parts[d][s]]
        assert got == want
    total = sum(r["n_tokens"] for r in rows)
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows) <= total / 512 * 1.1 + 20


def test_best_fit_decreasing_is_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(1, 51, rng.integers(0, 80))
        free: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free[free.index(min(fits))] -= n
            else:
                free.append(50 - n)
        rows = best_fit_decreasing(lengths, 50)
        assert sorted(50 - lengths[r].sum() for r in rows) == sorted(free)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    tree = CapacityTree(8)
    assert tree.take(1) is None
    tree.add(5, 0)
    tree.add(3, 1)
    assert tree.take(4) == (5, 0) and tree.take(2) == (3, 1) and tree.take(1) is None


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_written_matrices(spark, tmp_path, scheme):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    packed = pack_token_ids(docs, capacity=256)
    rows = write_packed(packed, f"{scheme}{tmp_path}/packed").collect()
    assert len(rows) == packed.count() and not list((tmp_path / "packed").glob(".part*"))
    for name in {r["file"] for r in rows}:
        own = sorted((r for r in rows if r["file"] == name), key=lambda r: r["file_row"])
        at = tmp_path / "packed" / name
        assert np.frombuffer(at.read_bytes(), "<u2").reshape(-1, 256).tolist() == [np.frombuffer(r["input_ids"], "<u2").tolist() for r in own]
        for ext, column in (("cu", "cu_seqlens"), ("resets", "position_resets")):
            assert np.frombuffer(at.with_suffix(f".{ext}").read_bytes(), "<i4").tolist() == [x for r in own for x in (len(r[column]), *r[column])]
    none = write_packed(pack_token_ids(spark.createDataFrame([], "doc_id long, text string")), f"{tmp_path}/none")
    assert none.count() == 0


# toxicity


def test_search_equals_full_scan(monkeypatch):
    rng = np.random.default_rng(2)
    for n, k in ((300, 9), (40, 15), (7, 15), (1, 1)):
        v = rng.random((n, 60)).astype(np.float32) * (rng.random((n, 60)) < np.r_[np.full(10, 0.6), np.full(50, 0.05)])
        v[:, 0] += 0.01
        v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 2).astype(np.float32)  # ties
        row, col = np.nonzero(v)
        bounds = np.searchsorted(row, np.arange(n + 1))
        monkeypatch.setattr(toxicity, "_PART", 64)
        index = BlockMaxIndex(bounds, col, lambda a, z: v[row, col][bounds[a] : bounds[z]], 60, block=16)
        assert 0 < index.lists.shape[2] < 60
        q = [np.flatnonzero(rng.random(60) < 0.2) for _ in range(150)] + [np.zeros(0, np.int64)]
        w = [rng.random(len(t)).astype(np.float32) for t in q]
        without = rng.integers(-1, n, len(q))
        got = index.search(np.r_[0, np.cumsum([len(t) for t in q])], np.concatenate(q), np.concatenate(w), k, without)
        for t, x, own, (e, c) in zip(q, w, without, got):
            full = v[:, t] @ x
            best = sorted((-round(float(s), 6), i) for i, s in enumerate(full) if s > 0 and i != own)[:k]
            assert np.allclose(c, [-s for s, _ in best], atol=1e-5)
            clear = [i for s, i in best if sum(abs(s - z) < 1e-5 for z, _ in best) == 1 and s < best[-1][0] - 1e-5]
            assert set(clear) <= set(e.tolist())


def brute_toxicity(docs, labels, k=15):
    """(score, neighbours) of every document from the definitions alone, one at a time."""
    words = {i: Counter(re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (t or "").lower())) for i, t in docs.items()}
    examples, seen = [], set()
    for i in sorted(labels):
        if words.get(i) and (docs[i], labels[i]) not in seen:
            seen.add((docs[i], labels[i]))
            examples.append(i)
    df = Counter(w for i, t in docs.items() if t is not None for w in words[i])
    n = sum(t is not None for t in docs.values())
    pos, neg = (Counter(w for i in examples if labels[i] == y for w in words[i]) for y in (1, 0))
    n_pos = sum(labels[i] for i in examples)
    n_neg = len(examples) - n_pos
    lift = lambda w: ((pos[w] + 1) / (n_pos + 2)) / ((neg[w] + 1) / (n_neg + 2))
    weight = {w: (math.log((n + 1) / (df[w] + 1)) + 1) * math.sqrt(max(1, lift(w))) for w in pos | neg}

    def unit(i):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in words[i].items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    of = {i: unit(i) for i in words}
    base = {i: of[i] for i in examples}

    def vote(i):
        cos = [(sum(x * b.get(w, 0) for w, x in of[i].items()), j) for j, b in base.items() if j != i]
        best = sorted((-c, j) for c, j in cos if c > 0)[:k]
        return (sum(c * labels[j] for c, j in best) / sum(c for c, _ in best) if best else None), best

    tried = sorted((v, labels[i]) for i in examples if (v := vote(i)[0]) is not None)
    pools = []
    for v, y in tried:
        if pools and abs(pools[-1][3] - v) < 1e-9:
            pools[-1] = [pools[-1][0] + v, pools[-1][1] + y, pools[-1][2] + 1, v]
        else:
            pools.append([v, y, 1, v])
    merged = []
    for p in pools:
        merged.append(p[:3])
        while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
            q = merged.pop()
            merged[-1] = [a + b for a, b in zip(merged[-1], q)]
    alone = [labels[i] for i in examples if vote(i)[0] is None]
    none = (sum(alone) + n_pos / len(examples)) / (len(alone) + 1)
    x, y = [p[0] / p[2] for p in merged], [(p[1] + 0.5) / (p[2] + 1) for p in merged]
    return {i: (none if (v := vote(i))[0] is None else float(np.interp(v[0], x, y)), v[1]) for i in docs}


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "qqqq")], "doc_id long, text string"))
    lab = {r["doc_id"]: int(r["toxic"] > 0) for r in labels.collect()}
    want = brute_toxicity({r[0]: r[1] for r in docs.collect()}, lab)
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
    assert set(got) == set(want) and len({round(r["score"], 3) for r in got.values()}) > 2
    for i, (score, best) in want.items():
        assert got[i]["score"] == pytest.approx(score, abs=2e-3), i
        names = [e.split() for e in got[i]["evidence"]]
        assert [float(c) for _, _, c in names] == pytest.approx([-c for c, _ in best], abs=2e-4)
        clear = {j for c, j in best if c < best[-1][0] - 1e-5}
        assert clear <= {int(j) for j, _, _ in names} and all((label == "toxic") == lab[int(j)] for j, label, _ in names)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = score_toxicity(docs, train).join(held.withColumnRenamed("toxic", "y"), "doc_id").select("y", "toxic", "score").collect()
    tp = sum(r["y"] == 1 and r["toxic"] for r in got)
    fn = sum(r["y"] == 1 and not r["toxic"] for r in got)
    fp = sum(r["y"] == 0 and r["toxic"] for r in got)
    print(tp, fn, fp, len(got))
    assert tp / (tp + fn) > 0.9 and fp / len(got) < 0.02
    for lo, hi in ((0.0, 0.5), (0.5, 1.01)):  # calibration
        part = [r for r in got if lo <= r["score"] < hi]
        assert abs(np.mean([r["score"] for r in part]) - np.mean([r["y"] for r in part])) < 0.08


def test_unlike_labelled_texts_are_all_examples(spark):
    rng = random.Random(3)
    stock = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(["the", "of", "and", *rng.sample(stock, 12), *(["vilest"] if i < 40 else [])])) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]  # equal texts are one example
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 200 < 40).cast("int").alias("toxic"))
    model = fit_toxicity(docs, labels)
    assert model.examples.ids.to_pylist() == list(range(120))
    assert {r["doc_id"] for r in score_toxicity(docs, labels).filter("toxic").collect()} == {*range(40), *range(200, 205)}
    assert 40 <= len(fit_toxicity(docs, labels, max_labelled=50).examples.ids) <= 50


def test_toxicity_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(None, None), (10**9, ""), (None, "?!"), (10**9, "")], "doc_id long, text string")
    df = docs.unionByName(extra).withColumn("score", F.lit(1)).withColumn("y", F.lit(2))
    got = score_toxicity(df, labels.unionByName(labels.limit(5)))
    odd = got.filter("doc_id is null or doc_id = 1000000000").collect()
    assert len(odd) == 4 and all(r["score"] < 0.5 and not r["toxic"] and r["evidence"] == [] for r in odd)
    assert got.count() == df.count()
    kept = keep_clean(df, labels)
    assert kept.columns == df.columns and kept.count() == got.filter("not toxic").count()
    none = score_toxicity(df.limit(5), labels.filter("toxic = 0"))
    assert all(r["score"] is None and not r["toxic"] for r in none.collect())
    assert fit_toxicity(docs.limit(0), labels) is None
    assert score_toxicity(docs.limit(0), labels).count() == 0
