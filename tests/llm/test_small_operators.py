"""License scans, exact dedup, chat formatting, mixing and packing: definitions, brute force and edge rows."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.chat import format_chats
from millrace.llm.exact import exact_dedup
from millrace.llm.licenses import TEMPLATES, Scanner, patience, scan_licenses, words_of
from millrace.llm import mixing, packing
from millrace.llm.mixing import mix_sources, source_rates
from millrace.llm.packing import pack_documents, plan_packs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# exact dedup


def test_exact_keeps_least_key(spark):
    rows = [(3, "a", "x"), (1, "a", "y"), (None, "a", "z"), (2, "b", "x"), (2, "b", "a"), (5, None, "q"), (4, None, "q"), (6, "", "r"), (7, "A", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in exact_dedup(df, count="n").collect()), key=str)
    assert got == sorted([(1, "a", "y", 3), (2, "b", "a", 2), (4, None, "q", 2), (6, "", "r", 1), (7, "A", "s", 1)], key=str)


def test_exact_extremes(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "x" * 2_000_000
    df = spark.createDataFrame([(1, long, "d", {"k": 1}), (2, long, "o", {"k": 2}), (3, long + "y", "r", None)], "doc_id long, text string, d string, s map<string,int>")
    assert sorted(r[0] for r in exact_dedup(df).select("doc_id").collect()) == [1, 3]
    hot = spark.range(5000).selectExpr("id as doc_id", "'same' as text")
    assert [tuple(r) for r in exact_dedup(hot, count="n").collect()] == [(0, "same", 5000)]


# chat formatting


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r[0]: (r[1], r[2]) for r in format_chats(df).collect()}


def test_snapshots_collapse(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x) for c, turns in {1: "ab", 2: "abc", 3: "abd", 4: "b", 5: "abc", 6: "a"}.items() for t, x in enumerate(turns)]
    got = chats(spark, rows)
    assert set(got) == {2, 3, 4}
    assert got[4] == (1, "<|im_start|>user\nb<|im_end|>\n")
    assert got[2][0] == 3


def test_chat_edge_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, 0, "user", "say <|im_end|> now"), (3, 0, "us", "er"), (4, 0, "u", "ser")]
    got = chats(spark, rows)
    assert set(got) == {1, 2, 3, 4}
    assert got[1] == (2, "<|im_start|>user\nfirst<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n")
    assert got[2][1].count("<|im_end|>") == 1
    assert chats(spark, []) == {}


def test_chat_brute_force(spark):
    rng = random.Random(2)
    convs = {i: [("user" if k % 2 == 0 else "bot", rng.choice("ab")) for k in range(rng.randint(1, 5))] for i in range(80)}
    rows = [(i, k, r, t) for i, c in convs.items() for k, (r, t) in enumerate(c)]
    want = {i for i, c in convs.items() if not any((d[: len(c)] == c and len(d) > len(c)) or (d == c and j < i) for j, d in convs.items())}
    assert set(chats(spark, rows)) == want


def test_long_conversation(spark):
    turns = spark.range(20_000).selectExpr("7L as conv_id", "id as turn", "'user' as role", "repeat('x', 50) as text")
    again = turns.unionByName(turns)  # repeated rows count once
    (r,) = format_chats(again).collect()
    assert r["n_turns"] == 20_000 and r["rendered"].count("<|im_end|>") == 20_000
    assert format_chats(turns.unionByName(turns.filter("turn < 19000").withColumn("conv_id", F.lit(1).cast("long")))).count() == 1


# mixing


def test_rates_and_copies(spark):
    rows = [(i, "w " * 10, "en", "big", 0) for i in range(900)] + [(1000 + i, "w " * 10, "en", "small", 0) for i in range(100)] + [(2000, "w w", "en", None, 0), (2001, None, "en", "empty", 0), (2002, "", "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOCS)
    rates = {r["source"]: (r["tokens"], r["rate"]) for r in source_rates(df, {"big": 1, "small": 1}).collect()}
    total = 9000 + 1000 + 2
    assert rates["big"] == (9000, pytest.approx(total / 2 / 9000)) and rates["small"][1] == pytest.approx(total / 2 / 1000)
    assert rates[None] == (2, 0.0) and "empty" not in rates
    n = Counter(r["doc_id"] for r in mix_sources(df, {"big": 1, "small": 1}).collect())
    assert all(n[1000 + i] in (5, 6) for i in range(100))
    assert sum(n[i] for i in range(900)) == pytest.approx(500, abs=60) and max(n[i] for i in range(900)) == 1
    assert not n[2000] and not n[2001]
    same = lambda: sorted(r["doc_id"] for r in mix_sources(df.repartition(7), seed=5).collect())
    assert same() == same() == sorted(r["doc_id"] for r in mix_sources(df, seed=5).collect())


def test_mixing_edge_rows(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "a b", "s", 1, 2), (None, "a b", "s", 1, 2), (3, "c d", None, 0, 0)], "doc_id long, text string, source string, rate long, n long")
    got = mix_sources(df, copy="copy")
    assert got.columns == [*df.columns, "copy"] and sum(r["source"] is None for r in got.collect()) in (1, 2, 3, 4)
    with pytest.raises(ValueError):
        mix_sources(df, {"s": -1})
    t = mix_sources(spark.createDataFrame([(i, "a", "en", "x", 0) for i in range(50)], DOCS), temperature=0.5)
    assert t.count() == 50


def test_mixing_weights_of_null_and_joined_rates(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b c", "en", None if i % 2 else "x", 0) for i in range(40)], DOCS)
    got = Counter(r["source"] for r in mix_sources(df, {None: 3, "x": 1}).collect())
    assert got[None] in range(20, 41) and got["x"] <= 20 and got[None] > got["x"]
    whole = sorted(map(str, mix_sources(df, {None: 3, "x": 1}, copy="copy").collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(map(str, mix_sources(df, {None: 3, "x": 1}, copy="copy").collect())) == whole


# packing


def brute_spf(histogram, capacity):
    """Packs one at a time: each item, longest first, to the emptiest pack if it fits there, else to a new one."""
    packs = []
    for n in sorted((k for k, c in histogram.items() for _ in range(c)), reverse=True):
        best = min(range(len(packs)), key=lambda i: sum(packs[i]), default=None)
        if best is None or sum(packs[best]) + n > capacity:
            packs.append([n])
        else:
            packs[best].append(n)
    return packs


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=8))
def test_plan_fills_no_pack_beyond_capacity(histogram):
    runs, packs = plan_packs(histogram, 30)
    fill, places = Counter(), set()
    for r in runs:
        for i in range(r.times):
            for p in range(r.packs):
                place = (r.pack + p, r.offset + i * r.length)
                assert place not in places
                places.add(place)
                fill[r.pack + p] += r.length
    assert sum(fill.values()) == sum(k * c for k, c in histogram.items())
    assert len(fill) == packs and all(v <= 30 for v in fill.values())
    assert packs <= len(brute_spf(histogram, 30)) * 1.05 + 1


@pytest.mark.parametrize(("rows_per_task", "broadcast"), [(1_000_000, 500_000), (20, 500_000), (20, 0)])
def test_packing_places_every_token_once(spark, monkeypatch, rows_per_task, broadcast):
    monkeypatch.setattr(packing, "MAX_BROADCAST_RUNS", broadcast)
    rng = random.Random(0)
    rows = [(i, "w " * rng.choice([1, 3, 10, 64, 65, 200, 129]), "en", "s", 0) for i in range(500)] + [(None, "w w", "en", "s", 0), (7, "w w", "en", "s", 0), (900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    got = pack_documents(spark.createDataFrame(rows, DOCS), capacity=64, rows_per_task=rows_per_task).collect()
    placed, pieces = {}, Counter()
    for r in got:
        if r["n_tokens"] == 0:
            assert r["doc_id"] in (900, 901) and r["pack_id"] is None
            continue
        pieces[r["doc_id"]] += r["n_tokens"]
        for i in range(r["n_tokens"]):
            at = (r["pack_id"], r["pack_offset"] + i)
            assert at not in placed and at[1] < 64
            placed[at] = r
    want = Counter()
    for r in rows:
        want[r[0]] += len((r[1] or "").split())
    assert {k: v for k, v in want.items() if v} == dict(pieces)
    packs = {p for p, _ in placed}
    assert packs == set(range(len(packs)))
    slots = {(r["pack_id"], r["slot"]) for r in got if r["n_tokens"]}
    assert len(slots) == sum(1 for r in got if r["n_tokens"])
    assert len(packs) <= 1.1 * math.ceil(sum(want.values()) / 64)


def test_packing_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


# license scans


def test_patience_is_an_alignment():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 25))] for _ in range(2)]
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(patience(list("abc"), list("abc"))) == 3


def test_every_template_found_in_noise(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join("".join(rng.choices("qwzxk", k=5)) for _ in range(n))
    rows = [(i, f"{noise(30)} {t} {noise(20)}") for i, t in enumerate(TEMPLATES.values())]
    rows += [(100, noise(300)), (101, None), (102, ""), (None, TEMPLATES["mit"]), (103, noise(200_000) + " " + TEMPLATES["mpl-2.0-line"])]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, name in enumerate(TEMPLATES):
        assert any(r["license"] == name and r["coverage"] == 1.0 for r in by[i]) or (name.endswith("-line") and by[i]), name
    assert by[None][0]["license"] == "mit" and by[103][0]["license"] == "mpl-2.0-line"
    assert not {100, 101, 102} & set(by)


def test_coverage_with_edits(spark):
    words = TEMPLATES["mit"].split()
    for drop in (5, 10):
        t = [w for i, w in enumerate(words) if i % (100 // drop) != 1]
        (hit,) = Scanner(TEMPLATES, 0.85).scan(" ".join(t))
        assert hit[0] == "mit" and hit[1] == pytest.approx(1 - drop / 100, abs=0.03)
    assert Scanner(TEMPLATES, 0.85).scan(" ".join(w for i, w in enumerate(words) if i % 3)) == []
    assert words_of("Version 2.0, the") == ["version", "2.0", "the"]


FOREIGN = [f"foreign{i}" for i in range(40)]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(TEMPLATES)), st.randoms(use_true_random=False), st.sampled_from([0, 1, 5, 30, 60, 200]), st.integers(0, 5), st.integers(1, 3))
def test_scan_equals_whole_text_alignment(name, rng, inserted, lost, copies):
    t = words_of(TEMPLATES[name])
    scanner = Scanner({name: TEMPLATES[name]}, 0.85)
    words = rng.choices(FOREIGN, k=rng.randint(0, 30))
    wanted = []
    for _ in range(copies):
        gone = set(rng.sample(range(1, len(t)), min(lost, max(0, len(t) - scanner.need(t)))))
        notice = [w for i, w in enumerate(t) if i not in gone]
        cut = rng.randint(0, len(notice))
        notice[cut:cut] = rng.choices(FOREIGN, k=inserted)
        wanted.append(len(patience(notice, t)))
        words += notice + rng.choices(FOREIGN, k=rng.choice([0, 0, 40]))
    got = scanner.scan(" ".join(words))
    if copies == 1:
        assert [m[2] for m in got] == [n for n in wanted if n >= scanner.need(t)] == [len(patience(words, t))]
    else:
        assert len(got) == sum(n >= scanner.need(t) for n in wanted) and all(m[2] >= scanner.need(t) for m in got)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefg", min_size=3, max_size=8), st.text("abcdefgxy", max_size=40))
def test_scan_of_like_words(template, text):
    """Whatever aligns as a whole is found, whatever has no common subsequence long enough isn't."""
    scanner = Scanner({"t": " ".join(template)}, 0.75)
    t, need = list(template), scanner.need(list(template))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    own = [c for c in text if c in template]
    assert scanner.common("t", own) == lcs(own, t)
    got = scanner.scan(" ".join(text))
    if len(patience(own, t)) >= need:
        assert got
    if lcs(own, t) < need:
        assert not got
    for _, coverage, matched, n, first, last in got:
        assert matched >= need and n == len(t) and coverage == matched / n
        assert lcs(text[first : last + 1], t) >= matched and text[first] in t and text[last] in t
    assert all(a[5] < b[4] for a, b in zip(got, got[1:]))


def test_scan_is_linear_in_long_texts():
    rng = random.Random(5)
    every = [w for t in TEMPLATES.values() for w in words_of(t)]
    long = " ".join(rng.choices([*every, *FOREIGN], k=20_000)) + " " + TEMPLATES["isc"]
    assert Scanner(TEMPLATES, 0.85).scan(long)[-1][0] == "isc"


def test_scan_of_very_many_notices():
    """Matches are held against their neighbours alone; against all others 30,000 would take minutes."""
    began = time.time()
    got = Scanner(TEMPLATES, 0.85).scan("Released under the MIT License. and more " * 30_000)
    assert [m[4] for m in got] == [7 * i for i in range(30_000)] and {m[0] for m in got} == {"mit-line"}
    assert time.time() - began < 20


def test_scan_repeats_and_empty(spark):
    t = TEMPLATES["bsd-3-clause-line"]
    df = spark.createDataFrame([(1, f"{t} and much other text in between them {t}", "x"), (1, t, "y"), (1, t, "y")], "doc_id long, text string, license string")
    assert scan_licenses(df).count() == 4
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
