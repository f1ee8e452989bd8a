"""Substring dedup against brute force."""

import random
import re

import pytest

from millrace.llm import repeats
from millrace.llm.repeats import drop_repeats, find_repeats

SCHEMA = "doc_id long, text string"


def brute(rows, size):
    """The definition, over a dictionary of all windows."""
    places = {(k, t) for k, t in rows if t}
    words = {p: re.findall(r"(?:[0-9A-Za-z_]|[^\x00-\x7f])+", p[1]) for p in places}
    where = {}
    for p, w in words.items():
        for i in range(len(w) - size + 1):
            where.setdefault(tuple(w[i : i + size]), []).append((p[0] is None, p[0] or 0, p, i))
    aligned = {}
    for found in where.values():
        found.sort(key=lambda x: (x[0], x[1], x[3]))
        for n, x in enumerate(found):
            if len(found) > 1:
                ref = found[1] if n == 0 else found[0]
                aligned.setdefault((x[2], ref[2], ref[3] - x[3]), []).append(x[3])
    out = []
    for (p, r, shift), starts in aligned.items():
        starts.sort()
        a = z = starts[0]
        for s in [*starts[1:], None]:
            if s is None or s > z + size:
                out.append((p[0], a, z - a + size, r[0], a + shift))
                a = s
            z = s
    return sorted(out, key=str)


def found(spark, rows, size=50, block=25):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted([tuple(r) for r in find_repeats(df, min_words=size, block=block).collect()], key=str)


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages_at_every_phase(spark, seed):
    rng = random.Random(seed)
    passage, short, long = text(rng, 51), text(rng, 49), text(rng, 130)
    rows = [(i, f"{text(rng, 17 + 3 * i)} {p} {text(rng, 5 + i)}") for i, p in enumerate([passage, passage, short, short, long, long, long, passage + " " + long])]
    rows += [(20, text(rng, 30) + " " + long + " " + text(rng, 11) + " " + long), (21, text(rng, 400)), (22, "")]
    got = found(spark, rows)
    assert got == brute(rows, 50)
    assert {r[0] for r in got} == {0, 1, 4, 5, 6, 7, 20}


def test_smaller_blocks(spark):
    rng = random.Random(9)
    p = text(rng, 26)
    rows = [(i, f"{text(rng, i)} {p} {text(rng, 40)}") for i in range(1, 14)]
    assert found(spark, rows, 25, 13) == brute(rows, 25)


def test_documents_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows, 50)


def test_edge_rows(spark):
    rng = random.Random(4)
    a, b = text(rng, 80), text(rng, 70)
    rows = [(None, a), (3, a), (3, a), (4, None), (5, ""), (6, "one two"), (7, b), (7, b + " tail")]
    got = found(spark, rows)
    assert got == brute(rows, 50)
    assert (None, 0, 80, 3, 0) in got and (3, 0, 80, None, 0) in got
    assert found(spark, []) == []
    same = "word " * 300  # a window repeats inside its own text
    assert {(r[0], r[3]) for r in found(spark, [(1, same)])} == {(1, 1)}


def test_extra_columns(spark):
    a = text(random.Random(1), 60)
    df = spark.createDataFrame([(1, a, 1, 2, "x"), (2, a, 3, 4, "y")], "doc_id long, text string, id long, g long, hits string")
    assert find_repeats(df).count() == 2


def test_very_long_text(spark):
    rng = random.Random(5)
    p = text(rng, 60)
    rows = [(1, text(rng, 150_000) + " " + p), (2, p)]
    assert found(spark, rows) == sorted([(1, 150_000, 60, 2, 0), (2, 0, 60, 1, 150_000)], key=str)


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        find_repeats(spark.createDataFrame([], SCHEMA), min_words=40, block=25)


def maximal_brute(rows, size):
    """All maximal repeats of every two places, by comparing all words along every shift."""
    words = {k: re.findall(r"(?:[0-9A-Za-z_]|[^\x00-\x7f])+", t) for k, t in rows}
    out = set()
    for k, w in words.items():
        for r, v in words.items():
            for shift in range(-len(w) + size, len(v) - size + 1):
                if k == r and shift == 0:
                    continue
                n = 0
                for i in range(max(0, -shift), min(len(w), len(v) - shift) + 1):
                    if i < min(len(w), len(v) - shift) and w[i] == v[i + shift]:
                        n += 1
                        continue
                    if n >= size:
                        out.add((k, i - n, n, r, i - n + shift))
                    n = 0
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rows_of_the_query_are_maximal(spark, tmp_path, seed):
    from millrace.llm.queries import QUERIES

    rng = random.Random(seed)
    p1, p2, p3 = text(rng, 60), text(rng, 60), text(rng, 70)
    rows = [(1, f"{text(rng, 3)} {p1} {text(rng, 4)}"), (2, f"{text(rng, 5)} {p1} {p2} {text(rng, 2)}"), (3, f"{text(rng, 7)} {p1} {p2}")]
    rows += [(4, f"{p2} {p3} {text(rng, 9)} {p2} {p3}"), (5, f"{p3} {text(rng, 6)} {p1} {p2} {p3}"), (6, " ".join([p1] * 3)), (7, text(rng, 90))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op3_substring_dedup"](spark, str(tmp_path)).collect()]
    every = maximal_brute(rows, 50)
    assert len(got) == len(set(got)) and set(got) <= every
    assert {(2, 5, 120, 3, 7), (3, 7, 120, 2, 5)} <= set(got)
    covered = lambda found: {(k, i) for k, a, n, *_ in found for i in range(a, a + n)}
    assert covered(got) == covered(every)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_hot_passages_in_parts(spark, monkeypatch, broadcast):
    """Marks of many places go another way to the same result."""
    rng = random.Random(11)
    p, q = text(rng, 70), text(rng, 60)
    rows = [(i, f"{text(rng, 8)} {p} {text(rng, 5)} {q if i % 3 else ''} {text(rng, 4)}") for i in range(40)] + [(None, p), (7, p), (7, p)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(repeats, "MAX_HOT", broadcast)
    for maximal in (False, True):
        a, b = ([str(r) for r in find_repeats(df, maximal=maximal, hot=h).collect()] for h in (100_000, 3))
        assert sorted(a) == sorted(b) and len(a) > 60
    assert found(spark, rows) == brute(rows, 50)


def test_drop_repeats_keeps_the_first_place(spark):
    rng = random.Random(12)
    p, q = text(rng, 80), text(rng, 49)
    rows = [(3, f"{text(rng, 9)} {p}! {text(rng, 9)} {q}"), (1, f"{text(rng, 20)}\n{p}; {text(rng, 3)}"), (2, p), (4, f"{q} {text(rng, 30)} {p} {text(rng, 7)} {p}"), (5, None), (None, p), (6, "")]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA + ", id string, cuts long")
    got = drop_repeats(df)
    assert got.columns == df.columns
    by = {r["doc_id"]: r for r in got.collect()}
    want = {k: t if k == 1 else t and t.replace(p, "") for k, t in rows}
    assert {k: r["text"] for k, r in by.items()} == want and all(r["id"] == "mine" and r["cuts"] == 1 for r in by.values())
    assert find_repeats(got).count() == 0
    assert drop_repeats(df.limit(0)).count() == 0


def test_hot_passage_of_many_texts(spark):
    """A passage that every text has: no task gets much more than its share."""
    n = 20_000
    p = text(random.Random(13), 55)
    df = spark.range(n).selectExpr("id as doc_id", f"concat_ws(' ', sha2(cast(id as string), 256), '{p}', md5(cast(id as string))) as text").repartition(8)
    got = find_repeats(df, hot=1000)
    assert got.count() == n
    assert got.filter("ref_doc_id = 0 or (doc_id = 0 and ref_doc_id = 1)").count() == n
