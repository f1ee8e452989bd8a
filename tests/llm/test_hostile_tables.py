"""Every operator and every stage on tables with clashing names, odd keys, null columns and no rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.chat import format_chats
from millrace.llm.exact import exact_dedup
from millrace.llm.fingerprints import fingerprint
from millrace.llm.licenses import scan_licenses
from millrace.llm.mixing import mix_sources
from millrace.llm.neardup import near_dedup, near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.repeats import drop_repeats, find_repeats
from millrace.llm.tokenids import pack_token_ids
from millrace.llm.toxicity import keep_clean, score_toxicity

CLASH = "ID string, idmany string, copies long, copy long, sig string, g long, h long, n long, r string, rate double, score string, toxic string, evidence string, `__known` string, c0 string, salt long, cuts string, first string, root long, node long, m string, y long, t string"
NOTICE = "Licensed under the Apache License, Version 2.0."
KEYS = {"string": lambda i: f"k{i:03d}", "decimal(20,2)": lambda i: Decimal(i) + Decimal("0.25"), "long": lambda i: i, "double": lambda i: i + 0.5}


def words(a, n):
    return " ".join(f"w{(a * 7919 + i * 31) % 9973}" for i in range(n))


def rows(kind):
    key = KEYS[kind]
    long = words(1, 60_000)
    texts = [words(2, 120), words(2, 120), words(2, 118) + " other end", f"{words(3, 20)} {words(2, 70)} {NOTICE}", "vile nasty " + words(4, 30), "vile nasty " + words(5, 30), words(6, 30), words(7, 30), long, long + " more", "", None, "one", "?!"]
    out = [(key(i), t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(None, words(2, 120), None, None, None), (None, None, None, None, None), out[0], out[0]]
    return out


@pytest.fixture(scope="module", params=["string", "decimal(20,2)"])
def table(request, spark):
    kind = request.param
    base = spark.createDataFrame(rows(kind), f"doc_id {kind}, text string, lang string, source string, n_chars long")
    names = CLASH.split(", ")
    docs = base.select("*", *[F.lit(7).cast(sort).alias(name.strip("`")) for name, sort in (c.rsplit(" ", 1) for c in names)])
    labels = spark.createDataFrame([(KEYS[kind](i), int(i in (4, 5))) for i in range(4, 8)], f"doc_id {kind}, toxic int")
    return kind, docs, labels


def test_reports(table):
    kind, docs, labels = table
    n = docs.count()
    same = lambda df: df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    licenses, packs, repeats = scan_licenses(docs), pack_documents(docs, capacity=64), find_repeats(docs, maximal=True)
    assert same(licenses) and [r["doc_id"] for r in licenses.collect()] == [KEYS[kind](3)]
    assert same(packs) and packs.select("doc_id").distinct().count() == 15
    got = {(r["doc_id"], r["ref_doc_id"]) for r in repeats.collect()}
    assert same(repeats) and (KEYS[kind](3), KEYS[kind](0)) in got and (None, KEYS[kind](0)) in got
    near = near_duplicates(docs)
    assert same(near) and {r["doc_id"]: r["group_id"] for r in near.collect() if r["size"] > 1 and r["doc_id"] is not None}[KEYS[kind](2)] == KEYS[kind](0)
    ids = pack_token_ids(docs, capacity=256)
    assert {d for r in ids.collect() for d in r["doc_ids"]} == {None, *(KEYS[kind](i) for i in (*range(10), 12, 13))}
    prints = fingerprint(docs, samples=8)
    assert same(prints) and prints.count() == n
    scores = score_toxicity(docs, labels)
    assert same(scores) and scores.count() == n
    for f in (scan_licenses, pack_documents, find_repeats, near_duplicates, pack_token_ids, fingerprint):
        assert f(docs.limit(0)).count() == 0
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_filters_keep_all_columns(table):
    kind, docs, labels = table
    for f in (exact_dedup, near_dedup, drop_repeats, lambda d: mix_sources(d, seed=3), lambda d: keep_clean(d, labels)):
        got = f(docs)
        assert got.columns == docs.columns and all(r["ID"] == "7" and r["copies"] == 7 for r in got.collect())
        assert f(docs.limit(0)).count() == 0
    counted = exact_dedup(docs, count="copies")
    assert counted.columns == [*docs.columns, "copies_"] and {r["doc_id"]: r["copies_"] for r in counted.collect() if r["doc_id"] is not None}[KEYS[kind](0)] == 5
    assert mix_sources(docs, copy="Copy").columns == [*docs.columns, "Copy_"]


def test_names_that_differ_by_case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame([(1, "a b", "x", "DOC"), (2, "a b", "x", "DOC")], "doc_id long, text string, source string, DOC_ID string")
        assert [tuple(r) for r in exact_dedup(docs, count="n").collect()] == [(1, "a b", "x", "DOC", 2)]
        assert near_dedup(docs).collect()[0]["DOC_ID"] == "DOC" and fingerprint(docs).count() == 2
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_chats_of_odd_keys(spark):
    for kind, key in KEYS.items():
        turns = spark.createDataFrame([(key(1), 0, "user", "a", "c"), (key(1), 0, "user", "a", "c"), (key(2), 0, "user", "a", "c"), (key(2), 1, None, None, "c"), (None, 0, "user", "a", "c")], f"conv_id {kind}, turn long, role string, text string, turns string")
        got = format_chats(turns).collect()
        assert [r["conv_id"] for r in got] == [key(2)] and got[0]["n_turns"] == 2
        assert format_chats(turns.limit(0)).count() == 0


def test_stages(table, spark, tmp_path):
    kind, docs, labels = table
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for d in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, d, str(tmp_path))
            path = str(tmp_path / f"{name}-{d is docs}-{id(d)}")
            out.write.parquet(path)
            d = spark.read.parquet(path)
            assert name == "packing" or d.columns == docs.columns
