"""Near-dedup against brute-force Jaccard similarity of word runs."""

import random
import re

import numpy as np
import pytest

from millrace.llm.neardup import TOKENS, branches, components, connected, near_dedup, near_duplicates

SCHEMA = "doc_id long, text string"


def shingles(t, n=3):
    w = re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def edited(rng, t, share):
    return " ".join("".join(rng.choices("stuvwxyz", k=4)) if rng.random() < share else w for w in t.split())


def groups(spark, rows, **how):
    return {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), **how).collect()}


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r[0]: shingles(r[1]) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates(docs).collect()}
    assert set(got) == set(rows)
    ids = sorted(rows)
    alike, missed = 0, 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if jaccard(rows[a], rows[b]) >= 0.5:
                alike += 1
                missed += got[a] != got[b]
    assert alike > 100 and missed <= 0.02 * alike
    # every member is similar to some other of its group, estimates allowed for
    by = {}
    for k, g in got.items():
        by.setdefault(g, []).append(k)
    for members in by.values():
        for a in members:
            assert len(members) == 1 or max(jaccard(rows[a], rows[b]) for b in members if b != a) > 0.25


def test_planted_groups_of_all_sizes(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for size in (2, 3, 40, 400):
        base = text(rng, 200)
        first = len(rows)
        for _ in range(size):
            want[len(rows)] = first
            rows.append((len(rows), edited(rng, base, 0.04)))
    for _ in range(200):
        want[len(rows)] = len(rows)
        rows.append((len(rows), text(rng, 120)))
    got = groups(spark, rows)
    wrong = [k for k, g in want.items() if got[k]["group_id"] != g]
    assert len(wrong) <= 0.01 * len(rows)
    assert all(got[k]["size"] == 1 and got[k]["kept"] for k, g in want.items() if k == g and k >= 445)
    assert sum(r["kept"] for r in got.values()) == len({r["group_id"] for r in got.values()})


def test_shared_passage_is_no_copy(spark):
    rng = random.Random(8)
    p = text(rng, 60)
    rows = [(i, f"{text(rng, 200)} {p} {text(rng, 60)}") for i in range(150)]
    assert all(r["kept"] for r in groups(spark, rows).values())


def test_edge_rows(spark):
    t = text(random.Random(1), 50)
    rows = [(5, t), (2, t), (None, t), (9, None), (10, None), (11, ""), (12, "!!"), (13, "hello there"), (14, "Hello, there!"), (15, "hello")]
    got = groups(spark, rows)
    assert [got[k]["group_id"] for k in (5, 2, None)] == [2, 2, 2]
    assert got[2]["kept"] and not got[5]["kept"] and not got[None]["kept"]
    assert all(got[k]["kept"] and got[k]["size"] == 1 for k in (9, 10, 11, 12, 15))
    assert got[14]["group_id"] == 13
    assert groups(spark, []) == {}


def test_dedup_keeps_columns_and_one_row(spark):
    t = text(random.Random(2), 50)
    rows = [(1, t, "a", 1), (1, t, "b", 2), (2, t + " x", "c", 3), (3, None, None, None), (3, None, None, None), (4, "lone words here", "d", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, sig long")
    got = near_dedup(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]


def test_components_equal_transitive_closure():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 3, (120, TOKENS)).astype(np.uint16)
    for i in range(1, 120, 3):
        sig[i, : TOKENS // 2 + i % 40] = sig[i - 1, : TOKENS // 2 + i % 40]
    least = 78
    parent = components(sig, least)
    root = lambda i: i if parent[i] == i else root(parent[i])
    near = (sig[:, None, :] == sig[None, :, :]).sum(axis=2) >= least
    reach = near.copy()
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert all((root(a) == root(b)) == bool(reach[a, b]) for a in range(120) for b in range(120))


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 40), (100, 41), (41, 42), (7, 7)] + [(200 + i, 201 + i) for i in range(0, 20, 2)]
    got = {r[0]: r[1] for r in connected(spark.createDataFrame(edges, "id long, other long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (40, 41, 42, 100)} == {40}
    assert all(got[201 + i] == 200 + i for i in range(0, 20, 2))


def test_every_tree_branches_alike():
    node = np.array([5, 5, 9], np.uint64)
    row, token = branches(2, node, 0.05)
    assert token[row == 0].tolist() == token[row == 1].tolist() != token[row == 2].tolist()


@pytest.mark.parametrize("leaf", [2, 48])
def test_leaf_size_does_not_change_groups(spark, leaf):
    rng = random.Random(6)
    base = text(rng, 150)
    rows = [(i, edited(rng, base, 0.02)) for i in range(60)] + [(100 + i, text(rng, 90)) for i in range(40)]
    got = groups(spark, rows, leaf=leaf)
    assert {got[i]["group_id"] for i in range(60)} == {0}


@pytest.mark.parametrize("kind", ["alike", "two kinds", "chain"])
def test_large_nodes_in_blocks(spark, kind):
    """Nodes beyond ``block`` texts are compared in parts, with the components that one task finds."""
    rng = random.Random(21)
    frame = text(rng, 60)
    if kind == "alike":
        rows = [(i, edited(rng, frame, 0.03)) for i in range(150)]
    elif kind == "two kinds":
        tails = [text(rng, 25), text(rng, 25)]
        rows = [(i, f"{frame} {edited(rng, tails[i % 2], 0.02)} {text(rng, 2)}") for i in range(150)]
    else:
        words = (frame + " " + text(rng, 60)).split()
        rows = [(i, " ".join(words[i // 3 : i // 3 + 60])) for i in range(170)]
    a, b = (groups(spark, rows, leaf=4, depth=2, block=n) for n in (4096, 16))
    assert {k: (r["group_id"], r["size"], r["kept"]) for k, r in a.items()} == {k: (r["group_id"], r["size"], r["kept"]) for k, r in b.items()}


def test_many_half_alike_pages(spark):
    """Pages of one template whose words beyond it differ: large nodes end, and no page is held against all others in one task."""
    rng = random.Random(22)
    frame = text(rng, 40)
    rows = [(i, f"{frame} {text(rng, 20)}") for i in range(6_000)]
    got = groups(spark, rows, block=512)
    assert len(got) == 6_000 and sum(r["kept"] for r in got.values()) < 60
