"""MinHash near-deduplication by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, written

from .frames import named as chosen
from .frames import packed, place, unpacked
from .words import Words, mix, mix_int, slices, windows

#: Minwise tokens of a text; the similarity of two texts is the share of tokens that agree.
TOKENS = 128
_SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS + np.uint64(77)) | np.uint64(1)


def minwise(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have words, their TOKENS minwise tokens of 64 bits): the least of TOKENS hashes over the distinct
    runs of ``shingle`` words; a text of fewer words is one run."""
    h, counts = words.hashes(), words.counts()
    has = np.flatnonzero(counts)
    runs = windows(h, shingle)
    sums, start = [], words.bounds[:-1]
    pieces: list[np.ndarray] = []
    for i in has.tolist():
        a, n = int(start[i]), int(counts[i])
        if n >= shingle:
            pieces.append(runs[a : a + n - shingle + 1])
        else:
            pieces.append(windows(h[a : a + n], n) + np.uint64(n))
        sums.append(len(pieces[-1]))
    out = np.zeros((len(has), TOKENS), np.uint64)
    if not pieces:
        return has, out
    flat = np.concatenate(pieces)
    cuts = np.r_[0, np.cumsum(sums)[:-1]]
    for k in range(TOKENS):
        v = (flat ^ _SEEDS[k]) * _ODD[k]
        out[:, k] = mix(np.minimum.reduceat(v ^ (v >> np.uint64(29)), cuts))
    return has, out


def branches(level: int, node: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by which every node branches, as (node's number, token): each token is selected with probability ``rate``,
    by a hash of level, node and token, so all texts of a node branch alike. A tree's number is its root."""
    seed = np.uint64(mix_int(level))
    draw = mix((node ^ seed)[:, None] + _SEEDS[None, :])
    return np.nonzero(draw < np.uint64(min(int(rate * 2.0**64), (1 << 64) - 1)))


def children(node: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(node + _SEEDS[token]) ^ (value * np.uint64(0x9E3779B97F4A7C15)))


def components(sig: np.ndarray, least: int) -> np.ndarray:
    """For every row the row it was reached from (itself for a component's first): exact components of the graph that
    joins rows with at least ``least`` equal tokens. A row reached is compared with the rows not yet reached alone, so
    a dense group of n costs about n comparisons with each of its few stragglers."""
    n = len(sig)
    parent = np.arange(n)
    left = np.ones(n, bool)
    while left.any():
        todo = [int(np.argmax(left))]
        left[todo[0]] = False
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            hit = np.concatenate([r[(sig[r] == sig[i]).sum(axis=1) >= least] for r in np.array_split(rest, max(1, len(rest) // 8192))])
            parent[hit] = i
            left[hit] = False
            todo += hit.tolist()
    return parent


def near_pairs(
    docs: DataFrame,
    *,
    threshold: float = 0.45,
    shingle: int = 3,
    trees: int = 8,
    leaf: int = 48,
    depth: int = 5,
    block: int = 4096,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): texts as (id, doc_id, rows) for every distinct (key, text), and pairs (id, other) of near copies
    that span all groups found.

    Every text becomes TOKENS minwise tokens of its distinct runs of ``shingle`` lower-cased words. In each of ``trees``
    independent trees a node's texts branch by randomly selected tokens, each with probability 1 / (threshold x TOKENS),
    to one child for each value of such a token: two texts of similarity at or above the threshold are expected together
    in at least one child, unrelated ones in hardly any. Nodes of at most ``leaf`` texts are compared exhaustively; larger
    ones branch on. Nodes still larger after ``depth`` levels are compared without any cap by ``components``: texts that
    stay together that long are mostly copies, for which this is near linear. A node of more than ``block`` texts is never
    held in one task: it is compared in parts of about that size, each with some texts of all parts among it, and then the
    texts outside the node's main component so far meet every part, block by block. Texts with equal tokens enter as one.
    Texts are told apart by 64-bit hashes of key and text together with the key. Sides of joins that grow with the corpus are
    never broadcast, so plans are the same at every size.
    """
    spark = docs.sparkSession
    rate = 1 / (threshold * TOKENS)
    least = int(np.ceil(threshold * TOKENS))
    named = chosen(docs, doc_id=key, text=text).withColumn("text", F.col("text").cast("string"))
    kind = named.schema["doc_id"].dataType
    named = named.select(F.xxhash64("doc_id", "text").alias("id"), "doc_id", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            has, sig = minwise(Words(pc.utf8_lower(b.column(2))), shingle)
            first = children(root, token, sig[:, token])  # nodes of the first level, by whole tokens
            which = np.full(b.num_rows, -1)
            which[has] = np.arange(len(has))
            small = sig.astype(np.uint16)  # 16 bits are enough to compare texts that share a node
            blobs = pa.array([small[i].tobytes() if i >= 0 else None for i in which.tolist()], pa.binary())
            nodes = pa.array([first[i].view(np.int64) if i >= 0 else None for i in which.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), blobs, nodes], names=["id", "doc_id", "sig", "nodes"])

    root, token = np.arange(trees, dtype=np.uint64), np.zeros(0, np.int64)
    row, token = branches(1, root, rate)
    root = root[row]
    shape = T.StructType([T.StructField("id", T.LongType()), T.StructField("doc_id", kind), T.StructField("sig", T.BinaryType()), T.StructField("nodes", T.ArrayType(T.LongType()))])
    sketches = written(named.mapInArrow(sketch, shape), "sketches")
    texts = sketches.groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    same = sketches.filter("sig is not null").select("id", F.md5("sig").alias("m"))
    heads = same.groupBy("m").agg(F.min("id").alias("id"))
    equal = same.join(heads.withColumnRenamed("id", "other"), "m").filter("id != other").select("id", "other")
    kept = sketches.filter("sig is not null").join(heads.select("id").hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    kept = written(kept.select("id", "sig", "nodes"), "kept")
    sigs = kept.select("id", "sig")

    def grow(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, TOKENS)
                    node = b.column(2).to_numpy().view(np.uint64)
                    row, token = branches(level, node, rate)
                    child = children(node[row], token, sig[row, token].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(0).take(pa.array(row))], names=["node", "id"])

        return run

    done: list[DataFrame] = []
    level, here = 1, kept.select(F.explode("nodes").alias("node"), "id")
    while True:
        sizes = here.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")  # no node is held in a task
        made, here = here, written(here.join(sizes.hint("merge"), "node"), f"level{level}")
        if level > 1:
            discard(made)
        large = here.filter(F.col("n") > leaf)
        last = level == depth or not large.take(1)
        done.append(here if last else here.filter(F.col("n") <= leaf))
        if last:
            break
        level += 1
        here = written(large.join(sigs, "id").select("id", "sig", "node").mapInArrow(grow(level), "node long, id long"), f"branch{level}")
    nodes = done[0]
    for x in done[1:]:
        nodes = nodes.unionByName(x)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "other"]

        def pairs(node: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            size = np.diff(cuts)
            a, b = cuts[:-1][size == 2], cuts[:-1][size == 2] + 1  # most nodes hold two
            ok = (sig[a] == sig[b]).sum(axis=1) >= least
            left, right = [ids[a[ok]]], [ids[b[ok]]]
            for i, z in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist()):
                parent = components(sig[i:z], least)
                on = np.flatnonzero(parent != np.arange(z - i))
                left.append(ids[i + on])
                right.append(ids[i + parent[on]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=names)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            node, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, TOKENS)
            cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if (node != node[-1]).any() else 0
            if held and (cut or held[0][0][0] != node[-1]):
                held.append((node[:cut], ids[:cut], sig[:cut]))
                yield pairs(*[np.concatenate(x) for x in zip(*held)])
                held = []
            elif cut:
                yield pairs(node[:cut], ids[:cut], sig[:cut])
            held.append((node[cut:], ids[cut:], sig[cut:]))
        if held:
            yield pairs(*[np.concatenate(x) for x in zip(*held)])

    def compared(nodes: DataFrame) -> DataFrame:
        members = nodes.select("node", "id").join(sigs.hint("merge"), "id").select("node", "id", "sig")
        return members.repartition("node").sortWithinPartitions("node", "id").mapInArrow(compare, "id long, other long").distinct()

    big = nodes.filter(F.col("n") > block)
    if not big.take(1):
        return texts, compared(nodes).unionByName(equal)
    parts = F.ceil(F.col("n") / block).cast("int")
    part = lambda of, salt: F.pmod(F.xxhash64("id", F.lit(salt)), of).cast("int")
    every = lambda of, name: F.explode(F.sequence(F.lit(0), of - 1)).alias(name)
    key_of = lambda *c: F.xxhash64("node", *c).alias("node")
    # each part of a big node, and with it the same few texts of the node
    pivots = big.groupBy("node", "n", part(F.lit(16), 1).alias("slot")).agg(F.min_by("id", F.xxhash64("id", F.lit(2))).alias("id"))
    first = big.select(key_of(part(parts, 3)), "id").unionByName(pivots.select("node", "id", every(parts, "k")).select(key_of("k"), "id")).distinct()
    pairs = written(compared(nodes.filter(F.col("n") <= block).select("node", "id").unionByName(first)).unionByName(equal), "pairs")
    # every text outside a node's main component so far, with every part of the node
    rooted = big.join(connected(pairs), "id", "left").withColumn("root", F.coalesce("root", "id"))
    held = rooted.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("left"))
    rooted = written(rooted.join(held.filter("left > 0"), "node"), "rooted")
    outside = F.ceil(F.col("left") / block).cast("int")
    left = rooted.filter("root != main").select("node", "id", part(outside, 4).alias("u"), every(parts, "k"))
    right = rooted.select("node", "id", every(outside, "u"), part(parts, 3).alias("k"))
    second = left.unionByName(right).select(key_of("u", "k"), "id").distinct()
    return texts, pairs.unionByName(compared(second)).distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """(id, root): for every id in ``pairs`` the least id of its component, by alternating large-star and small-star
    steps on tables written to the shared folder, until the edges stand still."""
    e = pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).filter("a != b").distinct()
    e = written(e, "edges")
    before = None
    while True:
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e2 = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours are tied to the least of them
        e2 = e2.distinct()
        low2 = e2.groupBy("a").agg(F.min("b").alias("m"))
        tied = e2.join(low2, "a")
        e3 = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        before_e, e = e, written(e3, "edges")
        discard(before_e)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = state


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """(id, doc_id, rows, group_id, size, first): every distinct (key, text) with its group; see ``near_duplicates``."""
    texts, pairs = near_pairs(docs, **how)
    roots = connected(pairs)
    t = texts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = t.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("least"), F.count(F.lit(1)).alias("size"))
    t = t.join(groups, "root")
    first = (F.col("id") == F.col("least.id")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    return t.select("id", "doc_id", "rows", F.col("least.doc_id").alias("group_id"), "size", first.alias("first"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, group_id, size, kept): every distinct (key, text), the least key of its group of near copies, the
    group's size, and whether it is the one that stays.

    Groups are the connected components of near copies (see ``near_pairs``). Defined cases: null, empty and wordless
    texts are nobody's near copy and stay. A text of fewer words than a shingle is one shingle. The key keeps its type. A null
    key is kept as null and stays only where its whole group has none. Rows of equal key and text are one; equal keys with different
    texts are different texts. Ties go to the least key, then the least hash of key and text. Very long texts are read
    whole. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    return near_groups(docs, **how).select("doc_id", "group_id", "size", F.col("first").alias("kept"))


def near_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, one for each group, with all their columns. Of rows with equal
    key and text one stays. Columns of any name may be there: they travel inside a struct."""
    groups = written(near_groups(docs, key=key, text=text, **how).filter("not first or rows > 1").select(F.col("id").alias("gid"), F.col("doc_id").alias("gkey"), "first"), "groups")
    rows, row = packed(docs)
    k, t = F.col(f"c{place(docs, key)}"), F.col(f"c{place(docs, text)}")
    rows = rows.select(F.xxhash64(k, t.cast("string")).alias("id"), k.alias("k"), row.alias("r"))
    met = lambda g, how: rows.join(g, (F.col("id") == F.col("gid")) & F.col("k").eqNullSafe(F.col("gkey")), how)
    once = met(groups.filter("first"), "left_semi").dropDuplicates(["id", "k"])
    return unpacked(met(groups, "left_anti").unionByName(once), "r", docs)
