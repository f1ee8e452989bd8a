"""Substring deduplication: passages that occur more than once, found from fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .frames import named as chosen
from .frames import packed, place, unpacked
from .words import Words, mix, mix_int, slices, window_mask, windows

#: Marks of more than ``hot`` runs are collected and broadcast up to this number, and joined beyond it.
MAX_HOT = 100_000
#: Words of the gram that marks a window's place in the shuffle.
MARK = 9
_NONE = 31
#: Bits of the filter that passes the few texts whose rows may be extended.
FILTER_BITS = 1 << 23


def _sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every ``width`` consecutive values."""
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, step = np.arange(len(v)), 1
    pick = lambda a, b: np.where(v[b] < v[a], b, a)
    while step * 2 <= width:
        at = pick(at[:-step], at[step:])
        step *= 2
    return pick(at[:n], at[width - step : width - step + n]) if width > step else at[:n]


def _marks(words: Words, h: np.ndarray, size: int, valid: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive valid windows of ``size`` words with the same mark: first and last window, place of the
    mark and its hash. Equal windows have equal marks at equal offsets, whatever surrounds them."""
    grams = mix(windows(h, MARK) ^ np.uint64(mix_int(seed)))
    place = _sliding_argmin(grams, size - MARK + 1)
    on = np.flatnonzero(valid)
    p = place[on]
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (p[1:] != p[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(on)] - 1 if len(on) else first
    return on[first], on[last], p[first], grams[p[first]] if len(on) else grams[:0]


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Number of leading values that ``x`` and ``y`` share, compared in growing steps."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def _extended(whole: DataFrame, named: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc_id, ref_doc_id, shift, a, z), each extended left and right as far as the two texts agree in step.

    A row can grow only where the next window is a repeat too, with another reference: that is read from the rows
    alone. Of the others the two texts are met, once a pair of texts."""
    here = Window.partitionBy("id")
    before = here.orderBy("a").rangeBetween(Window.unboundedPreceding, -1)  # rows that start at a - 1 or before it
    after = here.orderBy(F.col("z").desc()).rangeBetween(Window.unboundedPreceding, -1)  # rows that end at z + 1 or after it
    grows = (F.max("z").over(before) >= F.col("a") - 1) | (F.min("a").over(after) <= F.col("z") + 1)
    whole = written(whole.withColumn("open", F.coalesce(grows, F.lit(False))), "repeats")
    pairs = whole.filter("open").groupBy("id", "ref_id").agg(F.first("doc_id").alias("doc_id"), F.first("ref_doc_id").alias("ref_doc_id"), F.sort_array(F.collect_list(F.struct("shift", "a", "z"))).alias("runs"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(FILTER_BITS, bool)
        for b in batches:
            for c in b.columns:
                on[c.to_numpy() & (FILTER_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(on).tobytes()])], names=["bits"])

    wanted = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in whole.filter("open").select("id", "ref_id").coalesce(16).mapInArrow(bits, "bits binary").collect():
        wanted |= np.frombuffer(r[0], np.uint8)
    sent = named.sparkSession.sparkContext.broadcast(wanted)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy() & (FILTER_BITS - 1)
            yield b.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7))) & 1 == 1))

    texts = named.select("id", "text").mapInArrow(passed, "id long, text string").groupBy("id").agg(F.first("text").alias("text"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "text"), "ref_text"):
            w, v = Words(b.column(3)), Words(b.column(4))
            hw, hv = w.hashes(), v.hashes()
            out: list[tuple[int, int, int, int]] = []
            for i, runs in enumerate(b.column(2).to_pylist()):
                x, y = hw[w.bounds[i] : w.bounds[i + 1]], hv[v.bounds[i] : v.bounds[i + 1]]
                last = (None, 0)
                for run in runs:
                    d, a, end = run["shift"], run["a"], run["z"] + min_words
                    if last[0] == d and end <= last[1]:
                        continue  # inside the row before it
                    end += _same(x[end:], y[end + d :])
                    a -= _same(x[:a][::-1], y[: a + d][::-1])
                    out.append((i, d, a, end - min_words))
                    last = (d, end)
            rows, d, a, z = (pa.array([o[j] for o in out], pa.int32()) for j in range(4))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), d, a, z], names=["doc_id", "ref_doc_id", "shift", "a", "z"])

    met = pairs.join(texts, "id").join(texts.select(F.col("id").alias("ref_id"), F.col("text").alias("ref_text")), "ref_id")
    met = met.select("doc_id", "ref_doc_id", "runs", "text", "ref_text")
    grown = met.mapInArrow(extend, T.StructType([met.schema["doc_id"], met.schema["ref_doc_id"], *(T.StructField(c, T.IntegerType()) for c in ("shift", "a", "z"))]))
    return whole.filter("not open").select("doc_id", "ref_doc_id", "shift", "a", "z").unionByName(grown)


def _ordered() -> list[Column]:
    return [F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("id"), F.col("s")]


def _least_places(each: DataFrame) -> DataFrame:
    """Windows with the least other place that has the same, ``ref``; windows of one place alone go. One group is in one task."""
    order = Window.partitionBy("g", "h").orderBy(*_ordered())
    spot = F.struct(*_ordered())
    return each.withColumn("ref", F.when(F.row_number().over(order) == 1, F.lead(spot).over(order)).otherwise(F.first(spot).over(order))).filter("ref is not null")


def _least_places_spread(each: DataFrame) -> DataFrame:
    """The same for groups of any size: a group's least place and its second least come from sums of partial minima, and its
    rows meet them by joins that split a large group."""
    spot = F.struct(*_ordered())
    least = each.groupBy("g", "h").agg(F.min(spot).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "h", "least")
    met = each.join(least, ["g", "h"])
    second = met.filter(spot != F.col("least")).groupBy("g", "h").agg(F.min(spot).alias("ref"))
    others = met.filter(spot != F.col("least")).withColumnRenamed("least", "ref")
    return others.unionByName(met.filter(spot == F.col("least")).drop("least").join(second, ["g", "h"]))


def find_repeats(docs: DataFrame, *, min_words: int = 50, block: int = 25, maximal: bool = False, hot: int = 100_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, ref_doc_id, ref_start_word): every passage of at least ``min_words`` words that
    occurs in another place too, and one such place.

    Index: every text's non-overlapping blocks of ``block`` words. Probe: every rolling window of as many words. A
    passage of min_words >= 2 x block - 1 words holds a whole block of its text, so no repeat is missed. Blocks and
    probes meet by a mark, the least hashed 9-word gram of a window: windows that are equal have it in the same place,
    and consecutive windows with one mark travel as one row, so a shuffle of about a row per ten words probes all windows.
    Extension: around the hits all windows of ``min_words`` words are compared, again a row per run of windows with one
    mark, and those that meet the same place in step are joined to maximal runs. Work grows with the number of places
    and not with that of pairs: a window's reference is the least other place (doc_id, then word) that has it.

    A row ends where its windows' least place changes, so inside a longer copy of two texts a passage that a lesser text
    has too cuts rows short. With ``maximal`` every row is then extended left and right over both texts until words
    differ, and rows that become equal are one: each is a maximal repeat of its text and its reference. Only the
    references of windows are named, so two texts all of whose common windows occur in lesser ones have no row together.

    A word is a run of ASCII letters, digits and underscores and of other characters beyond ASCII; case counts, what
    lies between words doesn't. Windows of one row overlap or touch and all equal the reference's words in step.

    A mark of more than ``hot`` runs of windows isn't sorted in one task: its least places are found by partial minima. The result
    is the same.

    Defined cases: null and empty texts and texts shorter than ``min_words`` have no rows. The key keeps its type; a null key is kept as null
    and comes after all others. Very long texts are read whole. Rows of equal key and text count once; equal keys with different texts are different places.
    A passage repeated inside one text refers to its own document. Other columns are ignored. An empty table gives an
    empty table. Texts are told apart by 64-bit hashes of key and text, windows by 64-bit hashes and their mark's.
    """
    whole, named = _repeats(docs, min_words, block, hot, key, text)
    if maximal:
        whole = _extended(whole, named, min_words)
    return whole.select("doc_id", F.col("a").alias("start_word"), (F.col("z") - F.col("a") + min_words).alias("n_words"), "ref_doc_id", (F.col("a") + F.col("shift")).alias("ref_start_word"))


def _repeats(docs: DataFrame, min_words: int, block: int, hot: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(runs of windows with one reference in step as id, doc_id, ref_id, ref_doc_id, shift, a, z; texts as id, doc_id, text)."""
    if block <= MARK or block - MARK >= _NONE or min_words < 2 * block - 1:
        raise ValueError(f"block must lie in {MARK + 1}..{MARK + _NONE - 1} and min_words be at least 2 x block - 1")
    named = chosen(docs, doc_id=key, text=text).select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") >= 2 * min_words - 1)
    named = named.select(F.xxhash64("doc_id", "text").alias("id"), "doc_id", "text")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(b.column(1))
            s0, s1, p, g = _marks(w, h := w.hashes(), block, window_mask(w, block), 1) if len(w) >= block else [np.zeros(0, np.int64)] * 4
            owner = np.searchsorted(w.bounds, s0, "right") - 1
            base = w.bounds[owner]
            aligned = -(-(s0 - base) // block) * block + base
            own = np.where(aligned <= s1, p - aligned, _NONE)
            x = ((p - base) << 15) | ((p - s1) << 10) | ((p - s0) << 5) | own
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column(0).take(pa.array(owner)), pa.array(x)], names=["g", "id", "x"])

    bits = lambda at, n: F.shiftright("x", at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    met = named.select("id", "text").mapInArrow(probes, "g long, id long, x long")
    met = met.withColumn("own", bits(0, 5))
    # a mark's places are only counted where they lie: a mark that a third of all texts have is never in one task
    marks = met.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.when(F.col("own") < _NONE, F.expr("shiftleft(1, own)")).otherwise(0)).alias("blocks"))
    met = met.join(marks.filter("n > 1 and blocks != 0").select("g", "blocks"), "g")
    # the bits of offsets lo..hi at which the group has a block
    span = F.expr(f"(shiftleft(1L, cast((x >> 5) & 31 as int) + 1) - 1) & ~(shiftleft(1L, cast((x >> 10) & 31 as int)) - 1) & cast(blocks as bigint) & {(1 << _NONE) - 1}L")
    hits = met.withColumn("m", span).filter("m != 0").groupBy("id").agg(F.collect_list(F.expr("shiftleft(shiftright(x, 15), 32) | m")).alias("hits"))

    def extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(b.column(2))
            if len(w) < min_words:
                continue
            h = w.hashes()
            lists = b.column(3)
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            place, mask = (flat >> 32) + w.bounds[row], flat & 0xFFFFFFFF
            near = np.zeros(len(w) + 1, np.int64)
            for o in range(block - MARK + 1):
                start = (place - o)[(mask >> o) & 1 == 1]
                np.add.at(near, np.maximum(start + block - min_words, 0), 1)
                np.add.at(near, start + 1, -1)
            valid = window_mask(w, min_words)
            valid &= np.cumsum(near)[: len(valid)] > 0
            s0, s1, p, g = _marks(w, h, min_words, valid, 2)
            owner = np.searchsorted(w.bounds, s0, "right") - 1
            base = w.bounds[owner]
            values = windows(h, min_words)[np.flatnonzero(valid)].view(np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(s1 - s0 + 1)].astype(np.int32)), pa.array(values))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column(1).take(take), b.column(0).take(take), pa.array((s0 - base).astype(np.int32)), hashes], names=["g", "doc_id", "id", "s", "hashes"])

    shape = T.StructType([T.StructField("g", T.LongType()), named.schema["doc_id"], T.StructField("id", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    found = written(named.join(hits, "id").select("id", "doc_id", "text", "hits").mapInArrow(extensions, shape), "runs")
    sizes = found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("g")
    often = [r[0] for r in sizes.limit(MAX_HOT + 1).collect()]
    spread = lambda d: d.select("g", "doc_id", "id", F.col("s").alias("s0"), F.posexplode("hashes").alias("i", "h")).withColumn("s", F.col("s0") + F.col("i"))
    if not often:
        each = _least_places(spread(found.repartition("g").dropDuplicates(["g", "id", "s"])))
    else:
        table = F.broadcast(named.sparkSession.createDataFrame([(x,) for x in often], "g long")) if len(often) <= MAX_HOT else sizes
        cold = found.join(table, "g", "left_anti").repartition("g").dropDuplicates(["g", "id", "s"])
        warm = found.join(table, "g", "left_semi").dropDuplicates(["g", "id", "s"])
        each = _least_places(spread(cold)).unionByName(_least_places_spread(spread(warm)))
    runs = each.groupBy("g", "doc_id", "id", "s0", F.col("ref.doc_id").alias("ref_doc_id"), F.col("ref.id").alias("ref_id"), (F.col("ref.s") - F.col("s")).alias("shift")).agg(F.min("s").alias("a"), F.max("s").alias("z"))
    along = Window.partitionBy("id", "ref_id", "shift").orderBy("a")
    runs = runs.withColumn("new", (F.col("a") > F.coalesce(F.max("z").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1 << 30)) + min_words).cast("int"))
    runs = runs.withColumn("island", F.sum("new").over(along))
    whole = runs.groupBy("id", "ref_id", "shift", "island").agg(F.first("doc_id").alias("doc_id"), F.first("ref_doc_id").alias("ref_doc_id"), F.min("a").alias("a"), F.max("z").alias("z"))
    return whole, named


def drop_repeats(docs: DataFrame, *, min_words: int = 50, block: int = 25, hot: int = 100_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every repeated passage of at least ``min_words`` words cut out of all places but the least one (doc_id, then
    word) that has it; what lies between a cut passage's words goes with them.

    Rows of ``find_repeats`` whose reference comes before them are cut, so the first place of every passage stays whole. Defined cases
    are those of ``find_repeats``; texts without a cut pass as they are, and a text that is all cut becomes empty. A text that
    repeats itself in overlap keeps its first period. Rows of equal key and text are cut alike and all stay. Columns of any name may be there.
    """
    whole, _ = _repeats(docs, min_words, block, hot, key, text)
    spot = lambda of, id, at: F.struct(F.col(of).isNull(), F.col(of), F.col(id), at)
    later = spot("ref_doc_id", "ref_id", F.col("a") + F.col("shift")) < spot("doc_id", "id", F.col("a"))
    cuts = whole.filter(later).groupBy("id").agg(F.collect_list(F.expr(f"shiftleft(cast(a as bigint), 32) | (z + {min_words})")).alias("cuts"))
    rows, row = packed(docs)
    k, t = F.col(f"c{place(docs, key)}"), F.col(f"c{place(docs, text)}")
    rows = rows.select(F.xxhash64(k, t.cast("string")).alias("id"), t.cast("string").alias("text"), row.alias("r")).join(cuts, "id", "left")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for x, some in zip(texts, spans):
            w = Words(pa.array([x]))
            keep = np.ones(len(w.buf), bool)
            for a, z in ((int(s) >> 32, (int(s) & 0xFFFFFFFF) - 1) for s in some):
                keep[w.starts[a] : w.starts[z] + w.lens[z]] = False
            n = int(w.offsets[-1])
            out.append(w.buf[:n][keep[:n]].tobytes().decode("utf-8"))
        return pd.Series(out, dtype=object)

    changed = rows.filter("cuts is not null").withColumn("text", cut("text", "cuts"))
    whole = rows.filter("cuts is null").unionByName(changed)
    kind = docs.schema[place(docs, text)].dataType
    return unpacked(whole.withColumn("r", F.col("r").withField(f"c{place(docs, text)}", F.col("text").cast(kind))), "r", docs)
