"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import named, place
from .words import Words, slices

#: Texts that are searched for at once: their scores against all examples are held together.
_BATCH = 128
#: Examples that are indexed at once.
_PART = 1024
#: Beyond rounding of sums in single precision, so that no tie is lost.
_SLACK = np.float32(4e-6)


class Vocabulary:
    """Numbers of known word hashes: an open-addressing table, looked up for whole arrays at once."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, self.size, self.slots = hashes, len(hashes), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"slots": None}  # made where it is used: it needn't be sent

    def _fill(self) -> None:
        hashes = self.hashes
        bits = max(10, (2 * self.size).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(self.size, dtype=np.int32)
        at = hashes & self.mask
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[won]] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + np.uint64(1)) & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The number of every hash, -1 where it isn't known."""
        out = np.full(len(h), -1, np.int32)
        if not self.size:
            return out
        if self.slots is None:
            self._fill()
        left, at = np.arange(len(h)), h & self.mask
        while len(left):
            slot = self.slots[at]
            hit = (self.hashes[slot] == h[left]) & (slot >= 0)
            out[left[hit]] = slot[hit]
            on = ~hit & (slot >= 0)
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return out


def _counts(texts: pa.Array, known: Vocabulary | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds by text, terms, their counts) of lower-cased texts; terms are numbers in ``known``, or word hashes."""
    words = Words(pc.utf8_lower(texts))
    owner, h = words.owner(), words.hashes()
    if known is not None:
        term = known(h)
        there = term >= 0
        pair, tf = np.unique((owner[there].astype(np.int64) << 32) | term[there], return_counts=True)
        owner, term = pair >> 32, pair & 0xFFFFFFFF
    else:
        order = np.lexsort((h, owner))
        owner, term = owner[order], h[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])]) if len(term) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[first, len(term)])
        owner, term = owner[first], term[first]
    return np.searchsorted(owner, np.arange(len(texts) + 1)), term, tf


class BlockMaxIndex:
    """Inverted lists of the examples' unit TF-IDF vectors, in blocks of ``block`` examples.

    Lists of terms that more than 1/``dense`` of the examples have are kept block by block with the greatest weight of each
    block. Shorter lists have about one posting in a block, so that a posting is its block's maximum; they are kept as postings.

    ``search`` is exact. Short lists are summed first. A block's bound is its best sum so far, plus, over the long lists,
    query weight times block maximum. The most promising blocks get their long lists added; then every other block whose
    bound reaches the k-th best sum does. The rest can't hold one of the k nearest.
    """

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, weights: Callable[[int, int], np.ndarray], n_terms: int, block: int = 32, dense: int = 16) -> None:
        """``bounds[i]:bounds[i + 1]`` are example i's terms; ``weights(a, z)`` gives those of examples a to z, which are taken a
        few at a time, so hardly more than the lists themselves is held."""
        self.n = n = len(bounds) - 1
        df = np.bincount(terms, minlength=n_terms)
        longs = np.flatnonzero(df * dense > n)
        self.long_of = np.full(n_terms, -1, np.int32)
        self.long_of[longs] = np.arange(len(longs))
        lead = np.full(n, len(longs))

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for a in range(0, n, _PART):
                z = min(n, a + _PART)
                t = terms[bounds[a] : bounds[z]]
                yield np.repeat(np.arange(a, z), np.diff(bounds[a : z + 1])), t, weights(a, z), self.long_of[t]

        # examples whose weightiest long term is the same lie together: texts of one language share blocks
        for row, _, w, of in parts():
            on = np.flatnonzero(of >= 0)
            by = on[np.lexsort((w[on], row[on]))]
            lead[row[by]] = of[by]  # an example's last is its weightiest
        self.example = np.lexsort((np.arange(n), lead))  # place in the blocks -> example
        self.place = np.empty(n, np.int64)
        self.place[self.example] = np.arange(n)
        blocks = -(-n // block)
        lists = np.zeros((blocks * block, len(longs)), np.float32)
        df[longs] = 0
        self.ptr = np.r_[0, np.cumsum(df)]
        self.post, self.value = np.empty(self.ptr[-1], np.int32), np.empty(self.ptr[-1], np.float32)
        free = self.ptr[:-1].copy()
        for row, t, w, of in parts():
            on = of >= 0
            lists[self.place[row[on]], of[on]] = w[on]
            short = np.flatnonzero(~on)
            short = short[np.argsort(t[short], kind="stable")]
            term, first, size = np.unique(t[short], return_index=True, return_counts=True)
            to = np.arange(len(short)) + np.repeat(free[term] - first, size)
            self.post[to], self.value[to] = self.place[row[short]], w[short]
            free[term] += size
        self.lists = lists.reshape(blocks, block, len(longs))
        self.maxima = np.ascontiguousarray(self.lists.max(axis=1).T)

    def search(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every query (examples, cosines) of its k nearest with cosine above 0, but for the example ``without``;
        ties go to the lesser example."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(bounds) - 1, _BATCH):
            out += self._batch(bounds[a : a + _BATCH + 1], terms, weights, k, without[a : a + _BATCH])
        return out

    def _batch(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        q, (blocks, block, width) = len(bounds) - 1, self.lists.shape
        cells = blocks * block
        sums = np.zeros((q, cells), np.float32)
        dense = np.zeros((q, width), np.float32)
        for i in range(q):
            t, w = terms[bounds[i] : bounds[i + 1]], weights[bounds[i] : bounds[i + 1]]
            of = self.long_of[t]
            dense[i, of[of >= 0]] = w[of >= 0]
            first, size = self.ptr[t], self.ptr[t + 1] - self.ptr[t]
            ends = np.cumsum(size)
            if len(ends) and ends[-1]:
                at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
                sums[i] = np.bincount(self.post[at], self.value[at] * np.repeat(w, size), minlength=cells)
        mine = np.flatnonzero(without >= 0)
        sums[mine, self.place[without[mine]]] = -np.inf
        bound = sums.reshape(q, blocks, block).max(axis=2) + dense @ self.maxima
        kth = np.zeros(q, np.float32)
        eager = np.argpartition(-bound, min(blocks, 2 + k) - 1, axis=1)[:, : 2 + k]
        done = np.zeros((q, blocks), bool)
        done[np.arange(q)[:, None], eager] = True
        ask = done
        for last in (False, True):
            for b in np.flatnonzero(ask.any(axis=0)):
                who = np.flatnonzero(ask[:, b])
                sums[who, b * block : (b + 1) * block] += dense[who] @ self.lists[b].T
            if not last:
                if cells > k:
                    first = np.take_along_axis(sums.reshape(q, blocks, block), eager[:, :, None], axis=1).reshape(q, -1)
                    kth = np.maximum(0, -np.partition(-first, k - 1, axis=1)[:, k - 1])
                ask = (bound >= (kth - _SLACK)[:, None]) & (bound > 0) & ~done
                done |= ask
        out = []
        for i in range(q):
            at = np.flatnonzero((sums[i] >= kth[i] - _SLACK) & (sums[i] > 0))
            at = at[done[i, at // block]]
            s, e = sums[i, at], self.example[np.minimum(at, self.n - 1)]
            best = np.lexsort((e, -np.round(s, 6)))[:k]
            out.append((e[best], s[best]))
        return out


class Examples:
    """The labelled examples as they are sent to the tasks: vocabulary, term weights and counts. A worker makes the index of them once."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tf: np.ndarray, ids: pa.Array, labels: np.ndarray) -> None:
        self.known, self.bounds, self.terms, self.tf, self.ids, self.labels = Vocabulary(hashes), bounds, terms, tf, ids, labels
        self.idf = np.ones(len(hashes), np.float32)  # times the relevance of every term
        self._index: BlockMaxIndex | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    @property
    def index(self) -> BlockMaxIndex:
        if self._index is None:
            of = lambda x, a, z: x[self.bounds[a] : self.bounds[z]]
            weights = lambda a, z: self.vectors(self.bounds[a : z + 1] - self.bounds[a], of(self.terms, a, z), of(self.tf, a, z))
            self._index = BlockMaxIndex(self.bounds, self.terms, weights, self.known.size)
        return self._index

    def vectors(self, bounds: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Unit vectors of texts: weights of their terms."""
        w = ((1 + np.log(tf, dtype=np.float64)) * self.idf[terms]).astype(np.float32)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        norm = np.sqrt(np.bincount(row, w.astype(np.float64) ** 2, minlength=len(bounds) - 1))
        return (w / norm[row]).astype(np.float32)

    def near(self, bounds: np.ndarray, terms: np.ndarray, tf: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(votes, nearest examples and cosines); a vote is their cosine-weighted share of toxic ones, NaN where there are none."""
        found = self.index.search(bounds, terms, self.vectors(bounds, terms, tf), k, own)
        return np.array([float((c * self.labels[e]).sum() / c.sum()) if len(e) else np.nan for e, c in found]), found


@dataclass
class ToxicityModel:
    examples: Examples
    sent: Broadcast
    k: int
    knots: tuple[np.ndarray, np.ndarray]
    none_rate: float

    def scorer(self) -> Callable[[pa.Array, pa.Array, bool], tuple[np.ndarray, list[list[str]]]]:
        """For tasks: scores and evidence of texts."""
        sent, k, knots, none_rate = self.sent, self.k, self.knots, self.none_rate

        def scores(ids: pa.Array, texts: pa.Array, explain: bool) -> tuple[np.ndarray, list[list[str]]]:
            m = sent.value
            own = pc.fill_null(pc.index_in(ids, value_set=m.ids.cast(ids.type)), -1).to_numpy(zero_copy_only=False)
            votes, near = m.near(*_counts(texts, m.known), own, k)
            names: list[list[str]] = []
            if explain:
                shown = lambda e, c: f"{m.ids[e].as_py()} {'toxic' if m.labels[e] else 'clean'} {c:.4f}"
                names = [[shown(int(e), c) for e, c in zip(es, cs)] for es, cs in near]
            return np.where(np.isnan(votes), none_rate, np.interp(votes, *knots)), names

        return scores


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over the sorted distinct votes; every pool's rate is drawn to 1/2 by one example."""
    values, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # sum of x, sum of y, n
    for v, s, n in zip(values.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist()):
        pools.append([v * n, s, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            p = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], p)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """What a term's weight is multiplied by: the root of how many times as often toxic examples have it as clean ones,
    from add-one counts, and at least 1, so no term loses weight and none goes."""
    return np.sqrt(np.maximum(1.0, ((toxic + 1) / (n_toxic + 2)) / ((clean + 1) / (n_clean + 2))))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_labelled: int = 20_000,
    k: int = 15,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> ToxicityModel | None:
    """The model, or None where the labels have no toxic or no clean document with words.

    At most ``max_labelled`` labelled documents are used: those of the least hashed id. Of them only texts without a word and
    exact copies (equal text and label; the least id stays) are no examples; of several texts with one id the one of the least digest is it. Terms are all lower-cased words of the examples.
    A term's weight is (1 + log of its count) times its inverse document frequency, counted over all documents, times
    its ``relevance`` to the labels. Votes are calibrated by leaving each example out of its own neighbours.
    """
    spark = docs.sparkSession
    d = named(docs, doc_id=key, text=text).select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    kind = d.schema["doc_id"].dataType
    lab = named(labels, doc_id=key, y=label).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("y").cast("int").alias("y")).dropna().groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    picked = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    mine = d.join(F.broadcast(picked), "doc_id").filter(F.col("text").rlike(r"[0-9A-Za-z_]|[^\x00-\x7F]"))
    mine = mine.withColumn("m", F.sha2("text", 256)).groupBy("doc_id", "y").agg(F.min("m").alias("m"), F.min_by("text", "m").alias("text"))
    once = mine.groupBy("y", "m").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text")).select("doc_id", "y", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            bounds, h, tf = _counts(b.column(2), None)
            cells = [[x[i:j].tobytes() for i, j in zip(bounds, bounds[1:])] for x in (h, tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.binary()) for c in cells)], names=["doc_id", "y", "h", "tf"])

    shape = T.StructType([T.StructField("doc_id", kind), T.StructField("y", T.IntegerType()), T.StructField("h", T.BinaryType()), T.StructField("tf", T.BinaryType())])
    found = once.mapInArrow(counted, shape).toArrow().combine_chunks()
    y = found.column("y").to_numpy().astype(np.float32)
    n_toxic, n_clean = int(y.sum()), int(len(y) - y.sum())
    if not n_toxic or not n_clean:
        return None
    order = pc.sort_indices(found, [("doc_id", "ascending")]).to_numpy()
    ids, y = found.column("doc_id").combine_chunks().take(pa.array(order)), y[order]
    size = pc.binary_length(found.column("tf")).to_numpy().astype(np.int64) // 4
    flat = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_buffer(), t) for x in found.column(c).chunk(0))])
    h, tf = flat("h", np.uint64), flat("tf", np.int32)
    del found
    distinct = np.unique(h)
    number = Vocabulary(distinct)
    terms = np.concatenate([number(x) for x in np.array_split(h, len(h) // 500_000 + 1)])
    del h, number
    bounds = np.r_[0, np.cumsum(size[order])]
    at = np.arange(bounds[-1], dtype=np.int32) + np.repeat(((np.cumsum(size) - size)[order] - bounds[:-1]).astype(np.int32), size[order])
    given = Examples(distinct, bounds, terms[at], tf[at].astype(np.min_scalar_type(int(tf.max()))), ids, y)
    del terms, tf, at
    sent = spark.sparkContext.broadcast(given.known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(sent.value.size, np.int64), 0
        for b in slices(batches, "text"):
            total += np.bincount(_counts(b.column(0), sent.value)[1], minlength=len(total))
            seen += b.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[seen, total[some]])], names=["t", "n"])

    stats = d.select("text").mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    sent.unpersist()
    t, n = stats.column("t").to_numpy(), stats.column("n").to_numpy()
    df = np.zeros(len(distinct))
    df[t[t >= 0]] = n[t >= 0]
    has = np.bincount(given.terms, y[np.repeat(np.arange(len(y)), np.diff(bounds))], minlength=len(distinct))
    lift = relevance(has, np.bincount(given.terms, minlength=len(distinct)) - has, n_toxic, n_clean)
    given.idf = ((np.log((n[t < 0].sum() + 1) / (df + 1)) + 1) * lift).astype(np.float32)
    sent_examples = spark.sparkContext.broadcast(given)

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent_examples.value
        for b in batches:
            own = b.column(0).to_numpy()
            for e in np.array_split(own, len(own) // 256 + 1):
                size = np.diff(m.bounds)[e]
                cuts = np.r_[0, np.cumsum(size)]
                at = np.arange(cuts[-1]) + np.repeat(m.bounds[e] - cuts[:-1], size)
                yield pa.RecordBatch.from_arrays([pa.array(m.near(cuts, m.terms[at], m.tf[at], e, k)[0]), pa.array(m.labels[e])], names=["vote", "y"])

    parts = max(1, min(len(y) // 500, spark.sparkContext.defaultParallelism * 2))
    tried = spark.range(0, len(y), 1, parts).mapInArrow(leave_out, "vote double, y float").toArrow()
    votes, truth = tried.column("vote").to_numpy(), tried.column("y").to_numpy().astype(float)
    alone = np.isnan(votes)
    knots = _monotone(votes[~alone], truth[~alone]) if not alone.all() else (np.zeros(1), np.zeros(1))
    return ToxicityModel(given, sent_examples, k, knots, float((truth[alone].sum() + n_toxic / len(y)) / (alone.sum() + 1)))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, key: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """(doc_id, score, toxic, evidence) of every row of ``docs``.

    ``score`` is the calibrated share of toxic ones among the k nearest labelled examples by TF-IDF cosine over all words of
    the examples (see ``fit_toxicity``), weighted by cosine; ``evidence`` names them as "id label cosine", nearest first.
    A document that is an example itself is not its own neighbour, while an exact copy of it is near to it. The model is
    fitted on a bounded number of labelled rows, so what is broadcast doesn't grow with the corpus; documents are scored
    without a shuffle.

    Defined cases: texts that are null or empty or have no word of an example score the rate of toxic examples among those that have
    no neighbour (with the whole share of toxic examples counted as one more) and have no evidence. With no toxic or no
    clean example the score is null and nothing is toxic. The key keeps its type, a null key is kept as null. Repeated rows
    score alike. Equal cosines go to the lesser example id. Several labels of one document count as toxic if one is. Very
    long texts are read whole. Other columns are ignored. An empty table gives an empty table.
    """
    d = named(docs, doc_id=key, text=text).withColumn("text", F.col("text").cast("string"))
    kind = d.schema["doc_id"].dataType
    model = fit_toxicity(docs, labels, key=key, text=text, **fit)
    scores = model.scorer() if model else lambda ids, texts, _: (np.full(len(texts), np.nan), [[]] * len(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            score, evidence = scores(b.column(0), b.column(1), True)
            values = [b.column(0), pa.array(score, pa.float64(), from_pandas=True), pa.array(np.nan_to_num(score) >= threshold), pa.array(evidence, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "score", "toxic", "evidence"])

    shape = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType()), T.StructField("evidence", T.ArrayType(T.StringType()))])
    return d.mapInArrow(run, shape)


def keep_clean(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, key: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` doesn't call toxic, with all their columns; whole rows pass the scorer,
    so there is no join and no shuffle. Cases are defined as there."""
    model = fit_toxicity(docs, labels, key=key, text=text, **fit)
    if model is None:
        return docs
    scores = model.scorer()
    k, t = place(docs, key), place(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, t):
            yield b.filter(pa.array(~(scores(b.column(k), b.column(t), False)[0] >= threshold)))

    return docs.mapInArrow(run, docs.schema)
