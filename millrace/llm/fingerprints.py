"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import named
from .words import Words, mix, mix_int, slices

#: Smaller slices than elsewhere: the sampling tables take samples x terms numbers.
_SLICE = 4 << 20


_U21, _U32 = np.float32(2.0**-21), np.float32(2.0**-32)


def sample_terms(h: np.ndarray, logw: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For sample ``k`` the log of the gamma-based race value and the quantised level of every (term hash, log weight).

    With r, c ~ Gamma(2, 1) and b ~ U(0, 1) of the term: level t = floor(log w / r + b), log y = r (t - b) and
    log a = log c - log y - r. A document's sample is the term of least a, with its level. The five uniform numbers
    behind r, c and b are cut from two 64-bit hashes of the term.
    """
    stream = (seed * 1_000_003 + k) * 2
    m = mix(h ^ np.uint64(mix_int(stream * 0x9E3779B97F4A7C15 + 1)))
    n = mix(h ^ np.uint64(mix_int((stream + 1) * 0x9E3779B97F4A7C15 + 1)))
    low = np.uint64((1 << 21) - 1)
    u = lambda bits: (bits.astype(np.float32) + np.float32(0.5)) * _U21
    r = -np.log(u(m & low) * u((m >> np.uint64(21)) & low))
    b = u((m >> np.uint64(42)) & low)
    n = n.view(np.uint32).astype(np.float32)
    n = (n + np.float32(0.5)) * _U32
    logc = np.log(-np.log(n[0::2] * n[1::2]) + np.float32(1e-30))
    t = np.floor(logw / r + b)
    return logc - r * (t - b) - r, t


def _signatures(batch: pa.RecordBatch, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x samples signature, number of distinct terms of every row); rows without words have no meaningful signature."""
    words = Words(pc.utf8_lower(batch.column(1)))
    rows = batch.num_rows
    _, term = np.unique(words.hashes(), return_inverse=True)
    terms = np.zeros(term.max() + 1 if len(term) else 0, np.uint64)
    terms[term] = words.hashes()
    # weight of a term: how often the text has it
    pair, tf = np.unique((words.owner().astype(np.uint64) << np.uint64(32)) | term.astype(np.uint64), return_counts=True)
    doc, term = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # a (term, weight) is sampled once, however many documents have it
    combo, inverse = np.unique((term.astype(np.uint64) << np.uint64(32)) | tf.astype(np.uint64), return_inverse=True)
    h = terms[(combo >> np.uint64(32)).astype(np.int64)]
    logw = np.log((combo & np.uint64(0xFFFFFFFF)).astype(np.float32))
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros((rows, samples), np.int32)
    distinct = np.bincount(doc, minlength=rows)
    if len(doc):
        owners = doc[starts]
        for k in range(samples):
            a, t = sample_terms(h, logw, k, seed)
            # least race value first, as ordered bits; equal values go to the lesser sample hash, whatever the slice
            bits = a.astype(np.float32).view(np.int32)
            bits = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64)
            race = (bits << 32) | (mix(h + t.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)).view(np.int64)
            out[owners, k] = np.minimum.reduceat(race[inverse], starts).astype(np.int32)
    return out, distinct


def fingerprint(docs: DataFrame, *, samples: int = 64, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_terms, signature): ``samples`` consistent weighted samples of a text's lower-cased words by their counts.

    Two signatures agree in a place with probability sum(min) / sum(max) of the word counts, the generalised Jaccard
    similarity; ``similarity`` estimates it. No shuffle: a document's signature depends on its text and the seed alone.

    Defined cases: a null, empty or wordless text has n_terms 0 and a null signature. The key keeps its type, a null key is
    kept as null. Repeated rows get equal rows. Race values that are equal to the last bit go to the lesser sample hash.
    Very long texts are read whole. Other columns are ignored. An empty table gives an empty table.
    """
    if samples < 1:
        raise ValueError("samples must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            sig, n = _signatures(b, samples, seed)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), samples).cast(pa.list_(pa.int32()))
            lists = pc.if_else(pa.array(n > 0), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), lists], names=["doc_id", "n_terms", "signature"])

    d = named(docs, doc_id=key, text=text).withColumn("text", F.col("text").cast("string"))
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], T.StructField("n_terms", T.IntegerType()), T.StructField("signature", T.ArrayType(T.IntegerType()))]))


def similarity(a, b):
    """Share of equal places of two signature columns: the estimate of their texts' generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)
