"""Token ids packed by best-fit decreasing into fixed rows, and their binary form."""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import named
from .words import Words, slices

#: Where the vocabulary files of public tokenizers lie by default; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level BPE of that kind cuts a text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(*spans: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, z in spans:
        t[a : z + 1] = True
    return t


_SOLID = _table((0x21, 0x7E), (0xC3, 0xDF), (0xE4, 0xF4))  # first bytes of characters that are no white space
_LOOSE = _table((0, 0x20), (0x7F, 0x7F), (0xC2, 0xC2), (0xE1, 0xE3))  # of characters that may be
_NEWLINE, _SPACE = 10, 32


class Encoder:
    """Ids of texts by a vocabulary file: ``.tiktoken`` ranks of a byte-level BPE, or a ``tokenizers`` JSON file.

    Byte-level BPE with this pattern starts afresh at a space before a visible character and around a lone newline
    between visible characters. Texts of a slice are cut there, and each distinct unit is encoded once, all of them in
    one call with newlines between them. Units with other white space in them are encoded one by one. Vocabularies of
    other kinds encode whole texts.
    """

    def __init__(self, path: str) -> None:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.bpe = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.newline = ranks[b"\n"]
            size, self.by_unit = max(ranks.values()) + 2, True
            self.ids = lambda text: self.bpe.encode_to_numpy(text, disallowed_special=())
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            t.no_padding()
            t.no_truncation()
            size, self.by_unit = t.get_vocab_size(), False
            self.ids = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's ids begin; null texts have none."""
        if not self.by_unit:
            return self._whole(texts)
        words = Words(texts)
        buf, offs = words.buf, words.offsets
        n = int(offs[-1])
        body = buf[:n]
        cut = np.zeros(n + 1, bool)
        solid = _SOLID[buf[1 : n + 1]]
        inner = np.ones(n, bool)  # not the last byte of its text
        inner[offs[1:][offs[1:] > 0] - 1] = False
        cut[:n] = (body == _SPACE) & solid & inner
        nl = np.flatnonzero((body == _NEWLINE) & solid & inner)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        nl = nl[(nl > 0) & ~first[nl]]
        before = buf[nl - 1]
        nl = nl[((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (before < 0xC0) & (buf[nl - 2] >= 0xC3) & (buf[nl - 2] < 0xE0))]
        cut[nl] = cut[nl + 1] = True
        cut |= first
        starts = np.flatnonzero(cut[:n])
        lens = np.diff(np.r_[starts, n])
        h = _span_hashes(buf, starts, lens)
        _, rep, unit = np.unique(h, return_index=True, return_inverse=True)
        at = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), shape=(len(buf) - 7,), strides=(1,))
        same = (lens == lens[rep][unit]) & ((at[starts] == at[starts[rep]][unit]) | (lens < 8))
        if not same.all():
            return self._whole(texts)
        loose = np.r_[0, np.cumsum(_LOOSE[body])]
        ustart, ulen = starts[rep], lens[rep]
        odd = loose[ustart + ulen] - loose[ustart] - (buf[ustart] == _SPACE) > 0
        plain = np.flatnonzero(~odd)
        flat, size = np.zeros(0, np.uint32), np.zeros(len(rep), np.int64)
        if len(plain):
            step = ulen[plain] + 1  # and a newline
            ends = np.cumsum(step)
            src = np.arange(ends[-1]) + np.repeat(ustart[plain] - (ends - step), step)
            joined = buf[src]
            joined[ends - 1] = _NEWLINE
            flat = self.ids(joined.tobytes().decode("utf-8"))
            marks = np.flatnonzero(flat == self.newline)
            if len(marks) != len(plain):
                return self._whole(texts)
            size[plain] = np.diff(np.r_[-1, marks]) - 1
        where = np.zeros(len(rep), np.int64)
        where[plain] = np.r_[0, marks[:-1] + 1] if len(plain) else 0
        extra, total = [flat], len(flat)
        for u in np.flatnonzero(odd).tolist():
            x = self.ids(buf[ustart[u] : ustart[u] + ulen[u]].tobytes().decode("utf-8"))
            where[u], size[u] = total, len(x)
            extra.append(x)
            total += len(x)
        flat = np.concatenate(extra)
        k = size[unit]
        ends = np.r_[0, np.cumsum(k)]
        ids = flat[np.arange(ends[-1]) + np.repeat(where[unit] - ends[:-1], k)].astype(self.dtype)
        return ids, ends[np.searchsorted(starts, offs)]

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = [self.ids(t or "") for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, self.dtype), *each]).astype(self.dtype), np.cumsum([0, *map(len, each)])


def _span_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    spans = Words.__new__(Words)
    spans.buf, spans.starts, spans.lens = buf, starts, lens
    return spans.hashes()


@lru_cache(maxsize=2)
def encoder_at(path: str) -> Encoder:
    """The worker's encoder: vocabulary and units are kept between tasks."""
    return Encoder(path)


class CapacityTree:
    """Rows by free capacity: a segment tree over capacities tells the least one that fits and has a row."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        if len(self.rows[free]) == 1:
            i = self.size + free
            while i and not self.count[i]:
                self.count[i] = 1
                i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of a row with the least capacity of at least ``need``, taken out."""
        i = self.size + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        row = self.rows[free].pop()
        if not self.rows[free]:
            i = self.size + free
            self.count[i] = 0
            i >>= 1
            while i and not (self.count[2 * i] or self.count[2 * i + 1]):
                self.count[i] = 0
                i >>= 1
        return free, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of every row: items longest first (ties by number), each into the fullest row that has room."""
    tree = CapacityTree(capacity)
    rows: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        hit = tree.take(n)
        if hit is None:
            free, row = capacity, len(rows)
            rows.append([])
        else:
            free, row = hit
        rows[row].append(i)
        if free - n:
            tree.add(free - n, row)
    return rows


def _pieces(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first token and length of the pieces of at most ``capacity`` tokens of texts of ``n`` tokens."""
    k = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), k)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * capacity
    return doc, start, np.minimum(capacity, n[doc] - start)


def pack_token_ids(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    tokenizer: str = TOKENIZER,
    pad_id: int = 50256,
    group_bytes: int = 32 << 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows of ``capacity`` token ids, each filled with whole documents or pieces of overlong ones.

    input_ids: the row's ids, little-endian, 2 bytes where the vocabulary has at most 65,536 entries, else 4, padded with
    ``pad_id``. cu_seqlens: 0 and the running ends of the segments (padding is no segment). position_resets: the starts
    of the segments, where positions begin at 0 again. doc_ids and doc_starts: every segment's document and its first
    token in it; putting pieces together by them gives all ids back.

    Documents are packed where they are read: a task packs its texts in groups of about ``group_bytes`` by best-fit
    decreasing, so nothing is shuffled and no task needs more than a group in memory. A full group leaves less than one
    part-filled row in a hundred; the last group of a task is smaller, so many small splits leave more of them. ``shard`` and ``row`` name a row.

    Defined cases: null and empty texts have no tokens and appear in no row. The key keeps its type, a null key is kept as
    null. Repeated rows are packed as documents of their own. Special tokens' strings in a text are ordinary text. Very long
    texts are encoded whole and cut between tokens. Other columns are ignored. An empty table gives an empty table.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, group = context.partitionId() if context else 0, 0
        encoder = encoder_at(tokenizer)
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for b in slices(batches, "text", 8 << 20):
            fresh, bounds = encoder.encode(b.column(1))
            keys.append(b.column(0))
            ids.append(fresh)
            sizes.append(np.diff(bounds))
            held += fresh.nbytes
            if held >= group_bytes:
                yield from _rows(f"{part:06d}-{group:04d}", pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(sizes), capacity, pad_id)
                keys, ids, sizes, held, group = [], [], [], 0, group + 1
        if keys:
            yield from _rows(f"{part:06d}-{group:04d}", pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(sizes), capacity, pad_id)

    d = named(docs, doc_id=key, text=text).withColumn("text", F.col("text").cast("string"))
    kinds = {"shard": T.StringType(), "row": T.IntegerType(), "n_tokens": T.IntegerType(), "input_ids": T.BinaryType(), "cu_seqlens": T.ArrayType(T.IntegerType()), "position_resets": T.ArrayType(T.IntegerType()), "doc_ids": T.ArrayType(d.schema["doc_id"].dataType), "doc_starts": T.ArrayType(T.LongType())}
    return d.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in kinds.items()]))


def _rows(shard: str, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray, capacity: int, pad_id: int) -> Iterator[pa.RecordBatch]:
    doc, start, length = _pieces(sizes, capacity)
    first = (np.cumsum(sizes) - sizes)[doc] + start
    packed = best_fit_decreasing(length, capacity)
    schema = pa.schema([("shard", pa.string()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), *((c, pa.list_(pa.int32())) for c in ("cu_seqlens", "position_resets")), ("doc_ids", pa.list_(keys.type)), ("doc_starts", pa.list_(pa.int64()))])
    for a in range(0, len(packed), 1000):
        cols: list[list] = [[] for _ in schema]
        for r, items in enumerate(packed[a : a + 1000], a):
            ends = np.cumsum(length[items])
            matrix_row = np.full(capacity, pad_id, ids.dtype)
            matrix_row[: ends[-1]] = np.concatenate([ids[first[i] : first[i] + length[i]] for i in items])
            values = (shard, r, int(ends[-1]), matrix_row.tobytes(), np.r_[0, ends], np.r_[0, ends[:-1]], keys.take(pa.array(doc[items])), start[items])
            for c, v in zip(cols, values):
                c.append(v)
        ids_of = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in cols[6]])].astype(np.int32)), pa.concat_arrays(cols[6]))
        yield pa.RecordBatch.from_arrays([ids_of if f.name == "doc_ids" else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def write_packed(packed: DataFrame, path: str) -> DataFrame:
    """``packed`` with file and file_row, written as matrices by the tasks that make its rows.

    A batch of rows is ``part-*.ids`` (rows x capacity ids), ``part-*.cu`` and ``part-*.resets`` (int32, for every row its
    number of values and the values: cumulative segment lengths from 0, and the places where positions begin again at 0);
    file and file_row name a row's matrix and place in it. ``path`` is a folder that all executors share, plain or a URI
    of a file system that Arrow writes to. Files are named by their first shard and row and renamed into place, so a retried or
    repeated task writes the same files again. The work runs on an action; an empty table writes nothing.
    """
    base = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa_fs.FileSystem.from_uri(base)
        fs.create_dir(folder, recursive=True)
        for b in batches:
            if not b.num_rows:
                continue
            name = f"part-{b.column(0)[0].as_py()}-{b.column(1)[0].as_py():07d}"
            each = lambda c: b"".join(np.array([len(x), *x], "<i4").tobytes() for x in b.column(c).to_pylist())
            for ext, data in (("ids", b"".join(b.column(3).to_pylist())), ("cu", each(4)), ("resets", each(5))):
                own = f"{folder}/.{name}.{ext}.{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(own) as f:
                    f.write(data)
                fs.move(own, f"{folder}/{name}.{ext}")
            more = [pa.array([f"{name}.ids"] * b.num_rows), pa.array(np.arange(b.num_rows, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "file", "file_row"])

    return packed.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField("file", T.StringType()), T.StructField("file_row", T.IntegerType())]))
