"""Vectorised word splitting and hashing over Arrow string columns.

Python work in these operators runs on whole Arrow batches: a batch's UTF-8 buffer is scanned once with numpy and
gives word boundaries and 64-bit word hashes without making a Python string per word. A word is a run of ASCII
letters, digits and underscores and of any non-ASCII characters; everything else separates words. Batches are cut
at ``SLICE_BYTES`` of text, so memory doesn't follow the batch size; no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & ((1 << 64) - 1)], dtype=np.uint64))[0])


class Words:
    """Words of a slice of texts: ``starts`` and ``lens`` in ``buf``, ``bounds[i]:bounds[i+1]`` are text i's words."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        lo, hi = int(offs[0]), int(offs[-1])
        body = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
        self.offsets = offs - lo
        self.buf = np.concatenate([body, np.zeros(16, np.uint8)])
        inside = _WORD[body]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = self.offsets[:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(body))]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        self.starts = np.flatnonzero(first)
        self.lens = np.flatnonzero(last) + 1 - self.starts
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def position(self) -> np.ndarray:
        """Number of every word within its text."""
        return np.arange(len(self.starts)) - np.repeat(self.bounds[:-1], self.counts())

    def _at(self) -> np.ndarray:
        return np.lib.stride_tricks.as_strided(self.buf[:8].view(np.uint64), shape=(len(self.buf) - 7,), strides=(1,))

    def hashes(self) -> np.ndarray:
        at, lens = self._at(), self.lens
        h = mix((at[self.starts] & _MASK[np.minimum(lens, 8)]) ^ (lens.astype(np.uint64) * _GOLD))
        k, idx = 8, np.flatnonzero(lens > 8)
        while idx.size:
            x = at[self.starts[idx] + k] & _MASK[np.minimum(lens[idx] - k, 8)]
            h[idx] = mix(h[idx] * _A ^ x)
            k += 8
            idx = idx[lens[idx] > k]
        return h

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at least ``size`` (1..8) bytes and the hashes of that many leading bytes."""
        idx = np.flatnonzero(self.lens >= size)
        return idx, mix((self._at()[self.starts[idx]] & _MASK[size]) ^ np.uint64(mix_int(size + 977)))

    def text(self, i: int, size: int | None = None) -> str:
        s, n = int(self.starts[i]), int(self.lens[i]) if size is None else size
        return self.buf[s : s + n].tobytes().decode("utf-8", "ignore")


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, by doubling: O(log size) vector operations."""
    out, done, power, width = None, 0, h, 1
    left = size
    while left:
        if left & 1:
            part = power[done:]
            out = part.copy() if out is None else mix(out[: len(part)] * _B + part[: len(out)] + np.uint64(width))
            done += width
        left >>= 1
        if left:
            power = mix(power[:-width] * _A + power[width:] + np.uint64(width)) if len(power) > width else power[:0]
            width *= 2
    n = max(0, len(h) - size + 1)
    return out[:n]


def window_mask(words: Words, size: int) -> np.ndarray:
    """Which starts of ``windows`` stay inside one text."""
    n = max(0, len(words) - size + 1)
    ends = np.repeat(words.bounds[1:], words.counts())
    return np.arange(n) + size <= ends[:n]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut between rows to about ``limit`` bytes of ``column`` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
