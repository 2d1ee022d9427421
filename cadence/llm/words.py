"""Words of whole texts as numpy arrays, for use inside Arrow batches.

A word is a run of bytes other than U+0020 and U+0009 to U+000D, as in
``[^\\x20\\x09-\\x0D]+``; those separators are single UTF-8 bytes, so the work is
done on the UTF-8 bytes themselves. Hashes depend on the bytes alone: they are the same on
every worker and in every run. Each is a chain of 64-bit mixing steps from a key on, one step for eight bytes (or,
in runs, for a word), so texts of a pattern collide no more often than any others. Two chains with keys of their own make
128 bits, for use where equal hashes are taken for equal words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Longer spans are hashed one by one.
_LONG = 64
_KEYS = (0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5)
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    """starts, ends: byte positions of each word in data; first: index of each text's first word, and the total."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> Words:
    """Words of texts given as utf8() gives them. A word never crosses from one text to the next."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64))
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; keys 0 and 1 give two independent ones."""
    import xxhash

    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(_KEYS[key]))
    if not len(out):
        return out
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    left = np.flatnonzero((size > 0) & (size <= _LONG))
    for at in range(0, _LONG, 8):
        if not len(left):
            break
        lane = lanes[starts[left] + at]
        rest = np.minimum(size[left] - at, 8).astype(np.uint64)
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        out[left] = mix(out[left] ^ lane)
        left = left[size[left] > at + 8]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        raw = data.data
        out[long] = [xxhash.xxh3_64_intdigest(raw[i:j], seed=_KEYS[key]) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def word_hash(w: Words, key: int = 0) -> np.ndarray:
    return spans_hash(w.data, w.starts, w.ends, key)


def run_hash(h: np.ndarray, k: int, key: int = 0) -> np.ndarray:
    """Hash of each k successive values; fewer than k values give none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _KEYS[key], np.uint64)
    for i in range(k):
        out ^= h[i : i + n]
        out *= _STEPS[key]
        out ^= out >> np.uint64(29)
    return mix(out)


def run_starts(w: Words, k: int) -> np.ndarray:
    """Word positions at which k successive words of one text begin."""
    n = len(w.starts) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.repeat(w.first[1:], w.count)[:n] - np.arange(n) >= k)
