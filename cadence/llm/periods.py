"""Periodic runs of words, found by internal pattern matching.

The words of a slice of texts are numbered, and the texts are laid end to end, each closed by a number of its own. Prefix doubling sorts
the positions by their next 1, 2, 4, ... words: after each round a block of 2^k words that starts at a multiple of 2^k (a dyadic block) has an
interval of the suffix array that holds all its occurrences. A wavelet tree over the suffix array then answers, for each
such block, which occurrence is the nearest before and behind it (range predecessor and successor). Occurrences that start within a
block's length form a progression, so the distance d to the nearest one is the progression's difference, and a
candidate period if half a block < d <= a block.

No run is missed: one of period q and exponent 4 holds a whole dyadic block of the least size b >= q, and has that block's next or
previous occurrence inside, too; nearer than q there is none, as q is the run's smallest period. Each candidate is carried on to both sides by
comparing words at distance d, which gives the run's exact ends. Blocks that occur once, or whose first word doesn't stand
again within a block's length, are not asked for.

Cases: null or empty text has no words, no runs and an empty rest; rows that repeat, in their id or whole, and rows without an id are worked on
each for itself; a long text is a slice of its own, in one task; runs of several periods may overlap, and a word goes if any of them
drops it; a table without rows gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Texts that are laid end to end.
SLICE_BYTES = 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class WaveletTree:
    """Over an array of numbers below 2^levels: how many in a stretch are below a bound, and the n-th smallest in a stretch."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            one = (values >> level) & 1 == 1
            packed = np.zeros(len(values) // 64 * 8 + 8, np.uint8)
            packed[: -(-len(values) // 8)] = np.packbits(one, bitorder="little")
            packed = packed.view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(len(values) - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a level."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[k][block] + np.bitwise_count(self.bits[k][block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        n = np.zeros(len(lo), np.int64)
        for k in range(self.levels):
            one = (bound >> (self.levels - 1 - k)) & 1 == 1
            a, b = self._ones(k, lo), self._ones(k, hi)
            n += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return n

    def smallest(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """nth from 0, and below hi - lo."""
        out = np.zeros(len(lo), np.int64)
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            left = (hi - b) - (lo - a)
            one = nth >= left
            nth = np.where(one, nth - left, nth)
            out |= one.astype(np.int64) << (self.levels - 1 - k)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return out


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each place's group of equal keys, and the group's size."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    size = np.diff(np.append(first, len(sorted_keys)))
    return np.repeat(first, size), np.repeat(size, size)


def block_queries(s: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """The suffix array, sorted as far as blocks need it, and for each size b the blocks to ask for: (b, places, lo, hi, ask behind, ask before)."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    start, size = _groups(s[sa])
    rank = np.empty(n, np.int64)
    rank[sa] = start
    far = n + 1
    behind, before = np.full(n, far), np.full(n, far)
    same = start[1:] == start[:-1]
    gap = sa[1:] - sa[:-1]
    behind[sa[:-1][same]], before[sa[1:][same]] = gap[same], gap[same]
    active, size = sa[size > 1], size[size > 1]
    asked, b = [], 1
    while len(active) and 2 * b <= longest:
        ask = (active % b == 0) & ((behind[active] <= b) | (before[active] <= b))
        j = active[ask]
        asked.append((b, j, rank[j], rank[j] + size[ask], behind[j] <= b, before[j] <= b))
        # positions with equal next b words are ordered by the b words after these; no such block reaches a closing number
        key = rank[active] * (n + 1) + rank[active + b]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old, _ = _groups(rank[active])
        slot = rank[active] + np.arange(len(active)) - old
        sa[slot] = active
        start, size = _groups(key)
        rank[active] = slot[start]
        active, size = active[size > 1], size[size > 1]
        b *= 2
    return sa, asked


def candidates(s: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places p and periods d such that the words from p on equal those from p + d on, for a block at least."""
    sa, asked = block_queries(s, longest)
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not sum(len(x[1]) for x in asked):
        return places[0], periods[0]
    tree = WaveletTree(sa)
    for b, j, lo, hi, ask_behind, ask_before in asked:
        place = tree.below(lo, hi, j)
        for ask, step in ((ask_behind & (place + 1 < hi - lo), 1), (ask_before & (place > 0), -1)):
            if not ask.any():
                continue
            other = tree.smallest(lo[ask], hi[ask], place[ask] + step)
            p, d = np.minimum(other, j[ask]), np.abs(other - j[ask])
            near = (d <= b) & (2 * d > b)
            places.append(p[near])
            periods.append(d[near])
    return np.concatenate(places), np.concatenate(periods)


def runs_of(s: np.ndarray, first: np.ndarray, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, ...]:
    """Runs of sequences that are laid end to end in s, sequence i from first[i] to the closing number at first[i + 1] - 1.

    Gives (sequence, start in it, length, period) in the order of sequence, start, period. exponent: 4 at least.
    """
    none = np.zeros(0, np.int64)
    p, d = candidates(s, int(np.diff(first).max(initial=0)))
    owner = np.searchsorted(first, p, "right") - 1
    order = np.lexsort((p, d, owner))
    owner, p, d = owner[order], p[order], d[order]
    out: list[tuple[np.ndarray, ...]] = []
    if not len(p):
        return none, none, none, none
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (d[1:] != d[:-1])]))
    for i, k in zip(cut.tolist(), np.append(cut[1:], len(p)).tolist(), strict=True):
        o, q = int(owner[i]), int(d[i])
        own = s[first[o] : first[o + 1] - 1]
        if len(own) < max(least, exponent * q):
            continue
        differ = np.flatnonzero(own[q:] != own[:-q])
        at = np.unique(np.searchsorted(differ, p[i:k] - first[o]))
        begin = np.where(at > 0, np.append(differ, 0)[at - 1] + 1, 0)
        end = np.append(differ, len(own) - q)[at] + q
        long = end - begin >= max(least, exponent * q)
        if long.any():
            out.append((np.full(int(long.sum()), o), begin[long], (end - begin)[long], np.full(int(long.sum()), q)))
    if not out:
        return none, none, none, none
    owner, start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def _numbered(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Equal words get equal numbers, exactly; each text is closed by a number of its own."""
    size = w.ends - w.starts
    inside = np.repeat(w.starts - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else w.starts, size) + np.arange(int(size.sum()))
    spelled = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(w.data[inside]))])
    texts = len(w.first) - 1
    first = w.first + np.arange(texts + 1)
    s = np.empty(int(first[-1]), np.int64)
    closing = first[1:] - 1
    inner = np.ones(len(s), bool)
    inner[closing] = False
    s[inner] = spelled.dictionary_encode().indices.to_numpy()
    s[closing] = len(size) + np.arange(texts)
    return s, first


def joined(w: W.Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    owner, at = w.owner()[keep], np.flatnonzero(keep)
    size = w.ends[at] - w.starts[at] + 1
    end = np.cumsum(size)
    data = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    where = np.repeat(w.starts[at] - (end - size), size) + np.arange(len(data))
    inner = np.ones(len(data), bool)
    inner[end - 1] = False
    data[inner] = w.data[where[inner]]
    texts = len(w.first) - 1
    count = np.bincount(owner, minlength=texts)
    last = np.concatenate([[0], end])[np.cumsum(count)]
    first = np.concatenate([[0], last[:-1]])
    offsets = np.concatenate([[0], np.cumsum(np.maximum(last - first - 1, 0))])
    drop = np.ones(len(data), bool)  # the space behind a text's last word
    drop[(last - 1)[count > 0]] = False
    return pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[drop]))])


def _found(texts: pa.Array) -> list[pa.Array]:
    data, at = W.utf8(texts)
    w = W.words(data, at)
    s, first = _numbered(w)
    owner, start, length, period = runs_of(s, first)
    begin = w.first[owner] + start
    dropped = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(dropped, begin + period, 1)
    np.add.at(dropped, begin + length, -1)
    keep = np.cumsum(dropped)[:-1] == 0
    rows = np.searchsorted(owner, np.arange(len(at)))
    runs = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
    return [pa.array(w.count, pa.int64()), runs, joined(w, keep).cast(pa.string())]


def collapse(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs (start, length, period, by start and period), kept: the words that no run drops, joined by one space.

    A run is a stretch of LEAST_LENGTH words and LEAST_EXPONENT periods at least; of each, the first period stays.
    """
    chosen = docs.select("doc_id", "text")
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.slices(batch, most=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_found(b.column("text"))], names=["doc_id", "n_words", "runs", "kept"])

    return chosen.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string")


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text, and for a tenth of all ids, by their checksum, one that repeats a stretch of its own words from some word on; no id: as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h.cast("long") / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")

    # one element, so that the words are taken once
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & text.isNotNull(), changed).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """What collapse() gives -> doc_id, n_runs, the greatest run (ties: smallest start, then period), and checksums of all runs and of what is kept."""
    # the greatest of (length, -start, -period)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period")))), "\n")
    d = found.withColumn("best", best)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-d.best.s).alias("start"), d.best.length.alias("length"), (-d.best.p).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
