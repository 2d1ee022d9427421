"""Substring dedup: recurring passages are confirmed over all documents, compiled into Aho-Corasick automata, and cut out
wherever the automata find them.

A window is WINDOW successive words of one document. Each word goes that lies in a window whose
words also begin, in this order, in a document with a smaller doc_id. Documents are judged as they came in.

Documents are dealt into chunks of some MB by a hash of id and text; a chunk is worked on as arrays.

1. Seeds. Of the runs of SEED words in a window, the one of least hash is its seed, so equal windows have equal seeds,
   and a few neighbouring windows share one. A chunk asks the buckets (ranges of hashes) which of its different seeds
   occur in more than one document. The other windows are out.
2. Confirmation. Of the windows that hold a recurring seed, a chunk sends each different one once, with its first document here.
   A bucket finds those that more than one document holds, and tells the one chunk with the first of all to bring its text.
3. Automata. These confirmed windows, joined to passages, go to the shard of their seed, where they are compiled once. Every
   document goes, with the stretches around its recurring seeds, to the shards of those seeds, and is streamed
   through the automaton. A hit counts if its 13 words agree with the pattern's in 128 bits and the pattern's document is earlier.
4. The hits return to the chunk, and what they cover is cut.

A word stands in the automata as a letter, by six bits of its hash. A chunk's message to a bucket is one binary value for all
keys, there are no more messages than keys, and none is looked at by itself in Python, so all grows with the input. A passage that any
share of the documents holds is sent once per chunk for confirmation; a shard whose seeds very many documents hold is
split into parts, each of which compiles its patterns.

Cases: null text has no words; an empty text, or fewer than WINDOW words, loses nothing; a null doc_id counts
as larger than all others; rows of one doc_id never take words from each other; a table without rows gives
no rows; further columns don't matter. One document has to fit into a task's memory.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

WINDOW, SEED = 13, 6
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Patterns of one automaton, and bytes of documents that are streamed in one part of a shard.
AUTOMATON_PATTERNS, PART_BYTES = 100_000, 16 << 20
#: Words that go through an automaton at once.
STREAM_WORDS = 200_000
_LAST = np.iinfo(np.int64).max

SEEDS = "bucket long, chunk long, keys binary, counts binary"
SEEDS_TOLD = "chunk long, bucket long, states binary"
WINDOWS = "bucket long, chunk long, memo boolean, keys binary, first binary, more binary"
WINDOWS_TOLD = "chunk long, bucket long, memo boolean, states binary"
PIECES = "shard long, part long, pattern boolean, chunk long, at long, doc long, text binary"
HITS = "chunk long, at long, bits binary"
KEPT = "n_words long, n_removed long, kept string"

_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _table(schema: str, columns: list) -> pa.Table:
    """Arrays, lists or Arrow arrays under the schema's names; no columns for no rows."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, _KINDS[k]) for x, (_, k) in zip(columns or [[]] * len(fields), fields, strict=True)], names=[n for n, _ in fields])


def _parts(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] as one binary value each."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _whole(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All binary values of a column, one after the other, and where each begins."""
    data, at = W.utf8(column)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind), at // size


def _deal(upper: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and where each begins, of keys in the order of their 64-bit hashes: a bucket is a range of the upper halves."""
    bucket = ((upper >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[cuts], np.append(cuts, len(bucket))


def _answers(told: pa.Table) -> np.ndarray:
    """What all buckets said, in the order of the keys that were sent."""
    order = np.argsort(told.column("bucket").to_numpy(), kind="stable")
    return _whole(told.take(pa.array(order)).column("states"), np.uint8)[0]


class Chunk:
    """A chunk's documents in the order of ids and texts: the same whenever it is made of the same rows."""

    def __init__(self, rows: pa.Table) -> None:
        ids = rows.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        data, at = W.utf8(rows.column("text"))
        order = np.lexsort((W.spans_hash(data, at[:-1], at[1:]), ids))
        self.rows, self.ids = rows.take(pa.array(order)), ids[order]
        data, self.at = W.utf8(self.rows.column("text"))
        self.words = W.words(data, self.at)

    def find_seeds(self, window: int) -> None:
        """begins: word positions of the windows; seeds: the different ones, in order; of_window: the seed of each window."""
        seed = min(SEED, window)
        self.hash, self.owner = W.word_hash(self.words), self.words.owner()
        self.begins = W.run_starts(self.words, window)
        runs = W.run_hash(self.hash, seed)
        self.at_seed = np.zeros(len(self.begins), np.int64)
        least = np.full(len(self.begins), np.iinfo(np.uint64).max, np.uint64)
        for k in range(window - seed + 1):
            x = runs[self.begins + k]
            less = x < least
            least[less], self.at_seed[less] = x[less], self.begins[less] + k
        self.seeds, self.of_window = np.unique(W.mix(least), return_inverse=True)  # mixed again, as least hashes are small ones

    def seed_repeats(self) -> np.ndarray:
        """For each different seed: it occurs in two documents of this chunk."""
        doc = self.ids[self.owner[self.begins]]
        low, high = np.full(len(self.seeds), _LAST), np.full(len(self.seeds), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of_window, doc)
        np.maximum.at(high, self.of_window, doc)
        return low < high

    def seed_counts(self) -> np.ndarray:
        """At how many places each stands, give or take."""
        new = np.flatnonzero(np.diff(self.at_seed, prepend=-1))
        return np.minimum(np.bincount(self.of_window[new], minlength=len(self.seeds)), 65535).astype(np.uint16)

    def find_windows(self, window: int, recurring: np.ndarray) -> None:
        """Keeps the windows whose seed recurs. a, b: both hashes of each different one, in order; of_window: which one each is."""
        keep = recurring[self.of_window] > 0 if len(self.begins) else np.zeros(0, bool)
        self.begins, self.of_seed = self.begins[keep], self.of_window[keep]
        a, b = (W.run_hash(h, window, k)[self.begins] for k, h in enumerate((self.hash, W.word_hash(self.words, 1))))
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        self.a, self.b = a[order][new], b[order][new]
        self.of_window = np.zeros(len(order), np.int64)
        self.of_window[order] = np.cumsum(new) - 1
        doc = self.ids[self.owner[self.begins]]
        self.first, last = np.full(len(self.a), _LAST), np.full(len(self.a), np.iinfo(np.int64).min)
        np.minimum.at(self.first, self.of_window, doc)
        np.maximum.at(last, self.of_window, doc)
        self.more = (last > self.first).astype(np.uint8)

    def stretches(self, chosen: np.ndarray, shard: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first of the chosen windows, first word, end word) of runs of neighbouring chosen windows of one document and shard."""
        at, own, of = self.begins[chosen], self.owner[self.begins[chosen]], shard[chosen]
        cut = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(own, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        last = np.append(cut[1:], len(at)) - 1
        return chosen[cut], at[cut], at[last[: len(cut)]] + window


def _ask_seeds(window: int, buckets: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        c = Chunk(rows)
        c.find_seeds(window)
        bucket, cuts = _deal(c.seeds, buckets)
        keys = c.seeds.astype(np.uint32) << np.uint32(1) | c.seed_repeats()
        return _table(SEEDS, [bucket, np.full(len(bucket), key[0].as_py()), _parts(keys, cuts), _parts(c.seed_counts(), cuts)])

    return run


def _tell_seeds(window: int, part_bytes: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """State of each key: 0 if one document has it, else 1 and how often the bucket's documents are to be halved."""
        keys, at = _whole(rows.column("keys"), np.uint32)
        _, which = np.unique(keys >> np.uint32(1), return_inverse=True)
        recurs = (np.bincount(which, weights=1.0 + (keys & np.uint32(1))) > 1)[which]
        places = int(_whole(rows.column("counts"), np.uint16)[0][recurs].sum(dtype=np.int64))
        halves = max(0, int(np.ceil(np.log2(max(1, places * 12 * window / part_bytes)))))
        return _table(SEEDS_TOLD, [rows.column("chunk"), np.full(rows.num_rows, key[0].as_py()), _parts(recurs.astype(np.uint8) * np.uint8(1 + halves), at)])

    return run


def _ask_windows(window: int, buckets: int):
    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(WINDOWS, [])
        c, chunk, states = Chunk(rows), key[0].as_py(), _answers(told)
        c.find_seeds(window)
        c.find_windows(window, states)
        bucket, cuts = _deal(c.a, buckets)
        n = len(bucket)
        asked = _table(WINDOWS, [bucket, np.full(n, chunk), np.zeros(n, bool), _parts(c.b, cuts), _parts(c.first, cuts), _parts(c.more, cuts)])
        return pa.concat_tables([asked, _table(WINDOWS, [[chunk % buckets], [chunk], [True], [states.tobytes()], [None], [None]])])

    return run


def _tell_windows(key: tuple, rows: pa.Table) -> pa.Table:
    """State of each window: 1 if more than one document holds it and this chunk has the first of them. Seeds' states pass through."""
    memo = rows.column("memo").to_numpy()
    kept, asked = rows.filter(pa.array(memo)), rows.filter(pa.array(~memo))
    keys, at = _whole(asked.column("keys"), np.uint64)
    first, more = _whole(asked.column("first"), np.int64)[0], _whole(asked.column("more"), np.uint8)[0]
    found, which = np.unique(keys, return_inverse=True)
    low, high, some = np.full(len(found), _LAST), np.full(len(found), np.iinfo(np.int64).min), np.zeros(len(found), np.int64)
    np.minimum.at(low, which, first)
    np.maximum.at(high, which, first)
    np.add.at(some, which, more)
    recurs = (low < high) | (some > 0)
    holder = np.full(len(found), len(keys))
    at_low = np.flatnonzero(first == low[which])
    np.minimum.at(holder, which[at_low], at_low)  # of the rows of one document in several chunks, one
    states = (recurs[which] & (holder[which] == np.arange(len(keys)))).astype(np.uint8)
    bucket = key[0].as_py()
    out = _table(WINDOWS_TOLD, [asked.column("chunk"), np.full(asked.num_rows, bucket), np.zeros(asked.num_rows, bool), _parts(states, at)])
    return pa.concat_tables([out, _table(WINDOWS_TOLD, [kept.column("chunk"), np.full(kept.num_rows, -1), np.ones(kept.num_rows, bool), kept.column("keys")])])


def _send_pieces(window: int, buckets: int):
    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        """Patterns and stretches of documents, to the parts of the shards of their seeds."""
        if not rows.num_rows:
            return _table(PIECES, [])
        c, chunk = Chunk(rows), key[0].as_py()
        memo = told.column("memo").to_numpy()
        states = _whole(told.filter(pa.array(memo)).column("states"), np.uint8)[0]
        c.find_seeds(window)
        c.find_windows(window, states)
        own = _answers(told.filter(pa.array(~memo))) > 0
        bucket, cuts = _deal(c.seeds, buckets)
        shard = np.repeat(bucket, np.diff(cuts))[c.of_seed] if len(c.seeds) else np.zeros(0, np.int64)
        parts = np.int64(1) << (states[c.of_seed].astype(np.int64) - 1) if len(c.seeds) else np.zeros(0, np.int64)
        data, starts, ends = c.words.data.tobytes(), c.words.starts, c.words.ends
        doc = c.ids[c.owner[c.begins]]
        mine = own[c.of_window] & (doc == c.first[c.of_window]) if len(c.begins) else np.zeros(0, bool)
        rest = np.flatnonzero(~mine)  # what the first document of all holds can't go from there
        if mine.any():  # each confirmed window once
            _, once = np.unique(np.where(mine, c.of_window, -1), return_index=True)
            mine[np.setdiff1d(np.flatnonzero(mine), once)] = False
        out = []
        for pattern, chosen in ((True, np.flatnonzero(mine)), (False, rest)):
            w, lo, hi = c.stretches(chosen, shard, window)
            texts = [data[i:j] for i, j in zip(starts[lo].tolist(), ends[hi - 1].tolist(), strict=True)]
            n = parts[w] if pattern else np.ones(len(w), np.int64)
            of = np.repeat(np.arange(len(w)), n)
            part = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) if pattern else np.full(len(w), chunk) % parts[w]
            out.append(_table(PIECES, [shard[w][of], part, np.full(len(of), pattern), np.full(len(of), chunk), lo[of], doc[w][of], pa.array(texts, pa.binary()).take(pa.array(of))]))
        return pa.concat_tables(out)

    return run


def _letters(h: np.ndarray) -> np.ndarray:
    """One of 64 letters for each word: no node has many children, and 13 of them tell windows apart well enough to be compared then."""
    return np.uint32(0x100) + (h >> np.uint64(58)).astype(np.uint32)


class Pieces:
    """Words, letters and window hashes of some pieces."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        self.words = W.words(*W.utf8(rows.column("text")))
        self.doc = rows.column("doc").to_numpy()[self.words.owner()]
        self.hash = W.word_hash(self.words)
        self.begins = W.run_starts(self.words, window)
        self.a, self.b = (W.run_hash(h, window, k) for k, h in enumerate((self.hash, W.word_hash(self.words, 1))))


def locate(rows: pa.Table, window: int) -> pa.Table:
    """Which windows of a part's documents are patterns of earlier documents, by automata of the part's patterns."""
    import ahocorasick

    pattern = rows.column("pattern").to_numpy()
    known, texts = rows.filter(pa.array(pattern)), rows.filter(pa.array(~pattern))
    if not known.num_rows or not texts.num_rows:
        return _table(HITS, [])
    p, t = Pieces(known, window), Pieces(texts, window)
    # a letter that no pattern has stands between two pieces
    first, n = t.words.first, len(t.hash)
    gapped = np.arange(n) + np.repeat(np.arange(texts.num_rows), t.words.count)
    line = np.ones(n + texts.num_rows, np.uint32)
    line[gapped] = _letters(t.hash)
    back = np.full(len(line), -1)
    back[gapped] = np.arange(n)
    stream, source = line.tobytes().decode("utf-32-le"), _letters(p.hash).tobytes().decode("utf-32-le")
    spelt = lambda at: source[at : at + window]
    hit = np.zeros(n, bool)
    for lo in range(0, len(p.begins), AUTOMATON_PATTERNS):
        begins = p.begins[lo : lo + AUTOMATON_PATTERNS]
        automaton, alike = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        for i, at in enumerate(begins.tolist()):
            if not automaton.add_word(spelt(at), i):  # the letters agree with those of another one, which it has taken the place of
                alike.append(at)
        automaton.make_automaton()
        by_letters: dict[str, list[int]] = {}
        wanted = {spelt(at) for at in alike}
        for at in begins.tolist() if wanted else ():
            if spelt(at) in wanted:
                by_letters.setdefault(spelt(at), []).append(at)
        k = 0
        while k < texts.num_rows:
            # whole pieces, some words at a time
            to = max(k + 1, int(np.searchsorted(first, first[k] + STREAM_WORDS, "right")) - 1)
            found = np.array(list(automaton.iter(stream, int(first[k]) + k, int(first[to]) + to)), np.int64).reshape(-1, 2)
            here, there = back[found[:, 0]] - window + 1, begins[found[:, 1]]
            real = (t.a[here] == p.a[there]) & (t.b[here] == p.b[there]) & (t.doc[here] > p.doc[there])
            hit[here[real]] = True
            for x, y in zip(here.tolist(), there.tolist(), strict=True) if wanted else ():  # few: all patterns of the same letters
                for at in by_letters.get(spelt(y), ()):
                    hit[x] |= bool(t.a[x] == p.a[at] and t.b[x] == p.b[at] and t.doc[x] > p.doc[at])
            k = to
    some = np.flatnonzero(np.add.reduceat(hit, first[:-1]) > 0)
    bits = [np.packbits(hit[i:j]).tobytes() for i, j in zip(first[some].tolist(), first[some + 1].tolist(), strict=True)]
    return _table(HITS, [texts.column("chunk").take(pa.array(some)), texts.column("at").take(pa.array(some)), pa.array(bits, pa.binary())])


def _locate(window: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return locate(rows, window)

    return run


def _cut(window: int):
    def run(key: tuple, rows: pa.Table, hits: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), *_table(KEPT, []).columns], names=["doc_id", "n_words", "n_removed", "kept"])
        c = Chunk(rows)
        edge = np.zeros(len(c.words.starts) + 1, np.int64)
        for at, bits in zip(hits.column("at").to_pylist(), hits.column("bits").to_pylist(), strict=True):
            begin = at + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + window, -1)
        keep, raw, out = np.cumsum(edge[:-1]) == 0, c.words.data.tobytes(), []
        for lo, hi, i, j in zip(c.at[:-1].tolist(), c.at[1:].tolist(), c.words.first[:-1].tolist(), c.words.first[1:].tolist(), strict=True):
            kept = b" ".join(compress(raw[lo:hi].split(), keep[i:j].tolist()))
            out.append((j - i, j - i - int(np.count_nonzero(keep[i:j])), kept.decode("utf-8", "replace")))
        return pa.Table.from_arrays([c.rows.column("doc_id"), *_table(KEPT, list(zip(*out, strict=True))).columns], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long").alias("chunk"))
    by_chunk = dealt.groupBy("chunk")
    seeds = by_chunk.applyInArrow(_ask_seeds(window, buckets), SEEDS).groupBy("bucket").applyInArrow(_tell_seeds(window, part_bytes), SEEDS_TOLD)
    asked = by_chunk.cogroup(seeds.groupBy("chunk")).applyInArrow(_ask_windows(window, buckets), WINDOWS)
    told = asked.groupBy("bucket").applyInArrow(_tell_windows, WINDOWS_TOLD)
    pieces = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_send_pieces(window, buckets), PIECES)
    hits = pieces.groupBy("shard", "part").applyInArrow(_locate(window), HITS)
    return by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_cut(window), "doc_id long, " + KEPT)
