"""Line dedup by pairwise alignment: common blocks of lines go from the later of two documents.

1. Each line has a hash. A document's runs are its shortest series of lines with MIN_WORDS words, one from each line
   on and one up to each line: every block with so many words is made of the runs inside it.
2. A document is paired with the earliest document that holds a run of it, for each run, and with the earliest one
   of the same lines: as many partners as twice its lines at most, and a run that a third of all documents hold
   makes one pair for each of them, not for each two.
3. A pair is aligned by patience diff on the lines' hashes: equal ends are matched, lines that stand once in either
   document are anchors, of which the longest ascending series counts, and the stretches between anchors are aligned
   in turn. Where all common lines of a stretch repeat, its longest common block takes the place of an anchor.
4. Aligned blocks with at least MIN_WORDS words go from the later document, and their runs wherever else they stand
   in it. Documents are judged as they came in.
5. Runs that an earlier document holds, but that no partner's alignment took (as they stand there in another order),
   are tried with their other holders, in hashed cohorts that grow eightfold, until they are taken or
   all holders are tried. So the result is that of aligning each document with all earlier ones. Documents of
   the same lines are tried once, as the earliest of them.

How rare a line is in the whole table bounds nothing here: a document's partners come from its rare and its
frequent lines alike, since leaving out frequent ones would lose large groups of copies.

Lines end at a line feed and are compared without white space at their ends; a line of white space alone
counts as aligned only where its neighbours are.

Cases: null text stays null, with no lines; an empty text is one empty line; a null doc_id is compared with
nothing and stays as it is; rows of one doc_id are not compared with each other; a document that loses all
lines stays with an empty text; a table without rows gives no rows; further columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import words as W
from .hot import counted, join_dealt
from .scratch import forget, tidy

MIN_WORDS = 5
#: Holders of a run that are tried after the earliest one; each further cohort is eight times as large.
COHORT = 4
#: Pairs of documents that are unpacked at once.
ROWS = 256
_PRIME, _BASE, _POWERS = (1 << 61) - 1, 0x1B873593CC9E2D51, [1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions (in a, in b) of lines that patience diff holds for the same, ascending in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        ours, theirs = Counter(a[i:j]), Counter(b[k:m])
        place = {x: p for p, x in enumerate(a[i:j], i) if ours[x] == 1 and theirs.get(x) == 1}
        shared = [(place[x], q) for q, x in enumerate(b[k:m], k) if x in place]
        # longest series that ascends in a as well
        ends, at, before = [], [], []
        for n, (p, _) in enumerate(shared):
            t = bisect_left(ends, p)
            ends[t : t + 1], at[t : t + 1] = [p], [n]
            before.append(at[t - 1] if t else -1)
        n, series = at[-1] if at else -1, []
        while n >= 0:
            series.append(shared[n])
            n = before[n]
        if series:
            for p, q in reversed(series):
                todo.append((i, p, k, q))
                found.append((p, q))
                i, k = p + 1, q + 1
            todo.append((i, j, k, m))
        elif any(x and x in theirs for x in ours):  # all common lines repeat: the longest common block stands for an anchor
            p, q, n = longest_block(a[i:j], b[k:m])
            found += [(i + p + x, k + q + x) for x in range(n)]
            todo += [(i, i + p, k, k + q), (i + p + n, j, k + q + n, m)]
    return sorted(found)


def longest_block(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """(place in a, place in b, lines) of the longest common block that isn't blank, by a's suffix automaton."""
    steps, link, length, end, last = [{}], [-1], [0], [-1], 0
    for p, x in enumerate(a):
        new, s = len(steps), last
        steps.append({}), link.append(0), length.append(length[last] + 1), end.append(p)
        while s >= 0 and x not in steps[s]:
            steps[s][x] = new
            s = link[s]
        if s >= 0:
            t = steps[s][x]
            if length[t] > length[s] + 1:
                old, t = t, len(steps)
                steps.append(dict(steps[old])), link.append(link[old]), length.append(length[s] + 1), end.append(end[old])
                while s >= 0 and steps[s].get(x) == old:
                    steps[s][x] = t
                    s = link[s]
                link[old] = t
            link[new] = t
        last = new
    best, s, n, solid = (0, 0, 0), 0, 0, -1
    for q, x in enumerate(b):
        solid = q if x else solid
        while s and x not in steps[s]:
            s = link[s]
            n = length[s]
        if x in steps[s]:
            s, n = steps[s][x], n + 1
        if n > best[2] and solid > q - n:
            best = (end[s] - n + 1, q - n + 1, n)
    return best


def spans(words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs with so many words from each line on and up to each line."""
    n, sums = len(words), [0]
    for w in words:
        sums.append(sums[-1] + w)
    out, e, s = set(), 0, 0
    for k in range(n):
        e = max(e, k)
        while e < n and sums[e + 1] - sums[k] < least:
            e += 1
        if e < n:
            out.add((k, e))
        while s < k and sums[k + 1] - sums[s + 1] >= least:
            s += 1
        if sums[k + 1] - sums[s] >= least:
            out.add((s, k))
    return sorted(out)


def runs(lines: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(first, last, key) of each of these runs. Keys are polynomials, modulo a prime, of the lines' hashes."""
    h = [0]
    for x in lines:
        h.append((h[-1] * _BASE + x + (1 << 63) + 1) % _PRIME)
    while len(_POWERS) <= len(lines):
        _POWERS.append(_POWERS[-1] * _BASE % _PRIME)
    return [(s, e, (h[e + 1] - h[s] * _POWERS[e + 1 - s]) % _PRIME) for s, e in spans(words, least)]


def keys_of(lines: list[int], words: list[int], least: int) -> list[int]:
    """The key of all lines together, below 0, and those of the runs in order; none if there is no run."""
    if sum(words) < least:
        return []
    return [-1 - runs(lines, [0] * (len(lines) - 1) + [1], 1)[0][2], *(key for _, _, key in runs(lines, words, least))]


def taken_runs(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Which of b's runs, by their places in spans(), lie in aligned blocks with at least so many words; words has those of b's lines."""
    of, block, number, size, last = [0] * len(b), [], 0, 0, (-2, -2)
    for i, k in [*aligned(a, b), (-9, -9)]:
        if (i, k) != (last[0] + 1, last[1] + 1):
            if size >= least and block:
                number += 1
                of[block[0] : block[-1] + 1] = [number] * len(block)
            block, size = [], 0
        if k >= 0:
            block.append(k)
            size += words[k]
        last = (i, k)
    return [n for n, (s, e) in enumerate(spans(words, least)) if of[s] and of[s] == of[e]] if number else []


def places(words: list[int], least: int, keys: list[int], taken: set[int]) -> list[int]:
    """Positions of the lines in runs whose keys are taken; keys are those of spans(), in order."""
    gone: set[int] = set()
    done = 0
    for (s, e), key in zip(spans(words, least), keys, strict=True) if taken else ():
        if key in taken:
            gone.update(range(max(s, done), e + 1))
            done = max(done, e + 1)
    return sorted(gone)


def common_lines(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Positions in b of aligned blocks with at least so many words, and of their runs elsewhere in b."""
    keys = [key for _, _, key in runs(b, words, least)]
    return places(words, least, keys, {keys[n] for n in taken_runs(a, b, words, least)})


def lines_of(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, row (a hash of the text), lines (the hash of each, 0 if blank), words (how many in each) and keys (see keys_of).

    Lines are compared by one keyed hash and runs by another: what both call equal agrees in 125 bits.
    """

    def hashes(w: W.Words, first: np.ndarray, n: np.ndarray, key: int) -> np.ndarray:
        h = W.word_hash(w, key)
        total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(h + (np.arange(len(h)) - np.repeat(first, n)).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))])
        return np.where(n > 0, W.mix(total[first + n] - total[first] + n.astype(np.uint64)), np.uint64(0)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.slices(batch):
                data, at = W.utf8(b.column("text"))
                w = W.words(data, at)
                feeds = np.flatnonzero(data == 10)
                starts = np.sort(np.concatenate([at[:-1], feeds + 1]), kind="stable")
                # a feed at a text's very end begins that text's empty last line, before the next text's first one
                count = np.diff(np.searchsorted(feeds, at)) + 1
                first = np.searchsorted(w.starts, starts)
                n = np.diff(np.append(first, len(w.starts)))
                cut = np.concatenate([[0], np.cumsum(count)])
                other, size = hashes(w, first, n, 1).tolist(), n.tolist()
                keys = [keys_of(other[i:j], size[i:j], least) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                cuts = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), b.column("row"), pa.ListArray.from_arrays(cuts, pa.array(hashes(w, first, n, 0))), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32))),
                    pa.array(keys, pa.list_(pa.int64())),
                ], names=["doc_id", "row", "lines", "words", "keys"])

    chosen = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    return chosen.mapInArrow(run, "doc_id long, row long, lines array<long>, words array<int>, keys array<long>")


def _by_row(out: str, columns: tuple[str, ...], f):
    """For mapInArrow: doc_id, row and a list of longs that f makes of the columns, of some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                made = [f(*x) for x in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "row", out])

    return run, f"doc_id long, row long, {out} array<long>"


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for batch in batches for b in W.slices(batch)):
            texts, counts, removed = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                out = set(gone or ())
                texts.append(text if not out else "\n".join(x for i, x in enumerate(lines) if i not in out))
                counts.append(len(lines))
                removed.append(len(out))
            columns = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return run


@tidy
def remove_common_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs -> its columns, with the text that stays, and n_lines and n_removed."""
    known = lines_of(docs, min_words).dropDuplicates(["doc_id", "row"]).checkpoint()
    each = known.select("doc_id", "row", F.explode(F.array_distinct("keys")).alias("key"))
    n_each = known.agg(F.sum(F.size(F.array_distinct("keys")))).first()[0] or 0
    owned = each.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("owner < last").select("key", "owner", "n")
    shared = join_dealt(each, owned.drop("n"), "key", owned, n_each, F.col("doc_id")).filter("doc_id > owner").select("doc_id", "row", "key", "owner").checkpoint()
    owners = known.select(F.col("doc_id").alias("owner"), F.col("lines").alias("owner_lines"))
    this = ["doc_id", "row"]

    def align(pairs: DataFrame) -> DataFrame:
        """Keys of the runs that are taken from doc_id, row."""
        pairs = pairs.distinct().checkpoint()
        both = join_dealt(pairs.join(known, this), owners, "owner", counted(pairs, "owner"), pairs.count(), F.col("doc_id")).select(*this, "owner_lines", "lines", "words", "keys")
        found = both.mapInArrow(*_by_row("keys", ("owner_lines", "lines", "words", "keys"), lambda a, b, w, k: sorted({k[n + 1] for n in taken_runs(a, b, w, min_words)})))
        out = found.select(*this, F.explode("keys").alias("key")).distinct().checkpoint()
        forget(pairs)
        return out

    taken = align(shared.select(*this, "owner"))
    left = shared.filter("key >= 0").join(taken, [*this, "key"], "left_anti").checkpoint()
    if not left.isEmpty():
        copies = shared.filter("key < 0").select(*this)
        wanted = left.select("key").distinct()
        holders = join_dealt(each, wanted, "key", owned.select("key", "n"), n_each, F.col("doc_id")).join(copies, this, "left_anti").select("key", F.col("doc_id").alias("holder")).distinct().checkpoint()
        n_left, of_key = left.count(), counted(left, "key")
        sizes = counted(holders, "key").filter("n > 1")
        left = join_dealt(left, sizes, "key", of_key, n_left, F.col("doc_id")).checkpoint()
        n_holders = holders.count()
        holders = join_dealt(holders, sizes.select("key", F.col("n").alias("of")), "key", sizes, n_holders, F.col("holder")).withColumn("place", F.pmod(F.xxhash64("holder"), F.col("of"))).drop("of").checkpoint()
        low, high = 0, COHORT
        while not left.isEmpty():
            cohort = holders.filter((F.col("place") >= low) & (F.col("place") < high))
            tried = join_dealt(left, cohort, "key", counted(left, "key"), left.count(), F.col("doc_id")).filter("holder < doc_id and holder <> owner").select(*this, F.col("holder").alias("owner"))
            more = align(tried)
            taken = taken.union(more)
            before, left = left, left.filter(F.col("n") > high).join(more, [*this, "key"], "left_anti").checkpoint()
            forget(before)
            low, high = high, high * 8
        forget(holders)
    gone = taken.groupBy(*this).agg(F.collect_set("key").alias("taken")).join(known, this)
    gone = gone.mapInArrow(*_by_row("gone", ("words", "keys", "taken"), lambda w, k, t: places(w, min_words, k[1:], set(t))))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "gone").checkpoint()
    forget(known, shared)
    # the row goes along as one value, so none of its names meets those of this function
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_row"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"))
    out = rows.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_row") == F.col("gone_row")), "left").select("text", "kept", "gone")
    schema = StructType([StructField("text", StringType()), StructField("kept", out.schema["kept"].dataType), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    out = out.mapInArrow(_cut(["text", "kept"]), schema)
    return out.select(*(F.col("text") if c == "text" else F.col("kept")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
