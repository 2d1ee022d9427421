"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's set holds its different shingles of some successive words (A to Z lower-cased); a document with fewer
words is one shingle. Documents are linked whose sets reach the threshold in intersection over union, and a
component is what links reach. Links are confirmed on the full sets, made of the whole texts; a shingle stands there
as a keyed 64-bit hash, which is compared within one pair of sets only, and a set as 128 bits.

1. Signatures. Every shingle has a random permutation of the signature's places and a random number for each
   step: in step j it offers (j, number) to the j-th place of its permutation. Offers of later steps are always
   larger, so a document stops after the step in which its largest place is below the next one.
2. Rows of one set are one node, named by their least doc_id: copies are never compared.
3. Bands of a signature give buckets. Each member is compared with the bucket's least one: a star, not all pairs.
4. Members of buckets that then still hold several components are joined once more, exactly: each set is ordered from its
   rarest shingle on, and sets of different components meet only in a shingle of both their prefixes, from whose places
   on enough may still be common. Where a shingle is common to many sets of one component, these are not joined with
   each other. So a link that shares a bucket is lost in no case, and one that shares none is as likely as MISS.

Cases: a document without words or text has an empty set, no links, and is its own component; a null doc_id is
linked with nothing, has a null component and is kept; rows of one doc_id are one node; a table without rows
gives no rows; further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .hot import counted, join_dealt
from .scratch import forget, tidy

SHINGLE, THRESHOLD = 5, 80  # percent
BAND_ROWS, MISS = 4, 1e-6
#: Standard deviations by which the signatures' estimate of a true link may fall short.
SLACK = 5.0

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND_ROWS))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash), sorted, each different shingle of a text once."""
    data, at = W.utf8(texts)
    w = W.words(_LOWER[data], at)
    h, owner, count = W.word_hash(w), w.owner(), w.count
    p = W.run_starts(w, size)
    own, hashes = [owner[p]], [W.run_hash(h, size)[p]]
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        own.append(short)
        hashes.append(W.run_hash(h, k)[w.first[:-1][short]] if len(short) else np.zeros(0, np.uint64))
    own, hashes = np.concatenate(own), np.concatenate(hashes)
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    return own[new], hashes[new]


def super_minhash(owner: np.ndarray, h: np.ndarray, texts: int, places: int) -> np.ndarray:
    """(texts, places) of 64-bit values: the step in the upper bits, a random number below."""
    wide = 8 if places <= 256 else 16
    if places > 1 << 16:
        raise ValueError("a signature has 65,536 places at most")
    below, above, kind = np.uint64(64 - wide), np.uint64(wide), np.uint8 if wide == 8 else np.uint16
    sig = np.full(texts * places, np.iinfo(np.uint64).max, np.uint64)
    perm, rows = None, None
    for j in range(places):
        if not len(h):
            break
        r = W.mix(h + np.uint64((j + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        if j:
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        else:
            place = k
        np.minimum.at(sig, owner * places + place, (np.uint64(j) << below) | (r >> above))
        present = np.unique(owner)
        going = np.zeros(texts, bool)
        if j + 1 < places:
            going[present] = sig.reshape(texts, places)[present].max(axis=1) >= np.uint64(j + 1) << below
        stays = going[owner]
        owner, h = owner[stays], h[stays]
        if j:
            rows = rows[stays]
            if len(rows) < 0.5 * len(perm):
                perm, rows = perm[rows], np.arange(len(rows))
        else:
            # the permutations of what is left, after their first swap
            perm, rows = np.tile(np.arange(places, dtype=kind), (len(h), 1)), np.arange(len(h))
            perm[rows, k[stays]] = 0
            perm[:, 0] = k[stays]
    return sig.reshape(texts, places)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit hash of the set), bands, marks (16 bits of each place)."""
    bands = bands_for(percent)
    places = bands * BAND_ROWS
    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.slices(batch):
                n = b.num_rows
                owner, h = shingles(b.column("text"), size)
                count = np.bincount(owner, minlength=n)
                sums = [_set_hash(h, count, seed) for seed in (1, 2)]
                sig = super_minhash(owner, h, n, places)
                keys = np.zeros((n, bands), np.uint64)
                for k in range(BAND_ROWS):
                    keys = W.mix(keys * _GOLDEN + sig.reshape(n, bands, BAND_ROWS)[:, :, k] + np.arange(bands, dtype=np.uint64))
                full = count > 0
                marks = (W.mix(sig) >> np.uint64(48)).astype(np.uint16).view(np.int16)
                offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                spots = np.concatenate([[0], np.cumsum(full * places)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array(count.astype(np.int64)), *(pa.array(s, mask=~full) for s in sums),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].view(np.int64).ravel())),
                    pa.ListArray.from_arrays(pa.array(spots), pa.array(marks[full].ravel())),
                ], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, marks array<short>")


def full_sets(docs: DataFrame, units: DataFrame, size: int) -> DataFrame:
    """unit, node, n, shingles (sorted): the whole sets of some units(unit, node, set_a, set_b), made of their documents' whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.slices(batch):
                owner, h = shingles(b.column("text"), size)
                count = np.bincount(owner, minlength=b.num_rows)
                cuts = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                made = pa.RecordBatch.from_arrays([b.column("unit"), b.column("node"), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64)))], names=["unit", "node", "n", "shingles"])
                # of rows that share a doc_id, the one whose set it is
                own = (_set_hash(h, count, 1) == b.column("set_a").to_numpy()) & (_set_hash(h, count, 2) == b.column("set_b").to_numpy())
                yield made.filter(pa.array(own))

    texts = docs.select(F.col("doc_id").cast("long").alias("its_id"), F.col("text").alias("text"))
    rows = texts.join(units.select("unit", "node", "set_a", "set_b"), F.col("its_id") == F.col("node")).select("unit", "node", "set_a", "set_b", "text")
    return rows.mapInArrow(run, "unit long, node long, n long, shingles array<long>").dropDuplicates(["unit"])


def _set_hash(h: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each set, by a sum over its shingles."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(h * np.uint64(2 * seed + 1) + np.uint64(seed)))])
    end = np.cumsum(count)
    return W.mix(total[end] - total[end - count]).view(np.int64)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) of units -> nodes (a, b) of those whose full sets reach the threshold. b's set goes to a, whose pairs are dealt if there are many."""
    pairs = pairs.checkpoint()
    x, y = (sets.select(F.col("unit").alias(f"{s}_unit"), F.col("node").alias(f"{s}_node"), F.col("shingles").alias(f"{s}_set")) for s in "ab")
    both = join_dealt(pairs.join(y, F.col("b") == F.col("b_unit")), x.withColumnRenamed("a_unit", "a"), "a", counted(pairs, "a"), pairs.count(), F.col("b"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    reached = 100 * shared >= percent * (F.size("a_set") + F.size("b_set") - shared)
    return both.filter(reached).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _size_class(n: Column) -> Column:
    """Sizes by tenths: never falls as n grows, which is all that is asked of it."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(1.1)).cast("int")


def prefix_pairs(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of units under different roots that may reach the threshold; roots(unit, root) are those to look at.

    Sets are ordered from shingles that stand under one root only, which no such pair shares, on to the others, from rare to
    frequent. Of two sets that reach it, the first shingle that they share lies in both their prefixes, and what
    follows it in either is no less than what must be shared. So only the others have to be placed one by one, and two sets meet at
    a shingle only if either's place leaves room for a partner of the other's size: sets of one template, which are alike in all but
    their own words, don't meet at the template's shingles unless that much makes a link.
    """
    own = sets.join(roots, "unit")
    rows = own.select("unit", "root", "n", F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    crossing = often.filter("low < high").select("shingle", "df")
    total = own.agg(F.sum("n")).first()[0] or 0
    of_unit = Window.partitionBy("unit")
    place = F.col("n") - F.count("*").over(of_unit) + F.row_number().over(of_unit.orderBy("df", "shingle")) - 1
    placed = join_dealt(rows, crossing, "shingle", crossing.withColumnRenamed("df", "n"), total, F.col("unit")).withColumn("place", place)
    prefix = placed.filter(100 * (F.col("n") - F.col("place")) >= percent * F.col("n")).select("shingle", "unit", "root", "n", "place").checkpoint()
    n_prefix = prefix.count()
    most = prefix.groupBy("shingle", "root").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("n"), F.count("*").alias("kinds"))
    most = most.filter("kinds > 1").select("shingle", "main", "n").checkpoint()
    known = join_dealt(prefix, most.select("shingle", "main"), "shingle", most, n_prefix, F.col("unit"))
    # the partner sizes that a place leaves possible: as large as the threshold allows, and no more than what follows can make up for
    least, largest = F.ceil(percent * F.col("n") / 100), F.floor(F.least(100 * F.col("n") / percent, (100 + percent) * (F.col("n") - F.col("place")) / percent - F.col("n")))
    known = known.withColumns({"own": _size_class(F.col("n")), "low": _size_class(least), "high": _size_class(largest)})
    known = known.filter((largest >= least) & (F.col("low") <= F.col("high"))).withColumn("other", F.explode(F.sequence("low", "high")))
    known = known.select("shingle", "unit", "root", "n", "place", "main", "own", "other").checkpoint()
    x = known.filter("root <> main").select(F.xxhash64("shingle", "own", "other").alias("key"), *(F.col(c).alias(f"a_{c}") for c in ("shingle", "unit", "root", "n", "place")))
    y = known.select(F.xxhash64("shingle", "other", "own").alias("key"), *(F.col(c).alias(f"b_{c}") for c in ("shingle", "unit", "root", "n", "place")))
    rest = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    fits = (
        (F.col("a_shingle") == F.col("b_shingle")) & (F.col("a_root") != F.col("b_root"))
        & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
        & ((100 + percent) * rest >= percent * (F.col("a_n") + F.col("b_n")))
    )
    met = join_dealt(y, x, "key", counted(y, "key"), known.count(), F.col("b_unit")).filter(fits)
    return met.select(F.least("a_unit", "b_unit").alias("a"), F.greatest("a_unit", "b_unit").alias("b")).distinct()


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs with a_n, b_n, a_marks, b_marks that sizes and signatures don't rule out."""
    places = bands_for(percent) * BAND_ROWS
    t = percent / 100
    least = math.floor(places * (t - SLACK * math.sqrt(t * (1 - t) / places)))
    same = F.aggregate(F.zip_with("a_marks", "b_marks", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return pairs.filter((100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (same >= least)).select("a", "b")


@tidy
def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    signed = signatures(docs, size, percent).checkpoint()
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    nodes = named.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("marks").alias("marks"), F.count("*").alias("copies"),
    )
    nodes = nodes.withColumn("unit", F.monotonically_increasing_id()).checkpoint()
    members = nodes.select(F.explode("bands").alias("band"), "unit", "node")
    first = F.struct("node", "unit")
    shared = members.groupBy("band").agg(F.min(first).alias("lead"), F.max(first).alias("last"), F.count("*").alias("n")).filter("n > 1").select("band", F.col("lead.unit").alias("lead"), "n")
    members = join_dealt(members, shared.drop("n"), "band", shared, nodes.count() * bands_for(percent), F.col("unit")).checkpoint()
    met = members.select("unit").distinct()
    sets = full_sets(docs, nodes.join(met, "unit").select("unit", "node", "set_a", "set_b"), size).checkpoint()
    about = nodes.select("unit", "n", "marks")
    a, b = (about.select(F.col("unit").alias(f"{x}_unit"), F.col("n").alias(f"{x}_n"), F.col("marks").alias(f"{x}_marks")) for x in "ab")
    pairs = members.filter("unit <> lead").select(F.col("lead").alias("a"), F.col("unit").alias("b")).distinct().checkpoint()
    stars = join_dealt(pairs.join(b, F.col("b") == F.col("b_unit")), a.withColumnRenamed("a_unit", "a"), "a", counted(pairs, "a"), pairs.count(), F.col("b"))
    found = components(verify(_similar(stars, percent), sets, percent))

    # buckets that still hold several components
    known = found.select("child", F.col("parent").alias("root"))
    placed = members.join(known, F.col("node") == F.col("child"), "left").select("band", "unit", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high").select("band", "n").checkpoint()
    open_ = join_dealt(placed, mixed.drop("n"), "band", mixed, members.count(), F.col("unit")).select("unit", "root").distinct()
    more = verify(prefix_pairs(sets, open_, percent), sets, percent).checkpoint()
    if more.limit(1).count():
        found = components(found.select(F.col("child").alias("a"), F.col("parent").alias("b")).union(more))

    groups = nodes.join(found, F.col("node") == F.col("child"), "left").select("set_a", F.col("set_b").alias("b"), F.coalesce("parent", "node").alias("of_set"), F.col("copies").alias("n")).checkpoint()
    of_rows = signed.select("doc_id", "n_shingles", "set_a", "set_b").checkpoint()
    n_rows = of_rows.count()
    forget(members, sets, pairs, mixed, more, nodes, signed)
    named, alone = of_rows.filter("n_shingles > 0 and doc_id is not null"), of_rows.filter("n_shingles = 0 or doc_id is null")
    # a set with many copies is dealt; sets that agree in 64 bits of 128 are told apart after the join
    both = join_dealt(named, groups.drop("n"), "set_a", groups.groupBy("set_a").agg(F.sum("n").alias("n")), n_rows, F.col("doc_id")).filter("set_b = b")
    linked = both.select("doc_id", "n_shingles", F.col("of_set").alias("component_id"))
    return linked.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
