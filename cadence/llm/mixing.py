"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects ``target / source_size`` copies. The expected
copies are summed up over the source's documents in the order of their sizes, one
offset per source is added, and a document is emitted once for each integer that
its stretch of the running sum crosses. As documents of like size stand together,
the words taken come within about one long document of the target.

The running sum is never taken in one task. All rows stand in one order: source, size, id (nulls last), text. They
are dealt into ranges of that order of some PART_ROWS rows each, cut at sampled rows, and a row's rank is the number of rows in the ranges before
its own and its place in there. So a part is as large as any other, whatever the ids, and rows that are equal in all are spread as well.

Cases: a null source is a source of its own, after all others; null or empty texts
have size 0, take part, and add no words; a source of size 0 has target 0; rows that
repeat, in their id or whole, and rows without an id are mixed and emitted each for itself; a table without rows gives no rows; columns beside
the two that are read don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the input, and the most copies that a document may get.
SHARE, MOST = 1.5, 2.0
#: Documents that are ranked in one task, about.
PART_ROWS = 50_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also target: weights repeat over the sources in code-point order, null last.

    Where a share exceeds ``most`` times its source, the excess goes to the others by weight. That ends at
    target = least(most * size, weight * level) with one level, found by taking the sources in the order in
    which they fill up. One row per source is all that is sorted here.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", most * F.col("source_size")).withColumn("fills_at", F.col("limit") / F.col("weight"))
    filling = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", share * F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that doesn't fill up at its own level fixes the level of all
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("limit", F.col("weight") * F.col("level")), F.col("limit")).alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """In [0, 1): the same for a source in every run."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def ranged(sized: DataFrame, parts: int) -> DataFrame:
    """Rows in the order of source, size, id (nulls last) and text, with their part, from 0, and their place in it, from 0. sized is checkpointed.

    Parts are cut at sampled rows; rows that are equal in all are told apart by their number in what is checkpointed.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("row"), F.col("nth")]
    dealt = sized.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number of a row has its partition above, and its place there in the lower 33 bits
    return dealt.withColumn("at", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("nth").checkpoint()


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, part_rows: int = PART_ROWS) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken, source, copies, row (a hash of the text): one row per row of docs."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row")).checkpoint()  # the texts are read once
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).checkpoint()
    earlier = F.coalesce(F.sum("n").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = targets(totals.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "its").join(totals.select(F.col("source").alias("s"), earlier.alias("earlier")), F.col("its").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    placed = ranged(sized, max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // part_rows)))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("rows")).select("p", before.alias("start"))  # a row for each part
    placed = placed.join(starts, F.col("part") == F.col("p")).join(known.withColumn("rate", rate), F.col("source").eqNullSafe(F.col("its")))
    at = F.col("start") + F.col("at") + 1 - F.col("earlier")  # from 1 on in each source
    copies = F.floor(at * F.col("rate") + F.col("u")) - F.floor((at - 1) * F.col("rate") + F.col("u"))
    return (
        placed.withColumn("u", offset_of(F.col("source"), seed)).withColumn("copies", copies.cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "row")
    )


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mix() says: rows of one id, source and text are counted on both sides, and joined one to one."""
    key = ["doc_id", "source", "row"]
    copies = mixed.select(*key, "copies", F.row_number().over(Window.partitionBy(*key).orderBy("copies")).alias("nth")).filter("copies > 0")
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(kept.alias("kept"), F.col("doc_id").alias("its_id"), F.col("source").alias("its_source"), F.xxhash64("text").alias("its_row"))
    rows = rows.withColumn("its_nth", F.row_number().over(Window.partitionBy("its_id", "its_source", "its_row").orderBy(F.xxhash64("kept"))))
    same = F.col("its_id").eqNullSafe(F.col("doc_id")) & F.col("its_source").eqNullSafe(F.col("source"))
    out = rows.join(copies, same & (F.col("its_row") == F.col("row")) & (F.col("its_nth") == F.col("nth")))
    return out.select("kept", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("kept.*")


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
s1 AS (SELECT *, CASE place % 3 WHEN 0 THEN {WEIGHTS[0]!r} WHEN 1 THEN {WEIGHTS[1]!r} ELSE {WEIGHTS[2]!r} END::DOUBLE AS weight, {MOST!r}::DOUBLE * source_size AS lim FROM s0),
s2 AS (SELECT *, lim / weight AS fills_at FROM s1),
s3 AS (SELECT *, ({SHARE!r}::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM s2),
s4 AS (SELECT source, source_size, least(lim, weight * (SELECT arg_min(own_level, fills_at) FROM s3 WHERE own_level <= fills_at)) AS target FROM s3),
ranked AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM sized),
placed AS (SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, source, k,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate,
  CAST(('0x' || substr(md5('{SEED}:' || coalesce('=' || source, 'null')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM ranked JOIN s4 USING (source))
SELECT doc_id, size, source_size, target, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) * size AS taken,
  source, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) AS copies FROM placed
"""
