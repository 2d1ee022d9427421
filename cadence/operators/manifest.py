"""Labelled manifests: reading lines, identity, numbering and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import text as T

MARKER = r"(?i)^#\s*LABEL:\s*([A-Z_]+)"
#: Rows of a part that is numbered in one task, parts that are summed up together, and parts whose sums are broadcast, at most.
PART_ROWS, GROUP_PARTS, BROADCAST_PARTS = 200_000, 1_000, 100_000


def section_label(lines: DataFrame, by: str = "file", part_lines: int = 100_000) -> DataFrame:
    """lines(file, line_no, line) with raw_label (the last marker at or above the line) and is_marker.

    A file's lines are looked at in parts of so many line numbers; the last marker of the parts above is handed on to each.
    """
    text = T.clean(F.regexp_replace("line", "^﻿", ""))
    marked = lines.withColumn("line", text).withColumn("own", F.nullif(F.regexp_extract("line", MARKER, 1), F.lit(""))).withColumn("_part", F.floor(F.col("line_no") / part_lines))
    last = marked.filter("own is not null").groupBy(by, "_part").agg(F.max_by("own", "line_no").alias("_last"))
    parts = marked.select(by, "_part").distinct().join(last, [by, "_part"], "left")
    handed = F.last("_last", ignorenulls=True).over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    above = Window.partitionBy(by, "_part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumn("_own_part", F.last("own", ignorenulls=True).over(above)).join(parts.select(by, "_part", handed.alias("_handed")), [by, "_part"])
    return inside.withColumn("raw_label", F.coalesce("_own_part", "_handed")).withColumn("is_marker", F.col("own").isNotNull()).drop("own", "_part", "_own_part", "_handed")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, order: list[str], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """1-based position in a total order, without sorting everything in one task.

    Rows are range-partitioned by sampled bounds of the order, in as many parts as their number asks for; positions inside
    a part are shifted by the rows of those before. Parts are summed up in groups of GROUP_PARTS, and these in one task.
    """
    rows = rows.checkpoint()  # counted, sampled and dealt
    parts = max(1, -(-rows.count() // part_rows))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    inside = inside.checkpoint()  # the part numbers must not change between the two uses
    counts = inside.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_group", F.floor(F.col("_part") / GROUP_PARTS))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("n").alias("n"))
    groups = groups.select("_group", F.coalesce(F.sum("n").over(upto.orderBy("_group")), F.lit(0)).alias("_before_group"))
    own = F.coalesce(F.sum("n").over(upto.partitionBy("_group").orderBy("_part")), F.lit(0))
    before = counts.withColumn("_own", own).join(groups, "_group").select("_part", (F.col("_own") + F.col("_before_group")).alias("_before"))
    # a row for each part: broadcast while there are few, else by what Spark finds
    return inside.join(F.broadcast(before) if parts <= BROADCAST_PARTS else before, "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def read_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(file, line_no, line) -> (entries: file, line_no, url, label; rejects: file, line_no, line, reason).

    Duplicates of (url, label) keep the first; comments and blank lines are nothing; markers of unknown labels, urls that
    aren't supported and urls before any marker are rejects.
    """
    s = section_label(lines).withColumn("label", T.normalize_label(F.col("raw_label")))
    reason = (
        F.when(F.col("is_marker") & F.col("label").isNull(), "unknown label")
        .when(F.col("is_marker") | (F.col("line") == "") | F.col("line").startswith("#"), "")
        .when(~T.is_supported_url(F.col("line")), "unsupported url")
        .when(F.col("raw_label").isNull(), "url before a label")
        .when(F.col("label").isNull(), "unknown label")
    )
    s = s.withColumn("reason", reason)
    rejects = s.filter("reason <> ''").select("file", "line_no", "line", "reason")
    entries = s.filter("reason is null").select("file", "line_no", F.col("line").alias("url"), "label")
    return first_seen(entries, ["url", "label"], ["file", "line_no"]), rejects


def manifest(lines: DataFrame, strict: bool = False) -> DataFrame:
    """entries with manifest_index. strict raises at the first reject, or if there is no entry."""
    entries, rejects = read_lines(lines)
    if strict:
        if bad := rejects.orderBy("file", "line_no").first():
            raise ValueError(f"{bad.reason} in {bad.file}, line {bad.line_no}: {bad.line}")
        if not entries.limit(1).count():
            raise ValueError("no urls found")
    return numbered(entries, ["file", "line_no"], "manifest_index").select(F.col("manifest_index").cast("long"), "url", "label")


def check_shard(count: int, index: int) -> None:
    if count < 1:
        raise ValueError("a manifest has one shard at least")
    if not 0 <= index < count:
        raise ValueError(f"the shard must be from 0 to {count - 1}")


def shard_of(index: Column, count: int) -> Column:
    return F.pmod(index - 1, F.lit(count)).cast("long")


def shard(entries: DataFrame, count: int, index: int) -> DataFrame:
    """Every count-th entry, with its number in the whole manifest."""
    check_shard(count, index)
    return entries.filter(shard_of(F.col("manifest_index"), count) == index)


def shards_complete_disjoint(entries: DataFrame, count: int) -> DataFrame:
    """missing, extra: rows that the shards' union lacks or has too much. Both are 0 for a partition."""
    union = shard(entries, count, 0)
    for i in range(1, count):
        union = union.unionAll(shard(entries, count, i))
    return compare_rows(entries, union)


def compare_rows(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """missing, extra: how many rows of whole the parts lack, and how many they have too much; repeated rows count. One exchange for both."""
    both = whole.withColumn("_n", F.lit(1)).unionByName(parts.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*whole.columns).agg(F.sum("_n").alias("_n"))
    return left.agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("extra"))


def shard_sizes(entries: DataFrame, count: int) -> DataFrame:
    """shard, n, index_sum: what each shard holds, in one pass."""
    return entries.groupBy(shard_of(F.col("manifest_index"), count).alias("shard")).agg(F.count("*").alias("n"), F.sum("manifest_index").alias("index_sum"))


def cross_label_overlap(entries: DataFrame) -> DataFrame:
    """Urls that stand under more than one label."""
    return entries.groupBy("url").agg(F.count_distinct("label").alias("n_labels")).filter("n_labels > 1")


def build_labelled(kids: DataFrame, normal: DataFrame) -> DataFrame:
    """Two url lists (position, url), each without comments, as (section, position, line) with a marker above each."""
    spark = kids.sparkSession
    out = spark.createDataFrame([(0, -1, "# LABEL: YOUTUBE_KIDS"), (1, -1, "# LABEL: NORMAL_YOUTUBE")], "section int, position long, line string")
    for section, rows in enumerate((kids, normal)):
        sound = rows.filter(~F.col("url").startswith("#") & (F.trim("url") != ""))
        out = out.unionByName(sound.select(F.lit(section).alias("section"), F.col("position").cast("long"), F.col("url").alias("line")))
    return out
