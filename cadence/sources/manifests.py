"""Manifest files, candidate lists and access samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.operators.manifest import build_labelled, manifest

ACCESS = {"yt_dlp_ok": "boolean", "duration": "double", "tested_seconds": "double"}


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line_no, line of text files, in the order of each file; a byte order mark is dropped.

    A large file is read in its blocks, each by a task of its own: lines are numbered inside their block, and shifted by what the
    blocks before it hold. Only counts by block are summed up over a file.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")]
    read = lambda: spark.read.text(paths)
    # rows of a block are in one partition, in their order; the id tells that order, whatever partition it is
    inside = read().select(*block, F.regexp_replace("value", "^\ufeff", "").alias("line"), F.monotonically_increasing_id().alias("_id"))
    inside = inside.withColumn("_nth", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_id")))
    counts = read().select(*block).groupBy("file", "_block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "_block", before.alias("_before"))
    return inside.join(starts, ["file", "_block"]).select("file", (F.col("_before") + F.col("_nth") - 1).alias("line_no"), "line")


def read_manifest(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    return manifest(read_lines(spark, paths), strict)


def write_manifest(kids: DataFrame, normal: DataFrame, path: str) -> None:
    """Candidates with position and url, as CSV, JSON, one url list per label and one list with markers."""
    rows = kids.withColumn("label", F.lit("kids")).unionByName(normal.withColumn("label", F.lit("normal")), allowMissingColumns=True)
    rows.write.mode("error").option("header", True).option("escape", '"').csv(f"{path}/csv")
    rows.write.mode("error").option("ignoreNullFields", "false").json(f"{path}/json")
    rows.select("label", F.col("url").alias("value")).write.mode("error").partitionBy("label").text(f"{path}/urls")
    lines = build_labelled(kids.select("position", "url"), normal.select("position", "url"))
    # the one list that must be a single ordered file: its rows are urls of one manifest
    lines.repartition(1).sortWithinPartitions("section", "position").select(F.col("line").alias("value")).write.mode("error").text(f"{path}/labelled")


def read_access_sample(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """All fields are text in CSV: those of ACCESS are cast, what can't be is null."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path) if form == "csv" else spark.read.json(path)
    return rows.withColumns({c: F.col(c).try_cast(k) for c, k in ACCESS.items() if c in rows.columns})


def write_access_sample(parts: list[DataFrame], path: str) -> None:
    """The union of the parts' columns, sorted by name, as JSON lines and CSV."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = rows.select(*sorted(rows.columns))
    rows.write.mode("error").json(f"{path}/jsonl")
    rows.write.mode("error").option("header", True).option("escape", '"').csv(f"{path}/csv")
