"""State tables as whole snapshots: each version in a folder of its own, and a pointer to the one that counts.

A version is complete before its pointer is written, and no folder is ever overwritten, so a reader sees the old
version or the new one. Each pointer is a small table of its own; the highest version counts. Old versions may be
dropped, which bounds what is listed and read, however often the state was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadence.sources import files

SCHEMA_VERSION = 1


def versions(spark: SparkSession, path: str) -> list[int]:
    """All that are complete and still there, by their pointers."""
    found = [int(x[1:]) for x in files.names(spark, f"{path}/pointers") if x[:1] == "p" and x[1:].isdigit()]
    # a pointer without rows is one whose write didn't end
    return sorted(v for v in found if any(x.endswith(".parquet") for x in files.names(spark, f"{path}/pointers/p{v}")))


def current_version(spark: SparkSession, path: str) -> int:
    return max(versions(spark, path), default=0)


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    version = version or current_version(spark, path)
    return spark.read.parquet(f"{path}/v{version}") if version else None


def write_state(state: DataFrame, path: str, keep: int | None = None) -> int:
    """keep: so many of the last versions stay, for readers that are under way; None keeps all."""
    spark = state.sparkSession
    old = versions(spark, path)
    version = max([0, *old, *(int(x[1:]) for x in files.names(spark, path) if x[:1] == "v" and x[1:].isdigit())]) + 1
    state.write.mode("error").parquet(f"{path}/v{version}")
    spark.createDataFrame([(version, SCHEMA_VERSION)], "version long, schema_version int").coalesce(1).write.mode("error").parquet(f"{path}/pointers/p{version}")
    for v in old[: max(0, len(old) + 1 - keep)] if keep else []:
        files.delete(spark, f"{path}/pointers/p{v}")
        files.delete(spark, f"{path}/v{v}")
    return version
