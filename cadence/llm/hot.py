"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many keys, the most frequent ones, are looked at, whatever the table's size: that bounds what is broadcast here. All others
#: have less than this part of the rows each.
SHARES = 1000


def join_dealt(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int, by: Column, how: str = "inner") -> DataFrame:
    """rows joined with table on the key (how: inner or left), where counts(key, n) says how many of the total rows have a key.

    The rows of a hot key are dealt by a hash of ``by``, and what the table has for it goes along to each part, so no task gets
    more than about a SHARES-th of all rows for one key. Null keys join with nothing.
    """
    hot = counts.orderBy(F.col("n").desc(), key).limit(SHARES).select(F.col(key).alias("_hot"), F.ceil(F.col("n") * SHARES / max(total, 1)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_hot", "_parts")
    spread = table.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_its_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts").withColumnRenamed(key, "_its_key")
    return dealt.join(spread, (F.col(key) == F.col("_its_key")) & (F.col("_part") == F.col("_its_part")), how).drop("_part", "_its_part", "_its_key")


def counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))
