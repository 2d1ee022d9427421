"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of documents. Between stages the rows are written as Parquet into the cluster's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import line_dedup, mixing, near_dup, packing, quality
from cadence.llm.queries import ready, table


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as one value: so a stage's own names never meet those of the documents."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(carried(docs), model, ("carried",)).filter(F.col("score") >= quality.THRESHOLD).select("carried.*")


def cut_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one holds; those of which nothing is left go."""
    ready(spark)
    out = line_dedup.remove_common_lines(carried(docs))
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carried.n_chars"))
    return out.select(*(new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group."""
    ready(spark)
    kept = near_dup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return carried(docs).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("carried.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ready(spark)
    return mixing.emit(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which sequence."""
    ready(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_common_lines),
    ("near-duplicates", keep_one_of_each_group),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trees, alignments, union-find and packing are beyond SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            rows.write.parquet(f"{folder}/{k}")
            rows = spark.read.parquet(f"{folder}/{k}")
    return rows
