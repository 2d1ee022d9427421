"""One query for each operator of this folder, over its whole table and with production parameters."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, audio, divergence, html, line_dedup, mixing, near_dup, packing, periods, phrases, quality, topk, unigram


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that lies in no more pieces than there are cores is dealt out to all of them."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and rows.rdd.getNumPartitions() <= cores else rows


def ready(spark: SparkSession) -> None:
    """Uses the cluster's checkpoint folder; sets one of its own only where there is none and all runs on one machine, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def op1_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row")


def op3_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors)


def op4_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(audio.store_payload(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op8_pairwise_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_common_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"))


def op11_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    rows = anchors.with_noise(table(spark, sf_dir, "embeddings"))
    return anchors.mine(rows.filter("vec_id % 50 = 0"), rows)


def op12_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return divergence.judge(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periods.digest(periods.collapse(docs.select("doc_id", periods.with_repeats(F.col("doc_id"), F.col("text")).alias("text"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repeated_phrases, op2_mix_sources, op3_branch_and_bound, op4_super_minhash, op5_quality_rules, op6_telephony_audio,
        op7_best_fit_packing, op8_pairwise_alignment, op9_site_style_tree, op10_token_counts,
        op11_anchor_tree_negatives, op12_distribution_divergence, op13_periodic_runs,
    )
}
ORACLE_SQL = {"op2_mix_sources": mixing.ORACLE_SQL, "op3_branch_and_bound": topk.ORACLE_SQL, "op11_anchor_tree_negatives": anchors.ORACLE_SQL, "op12_distribution_divergence": divergence.ORACLE_SQL}
