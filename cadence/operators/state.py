"""Job state: resuming, repairing, folding of events, summaries and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import text as T

BATCH_STATUSES = ("pending", "processing", "completed", "failed", "interrupted")
SERVICE_STATUSES = ("queued", "processing", "completed", "failed")
# Texts that a resumed job shows.
RESUMED = "Previous process stopped; queued for automatic retry."
RESTARTED = "API restarted; job queued from the beginning."
#: What a resumed job takes from the manifest and not from its state.
FROM_MANIFEST = ("manifest_index", "label", "output_path", "workdir")


def requeue(state: DataFrame, service: bool = False) -> DataFrame:
    """Jobs that were under way when the process ended wait again."""
    cut = F.col("status").isin("processing", "interrupted") if not service else F.col("status") == "processing"
    put = {"status": "queued" if service else "pending", "stage_status": "restart_queued" if service else "interrupted", "detail": RESTARTED if service else RESUMED}
    return state.withColumns({k: F.when(cut, v).otherwise(F.col(k) if k in state.columns else F.lit("")) for k, v in put.items()})


def resume(manifest: DataFrame, state: DataFrame, key: tuple[str, ...] = ("url", "label")) -> DataFrame:
    """Every manifest entry with what is known of it; entries that left the manifest vanish.

    With key ("url",) the last entry of a url, by manifest_index, speaks for all its labels.
    """
    known = [c for c in state.columns if c not in (*FROM_MANIFEST, *key)]
    if tuple(key) == ("url",) and "manifest_index" in state.columns:
        last = F.row_number().over(Window.partitionBy("url").orderBy(F.col("manifest_index").desc()))
        state = state.withColumn("_last", last).filter("_last = 1")
    old = requeue(state).select(*(F.col(k).alias(f"_{k}") for k in key), *known, *(c for c in ("stage_status", "detail") if c not in known), F.lit(True).alias("_known"))
    on = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    fresh = {"status": "pending", "stage": "waiting", "stage_status": "pending", "detail": ""}
    joined = manifest.select(*[c for c in manifest.columns if c not in old.columns]).join(old, on, "left")
    out = joined.withColumns({k: F.when(F.col("_known"), F.col(k)).otherwise(F.lit(v)) for k, v in fresh.items() if k in joined.columns})
    if "attempts" in out.columns:
        out = out.withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return out.drop("_known", *(f"_{k}" for k in key))


def retry_failed(state: DataFrame, retry: bool = True) -> DataFrame:
    """Failed jobs wait again, if that is asked for."""
    if not retry:
        return state
    failed = F.col("status") == "failed"
    put = {"status": "pending", "stage": "waiting", "stage_status": "retry_queued", "error": None}
    return state.withColumns({k: F.when(failed, F.lit(v)).otherwise(F.col(k) if k in state.columns else F.lit(None)) for k, v in put.items()})


def reopen_missing_outputs(state: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Completed jobs whose output is gone wait again. outputs holds the keys of outputs that exist."""
    there = outputs.select(F.col(key).alias("_there")).distinct()
    lost = (F.col("status") == "completed") & F.col("_there").isNull()
    joined = state.join(there, F.col(key) == F.col("_there"), "left")
    keep = F.col("stage_status") if "stage_status" in state.columns else F.lit("")
    return joined.withColumn("stage_status", F.when(lost, "output_missing").otherwise(keep)).withColumn("status", F.when(lost, "pending").otherwise(F.col("status"))).drop("_there")


def pending(state: DataFrame) -> DataFrame:
    return state.filter("status = 'pending'")


def status_counts(statuses: tuple[str, ...]) -> list[Column]:
    return [F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in statuses)]


def status_summary(state: DataFrame) -> DataFrame:
    return state.agg(*status_counts(BATCH_STATUSES))


def job_summary(state: DataFrame) -> DataFrame:
    return state.agg(*status_counts(SERVICE_STATUSES))


def label_summary(state: DataFrame) -> DataFrame:
    """One row per label, and one with a null label for all, in one pass."""
    return state.rollup("label").agg(*status_counts(BATCH_STATUSES)).orderBy(F.col("label").asc_nulls_last())


def shard_rollup(states: DataFrame, shard: str = "shard") -> DataFrame:
    """The five counters of each shard, and of all in a row with a null shard."""
    return states.rollup(shard).agg(*status_counts(BATCH_STATUSES))


def final_status(state: DataFrame) -> DataFrame:
    """exit_code: 1 if any job failed, else 0."""
    return state.agg(F.coalesce(F.max(F.when(F.col("status") == "failed", 1).otherwise(0)), F.lit(0)).alias("exit_code"))


def fold_progress(events: DataFrame, job: str = "job_id") -> DataFrame:
    """The latest event of each job by (ts, seq)."""
    latest = F.max_by(F.struct("seq", "ts", "kind", "stage"), F.struct("ts", "seq"))
    return events.groupBy(job).agg(latest.alias("_e")).select(job, "_e.*")


def lifecycle(events: DataFrame, job: str = "job_id") -> DataFrame:
    """Each job's state after its events (seq, ts, kind, stage) in the order of (ts, seq), whenever they come.

    started: processing, one more attempt, no error; completed and failed end an attempt; progress moves the stage of a job
    that is under way; queued, or any other kind, puts it back. What counts is the last event that isn't progress, the last
    progress after it, and the last that starts or ends an attempt: a few values a job, which a stream can keep as well.
    """
    kind, e = F.col("kind"), F.struct("ts", "seq", "kind", "stage")
    progress = F.coalesce(kind == "progress", F.lit(False))
    folded = events.groupBy(job).agg(
        F.max(F.when(~progress, e)).alias("fixed"), F.max(F.when(progress, e)).alias("moved"), F.max(F.when(kind.isin("started", "completed", "failed"), e)).alias("ended"),
        F.count_if(kind == "started").alias("attempts"), F.count("*").alias("n_events"),
    )
    last = F.col("fixed.kind")
    stage = (
        F.when(last == "started", F.when(F.coalesce(F.col("moved") > F.col("fixed"), F.lit(False)), F.col("moved.stage")).otherwise("initializing"))
        .when(last == "completed", "finished").when(last == "failed", F.col("fixed.stage")).otherwise("waiting")
    )
    return folded.select(
        job, F.when(last == "started", "processing").when(last.isin("completed", "failed"), last).otherwise("queued").alias("status"), stage.alias("stage"), "attempts",
        F.when(F.col("ended.kind") == "failed", F.concat(F.lit("failed in "), F.col("ended.stage"))).alias("error"), "n_events",
    )


def attempt_number(events: DataFrame, job: str = "job_id") -> DataFrame:
    """Events with the number of the attempt that they belong to: starts so far."""
    so_far = Window.partitionBy(job).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("attempt", F.count_if(F.col("kind") == "started").over(so_far))


def public_view(jobs: DataFrame) -> DataFrame:
    return jobs.drop("workdir", "output_path")


def admit(requests: DataFrame) -> DataFrame:
    """requests(url, label, granularity, pitch_floor, pitch_ceiling, ...) with job_id, accepted and reason.

    The id is made of the request, so that a request that is seen twice is one job.
    """
    reason = (
        F.when(~T.is_supported_url(F.col("url")), "unsupported url")
        .when(~F.coalesce(F.col("label").isin("kids", "normal"), F.lit(False)), "unknown label")
        .when(~F.coalesce(F.col("granularity").isin("word", "syllable", "both"), F.lit(False)), "unknown granularity")
        .when(~T.pitch_range_ok(F.col("pitch_floor"), F.col("pitch_ceiling")), "invalid pitch range")
    )
    key = F.left(F.sha2(F.concat_ws("|", "url", "label", "granularity", "pitch_floor", "pitch_ceiling"), 256), F.lit(16))
    return requests.withColumns({"job_id": key, "reason": reason, "accepted": reason.isNull()})


def result_lookup(asked: DataFrame, state: DataFrame, results: DataFrame, job: str = "job_id") -> DataFrame:
    """asked(job_id) with code: 404 for an unknown job, 409 if it isn't completed, 410 if its result is gone, else 200."""
    s = state.select(F.col(job).alias("_job"), "status")
    r = results.select(F.col(job).alias("_result")).distinct()
    code = F.when(F.col("_job").isNull(), 404).when(F.col("status") != "completed", 409).when(F.col("_result").isNull(), 410).otherwise(200)
    joined = asked.join(s, F.col(job) == F.col("_job"), "left").join(r, F.col(job) == F.col("_result"), "left")
    return joined.withColumn("code", code).drop("_job", "_result")
