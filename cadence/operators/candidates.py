"""Finding and verifying candidate recordings: tasks, eligibility, metadata checks, quotas and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import text as T
from cadence.operators.manifest import first_seen

FIRST_YEAR = 2008
# Bounds of the two searches, the seed of the order of checks, and what a passed check is called.
LONG_SECONDS, SHORT_SECONDS = (300, 600), (270, 330)
SEED = 20260920
CHECK_PASSED = "passed_unauthenticated_metadata_format_check"


def search_tasks(topics: DataFrame, last_year: int | None = None) -> DataFrame:
    """topics(task_no, source, genre, phrase) for each year from FIRST_YEAR to the last (this one): query is phrase and year."""
    last = F.lit(last_year) if last_year else F.year(F.current_date())
    t = topics.withColumn("search_year", F.explode(F.sequence(F.lit(FIRST_YEAR), last)))
    return t.withColumn("search_query", F.concat_ws(" ", "phrase", "search_year"))


def seeded_order(key: Column, seed: int = SEED) -> Column:
    """Sort by this for a fixed shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key))


def eligible(found: DataFrame, seconds: tuple[int, int] = LONG_SECONDS) -> DataFrame:
    """found(rank, source, video_id, title, channel, duration, url) -> candidates with cleaned texts, without rows that lack
    an id or a duration in range."""
    c = found.withColumn("video_id", T.clean(F.col("video_id"))).filter((F.col("video_id") != "") & T.duration_between(F.col("duration"), *seconds))
    return c.select(
        "rank", "source", T.classify(F.col("source")).alias("classification"), T.clean(F.col("title")).alias("title"), T.clean(F.col("channel")).alias("channel"),
        F.col("duration").try_cast("double").cast("int").alias("duration_seconds"), "video_id", T.watch_url(F.col("url"), F.col("video_id")).alias("url"),
        T.kids_url(F.col("source"), F.col("video_id")).alias("kids_url"),
    )


def distinct_candidates(candidates: DataFrame, scope: str = "source") -> DataFrame:
    """First seen of each id, within its source or over all."""
    return first_seen(candidates, ["source", "video_id"] if scope == "source" else ["video_id"], ["rank"])


def oversample(candidates: DataFrame, target: int, factor: float, order: list[str]) -> DataFrame:
    return candidates.orderBy(*order).limit(int(target * factor))


def per_query_limit(found: DataFrame, limit: int, query: str = "search_query", order: str = "rank") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(order))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def results_per_query(target: int, queries: int) -> int:
    return max(12, target // queries + 8)


def verify(candidates: DataFrame, metadata: DataFrame, seconds: tuple[int, int] = LONG_SECONDS, sound: Column | None = None, key: str = "video_id") -> DataFrame:
    """Candidates with metadata that passes all checks; its title and channel stand above the candidate's.

    metadata(key, availability, language, duration, title, channel, uploader?, and formats, or what ``sound`` is made of).
    """
    m = metadata
    if "uploader" in m.columns:
        m = m.withColumn("channel", F.coalesce(F.nullif("channel", F.lit("")), "uploader"))
    m = m.withColumn("_sound", T.has_audio_format(F.col("formats")) if sound is None else sound)
    m = m.filter(T.available(F.col("availability")) & F.col("_sound") & T.language_ok(F.col("language")) & T.duration_between(F.col("duration"), *seconds))
    m = m.select(key, T.language_label(F.col("language")).alias("language"), F.col("duration").alias("_duration"), T.clean(F.col("title")).alias("_title"), T.clean(F.col("channel")).alias("_channel"))
    out = candidates.join(m, key).withColumns({
        "title": T.first_given(F.col("_title"), F.col("title")), "channel": T.first_given(F.col("_channel"), F.col("channel")),
        "duration_seconds": F.col("_duration").try_cast("double").cast("int"), "download_check": F.lit(CHECK_PASSED), "download_checked_at": T.utc_now(),
    })
    return out.drop("_title", "_channel", "_duration")


def quota(rows: DataFrame, target: int, label: str, order: list[Column | str]) -> DataFrame:
    """The first rows of each label."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= target).drop("_rank")


def sample_by_label(rows: DataFrame, n: int, eligible_if: Column, reason: Column, key: str = "video_id", label: str = "label", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """n eligible rows per label in seeded order, and the rows that came before the last of these but weren't eligible.

    Only the first n eligible rows of each label are ranked; the others are compared with the last of them.
    """
    good, at = F.coalesce(eligible_if, F.lit(False)), F.struct(seeded_order(F.col(key), seed).alias("place"), F.col(key).alias("key"))
    marked = rows.withColumn("_good", good).withColumn("_at", at)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_at"))
    ranked = marked.filter("_good").withColumn("_rank", rank).filter(F.col("_rank") <= n)
    last = ranked.filter(F.col("_rank") == n).select(F.col(label).alias("_label"), F.col("_at").alias("_last"))
    before = marked.filter("not _good").join(last, F.col(label).eqNullSafe(F.col("_label")), "left").filter("_last is null or _at < _last")
    return ranked.drop("_good", "_at", "_rank"), before.drop("_good", "_at", "_label", "_last").withColumn("reason", reason)


def collection_progress(checked: DataFrame, candidate_count: int | Column) -> DataFrame:
    """checked(label, passed) -> one row of counts."""
    return checked.agg(
        F.count("*").alias("checked"), F.lit(candidate_count).cast("long").alias("candidate_count"),
        F.count_if((F.col("label") == "kids") & F.col("passed")).alias("kids_verified"),
        F.count_if((F.col("label") == "normal") & F.col("passed")).alias("normal_verified"),
    )


def usable_outcome(found: Column, timed_out: Column, error: Column) -> Column:
    """yt_dlp_ok and yt_dlp_error of one access check; an error keeps its last 1,000 characters."""
    return F.struct(
        F.coalesce(found & ~timed_out, F.lit(False)).alias("ok"),
        F.when(timed_out, "timeout").when(found, "").otherwise(F.right(F.coalesce(error, F.lit("")), F.lit(1000))).alias("error"),
    )


def access_rate(checks: DataFrame, kind: str = "kind", ok: str = "ok") -> DataFrame:
    return checks.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("n_ok"))


def all_sources(kids: DataFrame, normal: DataFrame) -> DataFrame:
    """Both lists, duplicates and all."""
    return kids.unionByName(normal, allowMissingColumns=True)
