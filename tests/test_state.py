import datetime as dt

from pyspark.sql import functions as F

from cadence.operators import candidates as C
from cadence.operators import state as S
from cadence.sources import snapshots

STATE = "manifest_index long, url string, label string, status string, stage_status string, detail string, attempts long, output_path string"


def test_resume(spark):
    manifest = spark.createDataFrame([(1, "a", "kids", "new/a"), (2, "a", "normal", "new/a2"), (3, "c", "kids", "new/c")], "manifest_index long, url string, label string, output_path string")
    old = spark.createDataFrame([(9, "a", "kids", "processing", "", "", 2, "old"), (8, "a", "normal", "completed", "completed", "", 1, "old"), (7, "gone", "kids", "failed", "", "", 1, "old")], STATE)
    rows = {(r.url, r.label): r for r in S.resume(manifest, old).collect()}
    assert set(rows) == {("a", "kids"), ("a", "normal"), ("c", "kids")}
    a = rows["a", "kids"]
    assert (a.status, a.stage_status, a.detail, a.attempts, a.output_path, a.manifest_index) == ("pending", "interrupted", S.RESUMED, 2, "new/a", 1)
    assert rows["a", "normal"].status == "completed" and (rows["c", "kids"].status, rows["c", "kids"].attempts) == ("pending", 0)
    by_url = {(r.url, r.label): r.status for r in S.resume(manifest, old, key=("url",)).collect()}
    assert by_url["a", "kids"] == by_url["a", "normal"] == "pending"  # the last entry, by index, speaks for both


def test_repairs_and_summaries(spark):
    s = spark.createDataFrame([(1, "kids", "failed"), (2, "kids", "completed"), (3, "normal", "completed"), (4, "normal", "pending")], "job_id long, label string, status string")
    assert S.retry_failed(s).filter("status = 'pending'").count() == 2 and S.retry_failed(s, False).filter("status = 'failed'").count() == 1
    reopened = S.reopen_missing_outputs(s, spark.createDataFrame([(2,)], "job_id long"), "job_id")
    assert {r.job_id: r.status for r in reopened.collect()} == {1: "failed", 2: "completed", 3: "pending", 4: "pending"}
    assert tuple(S.status_summary(s).first()) == (4, 1, 0, 2, 1, 0)
    rows = {r.label: r for r in S.label_summary(s).collect()}
    assert rows["kids"].failed == 1 and rows[None].total == 4
    assert S.final_status(s).first().exit_code == 1 and S.final_status(s.filter("job_id > 1")).first().exit_code == 0
    assert S.final_status(s.filter("false")).first().exit_code == 0 and S.pending(s).count() == 1


def test_service_restart(spark):
    jobs = spark.createDataFrame([("j", "processing", "started", "")], "job_id string, status string, stage_status string, detail string")
    r = S.requeue(jobs, service=True).first()
    assert (r.status, r.stage_status) == ("queued", "restart_queued")
    assert S.job_summary(S.requeue(jobs, service=True)).first().queued == 1


def test_lifecycle(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [(1, k, t, kind, "download") for k, kind in enumerate(("queued", "started", "progress", "failed", "started", "completed"))]
    ev += [(2, 0, t, "started", "download"), (2, 1, t, "progress", "prosody_analysis"), (3, 0, t, "progress", "download")]
    rows = {r.job_id: r for r in S.lifecycle(spark.createDataFrame(ev, "job_id long, seq long, ts timestamp, kind string, stage string")).collect()}
    assert (rows[1].status, rows[1].stage, rows[1].attempts, rows[1].error) == ("completed", "finished", 2, None)
    assert (rows[2].status, rows[2].stage, rows[2].attempts) == ("processing", "prosody_analysis", 1)
    assert (rows[3].status, rows[3].stage) == ("queued", "waiting")


def test_admission(spark):
    ok = ("https://youtu.be/a", "kids", "both", 75.0, 600.0)
    bad = [("ftp://x", *ok[1:]), (ok[0], "adult", *ok[2:]), (*ok[:2], "phone", *ok[3:]), (*ok[:3], 700.0, 600.0), (None, None, None, None, None)]
    rows = S.admit(spark.createDataFrame([ok, ok, *bad], "url string, label string, granularity string, pitch_floor double, pitch_ceiling double")).collect()
    assert [r.reason for r in rows] == [None, None, "unsupported url", "unknown label", "unknown granularity", "invalid pitch range", "unsupported url"]
    assert rows[0].job_id == rows[1].job_id and len(rows[0].job_id) == 16
    assert S.public_view(spark.createDataFrame([(1, "w", "o")], "job_id long, workdir string, output_path string")).columns == ["job_id"]


def test_snapshots(spark, tmp_path):
    p = str(tmp_path / "state")
    assert snapshots.read_state(spark, p) is None
    first = spark.range(3).withColumn("status", F.lit("pending"))
    assert snapshots.write_state(first, p) == 1
    assert snapshots.write_state(snapshots.read_state(spark, p).withColumn("status", F.lit("completed")), p) == 2
    assert snapshots.read_state(spark, p).filter("status = 'completed'").count() == 3


def test_verification(spark):
    cand = spark.createDataFrame([(1, "youtube", "a", " A  title ", "c", "400", ""), (2, "youtube", "a", "again", "c", "400", ""), (3, "youtube_kids", "a", "k", "c", "300", "given"), (4, "youtube", "", "x", "c", "400", ""), (5, "youtube", "b", "x", "c", "n/a", "")], "rank long, source string, video_id string, title string, channel string, duration string, url string")
    e = C.eligible(cand)
    assert sorted(r["rank"] for r in e.collect()) == [1, 2, 3]
    assert sorted(r["rank"] for r in C.distinct_candidates(e).collect()) == [1, 3] and [r["rank"] for r in C.distinct_candidates(e, "global").collect()] == [1]
    meta = spark.sql("SELECT 'a' video_id, cast(null as string) availability, '' language, 450 duration, '' title, '' channel, 'up' uploader, array(named_struct('url','u','acodec','opus')) formats")
    v = C.verify(C.distinct_candidates(e, "global"), meta).first()
    assert (v.title, v.channel, v.duration_seconds, v.language) == ("A title", "up", 450, "english_search_candidate") and v.download_check == C.CHECK_PASSED
    assert C.verify(e, meta.withColumn("language", F.lit("de"))).count() == 0 and C.verify(e, meta.withColumn("availability", F.lit("private"))).count() == 0


def test_quota_sample_and_outcomes(spark):
    rows = spark.range(100).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("video_id"), F.when(F.col("id") % 2 == 0, "kids").otherwise("normal").alias("label"), "id")
    assert C.quota(rows, 7, "label", ["id"]).groupBy("label").count().filter("count = 7").count() == 2
    chosen, skipped = C.sample_by_label(rows, 10, F.col("id") % 3 > 0, F.lit("third"))
    assert chosen.count() == 20 and chosen.filter("id % 3 = 0").count() == 0 and set(r.reason for r in skipped.collect()) == {"third"}
    assert sorted(r.id for r in chosen.collect()) == sorted(r.id for r in C.sample_by_label(rows.repartition(5), 10, F.col("id") % 3 > 0, F.lit("third"))[0].collect())
    o = spark.createDataFrame([(True, False, None), (False, True, "x"), (False, False, "e" * 1500)], "f boolean, t boolean, e string").select(C.usable_outcome(F.col("f"), F.col("t"), F.col("e")).alias("o")).collect()
    assert [(r.o.ok, len(r.o.error)) for r in o] == [(True, 0), (False, 7), (False, 1000)]
    assert C.results_per_query(100, 20) == 13 and C.results_per_query(10, 20) == 12
    topics = spark.createDataFrame([(1, "youtube", "g", "p")], "task_no int, source string, genre string, phrase string")
    assert C.search_tasks(topics, 2010).orderBy("search_year").first().search_query == "p 2008" and C.search_tasks(topics, 2010).count() == 3
