"""Stateful streams: jobs with timers, and the ledger of what is done."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadence.sources import files, snapshots
from cadence.streaming import jobs
from cadence.streaming.ledger import FAN, KEEP, Ledger, not_done

EVENTS = "job_id string, seq long, ts timestamp_ntz, kind string, stage string"
T0 = dt.datetime(2024, 1, 1)


def events(spark, rows, path):
    made = [(j, n, T0 + dt.timedelta(seconds=t), k, s) for n, (j, t, k, s) in enumerate(rows)]
    spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").parquet(path)


def lives(spark, tmp_path, delay=0.0):
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    out = jobs.lives_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check", 100, 500, delay)
    return {r.job_id: (r.status, r.stage, r.attempts, r.error, r.n_events, r.interruptions) for r in out.collect()}


def test_a_silent_job_is_interrupted_and_its_state_goes(spark, tmp_path):
    events(spark, [("a", 0, "started", "x"), ("b", 5, "started", "x"), ("b", 10, "completed", "x"), ("c", 0, "started", "x"), ("c", 20, "progress", "y"), ("z", 50, "queued", "x")], f"{tmp_path}/in")
    first = lives(spark, tmp_path)
    assert first == {"a": ("processing", "initializing", 1, None, 1, 0), "b": ("completed", "finished", 1, None, 2, 0), "c": ("processing", "y", 1, None, 2, 0), "z": ("queued", "waiting", 0, None, 1, 0)}
    kept = lambda: {r[0] for r in spark.read.format("statestore").option("stateVarName", "life").load(f"{tmp_path}/check").select("key.job_id").collect()}
    assert kept() == {"a", "b", "c", "z"}
    events(spark, [("c", 90, "failed", "w"), ("c", 95, "started", "x"), ("d", 1000, "started", "x")], f"{tmp_path}/in")
    second = lives(spark, tmp_path)
    assert second["a"] == ("interrupted", "initializing", 1, None, 1, 1) and second["b"] == first["b"]
    assert second["c"] == ("interrupted", "initializing", 2, None, 4, 1) and second["d"] == ("processing", "initializing", 1, None, 1, 0)
    assert kept() == {"d"}  # what was silent for 500 s is forgotten
    events(spark, [("a", 1010, "started", "x")], f"{tmp_path}/in")
    assert lives(spark, tmp_path)["a"] == ("processing", "initializing", 1, None, 1, 0)  # a new life


def test_batches_do_not_matter(spark, tmp_path):
    """The same events in one batch, and out of order in several, with a delay that covers it."""
    rng = random.Random(4)
    rows = sorted(((rng.choice("abcde"), rng.randrange(3000), rng.choice(("queued", "started", "started", "progress", "progress", "completed", "failed")), rng.choice("xy")) for _ in range(150)), key=lambda r: r[1])
    events(spark, rows, f"{tmp_path}/one/in")
    numbered = list(enumerate(rows))
    for lo in range(0, 150, 50):
        part = numbered[lo : lo + 50]
        rng.shuffle(part)
        made = [(j, n, T0 + dt.timedelta(seconds=t), k, s) for n, (j, t, k, s) in part]
        spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/many/in")
        lives(spark, tmp_path / "many", 200.0)
    assert lives(spark, tmp_path / "many", 200.0) == lives(spark, tmp_path / "one", 200.0)


def test_fifty_batches_are_read_from_few_folders(spark, tmp_path):
    path = f"{tmp_path}/state"
    ledger = Ledger(spark, path, "id")
    most = 0
    for n in range(50):
        folder = ledger.new_folder(n)
        spark.createDataFrame([(n, "completed"), (1000 + n, "failed")], "id long, status string").coalesce(1).write.parquet(folder)
        ledger.add(folder)
        most = max(most, len(ledger.entries))
    assert most <= 2 * FAN and sorted(r.id for r in ledger.done().collect()) == list(range(50))
    assert len(snapshots.versions(spark, f"{path}_ledger/index")) == KEEP and len(files.names(spark, f"{path}_ledger/keys")) <= FAN + KEEP
    assert Ledger(spark, path, "id").entries == ledger.entries and len(files.names(spark, path)) == 50


def test_a_complete_folder_counts_after_a_crash(spark, tmp_path):
    path = f"{tmp_path}/state"
    ledger = Ledger(spark, path, "id")
    for ids, added in (([1, 2], True), ([3], False)):  # the second one's process ends before its version is written
        folder = ledger.new_folder(0)
        spark.createDataFrame([(i, "completed") for i in ids], "id long, status string").write.parquet(folder)
        if added:
            ledger.add(folder)
    (tmp_path / "state" / "run=000000001-half" / "batch=0").mkdir(parents=True)  # one that isn't complete
    again = Ledger(spark, path, "id")
    assert sorted(r.id for r in again.done().collect()) == [1, 2, 3] and again.next_number() == 2
    batch = spark.createDataFrame([(2, "x"), (4, "y")], "id long, what string")
    assert [tuple(r) for r in not_done(batch, again.done(), "id").collect()] == [(4, "y")] and not_done(batch, None, "id").count() == 2


def test_work_that_fails_leaves_nothing(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/in")

    def run(work, check):
        jobs.process_incrementally(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "id", work, f"{tmp_path}/state", f"{tmp_path}/{check}")

    broken = lambda b: b.withColumn("status", F.when(F.raise_error(F.lit("no disk")).isNull(), "completed"))
    with pytest.raises(Exception, match="no disk"):
        run(broken, "one")
    run(lambda b: b.withColumn("status", F.lit("completed")), "one")
    run(lambda b: b.withColumn("status", F.lit("twice")), "two")
    done = spark.read.parquet(f"{tmp_path}/state")
    assert {r.status for r in done.collect()} == {"completed"} and done.count() == 4


def test_old_versions_go(spark, tmp_path):
    p = f"{tmp_path}/s"
    for n in range(5):
        assert snapshots.write_state(spark.range(n + 1), p, keep=2) == n + 1
    assert snapshots.versions(spark, p) == [4, 5] and files.names(spark, p) == ["pointers", "v4", "v5"] and snapshots.read_state(spark, p).count() == 5
