"""Results on disk, streams, and models."""

import json

from pyspark.sql import functions as F

from cadence.operators import inference, payload
from cadence.plans.fixtures import Inputs
from cadence.sources import results
from cadence.streaming import jobs

WORD = {"word": "a", "start_time": 0.0, "end_time": 1.0, "pitch_mean_hz": None, "pitch_variance": None, "pause_after_sec": None, "speech_rate_sps": 1.0}
SYLLABLE = {"syllable": "a", "parent_word": "a", "syllable_index": 1, "syllable_count": 1, **{k: WORD[k] for k in list(WORD)[1:]}, "timing_method": "uniform_within_word"}


def test_every_shape_is_read(spark, tmp_path):
    head = {"label": "kids", "source_url": "u", "language": "en", "granularity": "both"}
    shapes = {"list.json": [WORD, WORD], "syl.json": [SYLLABLE], "both.json": {"words": [WORD], "syllables": [SYLLABLE, SYLLABLE]}, "full.json": {**head, "words": [WORD]}, "empty.json": {**head, "words": []}}
    for name, doc in shapes.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    words, syllables = results.read_results(spark, str(tmp_path))
    count = lambda d: {r.file.rsplit("/", 1)[1]: r["count"] for r in d.groupBy("file").count().collect()}
    assert count(words) == {"list.json": 2, "both.json": 1, "full.json": 1} and count(syllables) == {"syl.json": 1, "both.json": 2}
    assert words.filter("label = 'kids'").first().source_url == "u" and words.first().pitch_mean_hz is None


def test_results_round_trip(spark, tmp_path):
    heads = spark.createDataFrame([(1, "kids", "u", "en"), (2, "normal", "v", "en")], "recording_id long, label string, source_url string, language string")
    words = spark.createDataFrame([(1, 0, *WORD.values()), (1, 1, *WORD.values())], "recording_id long, pos long, " + results.WORD)
    results.write_results(payload.nest_payload(heads, words=words, granularity="word"), str(tmp_path / "r"))
    line = next((tmp_path / "r" / "label_dir=kids").glob("*.json")).read_text()
    assert '"pitch_mean_hz":null' in line and '"label":"kids"' in line
    assert results.read_results(spark, str(tmp_path / "r"))[0].count() == 2


def test_stream_fold_is_the_batch_fold(spark, sf):
    from cadence.plans.queries import QUERIES

    a, b = QUERIES["fold_progress"](spark, sf), QUERIES["stream_fold_progress"](spark, sf)
    assert a.count() == b.count() > 0 and a.exceptAll(b.select(a.columns)).count() == 0


def test_stream_admission_and_lifecycle(spark, sf, tmp_path):
    i = Inputs(spark, sf)
    i.requests().repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(i.requests().schema).parquet(str(tmp_path / "in"))
    got = jobs.run_to_memory(jobs.admit_jobs(stream).select("request_no", "job_id", "accepted", "reason"), "admitted", str(tmp_path / "c1"), "append")
    want = jobs.admit_jobs(i.requests()).select("request_no", "job_id", "accepted", "reason")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    i.job_events().repartition(3).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(i.job_events().schema).parquet(str(tmp_path / "ev"))
    got = jobs.run_to_memory(jobs.lifecycle_updates(events), "lives", str(tmp_path / "c2"))
    want = jobs.lifecycle_updates(i.job_events())
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_incremental_work_is_done_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))

    def work(batch):
        return batch.withColumn("status", F.when(F.col("id") == 3, "failed").otherwise("completed"))

    def go():
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        jobs.process_incrementally(stream, "id", work, str(tmp_path / "state"), str(tmp_path / "check"))
        return spark.read.parquet(str(tmp_path / "state"))

    assert go().count() == 5
    spark.range(3, 8).write.mode("append").parquet(str(tmp_path / "in"))
    done = go()
    assert done.count() == 9 and sorted(r.id for r in done.filter("batch = 1").collect()) == [3, 5, 6, 7]  # 4 was done, 3 had failed
    assert go().count() == 9


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    loads = tmp_path / "loads"
    loads.mkdir()

    def load_aligner(language):
        import uuid

        (loads / f"{language}-{uuid.uuid4().hex}").touch()
        return language

    def transcribe(model, aligner, row, batch_size):
        assert batch_size == 16
        if row["recording_id"] == 2:
            return None
        if row["recording_id"] == 3:
            raise KeyError("x")
        return {"n": model(row["text"]), "aligner": aligner}

    rows = spark.createDataFrame([(1, "en", "abc"), (2, "en", "d"), (3, "en", "e"), (4, "fr", "fg"), (5, "fr", "h")], "recording_id long, language string, text string").coalesce(1)
    out = inference.map_recordings(rows, lambda: len, transcribe, "n long, aligner string", load_aligner, 16, name=f"fake-{tmp_path.name}")
    got = {r.recording_id: r for r in out.collect()}
    assert (got[1].n, got[1].aligner, got[4].aligner) == (3, "en", "fr") and got[2].error == "ValueError: no output" and got[3].status == "failed" and got[3].error.startswith("KeyError")
    assert {p.name.split("-")[0] for p in loads.iterdir()} == {"en", "fr"} and len(list(loads.iterdir())) <= 4
    done, failed = inference.split_outcomes(out)
    assert done.count() == 3 and failed.count() == 2
