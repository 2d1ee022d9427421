"""Every operator as a query over the given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import text as T
from cadence.operators import align, candidates, captions, features, inference, manifest, payload, state
from cadence.operators.rangejoin import points_in_intervals
from cadence.plans import oracle
from cadence.plans.fixtures import Inputs
from cadence.sources import manifests, results, snapshots
from cadence.sources.captions import caption_text, read_captions, write_captions
from cadence.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SHARDS, QUOTA = 4, 20
#: Characters of a partition of texts whose lines are exchanged: with fewer, the blocks of that exchange would be many and small.
CAPTION_CHARS = 8_000_000
#: What a search takes in, wide enough for the tables' values.
SECONDS = (100, 600)


def query(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
    return f


def _ready(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of its own only where none is set and all runs on one machine, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def _folder(i: Inputs, name: str) -> str:
    """A new folder in the shared one."""
    return f"{_ready(i.spark)}/{name}-{uuid.uuid4().hex}"


def _event_stream(i: Inputs) -> DataFrame:
    return i.spark.readStream.schema(i.table("events").schema).option("recursiveFileLookup", True).parquet(f"{i.sf_dir}/events.parquet*")


@query
def syllabify(i: Inputs) -> DataFrame:
    parts = T.syllabify(F.col("word"))
    return i.words().select("recording_id", "pos", F.array_join(parts, "|").alias("syllables"), T.count_syllables(F.col("word")).cast("long").alias("n"))


@query
def syllable_units(i: Inputs) -> DataFrame:
    u = align.syllable_units(i.words())
    return u.select("recording_id", "pos", "syllable_index", "syllable_count", "syllable", "start_sec", "end_sec")


@query
def word_features(i: Inputs) -> DataFrame:
    f = features.word_features(i.words(), i.frames())
    return f.select("recording_id", "label", "pos", "word", "start_sec", "end_sec", *features.FEATURES)


@query
def syllable_features(i: Inputs) -> DataFrame:
    f = features.syllable_features(i.words(), i.frames())
    return f.select("recording_id", "pos", "syllable_index", "syllable", *features.FEATURES)


@query
def compare_labels(i: Inputs) -> DataFrame:
    _ready(i.spark)
    f = features.compare_labels(features.word_features(i.words(), i.frames()))
    return f.select(*(F.round(c, 4).alias(c) if c.startswith(("pitch", "pause", "speech")) else c for c in f.columns))


@query
def compare_labels_once(i: Inputs) -> DataFrame:
    """Medians by sketches, looked up in all values: in_bound says whether as many lie below and above as the accuracy promises."""
    _ready(i.spark)
    f = features.kept(features.word_features(i.words(), i.frames()))
    errors = features.rank_errors(f, features.compare_labels_once(f))
    slack = F.col("n") / features.ACCURACY + 1
    return errors.select("label", "feature", "n", ((F.col("below") - slack <= F.col("n") / 2) & (F.col("upto") + slack >= F.col("n") / 2)).alias("in_bound"))


@query
def usable_words(i: Inputs) -> DataFrame:
    return align.usable_words(i.segments())


@query
def nest_payload(i: Inputs) -> DataFrame:
    """Nested and unnested again: the arrays must hold every word at its place."""
    w = align.usable_words(i.segments())
    for c in features.FEATURES:
        w = w.withColumn(c, F.lit(None).cast("double"))
    heads = i.table("conversations").select(F.col("conv_id").alias("recording_id")).distinct().withColumns({"label": F.lit("kids"), "source_url": F.lit(""), "language": F.lit("en")})
    p = payload.nest_payload(heads, words=w, granularity="word")
    return p.select("recording_id", F.posexplode("words").alias("pos", "w")).select("recording_id", F.col("pos").cast("long").alias("pos"), "w.word", "w.start_time", "w.end_time")


@query
def record_counts(i: Inputs) -> DataFrame:
    w, s = i.words(), align.syllable_units(i.words())
    return payload.alignment_yield(i.recordings(), w, s)


@query
def manifest_index(i: Inputs) -> DataFrame:
    _ready(i.spark)
    return manifest.manifest(i.manifest_lines())


@query
def manifest_rejects(i: Inputs) -> DataFrame:
    lines = i.manifest_lines().withColumn("line", F.when(F.col("line_no") % 14 == 3, "ftp://elsewhere").otherwise(F.col("line")))
    return manifest.read_lines(lines)[1].select("line_no", "line", "reason")


@query
def shards(i: Inputs) -> DataFrame:
    _ready(i.spark)
    return manifest.manifest(i.manifest_lines()).withColumn("shard", manifest.shard_of(F.col("manifest_index"), SHARDS)).select("manifest_index", "shard", "url")


@query
def shards_complete_disjoint(i: Inputs) -> DataFrame:
    """What each shard holds, beside what all of them lack or have too much."""
    _ready(i.spark)
    m = manifest.manifest(i.manifest_lines())
    return manifest.shard_sizes(m, SHARDS).join(F.broadcast(manifest.shards_complete_disjoint(m, SHARDS)))  # one row


@query
def label_overlap(i: Inputs) -> DataFrame:
    return manifest.cross_label_overlap(manifest.read_lines(i.manifest_lines())[0])


@query
def output_names(i: Inputs) -> DataFrame:
    e = manifest.read_lines(i.manifest_lines())[0].withColumn("key", T.video_key(F.col("url")))
    return e.select("line_no", "key", T.output_name(F.col("line_no"), F.col("label"), F.col("key")).alias("output"), T.is_supported_url(F.col("url")).alias("supported"))


@query
def video_key(i: Inputs) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=a-"), F.col("page_id").cast("string"), F.lit("&t=1"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtu.be/"), F.col("page_id").cast("string"), F.lit("_x/more?y=1"))).otherwise(F.lit("https://www.youtube.com/playlist"))
    return i.table("pages").select("page_id", T.video_key(url).alias("key"))


@query
def clean(i: Inputs) -> DataFrame:
    return i.table("documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


@query
def kids_genre(i: Inputs) -> DataFrame:
    return i.table("documents").select("doc_id", T.kids_genre(F.col("text")).alias("genre"))


@query
def search_tasks(i: Inputs) -> DataFrame:
    topics = i.table("part").select(F.col("p_partkey").alias("task_no"), F.lit("youtube").alias("source"), F.lit("g").alias("genre"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("phrase"))
    return candidates.search_tasks(topics, 2025).select("task_no", "search_year", "search_query")


@query
def eligible_candidates(i: Inputs) -> DataFrame:
    c = candidates.distinct_candidates(candidates.eligible(i.found(), SECONDS), "source")
    return c.select("rank", "source", "classification", "title", "channel", "duration_seconds", "video_id", "url", "kids_url")


@query
def per_query_limit(i: Inputs) -> DataFrame:
    return candidates.per_query_limit(i.found(), candidates.results_per_query(100, 20), "channel").select("rank", "channel")


def _verified(i: Inputs) -> DataFrame:
    return candidates.verify(candidates.distinct_candidates(candidates.eligible(i.found(), SECONDS), "global"), i.metadata(), (0, 900))


@query
def verify_candidates(i: Inputs) -> DataFrame:
    return _verified(i).select("video_id", "title", "channel", "duration_seconds", "language", "download_check")


@query
def quota(i: Inputs) -> DataFrame:
    v = _verified(i).withColumn("label", F.when(F.col("source") == "youtube_kids", "kids").otherwise("normal"))
    return candidates.quota(v, QUOTA, "label", [candidates.seeded_order(F.col("video_id")), "video_id"]).select("label", "video_id")


@query
def oversample(i: Inputs) -> DataFrame:
    return candidates.oversample(candidates.eligible(i.found(), SECONDS), 50, 1.8, ["rank"]).select("rank", "video_id")


@query
def collection_progress(i: Inputs) -> DataFrame:
    every = candidates.distinct_candidates(candidates.eligible(i.found(), SECONDS), "global")
    passed = _verified(i).select(F.col("video_id").alias("p"))
    checked = every.join(passed, F.col("video_id") == F.col("p"), "left").select(F.when(F.col("source") == "youtube_kids", "kids").otherwise("normal").alias("label"), F.col("p").isNotNull().alias("passed"))
    return candidates.collection_progress(checked, F.count("*"))


@query
def access_rate(i: Inputs) -> DataFrame:
    d = i.table("documents")
    o = candidates.usable_outcome(F.col("n_chars") % 5 != 0, F.col("doc_id") % 7 == 0, F.col("text"))
    return candidates.access_rate(d.select(F.col("source").alias("kind"), o.alias("o")).select("kind", "o.ok"))


@query
def usable_outcome(i: Inputs) -> DataFrame:
    o = candidates.usable_outcome(F.col("n_chars") % 5 != 0, F.col("doc_id") % 7 == 0, F.col("text"))
    return i.table("documents").select("doc_id", o.alias("o")).select("doc_id", F.col("o.ok").alias("ok"), F.md5("o.error").alias("error"))


@query
def sample_by_label(i: Inputs) -> DataFrame:
    d = i.table("documents").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"), F.col("lang").alias("label"), "n_chars")
    return candidates.sample_by_label(d, 10, F.col("n_chars") >= 500, F.lit("too short"))[0].select("label", "video_id")


@query
def resume(i: Inputs) -> DataFrame:
    old = i.job_state().withColumnRenamed("job_id", "manifest_index")
    return state.resume(i.new_manifest(), old).select("manifest_index", "url", "label", "status", F.col("attempts").cast("long").alias("attempts"))


@query
def reopen_missing(i: Inputs) -> DataFrame:
    return state.reopen_missing_outputs(i.job_state(), i.outputs(), "job_id").select("job_id", "status", "stage_status")


@query
def retry_failed(i: Inputs) -> DataFrame:
    return state.retry_failed(i.job_state()).select("job_id", "status")


@query
def pending_jobs(i: Inputs) -> DataFrame:
    return state.pending(i.job_state()).select("job_id", "url", "label")


@query
def status_summary(i: Inputs) -> DataFrame:
    return state.label_summary(i.job_state())


@query
def shard_rollup(i: Inputs) -> DataFrame:
    return state.shard_rollup(i.job_state().withColumn("shard", F.col("job_id") % 8))


@query
def final_status(i: Inputs) -> DataFrame:
    return state.final_status(i.job_state())


@query
def fold_progress(i: Inputs) -> DataFrame:
    return state.fold_progress(i.job_events())


@query
def lifecycle(i: Inputs) -> DataFrame:
    return state.lifecycle(i.job_events())


@query
def attempt_number(i: Inputs) -> DataFrame:
    return state.attempt_number(i.job_events()).select("job_id", "seq", "attempt")


@query
def job_list(i: Inputs) -> DataFrame:
    jobs_ = state.lifecycle(i.job_events()).withColumns({"workdir": F.lit("w"), "output_path": F.lit("o")})
    return state.public_view(jobs_).select("job_id", "status", "stage", "attempts")


@query
def job_summary(i: Inputs) -> DataFrame:
    return state.job_summary(state.lifecycle(i.job_events()))


@query
def result_lookup(i: Inputs) -> DataFrame:
    asked = i.table("lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") * 1000).alias("job_id")).distinct()
    return state.result_lookup(asked, i.job_state(), i.outputs()).select("job_id", "code")


@query
def admit_jobs(i: Inputs) -> DataFrame:
    return state.admit(i.requests()).select("request_no", "job_id", "accepted", "reason")


@query
def stream_fold_progress(i: Inputs) -> DataFrame:
    """The same rows as fold_progress, by a stream over the table's files that ends when all are read."""
    folder = _folder(i, "progress")
    return jobs.run_to_table(jobs.fold_progress(i.job_events(_event_stream(i))), f"{folder}/state", f"{folder}/stream", "job_id")


@query
def stream_lifecycle(i: Inputs) -> DataFrame:
    folder = _folder(i, "lifecycle")
    return jobs.run_to_table(jobs.lifecycle_updates(i.job_events(_event_stream(i))), f"{folder}/state", f"{folder}/stream", "job_id")


#: Seconds of silence that interrupt a job, and seconds that events may be late.
SILENCE, LATE = 43_200, 3_600


@query
def stream_stuck_jobs(i: Inputs) -> DataFrame:
    """The lifecycle with timers: jobs that are under way and silent are interrupted, as far as the stream's watermark has come."""
    folder = _folder(i, "stuck")
    out = jobs.lives_to_table(i.job_events(_event_stream(i)), f"{folder}/state", f"{folder}/stream", SILENCE, 366 * 86_400, LATE)
    return out.drop("version")


@query
def stream_admission(i: Inputs) -> DataFrame:
    folder = _folder(i, "admission")
    admitted = jobs.admit_jobs(i.requests(_event_stream(i))).select("request_no", "job_id", "accepted", "reason")
    return jobs.run_to_table(admitted, f"{folder}/state", f"{folder}/stream")


@query
def caption_lines(i: Inputs) -> DataFrame:
    return captions.caption_lines(i.words()).select("recording_id", "pos", "line")


@query
def caption_times(i: Inputs) -> DataFrame:
    i.dealt_chars = CAPTION_CHARS
    t = captions.recording_lines(i.words())
    return t.select("recording_id", "line", "first_pos", "last_pos", F.round("line_start", 6).alias("line_start"), F.round("line_end", 6).alias("line_end"))


@query
def karaoke_segments(i: Inputs) -> DataFrame:
    """Words, every seventh ending late, run through the cursor of a line of nine."""
    w = i.words().withColumn("line", F.floor(F.col("pos") / 9)).withColumn("seq", F.struct("pos"))
    w = w.withColumn("line_start", (F.col("line") * 45).cast("double") / 8)
    return captions.karaoke_segments(w).select("recording_id", "pos", "gap_cs", "length_cs")


@query
def word_info(i: Inputs) -> DataFrame:
    w = captions.word_info(i.words())
    return w.select("recording_id", "pos", T.caption_time(F.col("start_sec")).alias("shown"), F.round("info_end", 6).alias("info_end"), T.caption_escape(F.col("word")).alias("word"), T.ends_sentence(F.col("word")).alias("ends"))


@query
def syllables_in_lines(i: Inputs) -> DataFrame:
    """Lines come to where their recordings' texts lie, and are looked up there; syllables are neither exchanged nor sorted."""
    i.dealt_chars = CAPTION_CHARS
    times = captions.recording_lines(i.words(), i.parts()).hint("shuffle_hash")
    return captions.syllables_in_lines(times, align.syllable_units(i.words())).select("recording_id", "line", "pos", "syllable_index")


@query
def voiced_in_spans(i: Inputs) -> DataFrame:
    """Voiced frames of each word, each nine words and each recording: intervals of under a second up to whole lengths, in one join."""
    w, bounds = i.words(), (F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))
    of = lambda rows, kind, span: rows.withColumns({"kind": F.lit(kind), "span": span}).select("recording_id", "kind", "span", "start_sec", "end_sec")
    nine = w.groupBy("recording_id", F.floor(F.col("pos") / 9).alias("k")).agg(*bounds)
    spans = of(w, "word", F.col("pos")).unionByName(of(nine, "nine", F.col("k"))).unionByName(of(w.groupBy("recording_id").agg(*bounds), "recording", F.lit(0).cast("long")))
    met = points_in_intervals(spans, i.frames().filter("f0 > 0"), "recording_id", F.col("start_sec"), F.col("end_sec"), "t", keep=True, levels=3)
    return met.groupBy("recording_id", "kind", "span").agg(F.count("f0").alias("n_voiced"), F.coalesce(F.sum("f0"), F.lit(0.0)).cast("long").alias("hz_sum"), F.max("t").alias("last_voiced"))


@query
def word_info_text(i: Inputs) -> DataFrame:
    f = features.word_features(i.words(), i.frames())
    return f.select("recording_id", "pos", T.word_info_text(F.col("word"), F.col("pitch_mean_hz"), F.col("pause_after_sec"), F.col("speech_rate_sps")).alias("info"))


@query
def syllable_text(i: Inputs) -> DataFrame:
    u = align.syllable_units(i.words())
    return u.select("recording_id", "pos", "syllable_index", T.syllable_text(F.col("syllable"), F.col("syllable_index"), F.col("syllable_count")).alias("shown"))


@query
def sorted_by_start(i: Inputs) -> DataFrame:
    """Words whose list order is not that of their times, put in order."""
    w = i.words().withColumn("start_sec", F.col("start_sec") - F.when(F.col("pos") % 5 == 0, 2.0).otherwise(0.0)).withColumn("was", F.col("pos"))
    return captions.by_start(w).select("recording_id", "pos", "was")


@query
def payload_counts(i: Inputs) -> DataFrame:
    w = align.usable_words(i.segments())
    for c in features.FEATURES:
        w = w.withColumn(c, F.lit(None).cast("double"))
    heads = i.table("conversations").select(F.col("conv_id").alias("recording_id")).distinct().withColumns({"label": F.lit("kids"), "source_url": F.lit(""), "language": F.lit("en")})
    p = payload.select_granularity(payload.nest_payload(heads, words=w, granularity="word"), "word")
    return p.select("recording_id", "granularity", payload.record_counts(p)["words"].cast("long").alias("n_words"))


@query
def labelled_manifest(i: Inputs) -> DataFrame:
    """Two lists of urls as one with markers; lines that begin with # are left out."""
    urls = i.found().select("source", F.col("rank").alias("position"), F.when(F.col("rank") % 17 == 0, "# note").otherwise(F.concat(F.lit("https://youtu.be/"), F.col("video_id"))).alias("url"))
    return manifest.build_labelled(urls.filter("source = 'youtube_kids'").drop("source"), urls.filter("source = 'youtube'").drop("source"))


@query
def durations(i: Inputs) -> DataFrame:
    d = i.table("documents")
    return d.select("doc_id", T.duration_min(F.col("n_chars").cast("double")).alias("minutes"), T.age_group(F.col("source"), F.col("lang")).alias("age_group"), T.pitch_range_ok(F.col("doc_id") % 50, F.col("n_chars")).alias("range_ok"))


@query
def incremental_work(i: Inputs) -> DataFrame:
    """Jobs of the event stream, each worked on once, by a stream that ends when all files are read, and by one that starts anew."""
    folder = _folder(i, "work")

    def work(batch: DataFrame) -> DataFrame:
        return batch.select("user_id", F.when(F.col("user_id") % 5 == 0, "failed").otherwise("completed").alias("status"))

    for start in ("first", "again"):
        jobs.process_incrementally(_event_stream(i).select("user_id"), "user_id", work, f"{folder}/state", f"{folder}/{start}")
    done = i.spark.read.parquet(f"{folder}/state")
    return done.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("status", "run").alias("status"))


def caption_events_of(i: Inputs, together: bool = False) -> DataFrame:
    """Captions show no features of syllables, so these aren't made."""
    _ready(i.spark)
    i.dealt_chars = CAPTION_CHARS
    w, s = features.word_features(i.words(), i.frames()), align.syllable_units(i.words())
    heads = i.recordings().select("recording_id", F.concat_ws(" · ", "label", "source_url").alias("title"))
    return captions.caption_events(heads, w, s, i.words(), i.parts(), together)


@query
def caption_events(i: Inputs) -> DataFrame:
    """Every event line of every recording's captions, with its place in the file."""
    return caption_events_of(i)


def _read_captions(texts: DataFrame) -> DataFrame:
    """Lines of each file (recording_id, text), and a hash of all its event lines."""
    text = F.regexp_replace("text", "\n$", "")
    return texts.select("recording_id", F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.sha2(F.substring_index(text, "\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n", -1), 256).alias("events"))


@query
def caption_file(i: Inputs) -> DataFrame:
    """Whole subtitle files, one text for each recording: how many lines, and a hash of the event lines."""
    return _read_captions(caption_text(caption_events_of(i, together=True)))


@query
def caption_files(i: Inputs) -> DataFrame:
    """The same, of files that are written and read back."""
    folder = _folder(i, "captions")
    write_captions(caption_events_of(i, together=True), folder)
    return _read_captions(read_captions(i.spark, folder).withColumn("recording_id", F.col("recording_id").cast("long")))


@query
def result_files(i: Inputs) -> DataFrame:
    """Result documents, written as JSON lines and read back as words and syllables."""
    folder, empty = _folder(i, "results"), {c: F.lit(None).cast("double") for c in features.FEATURES}
    w, s = i.words().withColumns(empty), align.syllable_units(i.words()).withColumns(empty)
    results.write_results(payload.nest_payload(i.recordings(), w, s, "both"), folder, "gzip")
    return results.read_units(i.spark, folder).select("source_url", "label", "kind", "pos", "part", "start_time", "end_time")


@query
def manifest_files(i: Inputs) -> DataFrame:
    """Manifest lines written as text files, and read again with all checks."""
    folder = _folder(i, "manifest")
    lines = i.manifest_lines()
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", F.col("line").alias("value")).write.partitionBy("file").text(folder)
    return manifests.read_manifest(i.spark, folder)


@query
def manifest_written(i: Inputs) -> DataFrame:
    """Candidate lists written in all forms; the tables, and the one list with labels, read back."""
    folder = _folder(i, "lists")
    urls = i.found().select("source", F.col("rank").alias("position"), F.concat(F.lit("https://youtu.be/"), F.col("video_id")).alias("url"))
    manifests.write_manifest(urls.filter("source = 'youtube_kids'").drop("source"), urls.filter("source = 'youtube'").drop("source"), folder)
    schema = "position long, url string, label string"
    tables = i.spark.read.option("header", True).schema(schema).csv(f"{folder}/csv").withColumn("form", F.lit("csv"))
    tables = tables.unionByName(i.spark.read.schema(schema).json(f"{folder}/json").withColumn("form", F.lit("json")))
    first = urls.groupBy("url", F.when(F.col("source") == "youtube_kids", "kids").otherwise("normal").alias("label")).agg(F.min("position").alias("position"))
    listed = manifests.read_manifest(i.spark, f"{folder}/labelled").join(first, ["url", "label"]).withColumn("form", F.lit("labelled"))
    return tables.unionByName(listed.drop("manifest_index")).select("form", "label", "position", "url")


@query
def access_sample_files(i: Inputs) -> DataFrame:
    """Access checks of two kinds with unlike columns, written in both forms and read back."""
    folder, d = _folder(i, "access"), i.table("documents")
    known = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("kind"), (F.col("n_chars") % 5 != 0).alias("yt_dlp_ok"), F.col("n_chars").cast("double").alias("duration"), F.concat(F.col("lang"), F.lit(', "'), F.col("doc_id").cast("string"), F.lit('"')).alias("title"))
    manifests.write_access_sample([known.filter("doc_id % 2 = 0").drop("title"), known.filter("doc_id % 2 = 1").drop("duration")], folder)
    back = [manifests.read_access_sample(i.spark, f"{folder}/{form}", form).select(F.col("doc_id").cast("string").alias("doc_id"), "kind", "yt_dlp_ok", "duration", "title").withColumn("form", F.lit(form)) for form in ("csv", "jsonl")]
    return back[0].unionByName(back[1])


@query
def state_snapshots(i: Inputs) -> DataFrame:
    """The state table, written, read, mended and written again; what the pointer then names."""
    folder = _folder(i, "state")
    snapshots.write_state(i.job_state(), folder)
    version = snapshots.write_state(state.retry_failed(snapshots.read_state(i.spark, folder)), folder)
    return snapshots.read_state(i.spark, folder).select("job_id", "url", "label", "status", "attempts", F.lit(version).cast("int").alias("version"))


@query
def all_sources(i: Inputs) -> DataFrame:
    """Both lists, with the rows that stand in both."""
    found = i.found().select("rank", "source", "video_id")
    return candidates.all_sources(found.filter("source = 'youtube_kids'"), found)


@query
def checked_at(i: Inputs) -> DataFrame:
    """The time of a check, in form and within a day of this machine's."""
    at = T.utc_now()
    return i.table("documents").select("doc_id", at.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("in_form"), (F.abs(F.unix_timestamp(F.to_timestamp(at)) - F.unix_timestamp()) < 86400).alias("is_now"))


@query
def payload_counts_both(i: Inputs) -> DataFrame:
    empty = {c: F.lit(None).cast("double") for c in features.FEATURES}
    p = payload.nest_payload(i.recordings(), i.words().withColumns(empty), align.syllable_units(i.words()).withColumns(empty), "both")
    p = payload.select_granularity(p, "both")
    n = payload.record_counts(p)
    return p.select("recording_id", "granularity", n["words"].cast("long").alias("n_words"), n["syllables"].cast("long").alias("n_syllables"))


@query
def map_recordings(i: Inputs) -> DataFrame:
    """A stand-in model that counts the text's characters, and fails where there are few."""
    d = i.table("documents").select(F.col("doc_id").alias("recording_id"), F.col("lang").alias("language"), "text")

    def transcribe(model, aligner, row, batch_size):
        if len(row["text"] or "") < 100:
            raise ValueError("too short")
        return {"n": model(row["text"]), "aligner": aligner}

    return inference.map_recordings(d, lambda: len, transcribe, "n long, aligner string", lambda language: f"align-{language}")


@query
def supervised_recordings(i: Inputs) -> DataFrame:
    """The stand-in model in a child process, with a time limit; texts of some lengths end the process."""
    d = i.table("documents").select(F.col("doc_id").alias("recording_id"), F.col("lang").alias("language"), "text")

    def transcribe(model, aligner, row, batch_size):
        if len(row["text"] or "") % 997 == 13:
            import os

            os._exit(3)
        return {"n": model(row["text"])}

    def many(model, aligner, rows, batch_size):
        return [transcribe(model, aligner, row, batch_size) for row in rows]

    return inference.map_recordings(d, lambda: len, transcribe, "n long", batch_size=64, many=many, limit=60.0)


@query
def requeue_service(i: Inputs) -> DataFrame:
    """Jobs of the service after a restart: those that were under way wait from the beginning."""
    jobs_ = i.job_state().withColumn("status", F.when(F.col("status") == "pending", "queued").otherwise(F.col("status"))).withColumns({"stage_status": F.lit("running"), "detail": F.lit("")})
    return state.requeue(jobs_, service=True).select("job_id", "status", "stage_status", "detail")


@query
def result_arrays(i: Inputs) -> DataFrame:
    """Words and syllables as bare arrays, one document a recording, without what says whose they are; read back and counted."""
    folder, empty = _folder(i, "arrays"), {c: F.lit(None).cast("double") for c in features.FEATURES}
    w, s = i.words().withColumns(empty), align.syllable_units(i.words()).withColumns(empty)
    p = payload.nest_payload(i.recordings(), w, s, "both")
    for name in ("words", "syllables"):
        p.filter(F.size(name) > 0).select(F.to_json(name, {"ignoreNullFields": "false"}).alias("value")).write.options(**results.QUICK).text(f"{folder}/{name}", compression="gzip")
    units = results.read_units(i.spark, folder).filter("label is null and source_url is null")
    return units.groupBy("kind", "pos").agg(F.count("*").alias("n"), F.count_distinct("part").alias("different"), F.max("start_time").alias("latest"))


@query
def uploader_channel(i: Inputs) -> DataFrame:
    """Candidates whose metadata names an uploader and, for some, no channel."""
    m = i.metadata().withColumns({"channel": F.when(F.col("duration") % 2 == 0, "").otherwise(F.concat(F.lit(" c "), F.col("duration").cast("string"))), "uploader": F.concat(F.lit("u  "), F.col("duration").cast("string"))})
    return candidates.verify(candidates.distinct_candidates(candidates.eligible(i.found(), SECONDS), "global"), m, (0, 900)).select("video_id", "channel")


ORACLE_SQL = oracle.SQL
