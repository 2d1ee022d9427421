"""Readers that take large files in blocks, and a sink of many named files."""

import json

import pytest
from pyspark.sql import functions as F

from cadence.sources import captions, manifests, results
from cadence.sources.captions import NamedText


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_of_a_large_file_are_numbered_over_many_tasks(spark, tmp_path, small_blocks):
    texts = {"big.txt": [f"line {i}" if i % 5 else "" for i in range(20_000)], "bom.txt": ["﻿# LABEL: KIDS", "á", "", "b"], "one.txt": ["x"], "none.txt": []}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes((("\r\n" if name == "bom.txt" else "\n").join(lines) + ("\n" if name == "big.txt" else "")).encode())
    got = manifests.read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    found = {}
    for r in got.collect():
        found.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    assert found == {k: dict(enumerate(x.removeprefix("﻿") for x in v)) for k, v in texts.items() if v}


def test_a_manifest_of_many_blocks(spark, tmp_path, small_blocks):
    lines = [x for i in range(3000) for x in ([f"# LABEL: {'KIDS' if i % 2000 else 'NORMAL'}"] if i % 1000 == 0 else []) + [f"https://youtu.be/v{i - i % 2}"]]
    (tmp_path / "m.txt").write_text("\n".join(lines))
    got = manifests.read_manifest(spark, str(tmp_path / "m.txt")).orderBy("manifest_index").collect()
    assert [(r.manifest_index, r.url, r.label) for r in got] == [(k + 1, f"https://youtu.be/v{2 * k}", "kids" if 1000 <= 2 * k < 2000 else "normal") for k in range(1500)]


WORD = {"word": "a", "start_time": 0.0, "end_time": 1.0, "pitch_mean_hz": None, "pitch_variance": None, "pause_after_sec": None, "speech_rate_sps": 1.0}


def test_documents_on_lines_are_read_in_many_tasks(spark, tmp_path, small_blocks):
    docs = [{"label": "kids", "source_url": f"u{i}", "language": "en", "granularity": "word", "words": [{**WORD, "word": f"w{i}"}] * (i % 3)} for i in range(3000)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(d) for d in docs) + "\n\n")
    plan = results.read_documents(spark, str(tmp_path))
    words = results.read_results(spark, str(tmp_path))[0]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5 and plan.count() == 3000
    got = {(r.source_url, r.pos): r.word for r in words.collect()}
    assert got == {(f"u{i}", p): f"w{i}" for i in range(3000) for p in range(i % 3)}


def test_each_file_is_routed_by_its_lines(spark, tmp_path, small_blocks):
    long = [{**WORD, "word": f"w{i}"} for i in range(2000)]  # one document of many blocks
    (tmp_path / "pretty.json").write_text(json.dumps({"label": "normal", "source_url": "p", "language": "en", "granularity": "word", "words": long}, indent=2))
    (tmp_path / "array.json").write_text(json.dumps(long[:3]))
    (tmp_path / "arrays.jsonl").write_text("\n".join(json.dumps(long[i : i + 1]) for i in range(4)))
    (tmp_path / "by_line.json").write_text("[\n" + ",\n".join(json.dumps(w) for w in long[:5]) + "\n]\n")  # its last word's line looks like a document
    (tmp_path / "flat.json").write_text(json.dumps({"words": long[:2], "syllables": []}, indent=0))
    (tmp_path / "empty.json").write_text("")
    words, syllables = results.read_results(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: (r.n, r.most) for r in words.groupBy("file").agg(F.count("*").alias("n"), F.max("pos").alias("most")).collect()}
    assert got == {"pretty.json": (2000, 1999), "array.json": (3, 2), "arrays.jsonl": (4, 0), "by_line.json": (5, 4), "flat.json": (2, 1)} and syllables.count() == 0
    assert [r.word for r in words.filter("source_url = 'p'").orderBy("pos").collect()] == [w["word"] for w in long]


def test_many_named_files_a_task(spark, tmp_path):
    spark.dataSource.register(NamedText)
    rows = spark.createDataFrame([(f"a/{i} ü+", f"text {i}\n\n") for i in range(300)] + [("empty", None)], "name string, text string").repartition(3)
    rows.write.format("named_text").option("path", f"{tmp_path}/n").option("suffix", ".ass").mode("append").save()
    got = {r.recording_id: r.text for r in captions.read_captions(spark, f"{tmp_path}/n").collect()}
    assert {k: v for k, v in got.items() if v} == {f"a/{i} ü+": f"text {i}\n\n" for i in range(300)}
    folders = sorted(p.name.split("-")[0] for p in (tmp_path / "n").iterdir())
    assert folders == ["_SUCCESS", "part=00000", "part=00001", "part=00002"] and (tmp_path / "n").rglob("empty.ass")
    with pytest.raises(FileExistsError):
        captions.write_captions(spark.createDataFrame([], "recording_id long, grp int, line long, pos long, event string"), f"{tmp_path}/n")


def test_a_job_that_fails_leaves_no_files(spark, tmp_path):
    spark.dataSource.register(NamedText)
    rows = spark.range(100).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("named_text").option("path", f"{tmp_path}/n").mode("append").save()
    assert not [p for p in (tmp_path / "n").rglob("*") if p.is_file()]


def test_units_are_those_of_words_and_syllables(spark, tmp_path, small_blocks):
    """One table of both kinds holds what the two hold, for every shape of document, and parses each document once."""
    words = [{**WORD, "word": f"w{i}", "start_time": i} for i in range(5)]
    syllables = [{**WORD, "syllable": f"s{i}", "parent_word": "w", "syllable_index": 1, "syllable_count": 1, "timing_method": "x"} for i in range(4)]
    for s in syllables:
        del s["word"]
    both = {"label": "normal", "source_url": "p", "language": "en", "granularity": "both", "words": words, "syllables": syllables}
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({**both, "source_url": f"u{i}"}) for i in range(40)) + "\n \n")
    (tmp_path / "pretty.json").write_text(json.dumps(both, indent=2))
    (tmp_path / "flat.json").write_text(json.dumps({"words": words[:2]}, indent=0))
    (tmp_path / "words.jsonl").write_text("\n".join(json.dumps(words[i:]) for i in range(5)))
    (tmp_path / "syllables.json").write_text(json.dumps(syllables))
    (tmp_path / "broken.json").write_text("[{]\n{}\n")
    two = results.read_results(spark, str(tmp_path))
    names = ["file", "label", "source_url", "language", "kind", "pos", "part", "start_time", "end_time", *(c.split()[0] for c in results.NUMBERS.split(", "))]
    want = [d.withColumns({"kind": F.lit(k), "part": F.col(k)}).select(names) for d, k in zip(two, ("word", "syllable"), strict=True)]
    units = results.read_units(spark, str(tmp_path))
    text = lambda rows: sorted(map(str, rows.collect()))
    assert units.columns == names and text(units) == text(want[0].unionByName(want[1])) and units.count() > 300
    assert units._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2 * 2  # an object or an array, in two branches of files


def test_documents_on_lines_may_hold_any_character(spark, tmp_path):
    """Characters that end a line elsewhere don't make two documents on lines one; blanks may follow a document."""
    docs = [{"label": "kids", "source_url": f"u{i}", "language": "en", "granularity": "word", "words": [{**WORD, "word": c}]} for i, c in enumerate("a\u2028\u0085b")]
    (tmp_path / "odd.json").write_text(" \n".join(json.dumps(d, ensure_ascii=False) for d in docs) + "\t\n", encoding="utf-8", newline="\n")
    assert sorted(r.word for r in results.read_results(spark, str(tmp_path))[0].collect()) == sorted("a\u2028\u0085b")
