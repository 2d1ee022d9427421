import pytest
from pyspark.sql import functions as F

from cadence.operators import manifest as M
from cadence.sources import manifests

A, B = "https://www.youtube.com/watch?v=aa", "https://youtu.be/bb"


def lines(spark, *text):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no long, line string")


def test_labels_duplicates_and_comments(spark):
    m = M.manifest(lines(spark, "﻿# LABEL: KIDS", "", "# note", f"  {A} ", A, "# label: normal_youtube", A, B), strict=True)
    assert [tuple(r) for r in m.orderBy("manifest_index").collect()] == [(1, A, "kids"), (2, A, "normal"), (3, B, "normal")]


@pytest.mark.parametrize("text, reason", [
    (["# LABEL: ADULTS", A], "unknown label"), (["# LABEL: KIDS", "ftp://x"], "unsupported url"), ([A], "url before a label"), (["# LABEL: KIDS"], "no urls found"),
])
def test_rejects(spark, text, reason):
    with pytest.raises(ValueError, match=reason):
        M.manifest(lines(spark, *text), strict=True)


def test_shards(spark):
    m = spark.createDataFrame([(i, f"u{i}", "kids") for i in range(1, 11)], "manifest_index long, url string, label string")
    got = [sorted(r.manifest_index for r in M.shard(m, 4, k).collect()) for k in range(4)]
    assert got == [[1, 5, 9], [2, 6, 10], [3, 7], [4, 8]]
    assert tuple(M.shards_complete_disjoint(m, 4).first()) == (0, 0)
    for count, index in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            M.shard(m, count, index)


def test_numbering_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    for part_rows in (700, 3, 10_000):
        got = M.numbered(rows, ["k"], "n", part_rows).orderBy("n").collect()
        assert [r.n for r in got] == list(range(1, 5001)) and [r.k for r in got] == sorted(r.k for r in got)


def test_parts_by_rows(spark, monkeypatch):
    """As many parts as the rows ask for, none of them large, and a table of parts that is too long to be broadcast."""
    monkeypatch.setattr(M, "GROUP_PARTS", 4)
    monkeypatch.setattr(M, "BROADCAST_PARTS", 10)
    rows = spark.range(0, 20_000, 1, 8).select((F.col("id") * F.col("id")).alias("k"))  # far from even
    got = M.numbered(rows, ["k"], "n", 1000)
    assert "BroadcastExchange" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.filter("k != (n - 1) * (n - 1)").count() == 0 and got.count() == 20_000
    assert M.numbered(rows.filter("k < 0"), ["k"], "n").count() == 0


def test_overlap(spark):
    m = spark.createDataFrame([("u", "kids"), ("u", "normal"), ("v", "kids")], "url string, label string")
    assert [r.url for r in M.cross_label_overlap(m).collect()] == ["u"]


def test_write_and_read(spark, tmp_path):
    kids = spark.createDataFrame([(0, A), (1, B)], "position long, url string")
    normal = spark.createDataFrame([(0, A)], "position long, url string")
    manifests.write_manifest(kids, normal, str(tmp_path / "m"))
    back = manifests.read_manifest(spark, str(tmp_path / "m" / "labelled"))
    assert [(r.url, r.label) for r in back.orderBy("manifest_index").collect()] == [(A, "kids"), (B, "kids"), (A, "normal")]
    assert spark.read.option("header", True).csv(str(tmp_path / "m" / "csv")).count() == 3


def test_access_sample(spark, tmp_path):
    a = spark.createDataFrame([("kids", True, 'say "hi", 😀')], "kind string, yt_dlp_ok boolean, title string")
    b = spark.createDataFrame([("youtube", False, 8.5)], "kind string, yt_dlp_ok boolean, tested_seconds double")
    manifests.write_access_sample([a, b], str(tmp_path / "s"))
    back = manifests.read_access_sample(spark, str(tmp_path / "s" / "csv")).orderBy("kind").collect()
    assert back[0].title == 'say "hi", 😀' and back[0].yt_dlp_ok is True and back[1].tested_seconds == 8.5
    assert manifests.read_access_sample(spark, str(tmp_path / "s" / "jsonl"), "jsonl").columns == ["kind", "tested_seconds", "title", "yt_dlp_ok"]
