import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadence.llm import quality
from cadence.llm.queries import QUERIES


def test_held_out_documents(spark, sf):
    rows = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 20 and len(bad) > 5 and np.mean([r.predicted for r in good]) > 0.95 and np.mean([r.predicted for r in bad]) < 0.2
    assert np.mean([g.score > b.score for g in good for b in bad]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_rules_compile_to_what_they_say(spark, docs_of):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    model = quality.fit_rows(x, y)
    names = [f"statistic_{s}" for s in quality.STATISTICS]
    got = np.array([r.p for r in spark.createDataFrame(x.tolist(), names).select(quality.expression(model).alias("p")).collect()])
    total = np.full(800, model.intercept)
    for rule in model.rules:
        holds = np.ones(800, bool)
        for name, above, bound in rule.conditions:
            v = x[:, quality.STATISTICS.index(name)]
            holds &= v > bound if above else v <= bound
        total += rule.weight * holds
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and ((got > 0.5) == y).mean() > 0.97 and len(model.rules) < 150


def test_statistics():
    s = dict(zip(quality.STATISTICS, quality._numbers(pa.array(["Ab ab ab\nAb 1!\nAb 1!", None, ""]))[0], strict=True))
    assert (s["n_words"], s["n_lines"], s["distinct_words"], s["top_word"]) == (7, 3, 3 / 7, 3 / 7) and s["distinct_lines"] == 2 / 3
    assert s["repeats"] == 1 / 7 and s["bare_words"] == s["mark_words"] == 2 / 7
    assert not quality._numbers(pa.array([None, "", "x"]))[:2].any()


def test_odd_no_and_one_sided_labels(spark, odd):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows in ([], [(1, 1, 0), (2, 1, 0)], [(None, 1, 0), (3, None, 0), (77, 0, 0)], [(i, i % 2, 0) for i in range(10)]):
        model = quality.fit(odd, labels(rows))
        out = quality.score(odd, model, ("doc_id", "size", "lang")).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score(odd.filter("false"), model).count() == 0
    assert quality.learnable(labels([(i, 1, 0) for i in range(100)]), 10).count() == 10
    assert odd.select(quality.held_out(F.col("doc_id")).alias("h")).filter("h is null").count() == 0


def test_the_driver_gets_a_row_a_label(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda x, y: seen.append((len(x), y.tolist())))
    docs = spark.createDataFrame([(1, f"text {i}", "x") for i in range(3000)] + [(6, None, "x"), (7, "b", "x")], "doc_id long, text string, label_id string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (99, 0), (None, 1)], "doc_id long, quality int")
    taught = {i for i in (1, 6) if zlib.crc32(str(i).encode()) % 5}
    quality.fit(docs.withColumnRenamed("label_id", "quality"), labels)
    assert seen == [(len(taught), [1.0 if i == 1 else 0.0 for i in sorted(taught)])]
