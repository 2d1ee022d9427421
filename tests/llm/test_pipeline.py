import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cadence.llm import line_dedup, near_dup


def test_stages_over_the_smallest_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(P.STAGES):
        columns = docs.columns
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert 200 > sizes[0] >= sizes[1] >= sizes[2] and sizes[4] >= sizes[3]
    mixed = spark.read.parquet(str(tmp_path / "3")).groupBy("doc_id").count()
    packed = docs.filter("piece = 0").groupBy("doc_id").count()
    assert mixed.exceptAll(packed).count() == 0 and docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert P.run(spark, sf).count() == sizes[4]


def test_decisions_take_effect(spark, sf, docs_of):
    a = "\n".join(f"line {i} of a long story that goes on and on" for i in range(12))
    own = "\n".join(f"another {i} tale told by nobody else at all, ever" for i in range(12))
    docs = docs_of([(1, a), (2, a), (3, own + "\n" + a), (4, own.replace("tale", "Tale")), (5, "")], ("score", "n_removed_x"))
    cut = P.cut_common_lines(spark, docs, sf)
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {1: (a, len(a)), 3: (own, len(own)), 4: (own.replace("tale", "Tale"), len(own)), 5: ("", 0)}
    assert sorted(r.doc_id for r in P.keep_one_of_each_group(spark, cut, sf).collect()) == [1, 3, 5]
    assert near_dup.SHINGLE == 5 and near_dup.THRESHOLD == 80 and line_dedup.MIN_WORDS == 5
    good = P.keep_good(spark, docs, sf)
    assert good.columns == docs.columns and good.count() <= docs.count()


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_no_rows(spark, sf, docs_of, stage):
    assert stage(spark, docs_of([(1, "x")]).filter("false"), sf).count() == 0


NAMES = ("label_id", "quality", "gone", "gone_id", "gone_row", "kept", "kept_id", "n_removed", "n_lines", "score", "carried", "own_id", "row", "size", "copies", "statistic_n_words", "component_id", "its_id", "keys", "taken", "nth", "part")


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES[:-1]])
def test_any_further_column_goes_through_unchanged(spark, sf, docs_of, stage):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").collect()}
    block = "\n".join(f"a line {i} that several documents hold in just these words" for i in range(9))
    docs = docs_of([(i, t + ("\n" + block if i % 5 == 0 else "")) for i, t in texts.items()])
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")))
    out = stage(spark, docs, sf)
    rows = out.collect()
    assert out.columns == docs.columns and rows
    for r in rows:
        assert [r[name] for name in NAMES] == [f"{k}:{r.doc_id}" for k in range(len(NAMES))] and (r.lang, r.source) == ("en", "s")
