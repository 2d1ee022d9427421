import duckdb
import pytest

from cadence.llm import mixing
from cadence.llm.queries import QUERIES


def test_query_is_its_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(mixing.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES["op2_mix_sources"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all() and len(got) == 200


@pytest.mark.parametrize("part_rows", [3, 50_000])
def test_targets_and_reruns(docs_of, part_rows):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}") for i in range(400)] + [(900, "v " * 30, None)]
    m = mixing.mix(docs_of(rows), part_rows=part_rows).toPandas()
    assert abs(m.taken.sum() - 1.5 * m["size"].sum()) < 200 and (m.taken <= 2 * m["size"]).all()
    for _, g in m.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 40 and g.target.iloc[0] <= 2 * g.source_size.iloc[0]
    again = mixing.mix(docs_of(rows[::-1]), part_rows=part_rows).toPandas()
    assert m.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_target_levels(spark):
    s = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 50)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s).collect()}
    # weights 5, 2, 1, 5: a, b and null fill up, the rest goes to c
    assert t == {"a": 200.0, "b": 20.0, None: 100.0, "c": 1740.0 - 320.0}


def test_odd_and_no_rows(odd):
    m = mixing.mix(odd).collect()
    assert len(m) == odd.count() and all(r.size == 0 and r.taken == 0 for r in m if r.doc_id in (1, 2, 8)) and mixing.mix(odd.filter("false")).count() == 0
    assert mixing.mix(odd.filter("text is null")).agg({"target": "sum"}).first()[0] == 0


def test_emit(docs_of):
    docs = docs_of([(i, "w " * (i % 9), f"s{i % 3}") for i in range(60)], ("copies", "its_copies"))
    m = mixing.mix(docs)
    out = mixing.emit(docs, m)
    assert out.columns == docs.columns and out.count() == m.agg({"copies": "sum"}).first()[0]
