"""Mixing rows that repeat or have no id, and the order of the registered SQL at every size of parts."""

from collections import Counter

import duckdb

from cadence.llm import mixing


def test_rows_are_emitted_one_by_one(docs_of):
    rows = [(7, "a b c", "s")] * 6 + [(7, "other d e", "s")] * 3 + [(None, f"v {i}", "s") for i in range(8)] + [(None, "v 0", "s"), (None, None, None), (None, None, None), (1, "w " * 9, "t")]
    docs = docs_of(rows, ("row", "copies"))
    m = mixing.mix(docs).collect()
    out = mixing.emit(docs, mixing.mix(docs))
    assert len(m) == len(rows) and out.columns == docs.columns
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    want = Counter()
    for r in m:
        want[r.doc_id, r.source, r.size] += r.copies
    assert got == +want and sum(got.values()) <= 2 * len(rows)


def test_order_is_that_of_the_sql(docs_of):
    rows = [(i * i % 1009, "" if i % 3 == 0 else "w " * (i % 2 + 1), f"s{i % 2}") for i in range(300)] + [(None, "w", "s1")]
    docs = docs_of(rows).dropDuplicates(["doc_id"])
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in docs.select("doc_id", "text", "source").collect()])
    want = sorted(c.sql(f"SELECT doc_id, size, copies FROM ({mixing.ORACLE_SQL})").fetchall(), key=str)
    for part_rows in (3, 50_000):
        assert sorted(((r.doc_id, r.size, r.copies) for r in mixing.mix(docs, part_rows=part_rows).collect()), key=str) == want


def test_parts_are_bounded_whatever_the_ids(spark):
    rows = [(i, "s", 3, i) for i in range(4000)] + [(1 << 61, "s", 3, 0)] + [(None, "s", 3, 7)] * 4000 + [(5, None, 1, 1)] * 2000
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long, row long").repartition(4).checkpoint()
    placed = mixing.ranged(sized, 50).toPandas()
    assert len(placed) == len(rows) and placed.groupby("part").size().max() <= 3 * len(rows) / 50
    got = placed.sort_values(["part", "at"])
    key = lambda r: (r[1] is None, r[1] or "", r[2], r[0] is None, r[0] or 0, r[3])
    plain = [(None if d != d else int(d), s, z, r) for d, s, z, r in zip(got.doc_id, got.source, got["size"], got.row, strict=True)]
    assert [key(r)[:4] for r in plain] == [key(r)[:4] for r in sorted(rows, key=key)]
