import math

import duckdb
import numpy as np

from cadence.llm import topk
from cadence.llm.queries import QUERIES


def brute(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: min(w for j, w in sound if j == i) for i, _ in sound if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in sound if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, **options):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string").drop("block") if len(rows[0]) == 3 else spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in topk.top_k(d.filter("vec_id % 50 = 0"), d, **options).collect())


def test_query_is_its_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(topk.ORACLE_SQL).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op3_branch_and_bound"](spark, sf).collect()) == sorted(want) and len(want) == 50


def test_ties_nulls_and_lengths(spark):
    half = [0.5] * 20
    rows = [(0, half), (50, [1.0]), (100, []), (1, half), (2, half), (3, half), (4, half), (5, half), (6, half), (7, None), (8, [None, 1.0]), (9, [float("nan")]), (10, [float("inf")] * 3), (None, half), (6, half), (50, [1.0])]
    assert run(spark, rows) == brute(rows)


def test_search_prunes_without_loss():
    rng = np.random.default_rng(1)
    for dims, scale in ((70, 300), (16, 5), (3, 2**31)):
        c = rng.integers(-scale, scale, (dims, 400))
        c[:, 50:300] = c[:, :1]  # a vector that is very common
        ids, q = rng.permutation(400), rng.integers(-scale, scale, (dims, 6))
        for i, (found, score) in enumerate(topk.search(q, ids[:6], c, ids, 5)):
            full = sorted((-int(s), int(v)) for s, v in zip((q[:, i].astype(object) @ c.astype(object)), ids, strict=True) if v != ids[i])[:5]
            assert list(zip((-score).tolist(), found.tolist(), strict=True)) == full


def test_grid_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=24).astype(np.float32)]) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_bound_is_carried_on(spark, monkeypatch):
    """In one task: what later blocks of candidates give is bounded by what is known; in any number of tasks the rows are the same."""
    rng = np.random.default_rng(6)
    c, ids = rng.integers(-300, 300, (40, 900)), rng.permutation(900)
    c[:, 500:600] = c[:, :100]  # ties over blocks
    block = {"q_n": 6, "q_dims": 40, "q_columns": np.ascontiguousarray(c[:, :6], np.int32).tobytes(), "q_ids": ids[:6].tolist()}
    best = topk.Best(block, 5)
    for lo in range(0, 900, 100):
        best.meet(c[:, lo : lo + 100], ids[lo : lo + 100])
        assert np.isfinite(best.least).all()
    for i, (found, score) in enumerate(best.found):
        full = sorted((-int(s), int(v)) for s, v in zip(c[:, i] @ c, ids, strict=True) if v != ids[i])[:5]
        assert list(zip((-score).tolist(), found.tolist(), strict=True)) == full
    late = topk.search(c[:, :6], ids[:6], c, ids, 5, least=best.least + 1)
    assert all(len(found) < 5 for found, _ in late)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 30)
    rows = [(i, [float(x) for x in rng.normal(size=24).astype(np.float32)]) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "TASKS_PER_CORE", 1)
    got = topk.top_k(d.filter("vec_id % 50 = 0"), d)
    # candidates stay where they are: all that is exchanged is k rows of a query from each task
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_rows(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(d, d).count() == 0


def test_scores_beyond_a_long(spark):
    most = (1 << 63) - 1
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 5.0]), (3, [1e30, 3.0]), (4, [0.0, 4.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(d.filter("vec_id = 0"), d).orderBy("rank").collect()]
    assert sorted(got[:2]) == [(1, most), (3, most)] and got[2:] == [(4, 256 * 1024), (2, -most - 1)]
    rng = np.random.default_rng(4)
    c = rng.integers(-(1 << 62), 1 << 62, (40, 300))
    for i, (found, _) in enumerate(topk.search(c[:, :4], np.arange(4), c, np.arange(300), 5)):
        scores = c[:, i].astype(object) @ c.astype(object)
        assert found.tolist() == sorted((j for j in range(300) if j != i), key=lambda j: (-scores[j], j))[:5]
