import math

import duckdb
import numpy as np
import pytest

from cadence.llm import anchors as A
from cadence.llm import blocks
from cadence.llm.queries import QUERIES

LONGEST = (1 << 63) - 1
clip = lambda x: max(-LONGEST - 1, min(LONGEST, x))


def brute(rows, every=50):
    sound = [(i, tuple(clip(math.floor(256 * x)) for x in v), y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda v, w: clip(sum(a * b for a, b in zip(v, w, strict=False)))
    out = []
    for a in {i for i, _, _ in sound if i % every == 0}:
        v, y = min((v, y) for i, v, y in sound if i == a)
        others = sorted((-score(v, w), i, z == y) for i, w, z in sound if i != a)
        for ps, p, _ in [x for x in others if x[2]][:5]:
            fits = [(n, -ns) for ns, n, same in others if not same and 50 * -ps <= 100 * -ns <= 95 * -ps]
            out += [(a, p, k, n, -ps, ns) for k, (n, ns) in enumerate(fits[:3], 1)]
    return sorted(out)


def run(spark, rows, kind="float"):
    d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    d = d.selectExpr("*", "'x' AS id", "1 AS v", "2 AS block", "3 AS place", "4 AS n")
    return sorted(tuple(r) for r in A.mine(d.filter("vec_id % 50 = 0"), d).collect())


def test_query_is_its_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(A.ORACLE_SQL).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op11_anchor_tree_negatives"](spark, sf).collect()) == sorted(want) and len(want) > 50


def clustered(n, dims=24, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(i, [float(x) for x in (centres[i % 7] + 0.3 * rng.normal(size=dims)).astype(np.float32)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_blocks_and_passes(spark, monkeypatch, small):
    rows = clustered(400)
    if small:  # anchors in several blocks and passes
        for name, value in (("QUERY_ROWS", 3), ("CANDIDATE_ROWS", 50), ("PASS_BYTES", 600)):
            monkeypatch.setattr(blocks, name, value)
    want = brute(rows)
    assert run(spark, rows) == want and len(want) > 50


def test_odd_rows(spark):
    half = [0.5] * 8
    rows = [
        (0, half, 1), (0, half, 0), (50, [1.0, 1.0], 1), (100, [], 2), (150, half, None), (200, None, 1), (250, [-0.5] * 8, 1), (1, half, 1), (2, half, 1), (2, half, 1), (3, [0.4] * 8, 1),
        (4, [0.3] * 8, 2), (5, [0.3] * 8, 2), (6, [0.3] * 8, 3), (6, [0.3] * 8, 3), (7, [None, 1.0], 1), (8, [float("nan")], 1), (9, [float("inf")], 2), (None, half, 1), (10, half, 2), (11, [0.2], 0), (12, [0.0] * 8, 0), (300, half, 9),
    ]
    want = brute(rows)
    assert run(spark, rows) == want and want
    d = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert A.mine(d, d).count() == 0


def test_scores_beyond_a_long(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2**40, 2**40, 6) * (1 if i % 3 else 2**12)], i % 3) for i in range(0, 200, 5)]
    assert run(spark, rows, "double") == brute(rows)


def test_tree_prunes_without_loss():
    rows = clustered(600, seed=5)
    v = np.array([[math.floor(256 * x) for x in r[1]] for r in rows], np.int64).T
    x = {"q_n": 100, "q_dims": 24, "q_columns": v[:, :100].tobytes(), "q_ids": list(range(100)), "q_labels": [0] * 100, "q_scoress": None}
    block = A.Positives(x, 5)
    assert sorted(block.order) == list(range(100)) and all(p < 0 or block.order.index(p) < block.order.index(i) for i, p in enumerate(block.parent))
    asked = []
    block.add = lambda i, ids, scores: (asked.append(len(ids)), A.Positives.add(block, i, ids, scores))
    for lo in range(0, 600, 100):
        block.meet(v[:, lo : lo + 100], np.arange(lo, lo + 100), np.zeros(100, np.int64))
    for i in range(100):
        full = sorted((-int(s), j) for j, s in enumerate(v[:, i] @ v) if j != i)[:5]
        assert list(zip((-block.best[i][1]).tolist(), block.best[i][0].tolist(), strict=True)) == full
    assert sum(asked) < 0.9 * 100 * 600  # a good part is never scored again
