import random

import numpy as np
import pytest

from cadence.llm import hot, near_dup
from cadence.llm.components import components, unite
from cadence.llm.queries import QUERIES

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, size, percent):
    sets = []
    for d, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append((d, frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()))
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for i, (d, s) in enumerate(sets):
        for e, z in sets[:i]:
            if None not in (d, e) and s and z and 100 * len(s & z) >= percent * len(s | z):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def run(docs, size, percent):
    return sorted((tuple(r) for r in near_dup.near_duplicates(docs, size, percent).collect()), key=str)


def test_query_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op4_super_minhash"](spark, sf).collect()), key=str) == brute(rows, 3, 85)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_chains_copies_and_short_texts(docs_of, size, percent):
    rng = random.Random(size)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 4, 30, 120]))]
        for _ in range(rng.randint(1, 14)):
            rows.append([len(rows) * 3 % 97 + 100 * g, " ".join(base)])
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = f"v{rng.randint(0, 400)}"
    rows += [(5000, rows[0][1].upper()), (rows[1][0], rows[1][1])]
    assert run(docs_of(rows), size, percent) == brute(rows, size, percent)


def test_odd_and_no_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert run(odd, 3, 85) == brute(rows, 3, 85) and run(odd.filter("false"), 3, 85) == []


def test_signature_estimates_with_less_variance():
    rng = np.random.default_rng(0)
    share = []
    for _ in range(200):
        u = rng.integers(0, 2**63, 20, dtype=np.uint64)
        s = near_dup.super_minhash(np.repeat([0, 1], 18), np.concatenate([u[:18], u[2:]]), 2, 80)
        share.append((s[0] == s[1]).mean())
    assert abs(np.mean(share) - 0.8) < 0.01 and np.std(share) < (0.16 / 80) ** 0.5
    # each place of a single element's signature holds another step
    one = near_dup.super_minhash(np.array([0]), np.array([7], np.uint64), 1, 80)[0]
    assert sorted((one >> np.uint64(56)).tolist()) == list(range(80))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)] + [(7, 7)]
    got = {r.child: r.parent for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    child, root = unite(*np.array(edges, np.int64).T)
    assert got == dict(zip(child.tolist(), root.tolist(), strict=True)) and got[1200] == 1000 and got[2299] == 2000
    few = components(spark.createDataFrame(edges, "a long, b long").repartition(7), task_links=40)  # no task sees all links
    assert got == {r.child: r.parent for r in few.collect()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [60, 66])
def test_low_thresholds_have_wide_signatures(docs_of, percent):
    rng = random.Random(percent)
    rows = []
    for g in range(6):
        base = [f"w{rng.randint(0, 900)}" for _ in range(60)]
        for _ in range(5):
            rows.append([len(rows), " ".join(base)])
            base[rng.randrange(60)] = f"v{g} {rng.random()}"
    assert run(docs_of(rows), 3, percent) == brute(rows, 3, percent)
    places = near_dup.bands_for(percent) * near_dup.BAND_ROWS
    one = near_dup.super_minhash(np.array([0]), np.array([7], np.uint64), 1, places)[0]
    assert places > 256 and sorted((one >> np.uint64(48)).tolist()) == list(range(places))


def twisted(n):
    """Two different words that polynomials modulo a power of two don't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 12])
def test_texts_of_colliding_words_are_not_linked(docs_of, n):
    a, b = twisted(n)
    rows = [(1, " ".join(f"w{i}" for i in range(11)) + f" {a}"), (2, " ".join(f"w{i}" for i in range(11)) + f" {b}")]
    rows += [(3, f"x {a} y"), (4, f"x {b} y")]
    assert run(docs_of(rows), 3, 85) == brute(rows, 3, 85)


def test_hot_buckets_and_shingles(docs_of, monkeypatch):
    monkeypatch.setattr(hot, "SHARES", 9)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 3, 5])):
            words[rng.randrange(60)] = f"v{rng.randint(0, 30)}"
        rows.append((d, " ".join(words)))
    assert run(docs_of(rows), 3, 85) == brute(rows, 3, 85)
