import difflib
import random

import pytest

from cadence.llm import hot
from cadence.llm import line_dedup as L
from cadence.llm.queries import QUERIES


def match(a, b, i, j, k, m):
    """Pairs of places in a[i:j] and b[k:m] by the rules of patience diff, the plain way."""
    if i < j and k < m and a[i] == b[k]:
        return {(i, k)} | match(a, b, i + 1, j, k + 1, m)
    if i < j and k < m and a[j - 1] == b[m - 1]:
        return {(j - 1, m - 1)} | match(a, b, i, j - 1, k, m - 1)
    if i >= j or k >= m:
        return set()
    once = [(p, q) for q in range(k, m) for p in range(i, j) if a[p] == b[q] and a[i:j].count(a[p]) == b[k:m].count(b[q]) == 1]
    if once:
        best = []  # of each, the longest ascending series that ends there; of equal ones that whose end lies lowest
        for n, (p, q) in enumerate(once):
            before = max((x for x in best[:n] if x[-1][0] < p), key=lambda x: (len(x), -x[-1][0]), default=[])
            best.append([*before, (p, q)])
        series = max(best, key=lambda x: (len(x), -x[-1][0]))
        out = set(series)
        for (p, q), (r, s) in zip([(i - 1, k - 1), *series], [*series, (j, m)], strict=True):
            out |= match(a, b, p + 1, r, q + 1, s)
        return out
    p = q = n = 0
    for y in range(k, m):
        for x in range(i, j):
            size = 0
            while x + size < j and y + size < m and a[x + size] == b[y + size]:
                size += 1
            if size > n and any(a[x : x + size]):
                p, q, n = x, y, size
    if not n:
        return set()
    return {(p + x, q + x) for x in range(n)} | match(a, b, i, p, k, q) | match(a, b, p + n, j, q + n, m)


def brute(rows, least=5):
    """Each document against every earlier one."""
    split = [(d, None if t is None else [(x, tuple(x.encode().split())) for x in t.split("\n")]) for d, t in rows]
    out = []
    for d, own in split:
        b, gone = [x for _, x in own or ()], set()
        for e, other in split if d is not None and own else ():
            if e is None or not other or e >= d or not {x for x in b if x} & {x for _, x in other}:
                continue
            pairs, block = sorted(match([x for _, x in other], b, 0, len(other), 0, len(b))), []
            for pair in [*pairs, None]:
                if block and (pair is None or pair != (block[-1][0] + 1, block[-1][1] + 1)):
                    k, m = block[0][1], block[-1][1] + 1
                    for s in range(k, m):
                        for t in range(s + 1, m + 1):
                            if sum(map(len, b[s:t])) >= least and (sum(map(len, b[s + 1 : t])) < least or sum(map(len, b[s : t - 1])) < least):
                                gone.add(tuple(b[s:t]))
                    block = []
                if pair:
                    block.append(pair)
        lines = set()
        for s in range(len(b)):
            for t in range(s + 1, len(b) + 1):
                if tuple(b[s:t]) in gone:
                    lines |= set(range(s, t))
        out.append((d, None if own is None else "\n".join(x for i, (x, _) in enumerate(own) if i not in lines), len(b), len(lines)))
    return sorted(out, key=str)


def run(docs):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.remove_common_lines(docs).collect()), key=str)


def test_query_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in QUERIES["op8_pairwise_alignment"](spark, sf).collect()), key=str)
    assert got == brute(rows) and sum(r[3] for r in got) > 0


def test_alignment():
    assert L.aligned([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert L.aligned([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)] and L.aligned([], [1]) == []
    assert L.aligned([1, 2, 3, 4, 5], [4, 5, 1, 2, 3]) == [(0, 2), (1, 3), (2, 4)]  # the longer series of anchors
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randint(0, 30) for _ in range(4)]
        pairs = L.aligned(a, b)
        assert all(a[i] == b[k] for i, k in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    whole = list(range(200))
    part = whole[:50] + [-1] + whole[60:]
    assert len(L.aligned(whole, part)) == sum(m.size for m in difflib.SequenceMatcher(None, whole, part, autojunk=False).get_matching_blocks())


def test_blocks_of_few_words_stay():
    assert L.common_lines([1, 2], [1, 2], [2, 2], 5) == [] and L.common_lines([1, 2], [1, 2], [2, 3], 5) == [0, 1]


def test_random_documents(docs_of):
    rng = random.Random(1)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    rows = [(d, "\n".join(rng.choice(pool) + rng.choice(["", "", " "]) if rng.random() < 0.7 else f"own {d} {rng.random()} words of it" for _ in range(rng.randint(1, 12)))) for d in rng.sample(range(500), 80)]
    assert run(docs_of(rows)) == brute(rows)


@pytest.mark.parametrize("n", [10, 12])
def test_lines_of_colliding_words_differ(docs_of, n):
    a, b = "a", "b"
    for _ in range(n):  # different words that polynomials modulo a power of two don't tell apart
        a, b = a + b, b + a
    rows = [(1, f"some words stand before {a}\nx"), (2, f"some words stand before {b}\nx")]
    assert run(docs_of(rows)) == brute(rows) and all(r[3] == 0 for r in brute(rows))


def test_hot_lines_and_owners(docs_of, monkeypatch):
    monkeypatch.setattr(hot, "SHARES", 7)
    rows = [(d, f"one common line of many words\nown {d} a b c d\nanother common line of five words") for d in range(120)] + [(500, "x"), (501, "own 3 a b c d")]
    assert run(docs_of(rows)) == brute(rows)


def test_odd_and_no_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert run(odd) == brute(rows) and run(odd.filter("false")) == [] and {"size", "lang", "row"} <= set(L.remove_common_lines(odd).columns)
