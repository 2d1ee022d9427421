import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from cadence.llm import periods as P
from cadence.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, exponent=4):
    """Every period, every stretch that keeps it; the smallest period of a stretch counts."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            part = words[start : start + length]
            if length >= max(least, exponent * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def changed(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None or text is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(doc_id, text):
    words = changed(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *most, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))


def test_wavelet_tree():
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 500):
        values = rng.permutation(n)
        tree = P.WaveletTree(values)
        lo = rng.integers(0, n, 50)
        hi = np.array([rng.integers(x + 1, n + 1) for x in lo])
        bound = rng.integers(0, n, 50)
        nth = np.array([rng.integers(0, h - x) for x, h in zip(lo, hi, strict=True)])
        assert tree.below(lo, hi, bound).tolist() == [int((values[x:h] < b).sum()) for x, h, b in zip(lo, hi, bound, strict=True)]
        assert tree.smallest(lo, hi, nth).tolist() == [int(np.sort(values[x:h])[k]) for x, h, k in zip(lo, hi, nth, strict=True)]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_sequences(letters):
    rng = random.Random(letters)
    many = [[rng.randrange(letters) for _ in range(rng.choice((0, 1, 5, 6, 30, 120)))] for _ in range(60)]
    for _ in range(60):  # runs of every period, next to one another
        x = []
        while len(x) < rng.choice((20, 150)):
            unit = [rng.randrange(letters + 3) for _ in range(rng.randrange(1, 12))]
            x += (unit * rng.randrange(1, 8))[: rng.randrange(1, 60)]
        many.append(x)
    flat, first = [], [0]
    for i, x in enumerate(many):
        flat += [*x, 1000 + i]
        first.append(len(flat))
    got = {}
    for o, s, n, q in zip(*(x.tolist() for x in P.runs_of(np.array(flat, np.int64), np.array(first))), strict=True):
        got.setdefault(o, []).append((s, n, q))
    assert [got.get(i, []) for i in range(len(many))] == [brute(x) for x in many]


def test_query_is_brute_force(spark, sf):
    rows = pd.read_parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, sf).collect()))
    assert got == sorted(row(int(i), t) for i, t in zip(rows.doc_id, rows.text, strict=True)) and sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark, odd, docs_of):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is not None, r)
    got = P.collapse(odd).collect()
    want = [(i, len(WORD.findall(t or "")), [*map(tuple, brute(WORD.findall(t or "")))] if t != "w " * 3000 else [(0, 3000, 1)]) for i, t in rows]
    assert sorted(((r.doc_id, r.n_words, [*map(tuple, r.runs)]) for r in got), key=key) == sorted(want, key=key)
    assert {r.kept for r in got if r.n_words == 3000} == {"w"} and P.digest(P.collapse(docs_of([]))).count() == 0


def test_long_text_and_slices(spark, docs_of, monkeypatch):
    rng = random.Random(5)
    unit = [f"u{rng.randrange(10**6)}" for _ in range(7001)]
    text = " ".join([*(f"x{i}" for i in range(999)), *unit * 5, *unit[:50], "end"])
    monkeypatch.setattr(P, "SLICE_BYTES", 300)
    docs = docs_of([(1, text), (2, "a b a b a b a b"), (3, text), (4, "a a a a a"), (5, "a a a a a a"), (6, "á á\tá\ná á  á b")], ("runs", "kept", "best"))
    got = {r.doc_id: ([*map(tuple, r.runs)], r.kept) for r in P.collapse(docs).collect()}
    assert got[1] == got[3] == ([(999, 5 * 7001 + 50, 7001)], " ".join([*(f"x{i}" for i in range(999)), *unit, "end"]))
    assert got[2] == ([(0, 8, 2)], "a b") and got[4] == ([], "a a a a a") and got[5] == ([(0, 6, 1)], "a") and got[6] == ([(0, 6, 1)], "á b")
