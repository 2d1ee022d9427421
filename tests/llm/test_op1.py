import hashlib
import random

import pytest

from cadence.llm import phrases
from cadence.llm.queries import QUERIES


def brute(rows, window=13):
    big = 1 << 63
    first, out = {}, []
    split = [(big if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, big), d)
    for (d, w), (own, _) in zip(split, rows, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((own, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(docs, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in phrases.remove_repeats(docs, **options).collect()), key=str)


def test_query_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_repeated_phrases"](spark, sf).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_random_texts_over_many_chunks(docs_of):
    rng = random.Random(7)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    rows = []
    for d in range(90):
        words = [w for _ in range(rng.randint(0, 6)) for w in (rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.7 else [rng.choice("xyz")] * rng.randint(1, 30))]
        rows.append((d, " ".join(words)))
    rows += [(5, rows[5][1]), (200, rows[3][1]), (None, rows[3][1])]
    assert run(docs_of(rows), chunk_bytes=300, bucket_bytes=700) == brute(rows)
    assert run(docs_of(rows), chunk_bytes=300, bucket_bytes=700, window=4) == brute(rows, 4)


def test_odd_and_no_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert run(odd) == brute(rows) and run(odd.filter("false")) == []


def test_hot_passage_is_kept_once(docs_of):
    passage = " ".join(f"w{i}" for i in range(60))
    got = run(docs_of([(i, f"own{i} {passage} end{i}") for i in range(300)]), chunk_bytes=2000, bucket_bytes=4000)
    assert sum(r[2] for r in got) == 299 * 60 and min(r[2] for r in got) == 0


def test_a_hot_shard_is_split(docs_of):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(200)]
    assert run(docs_of(rows), chunk_bytes=2000, bucket_bytes=4000, part_bytes=3000) == brute(rows)


@pytest.mark.parametrize("n", [10, 12])
def test_colliding_words_are_told_apart(docs_of, n):
    a, b = "a", "b"
    for _ in range(n):  # different words that polynomials modulo a power of two don't tell apart
        a, b = a + b, b + a
    rows = [(1, " ".join(f"w{i}" for i in range(12)) + f" {a}"), (2, " ".join(f"w{i}" for i in range(12)) + f" {b}")]
    assert run(docs_of(rows)) == brute(rows) and all(r[2] == 0 for r in brute(rows))


def test_hits_alone_decide(docs_of, monkeypatch):
    """With letters of one bit many windows look alike to the automata: what is compared afterwards keeps the result exact."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(6)]
    rows = pa.table({"shard": [0] * 12, "part": [0] * 12, "pattern": [True] * 6 + [False] * 6, "chunk": list(range(12)), "at": [0] * 12, "doc": [*range(6), *range(10, 16)], "text": pa.array([x.encode() for x in texts + texts[::-1]], pa.binary())})
    exact = phrases.locate(rows, 13)
    assert exact.num_rows == 6
    monkeypatch.setattr(phrases, "_letters", lambda h: np.uint32(256) + (h >> np.uint64(63)).astype(np.uint32))
    assert phrases.locate(rows, 13).equals(exact)
    monkeypatch.setattr(phrases, "AUTOMATON_PATTERNS", 7)
    monkeypatch.setattr(phrases, "STREAM_WORDS", 50)
    assert phrases.locate(rows, 13).equals(exact)
    assert phrases.locate(rows.filter(pa.array([False] * 6 + [True] * 6)), 13).num_rows == 0
