import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cadence.llm import divergence as D
from cadence.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def check_base(rows, got):
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got if r.doc_id is not None) == sorted((i, *base(t)) for i, t in rows if i is not None)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_query_is_its_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES["op12_distribution_divergence"](spark, sf)
    columns = ", ".join(got.columns)
    want = c.sql(f"SELECT {columns} FROM ({D.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_labels(spark, sf):
    import pandas as pd

    got = QUERIES["op12_distribution_divergence"](spark, sf.replace("0.001", "0.01")).toPandas()
    both = got.merge(pd.read_parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet"), on="doc_id")
    both = both[~both.base_failed & (both.n_words >= 100)]
    assert both[both.quality == 1].kept.mean() > 0.98 and both[both.quality == 0].kept.mean() < 0.2


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = D.judge(odd).collect()
    assert len(got) == len(rows)
    check_base(rows, got)


def test_repeats_and_lines(spark, docs_of):
    rows = [
        (1, "a b c " * 40), (2, " ".join(f"w{i}" for i in range(60)) + " x x x x"), (3, "p q r s p q r t\n\np q r s p q r t\n \nz"), (4, " ".join(f"v{i % 57}" for i in range(114))),
        (5, "a\r\na\na\n#*$%&|<> x"), (6, "á b á b á b"), (7, "k " * 4000), (8, "a b c d"), (9, " ".join(f"u{i}" for i in range(50))),
    ]
    check_base(rows, D.judge(docs_of(rows)).collect())
    assert D.judge(docs_of([])).count() == 0


def test_distance(spark):
    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    d = spark.createDataFrame([(p, q), (p, p), ([1.0, 0.0], [0.0, 5.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in d.select(D.distance(d.a, d.b)).collect()]
    a, b = [x / 4 for x in p], [x / 4 for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    want = math.sqrt(sum(x * math.log2(x / z) for v in (a, b) for x, z in zip(v, m, strict=True) if x) / 2)
    assert got[0] == pytest.approx(want) and got[1:] == [0.0, 1.0, None]


def test_a_text_unlike_its_language_goes(spark, docs_of, monkeypatch):
    import random

    rng = random.Random(3)
    like = lambda: " ".join(rng.choice(D.COMMON_WORDS[:20]) if rng.random() < 0.4 else "".join(rng.choices("abcdefghij", k=6)) for _ in range(300))
    rows = [(i, like()) for i in range(40)] + [(100, " ".join("".join(rng.choices("#$%&ABC", k=5)) for _ in range(300))), (101, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(300)))]
    kept = {r.doc_id: r.kept for r in D.judge(docs_of(rows, ("language", "classes", "n_words", "left0"))).collect()}
    assert all(kept[i] for i in range(40)) and not kept[100] and not kept[101]
    monkeypatch.setattr(D, "MOST_BROADCAST", 0)  # references joined by exchange
    assert {r.doc_id: r.kept for r in D.judge(docs_of(rows)).collect()} == kept
    assert all(r.kept for r in D.judge(docs_of(rows[:40]).withColumn("lang", F.lit(None).cast("string"))).collect())
