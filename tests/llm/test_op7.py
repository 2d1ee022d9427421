import zlib

import numpy as np
import pytest

from cadence.llm import packing
from cadence.llm.queries import QUERIES


def check_layout(rows, tokens):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= tokens
    return len(at)


def test_query_holds_all_ids(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_best_fit_packing"](spark, sf).collect()
    tk, by = packing.tokenizer(packing.default_tokenizer()), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for d, t in texts.items():
        ids, own = [*tk.encode(t or "", add_special_tokens=False).ids, 1], sorted(by[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, s, min(4096, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 4096))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.asarray(ids[s : s + 4096], "<u4").tobytes()) for s in range(0, len(ids), 4096)]
    assert check_layout(rows, 4096) <= sum(r.length for r in rows) / 4096 * 1.02 + 1


@pytest.mark.parametrize("text", [
    "á é ΣΑΣ Σ İstanbul ﬁ", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "don't I'll x　y ​", "́ a x ́", "\x85a\x1cb 12 3a4'S", "A. B, 1. É. x.. K. é, ²., a'., ...", "日本語 テキスト 😀😀 x.",
])
def test_words_give_the_ids_of_the_text(text):
    path = packing.default_tokenizer()
    assert np.frombuffer(packing.ids_of(text.encode(), path), "<u4").tolist() == [*packing.tokenizer(path).encode(text, add_special_tokens=False).ids, 1]


def test_words_of_all_signs_give_the_ids_of_the_text():
    path, rng = packing.default_tokenizer(), np.random.default_rng(7)
    signs = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0x180)), "'s", "'LL", "<|", "|>", "\u0301", "\u1e9e", "\u01c5", "\u212b", "\u0663", "\u2019"]
    for signs_of in (signs, signs[:94], signs[32:62] * 3 + signs[:8] + signs[126:190]):
        words = ["".join(rng.choice(signs_of, rng.integers(1, 9))) for _ in range(4000)]
        text = " ".join(words)
        assert np.frombuffer(packing.ids_of(text.encode(), path), "<u4").tolist() == [*packing.tokenizer(path).encode(text, add_special_tokens=False).ids, 1]


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    known, text = packing.WordIds(packing.default_tokenizer()), [f"w{i % 7}ord{i}." for i in range(400)]
    for lo in range(0, 400, 40):
        known.learn({w.encode() for w in text[lo : lo + 40]})
        assert len(known.known) <= 50 and len(known.pieces) <= 50


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_capacities_hold(rule):
    rng = np.random.default_rng(0)
    length = np.sort(rng.integers(1, 900, 3000))[::-1].copy()
    cap = packing.Capacities(1000, 4, 500_000)
    seq, off = packing.best_fit(length, cap, rule=rule)
    for s in np.unique(seq):
        own = length[seq == s]
        assert own.sum() <= 1000 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 500_000 * (1 + 1e-9) or len(own) == 1
        o = np.sort(off[seq == s])
        assert o[0] == 0 and np.array_equal(np.sort(np.append(o[1:], own.sum())), np.sort(o + own[np.argsort(off[seq == s])]))


def test_norm_rule_takes_the_fullest_that_fits():
    seq, _ = packing.best_fit(np.array([600, 500, 390, 380, 120]), packing.Capacities(1000, 1000, 10**6))
    assert seq.tolist() == [0, 1, 0, 1, 1]


def test_odd_and_no_rows(spark, odd):
    rows = packing.pack(packing.pieces(odd), shard_pieces=4).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) >= 11 and len([r for r in rows if r.length == 1]) == 5
    check_layout(rows, 4096)
    assert packing.pack(packing.pieces(odd.filter("false"))).count() == 0
    assert packing.pieces(odd, ids=True).filter("size(ids) <> length").count() == 0


def test_rows_without_an_id_are_spread_over_shards(spark):
    cut = spark.createDataFrame([(None, 0, 0, 3, 17)] * 2000, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    rows = packing.pack(cut, shard_pieces=200).toPandas()
    assert len(rows) == 2000 and (rows.sequence_id % 10).value_counts().max() < 300
