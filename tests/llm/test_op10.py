import random

import pytest
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from cadence.llm import unigram
from cadence.llm.queries import QUERIES


def reference(vocabulary, byte_pieces):
    """The same vocabulary in the library's own unigram model. Byte pieces stand under names that no text can match there."""
    low = min(s for _, s in vocabulary)
    full = [("<unk>", low), *((f"<0x{i:02X}>", low) for i in range(256) if byte_pieces), *vocabulary]
    t = Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=byte_pieces))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\t-\r]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    return t


def test_query_is_the_library(spark, sf):
    t = reference(*unigram.vocabulary(unigram.default_vocabulary()))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op10_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.n_tokens == len(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) and r.n_words == len((texts[r.doc_id] or "").encode().split()) for r in rows)


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_ties_and_unknown_characters(byte_pieces):
    rng = random.Random(int(byte_pieces))
    for _ in range(25):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(9)} | {unigram.MARK + "a", "b"}
        vocabulary = [(p, -float(rng.randint(1, 3))) for p in sorted(pieces)]  # whole scores: ties all over
        c, t = unigram.Counter(vocabulary, byte_pieces), reference(vocabulary, byte_pieces)
        words = ["".join(rng.choice("abcdé😀") for _ in range(rng.randint(1, 12))) for _ in range(40)]
        assert c.count([unigram.MARK + w for w in words]).tolist() == [len(t.encode(w, add_special_tokens=False).ids) for w in words]


def test_odd_and_no_rows(odd):
    rows = {r.doc_id: r for r in unigram.token_counts(odd).collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == rows[2].n_tokens == 0 and rows[9].n_words == 3000 and rows[7].n_tokens > 100
    assert unigram.token_counts(odd).count() == odd.count() and unigram.token_counts(odd.filter("false")).count() == 0


def test_small_cache(monkeypatch):
    monkeypatch.setattr(unigram, "CACHE_WORDS", 3)
    c = unigram.Counter([(unigram.MARK, -1.0), ("a", -1.0), ("b", -1.5), ("ab", -1.2)], False)
    texts = [[b"ab", b"a"], [b"b", b"bb", b"ab"], [], [b"a"] * 5]
    known = {}
    assert c.counts(texts, known) == [4, 7, 0, 10] == c.counts(texts, known)
