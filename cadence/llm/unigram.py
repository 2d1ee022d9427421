"""Token counts of a unigram tokenizer without making tokens: count-only Viterbi.

A vocabulary is a list of (piece, score). A text is cut at white space, each word gets the
word mark in front, and its tokens are the sequence of pieces with the highest sum of
scores. An Aho-Corasick automaton over the vocabulary lists all pieces that end at each
character; a forward pass carries, for each character, the best sum and the number of
pieces on the best path. Nothing else is kept, as only the number is asked for.

Tie rule: among paths of one score that end at a character, the last piece that begins
first (the longest) wins; a later one must be strictly better. A character that is no
piece can be an unknown piece, ten below the lowest score; if the vocabulary has byte
pieces, a run of unknown characters counts as its UTF-8 bytes, else as one token.

Cases: null or empty texts, or such of white space alone, have 0 tokens; rows that repeat
are counted each for itself; a table without rows gives no rows; further columns and a
null doc_id don't matter.
"""

from __future__ import annotations

import functools
from itertools import chain
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_BELOW = 10.0
#: Words whose counts a task remembers.
CACHE_WORDS = 200_000


class Counter:
    """Counts the pieces of words. Scores are finite; pieces are not empty and hold no line feed."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: bool) -> None:
        import ahocorasick

        self.automaton, self.byte_pieces = ahocorasick.Automaton(ahocorasick.STORE_INTS), byte_pieces
        for i, (piece, _) in enumerate(vocabulary):
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.sizes = np.array([len(p) for p, _ in vocabulary], np.int64)
        self.scores = np.array([s for _, s in vocabulary], np.float64)
        self.unknown = float(self.scores.min()) - UNKNOWN_BELOW

    def count(self, words: list[str]) -> np.ndarray:
        """Pieces of each word: all words go forward together, one character at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # a word's node k lies after its first k characters
        joined = "\n".join(words)
        nodes = len(joined) + 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        size = self.sizes[piece]
        depth = np.arange(nodes) - np.repeat(begin, sizes + 1)
        # of the pieces that end at a node, the longest is tried first
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else end
        place = np.arange(len(end)) - np.repeat(first, np.diff(np.append(first, len(end))))
        single = np.zeros(nodes, bool)
        single[end[size == 1]] = True
        bare = np.flatnonzero(~single & (depth > 0))
        key = depth[end] * (int(place.max(initial=0)) + 1) + place
        if key.max(initial=0) < 1 << 16:
            key = key.astype(np.uint16)  # sorted by radix
        order = np.argsort(key, kind="stable")
        bare = bare[np.argsort(depth[bare], kind="stable")]
        key = key[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        bounds = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)][: len(cuts)], strict=True))
        at_depth = depth[end[order][cuts]].tolist() if len(cuts) else []
        best, pieces, unknown = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, bool)
        best[begin] = 0.0
        bare_depth, b, g = depth[bare], 0, 0
        for d in range(1, int(sizes.max(initial=0)) + 1):
            while g < len(bounds) and at_depth[g] == d:
                pick = order[bounds[g][0] : bounds[g][1]]
                to, of = end[pick], end[pick] - size[pick]
                total = best[of] + self.scores[piece[pick]]
                better = total > best[to]
                to, of = to[better], of[better]
                best[to], pieces[to], unknown[to] = total[better], pieces[of] + 1, False
                g += 1
            if b < len(bare) and bare_depth[b] == d:
                stop = int(np.searchsorted(bare_depth, d, "right"))
                to = bare[b:stop]
                total = best[to - 1] + self.unknown
                better = total > best[to]
                to = to[better]
                more = np.array([len(joined[i - 1].encode()) for i in to.tolist()], np.int64) if self.byte_pieces else 1 - unknown[to - 1].astype(np.int64)
                best[to], pieces[to], unknown[to] = total[better], pieces[to - 1] + more, True
                b = stop
        return pieces[begin + sizes]

    def counts(self, texts: list[list[bytes]], known: dict[bytes, int]) -> list[int]:
        """Pieces of each text, as a list of words. known holds what was counted before, and is kept small."""
        words = set().union(*texts)
        missing = [w for w in words if w not in known]
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = list(words)
        for lo in range(0, len(missing), 1 << 14):
            part = missing[lo : lo + (1 << 14)]
            known.update(zip(part, self.count([MARK + w.decode("utf-8", "replace") for w in part]).tolist(), strict=True))
        return [sum(map(known.__getitem__, t)) for t in texts]


@functools.cache
def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The normal and user-defined pieces of a sentencepiece file with their scores, and if it has byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    size = p.get_piece_size()
    plain = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return [(p.id_to_piece(i), p.get_score(i)) for i in plain], any(p.is_byte(i) for i in range(size))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(*vocabulary(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_tokens."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known = counter(path), {}
        for batch in batches:
            for b in W.slices(batch):
                data, at = W.utf8(b.column("text"))
                raw = data.tobytes()
                texts = [raw[lo:hi].split() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                sizes = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(c.counts(texts, known), pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
