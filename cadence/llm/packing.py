"""Best-fit packing of tokenized documents into sequences, under several capacities at once.

1. ``pieces`` tokenizes every whole text, appends the end id, and cuts only what is
   longer than a sequence.
2. ``pack`` deals the pieces out to shards by a hash and packs each shard by vector
   best fit: pieces in falling order of length; each goes to the open sequence that has
   room in every capacity (tokens, documents, attention cost) and, among those, the
   smallest weighted residual norm (or, if asked, the largest weighted dot product of
   demand and residual). A sequence holds pieces of one shard, so what is lost against
   packing in one task is at most one open sequence per shard of some ten thousand pieces.

Cases: null or empty texts are the end id alone; rows that repeat are packed each for
itself; ties go to the sequence opened first; a table without rows gives no rows; further
columns don't matter; a null doc_id is packed like any other.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SEQUENCE_TOKENS = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs.
SHARD_PIECES = 1 << 14
#: Words, and pieces of words, whose ids a task remembers.
CACHE_WORDS = 350_000
#: Plain words are of printable ASCII and of letters of Latin-1, which no normal form changes and which lower-case one to one.
LETTERS = "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the tokenizer's pattern, for plain words in lower case.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^a-z{LETTERS}0-9]+")


class Capacities(NamedTuple):
    """Of one sequence. None of the production values but tokens ever binds: each piece has a token at least."""

    tokens: int = SEQUENCE_TOKENS
    documents: int = SEQUENCE_TOKENS
    attention: int = SEQUENCE_TOKENS**2

    def demand(self, length: np.ndarray) -> np.ndarray:
        """(pieces, 3): each capacity's share that a piece needs."""
        n = length.astype(np.float64)
        return np.column_stack([n, np.ones(len(n)), n * n])


WEIGHTS = (1.0, 0.05, 0.05)


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceIds(dict):
    """Ids of what the tokenizer's pattern cuts words into, as bytes; only its model is asked, for each piece once."""

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.model, self.spelled = tokenizer(path).model, {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in LETTERS}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        spelled = piece if piece.isascii() else piece.translate(self.spelled)
        ids = self[piece] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids


class WordIds:
    """Ids of white-space separated words as bytes of little-endian 32-bit integers.

    The tokenizer drops white space before it looks for pieces, so a text's ids are its words' ids in a row. Plain words are
    cut into pieces here, and pieces are remembered: nearly all distinct words are plain, and most are a known piece with
    other signs around it. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.path, self.known, self.pieces = path, {}, PieceIds(path)

    def learn(self, words: set[bytes]) -> None:
        """Looks up all that are not known yet."""
        known, pieces, other = self.known, self.pieces, []
        missing = [w for w in words if w not in known]
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = list(words)
        for w in missing:
            text = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:
                known[w] = b"".join([pieces[x] for x in PARTS.findall(text.lower())])
            else:
                other.append(w)
        for lo in range(0, len(other), 1 << 14):
            part = other[lo : lo + (1 << 14)]
            found = tokenizer(self.path).encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            known.update(zip(part, (array("I", e.ids).tobytes() for e in found), strict=True))

    def of(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def split(text: bytes) -> list[bytes]:
    """Words of a text. The tokenizer lower-cases; only its special tokens are looked for before that."""
    return (text if b"<|" in text else text.lower()).split()


def ids_of(text: bytes, path: str) -> bytes:
    """The ids of a whole text and the end id."""
    known, parts = WordIds(path), split(text)
    known.learn(set(parts))
    return known.of(parts) + END_ID.to_bytes(4, "little")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, tokens: int = SEQUENCE_TOKENS, ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = WordIds(path)
        for batch in batches:
            for b in W.slices(batch):
                data, at = W.utf8(b.column("text"))
                raw, out = data.tobytes(), []
                texts = [split(raw[lo:hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                known.learn(set().union(*texts))
                for doc, text in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                    all_ids = known.of(text) + END_ID.to_bytes(4, "little")
                    for k, cut in enumerate(range(0, len(all_ids), 4 * tokens)):
                        part = all_ids[cut : cut + 4 * tokens]
                        out.append((doc, k, cut // 4, len(part) // 4, zlib.crc32(part), part))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                if ids:
                    columns[-1] = pa.array([np.frombuffer(x[5], "<u4").astype(np.int64).tolist() for x in out], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(columns[: 5 + ids], names=names[: 5 + ids])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids array<long>" * ids)


def best_fit(length: np.ndarray, capacity: Capacities = Capacities(), weights: tuple[float, ...] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, for pieces in falling order of length."""
    whole = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    demand, w = capacity.demand(length) / whole, np.asarray(weights, np.float64)
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    left = np.zeros((3, 1024))  # residual shares of the open sequences
    number, used, n, opened = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0, 0
    least = demand.min(axis=0) - 1e-12 if len(length) else None
    for i, d in enumerate(demand):
        slack = left[:, :n] - d[:, None]
        fits = np.flatnonzero((slack >= -1e-12).all(axis=0))
        if len(fits):
            rest = slack[:, fits]
            cost = w @ (rest * rest) if rule == "norm" else -(w * d) @ left[:, fits]
            at = fits[int(np.argmin(cost))]
        else:
            if n == left.shape[1]:
                # sequences that can't take even the smallest piece are closed before more room is made
                keep = np.flatnonzero((left[:, :n] >= least[:, None]).all(axis=0))
                size = max(1024, 2 * len(keep))
                grown, num, use = np.zeros((3, size)), np.zeros(size, np.int64), np.zeros(size, np.int64)
                grown[:, : len(keep)], num[: len(keep)], use[: len(keep)] = left[:, keep], number[keep], used[keep]
                left, number, used, n = grown, num, use, len(keep)
            at = n
            left[:, at], number[at], used[at] = 1.0, opened, 0
            n, opened = n + 1, opened + 1
        sequence[i], offset[i] = number[at], used[at]
        left[:, at] -= d
        used[at] += length[i]
        if (left[:, at] < least).any():  # full: the last open one takes its place
            n -= 1
            if at != n:
                left[:, at], number[at], used[at] = left[:, n], number[n], used[n]
    return sequence, offset


def pack(cut: DataFrame, capacity: Capacities = Capacities(), weights: tuple[float, ...] = WEIGHTS, rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """cut: what pieces() gives -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    narrow = cut.select("doc_id", "piece", "start", "length", "ids_crc32").checkpoint()
    # by the rows' numbers in what is checkpointed: rows that repeat, or have no id, are spread like any others
    shards = max(1, -(-narrow.count() // shard_pieces))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_fit(t.column("length").to_numpy(), capacity, weights, rule)
        ids = sequence * shards + int(key[0].as_py())
        return pa.Table.from_arrays([*(t.column(c) for c in names[:5]), pa.array(ids), pa.array(offset)], names=names)

    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long")
    return narrow.withColumn("shard", shard).groupBy("shard").applyInArrow(run, PIECES + ", sequence_id long, offset long")
