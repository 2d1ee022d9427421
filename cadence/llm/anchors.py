"""Hard negatives by anchor spanning-tree bounds.

Anchors lie in blocks, and each block's anchors form a spanning tree of least total distance. A candidate's score with the root is
computed. From a parent to its child the score changes by at most the edge's length times the candidate's own length
(Cauchy-Schwarz), so an interval for the parent, or its score where that was computed, gives an interval for the child. Only
candidates whose interval overlaps the child's window are scored again; these have exact scores from there on down the tree.

Two walks over all candidates: the first finds each anchor's positives (window: from the worst of the best so far upwards), the second the
negatives of each positive (window: a share of the positive's score, from the worst of the best so far upwards). The candidates
are never exchanged, see ``blocks``.

Cases: rows with a null id or label, a null vector or null or non-finite components take no part; missing dimensions of a shorter vector count
as 0; of anchor rows with one id the least vector, then label, asks; candidate rows that repeat are found as often as they
stand there, and a positive that repeats gets its negatives each time, but never a row with the anchor's own id; an anchor without
positives gives no rows; a window of a negative score is empty; scores beyond the range of a long count as the largest or least long; a table without
rows gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: A negative's score, in percent of the positive's.
LEAST, MOST = 50, 95
LONGEST = (1 << 63) - 1

FOUND = "anchor_id long, vec_id long, score long"
MINED = "anchor_id long, place int, negative_id long, negative_score long"


def spanning_tree(anchors: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Of (dimensions, vectors): an order in which parents come first, each one's parent (the root's is -1), and edge lengths, rounded up."""
    a = anchors.astype(np.float64)
    square = (a**2).sum(axis=0)
    n = a.shape[1]
    parent, order, near = np.full(n, -1), [0], np.full(n, np.inf)
    out = np.zeros(n, bool)
    last = 0
    for _ in range(n - 1):
        out[last] = True
        d = square + square[last] - 2 * (a[:, last] @ a)
        closer = (d < near) & ~out
        near[closer], parent[closer] = d[closer], last
        last = int(np.argmin(np.where(out, np.inf, near)))
        order.append(last)
    long = np.sqrt(square)
    edge = np.sqrt(((a - a[:, parent]) ** 2).sum(axis=0)) * (1 + 1e-9) + 1e-12 * (long + long[parent])
    return order, parent.tolist(), edge


class Block:
    """Anchors of one block in one task, what is known of them so far, and the walk through a block of candidates."""

    def __init__(self, x: dict):
        self.vectors, self.ids, self.labels = blocks.matrix(x, "q_"), x["q_ids"], x["q_labels"]
        self.order, self.parent, self.edge = spanning_tree(self.vectors)

    def window(self, i: int) -> tuple[float, float]:
        """The scores that matter to anchor i."""
        raise NotImplementedError

    def takes(self, i: int, labels: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        raise NotImplementedError

    def meet(self, candidates: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        a, c = blocks.both(self.vectors, candidates)
        rows = np.ascontiguousarray(c.T)
        long = np.sqrt((c.astype(np.float64) ** 2).sum(axis=0)) * (1 + 1e-9)
        low, high = np.empty((2, a.shape[1], len(ids)))
        for i in self.order:
            if self.parent[i] < 0:
                exact = rows @ a[:, i]
                low[i] = high[i] = exact.astype(np.float64)
                ask = np.flatnonzero(self.takes(i, labels) & (ids != self.ids[i]))
                exact = exact[ask]
            else:
                far = self.edge[i] * long
                low[i], high[i] = low[self.parent[i]] - far, high[self.parent[i]] + far
                least, most = self.window(i)
                ask = np.flatnonzero((high[i] >= least) & (low[i] <= most) & self.takes(i, labels) & (ids != self.ids[i]))
                if not len(ask):
                    continue
                exact = (rows @ a[:, i])[ask] if 2 * len(ask) > len(ids) else rows[ask] @ a[:, i]
                low[i, ask] = high[i, ask] = exact.astype(np.float64)
            if exact.dtype == object:
                exact = np.array([max(-LONGEST - 1, min(LONGEST, int(s))) for s in exact], np.int64)
            self.add(i, ids[ask], exact.astype(np.int64))


def _loose(x: float) -> float:
    """How far a bound in doubles may be off."""
    return 0.5 + 1e-9 * abs(x)


class Positives(Block):
    def __init__(self, x: dict, k: int):
        super().__init__(x)
        self.k = k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]

    def window(self, i: int) -> tuple[float, float]:
        scores = self.best[i][1]
        return (float(scores[-1]) - _loose(float(scores[-1])), np.inf) if len(scores) == self.k else (-np.inf, np.inf)

    def takes(self, i: int, labels: np.ndarray) -> np.ndarray:
        return labels == self.labels[i]

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own_ids, own = self.best[i]
        if len(own) == self.k:
            ids, scores = ids[scores >= own[-1]], scores[scores >= own[-1]]
        if len(ids):
            ids, scores = np.concatenate([own_ids, ids]), np.concatenate([own, scores])
            first = np.lexsort((ids, ~scores))[: self.k]  # ~x is -x - 1, for the least long, too
            self.best[i] = ids[first], scores[first]

    def rows(self) -> pa.RecordBatch:
        ids, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*self.best, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, [len(i) for i, _ in self.best]), pa.int64()), pa.array(ids), pa.array(scores)], names=["anchor_id", "vec_id", "score"])


class Negatives(Block):
    def __init__(self, x: dict, k: int, least: int, most: int):
        super().__init__(x)
        self.k = k
        # the lowest and highest whole scores in each positive's window
        self.ranges = [[(-(-least * s // 100), most * s // 100) for s in own] for own in x["q_scoress"]]
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own) for own in self.ranges]

    def window(self, i: int) -> tuple[float, float]:
        least, most = np.inf, -np.inf
        for (lo, hi), (_, scores) in zip(self.ranges[i], self.best[i], strict=True):
            if lo <= hi:
                least, most = min(least, float(scores[-1] if len(scores) == self.k else lo)), max(most, float(hi))
        return (least - _loose(least), most + _loose(most)) if least <= most else (np.inf, -np.inf)

    def takes(self, i: int, labels: np.ndarray) -> np.ndarray:
        return labels != self.labels[i]

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, ~scores))
        ids, scores = ids[order], scores[order]
        for p, (lo, hi) in enumerate(self.ranges[i]):
            at = len(scores) - int(np.searchsorted(scores[::-1], hi, "right"))
            new = slice(at, min(at + self.k, len(scores) - int(np.searchsorted(scores[::-1], lo, "left"))))
            if new.stop > new.start:
                own_ids, own = self.best[i][p]
                all_ids, every = np.concatenate([own_ids, ids[new]]), np.concatenate([own, scores[new]])
                first = np.lexsort((all_ids, ~every))[: self.k]
                self.best[i][p] = all_ids[first], every[first]

    def rows(self) -> pa.RecordBatch:
        out = [(a, p, int(v), int(s)) for a, own in zip(self.ids, self.best, strict=True) for p, best in enumerate(own) for v, s in zip(*best, strict=True)]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "place", "negative_id", "negative_score"])


def _walk(make):
    def run(pairs: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Block] = {}
        for x in pairs:
            # a number may come in parts, which differ in their ids
            key = (x["q_block"], x["q_n"], x["q_ids"][0])
            if key not in known:
                known[key] = make(x)
            known[key].meet(blocks.matrix(x), np.array(x["ids"], np.int64), np.array(x["labels"], np.int64))
        for block in known.values():
            yield block.rows()

    return run


def mine(anchors: DataFrame, rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """anchors and rows (vec_id, embedding, label: a whole number) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor's best rows of its own label, the best rows of other labels whose score is least to most percent of the positive's.
    """

    def sound(x: DataFrame) -> DataFrame:
        x = x.select(F.col("vec_id").cast("long").alias("id"), blocks.whole(F.col("embedding"), scale).alias("v"), F.col("label").cast("long").alias("label"))
        return x.filter("id is not null and v is not null and label is not null")

    candidates = blocks.pack(sound(rows), blocks.CANDIDATE_ROWS, ("id", "label")).checkpoint()
    asked = sound(anchors).groupBy("id").agg(F.min(F.struct("v", "label")).alias("one")).select("id", "one.v", "one.label").checkpoint()
    asking = blocks.pack(asked, blocks.QUERY_ROWS, ("id", "label")).checkpoint()
    found = blocks.against_all(asking, candidates, _walk(lambda x: Positives(x, positives)), FOUND)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")) - 1
    found = found.withColumn("place", place).filter(F.col("place") < positives).checkpoint()
    windows = found.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    asking = blocks.pack(asked.join(windows, F.col("id") == F.col("anchor_id")).select("id", "v", "label", "scores"), blocks.QUERY_ROWS, ("id", "label", "scores")).checkpoint()
    mined = blocks.against_all(asking, candidates, _walk(lambda x: Negatives(x, negatives, least, most)), MINED)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id"))
    mined = mined.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    whose = found.select(F.col("anchor_id").alias("its_anchor"), F.col("place").alias("its_place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.join(whose, (F.col("anchor_id") == F.col("its_anchor")) & (F.col("place") == F.col("its_place")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def with_noise(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """rows(vec_id, embedding, label), where each so many-th id has the label after its own."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).alias("label"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
