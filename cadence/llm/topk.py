"""Exact top-k search by inner product: columnar branch and bound.

Vectors are turned to whole numbers, floor(SCALE * x), and packed into blocks in vertical layout: a block holds
its vectors dimension by dimension. Blocks of queries are broadcast in passes of a bounded size, and a task walks with
them through its blocks of candidates, which are never exchanged. Scores add up over blocks of dimensions. In the first
block the candidates that lead are scored fully, and the k-th of them is the query's bound; from the next one on the
bound is the k-th best score that the task has found. A candidate goes as soon as its sum and the most that the
remaining dimensions can add (the product of what is left of both lengths, by Cauchy-Schwarz) stay below the bound, and
the rest is packed together again. Each task gives at most k rows for a query, of which the best k overall are the
result; the number of tasks is that of the cluster's cores, not of the blocks.

Cases: vectors that are null, or hold null or non-finite components, and rows with a null id take no part; an empty
vector, or missing dimensions of a shorter one, count as 0; ties go to the smaller id; of query rows with one id
the least vector asks; candidate rows that repeat are found as often as they stand there, but never a row
with the query's own id; a component beyond the range of a long counts as the largest or least long; scores beyond it are compared as they
are within a block, and given as the largest or least long; a table without rows gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm import blocks

TOP, SCALE = 5, 256
QUERY_BLOCK, CANDIDATE_BLOCK, DIMENSION_BLOCK = 1024, 8192, 16
#: Tasks that walk through candidates, for each core of the cluster, at most.
TASKS_PER_CORE = 3
LONGEST = (1 << 63) - 1

FOUND = "query_id long, vec_id long, score long"


def search(query: np.ndarray, query_ids: np.ndarray, candidate: np.ndarray, ids: np.ndarray, k: int, step: int = DIMENSION_BLOCK, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its best k candidates, but for those below least, where that is given.

    Both matrices are (dimensions, vectors). least: a score for each query, -inf where nothing is known.
    """
    dims = len(query)
    q, c = blocks.both(query, candidate)
    kind = q.dtype
    cuts = list(range(0, dims, step)) or [0]
    # what is left of each length after each block of dimensions, rounded up
    left = lambda x: np.array([np.sqrt((x[i:].astype(np.float64) ** 2).sum(axis=0)) for i in [*cuts[1:], dims]]) * (1 + 1e-9)
    q_left, c_left = left(q), left(c)
    first = q[:step].T @ c[:step]
    floor = np.full(q.shape[1], -np.inf) if least is None else least
    known = np.isfinite(floor)
    floor = np.where(known, floor - 0.5 - 1e-9 * np.abs(np.where(known, floor, 0)), -np.inf)
    reach = (first + q_left[0][:, None] * c_left[0][None, :]).astype(np.float64) >= floor[:, None]
    out = []
    for i in range(q.shape[1]):
        alive = np.flatnonzero(reach[i] & (ids != query_ids[i]))
        total = first[i, alive]
        low = floor[i]
        if not known[i] and len(alive) > k:
            lead = np.argsort(-total)[:k] if kind == object else np.argpartition(-total, k - 1)[:k]
            bound = float((total[lead] + q[step:, i] @ c[step:, alive[lead]]).min())
            low = bound - 0.5 - 1e-9 * abs(bound)
        for b, lo in enumerate(cuts):
            if b:
                total = total + q[lo : lo + step, i] @ c[lo : lo + step, alive]
            keep = (total + q_left[b, i] * c_left[b, alive]).astype(np.float64) >= low
            alive, total = alive[keep], total[keep]
        if kind == object:
            best = np.array(sorted(range(len(alive)), key=lambda j: (-total[j], ids[alive[j]]))[:k], np.int64)
            out.append((ids[alive[best]], np.array([max(-LONGEST - 1, min(LONGEST, int(x))) for x in total[best]], np.int64)))
        else:
            best = np.lexsort((ids[alive], -total))[:k]
            out.append((ids[alive[best]], total[best].astype(np.int64)))
    return out


class Best:
    """A block of queries, and the best k candidates of each that a task has met."""

    def __init__(self, x: dict, k: int):
        self.query, self.ids, self.k = blocks.matrix(x, "q_"), np.array(x["q_ids"], np.int64), k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]
        self.least = np.full(len(self.ids), -np.inf)

    def meet(self, candidate: np.ndarray, ids: np.ndarray) -> None:
        dims = max(len(self.query), len(candidate))
        padded = [np.pad(x, ((0, dims - len(x)), (0, 0))) for x in (self.query, candidate)]
        for i, (new, scores) in enumerate(search(padded[0], self.ids, padded[1], ids, self.k, least=self.least)):
            if len(new):
                own, own_scores = self.found[i]
                new, scores = np.concatenate([own, new]), np.concatenate([own_scores, scores])
                first = np.lexsort((new, ~scores))[: self.k]  # ~x is -x - 1, for the least long, too
                self.found[i] = new[first], scores[first]
                # the least long stands for all scores below it, so it bounds nothing
                if len(first) == self.k and scores[first[-1]] > -LONGEST - 1:
                    self.least[i] = float(scores[first[-1]])

    def rows(self) -> pa.RecordBatch:
        ids, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*self.found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, [len(i) for i, _ in self.found])), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def _walk(k: int):
    def run(pairs: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Best] = {}
        for x in pairs:
            # a number may come in parts, which differ in their ids
            key = (x["q_block"], x["q_n"], x["q_ids"][0])
            if key not in known:
                known[key] = Best(x, k)
            known[key].meet(blocks.matrix(x), np.array(x["ids"], np.int64))
        for best in known.values():
            yield best.rows()

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """queries and candidates (vec_id, embedding) -> query_id, rank, vec_id, score."""

    def sound(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("vec_id").cast("long").alias("id"), blocks.whole(F.col("embedding"), scale).alias("v")).filter("id is not null and v is not null")

    asked = sound(queries).groupBy("id").agg(F.min("v").alias("v"))
    asking = blocks.pack(asked, QUERY_BLOCK).checkpoint()
    every = blocks.pack(sound(candidates), CANDIDATE_BLOCK).checkpoint()
    tasks = TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    found = blocks.against_all(asking, every.coalesce(tasks), _walk(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
