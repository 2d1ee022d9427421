"""A stated set of query vectors against all vectors: both in blocks, the queries' blocks broadcast in passes of a bounded size.

A block holds its vectors dimension by dimension. The candidates' blocks stay where they are: each pass brings some blocks of queries, of
PASS_BYTES together, to every task, and the task walks through its candidates with them. So what is known of a query
after one block, such as its k-th best score, bounds the work in the next, and only the best rows of each query
in a task are exchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, and bytes of its numbers; bytes of query blocks that are broadcast at once.
QUERY_ROWS, CANDIDATE_ROWS, BLOCK_BYTES, PASS_BYTES = 1024, 2048, 1 << 20, 1 << 23

BLOCK = "block long, n int, dims int, columns binary"


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null if there is any null or non-finite one."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def pack(rows: DataFrame, most_rows: int, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """rows(id, v: array of long, ...) -> block, n, dims, columns, and what is kept of the rows as arrays.

    Blocks are numbered 0, 1, ... by a hash of the ids; a number may come in more than one part, or not at all.
    """
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // max(1, min(most_rows, BLOCK_BYTES // (4 * max(1, dims))))))
    kinds = [rows.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([BLOCK, *(f"`{c}s` array<{k}>" for c, k in zip(keep, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column("block").to_numpy()
            vectors = b.column("v")
            at = vectors.offsets.to_numpy()
            flat, size = vectors.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at)
            matrix = np.zeros((len(block), int(size.max(initial=0))), np.int64)
            matrix[np.repeat(np.arange(len(block)), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
            small = len(flat) == 0 or (flat.min() >= -(1 << 31) and flat.max() < 1 << 31)
            for k in np.unique(block):
                own = np.flatnonzero(block == k)
                columns = np.ascontiguousarray(matrix[own].T, np.int32 if small else np.int64).tobytes()
                kept = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), b.column(c).take(pa.array(own))) for c in keep]
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([matrix.shape[1]], pa.int32()), pa.array([columns], pa.binary()), *kept], names=["block", "n", "dims", "columns", *(f"{c}s" for c in keep)])

    # a block's rows stand together after the exchange
    dealt = rows.select("v", *keep, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("block")).repartition(blocks, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, schema)


def matrix(block: dict, prefix: str = "") -> np.ndarray:
    """The (dimensions, vectors) of a block."""
    n, dims, raw = block[f"{prefix}n"], block[f"{prefix}dims"], block[f"{prefix}columns"]
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dims else np.int64).reshape(dims, n)


def both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices with as many dimensions, in a kind of number in which sums of products are exact."""
    dims = max(len(a), len(b))
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(dims, 1)
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    out = []
    for x in (a, b):
        y = np.zeros((dims, x.shape[1]), kind)
        y[: len(x)] = x.astype(np.int64).astype(object) if kind is object else x
        out.append(y)
    return out[0], out[1]


def against_all(queries: DataFrame, candidates: DataFrame, walk: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """walk gets, in each task, one dict after another: a candidates' block, and under q_<name> a queries' block. Both frames are checkpointed packs."""
    spark = queries.sparkSession
    last, largest = queries.agg(F.coalesce(F.max("block"), F.lit(-1)), F.coalesce(F.max(F.octet_length("columns")), F.lit(1))).first()
    step = max(1, PASS_BYTES // max(1, largest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from walk(x for b in batches for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist())

    def one(lo: int) -> DataFrame:
        q = queries.filter((F.col("block") >= lo) & (F.col("block") < lo + step)).select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
        numbers = F.sequence(F.lit(lo).cast("long"), F.lit(max(lo, min(last, lo + step - 1))).cast("long"))
        dealt = candidates.withColumn("_for", F.explode(numbers))
        return dealt.join(F.broadcast(q), F.col("_for") == F.col("q_block")).drop("_for").mapInArrow(run, schema)

    if last < step:
        return one(0)
    folder = f"{spark.sparkContext.getCheckpointDir()}/passes-{uuid.uuid4().hex}"
    for lo in range(0, last + 1, step):
        one(lo).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
