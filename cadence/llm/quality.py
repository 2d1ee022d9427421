"""Quality classifier: a sparse ensemble of rules over statistics of the whole text.

1. ``statistics`` makes one row of numbers for every document.
2. ``fit`` grows shallow boosted trees on a bounded sample of labelled rows, takes each
   path from a root as a conjunctive rule, and weighs the rules by lasso logistic regression.
3. ``score`` compiles the rules of non-zero weight into one Spark column expression.

Cases: null or empty text has all statistics 0 and gets a score like any other; a null
or repeated doc_id is scored row by row; labels that are null, or of unknown documents,
teach nothing; without labels of both kinds the score is the share of label 1, or 0.5
without any; of rows that share a labelled doc_id the least text teaches; a table without rows gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import words as W

#: At most so many labelled rows are learnt from: the first in the order of a hash of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, SHRINK, PENALTY = 40, 3, 0.3, 2e-3
THRESHOLD = 0.3

STATISTICS = (
    "n_words", "n_lines", "word_bytes", "line_words", "upper", "digit", "mark", "bar", "space", "wide",
    "distinct_words", "distinct_lines", "repeats", "bare_words", "capital_words", "mark_words", "top_word",
)

_CLASSES = np.zeros((256, 6), bool)
_CLASSES[ord("A") : ord("Z") + 1, 0] = True
_CLASSES[ord("0") : ord("9") + 1, 1] = True
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,|"], 2] = True
_CLASSES[ord("|"), 3] = True
_CLASSES[[32, 9, 10, 11, 12, 13], 4] = True
_CLASSES[128:, 5] = True
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(256) if c >= 128 or chr(c).isalpha()]] = True


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each owner, and how often the most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])]))
    times, top = np.diff(np.append(new, len(v))), np.zeros(n, np.int64)
    np.maximum.at(top, o[new], times)
    return np.bincount(o[new], minlength=n), top


def _numbers(texts: pa.Array) -> np.ndarray:
    data, at = W.utf8(texts)
    n, w = len(at) - 1, W.words(data, at)
    size, count, owner = np.diff(at), w.count, w.owner()
    per = lambda x: np.bincount(owner, weights=x, minlength=n)
    sums = []
    for k in range(_CLASSES.shape[1]):
        total = np.concatenate([[0], np.cumsum(_CLASSES[:, k][data])])
        sums.append(np.diff(total[at]))
    h = W.word_hash(w)
    distinct, top = _distinct(owner, h, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    marks = np.concatenate([[0], np.cumsum(_CLASSES[:, 2][data])])
    upper = np.concatenate([[0], np.cumsum(_CLASSES[:, 0][data])])
    within = lambda total: total[w.ends] - total[w.starts]
    # lines: the spans between line feeds, each text's last one included
    feed = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([at[:-1][size > 0], feed + 1]))
    line_owner = np.searchsorted(at, line_starts, "right") - 1
    inside = (line_starts < len(data)) & ~np.isin(line_starts, at[:-1][size == 0])
    line_starts, line_owner = line_starts[inside], line_owner[inside]
    keep = np.concatenate([[True], line_starts[1:] != line_starts[:-1]]) if len(line_starts) else np.zeros(0, bool)
    line_starts, line_owner = line_starts[keep], line_owner[keep]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), at[line_owner + 1]) if len(line_starts) else line_starts
    line_ends = line_ends - ((line_ends > line_starts) & (data[np.maximum(line_ends, 1) - 1] == 10)) if len(line_starts) else line_ends
    lines, _ = _distinct(line_owner, W.spans_hash(data, line_starts, line_ends), n)
    n_lines = np.bincount(line_owner, minlength=n)
    by = lambda x, y: np.divide(x, y, out=np.zeros(n), where=y > 0)
    return np.column_stack([
        count, n_lines, by(per(w.ends - w.starts), count), by(count, n_lines), *(by(x, size) for x in sums),
        by(distinct, count), by(lines, n_lines), by(per(same), count), by(per(within(letters) == 0), count),
        by(per(within(upper) > 1), count), by(per(within(marks) > 0), count), by(top, count),
    ]).astype(np.float64)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, ...) -> the kept columns and one double per name of STATISTICS, as statistic_<name>."""
    chosen = docs.select(*(c for c in keep if c != "text"), "text")
    made = [f"statistic_{x}" for x in STATISTICS]
    schema = StructType([*(StructField(c, chosen.schema[c].dataType) for c in keep), *(StructField(x, DoubleType()) for x in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.slices(batch):
                x = _numbers(b.column("text"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=[*keep, *made])

    return chosen.mapInArrow(run, schema)


class Rule(NamedTuple):
    """All conditions hold: (statistic, True if it must exceed the bound, bound)."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float


class Model(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]


def _grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple) -> tuple[list[tuple], list[tuple[np.ndarray, float]]]:
    """Paths to every node below this one, and the leaves as (rows, step)."""
    leaf = (rows, float(g[rows].sum() / (h[rows].sum() + 1.0)))
    if not depth or len(rows) < 40:
        return [], [leaf]
    best, total_g, total_h = (1e-6, None, None), g[rows].sum(), h[rows].sum()
    for j, e in enumerate(edges):
        if not len(e):
            continue
        k = binned[rows, j]
        gs, hs = (np.cumsum(np.bincount(k, weights=v[rows], minlength=len(e) + 1))[:-1] for v in (g, h))
        c = np.cumsum(np.bincount(k, minlength=len(e) + 1))[:-1]
        gain = gs**2 / (hs + 1.0) + (total_g - gs) ** 2 / (total_h - hs + 1.0) - total_g**2 / (total_h + 1.0)
        gain[(c < 10) | (len(rows) - c < 10)] = 0
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), j, i)
    _, j, i = best
    if j is None:
        return [], [leaf]
    paths, leaves = [], []
    for above in (False, True):
        own = (*path, (j, above, float(edges[j][i])))
        side = rows[(binned[rows, j] > i) == above]
        below, ends = _grow(x, edges, binned, g, h, side, depth - 1, own)
        paths += [own, *below]
        leaves += ends
    return paths, leaves


def _lasso(rules: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an absolute-value penalty, by accelerated proximal steps; the intercept is free."""
    z = np.column_stack([np.ones(len(y)), rules]).astype(np.float64)
    n = len(y)
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (z.T @ (z @ v)))
    w = u = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ u, -30, 30)))
        new = u - step * (z.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        u = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit_rows(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), ())
    edges = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64)))[:] for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    raw, paths = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        own, leaves = _grow(x, edges, binned, y - p, p * (1 - p), np.arange(len(y)), depth, ())
        for rows, step in leaves:
            raw[rows] += SHRINK * step
        paths += own
    rules: dict[tuple, np.ndarray] = {}
    seen = set()
    for path in paths:
        path = tuple(sorted(set(path)))
        holds = np.ones(len(y), bool)
        for j, above, bound in path:
            holds &= (x[:, j] > bound) == above
        key = holds.tobytes()
        if path not in rules and key not in seen and 0 < holds.sum() < len(y):
            rules[path] = holds
            seen |= {key, (~holds).tobytes()}
    if not rules:
        return Model(float(np.log(share / (1 - share))), ())
    intercept, weights = _lasso(np.column_stack([*rules.values()]), y, penalty)
    kept = [Rule(tuple((STATISTICS[j], a, b) for j, a, b in path), float(w)) for path, w in zip(rules, weights, strict=True) if abs(w) > 1e-9]
    return Model(intercept, tuple(kept))


def learnable(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample of the labelled rows that aren't held out."""
    return (
        labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("label_id"), "quality")
        .orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(sample_rows)
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The sample, of sample_rows at most, goes to every executor and its statistics to the driver; docs stay where they are.

    Of rows with one doc_id the least text is learnt from, and a label that repeats counts once: so the driver gets sample_rows rows at most.
    """
    texts = docs.select(F.col("doc_id").alias("its_id"), F.coalesce("text", F.lit("")).alias("its_text"))
    taught = texts.join(F.broadcast(learnable(labels, sample_rows)), F.col("its_id") == F.col("label_id"))
    taught = taught.groupBy(F.col("label_id").alias("doc_id"), "quality").agg(F.min("its_text").alias("text"))
    rows = statistics(taught, ("doc_id", "quality")).toPandas().sort_values(["doc_id", "quality"], kind="stable")
    return fit_rows(rows[[f"statistic_{x}" for x in STATISTICS]].to_numpy(np.float64), rows["quality"].to_numpy(np.float64))


def expression(model: Model) -> Column:
    total = F.lit(model.intercept)
    for rule in model.rules:
        holds = None
        for name, above, bound in rule.conditions:
            value = F.col(f"statistic_{name}")
            one = value > bound if above else value <= bound
            holds = one if holds is None else holds & one
        total = total + F.when(holds, F.lit(rule.weight)).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-total))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs and score."""
    return statistics(docs, keep).select(*keep, expression(model).alias("score"))
