"""Batch inference over recordings with models that the caller brings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.supervised import Child

Load = Callable[[], Any]
Transcribe = Callable[[Any, Any, dict, int], dict]
TranscribeMany = Callable[[Any, Any, list[dict], int], list[dict]]

#: Models of this worker process: the main one of each name, and the last one that belongs to a language.
_models: dict[str, Any] = {}


def model_of(name: str, load: Load) -> Any:
    """The worker's model of this name, loaded when it is first asked for."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def aligner_of(name: str, language: str, load: Callable[[str], Any]) -> Any:
    have = _models.get(f"{name}/aligner")
    if have is None or have[0] != language:
        _models.pop(f"{name}/aligner", None)  # the old one goes before the new one is loaded
        _models[f"{name}/aligner"] = have = (language, load(language))
    return have[1]


def _one(name: str, load: Load, load_aligner: Callable[[str], Any] | None, transcribe: Transcribe, row: dict, batch_size: int) -> dict:
    try:
        aligner = aligner_of(name, row["language"], load_aligner) if load_aligner else None
        given = transcribe(model_of(name, load), aligner, row, batch_size)
        if given is None:
            raise ValueError("no output")
        return {"status": "completed", "error": None} | given
    except Exception as e:  # noqa: BLE001  one recording must not end the others
        return {"status": "failed", "error": f"{type(e).__name__}: {e}"}


def work_on(rows: list[dict], name: str, load: Load, load_aligner: Callable[[str], Any] | None, transcribe: Transcribe, many: TranscribeMany | None, batch_size: int) -> list[dict]:
    """Outcomes of rows of one language. If they go to the model together and that fails, each goes by itself."""
    if many and len(rows) > 1:
        try:
            aligner = aligner_of(name, rows[0]["language"], load_aligner) if load_aligner else None
            given = many(model_of(name, load), aligner, rows, batch_size)
            if len(given) == len(rows) and all(x is not None for x in given):
                return [{"status": "completed", "error": None} | x for x in given]
        except Exception:  # noqa: BLE001, S110  the rows are tried one by one below, and their own errors kept
            pass
    return [_one(name, load, load_aligner, transcribe, row, batch_size) for row in rows]


def work_within(rows: list[dict], limit: float, load_limit: float, name: str, *how: Any) -> list[dict]:
    """work_on() in this worker's child process, with so many seconds for each recording. If rows that go together take too long, or end
    the child, each goes by itself; the one at fault fails, and the next one gets a new child."""

    def serve() -> Callable[[list[dict]], list[dict]]:
        model_of(name, how[0])
        return lambda asked: work_on(asked, name, *how)

    key = f"{name}/child"
    try:
        if key not in _models or not _models[key].alive:
            _models[key] = Child(serve, load_limit)
        return _models[key].ask(rows, limit * len(rows))
    except Exception as e:  # noqa: BLE001  as in work_on()
        if len(rows) > 1:
            return [x for row in rows for x in work_within([row], limit, load_limit, name, *how)]
        return [{"status": "failed", "error": f"{type(e).__name__}: {e}"}]


def map_recordings(
    recordings: DataFrame, load: Load, transcribe: Transcribe, schema: str,
    load_aligner: Callable[[str], Any] | None = None, batch_size: int = 4, name: str = "model", many: TranscribeMany | None = None,
    limit: float | None = None, load_limit: float = 600.0,
) -> DataFrame:
    """recordings(recording_id, language, ...) -> the fields of ``schema``, recording_id, status and error.

    ``load`` runs once per worker process, whatever number of tasks it works through; ``load_aligner`` when the language
    changes; rows come sorted by language, so that is seldom. Another ``load`` under the same name is another model.
    ``transcribe(model, aligner, row, batch_size)`` gives a dict of the schema's fields; batch_size is for the model's own use
    within a recording. ``many(model, aligner, rows, batch_size)`` gives one dict for each of up to batch_size rows of one
    language. An exception, or None, fails that recording alone. With ``limit``, seconds for a recording, models live in a child process of
    each worker, which may take load_limit seconds to load them: one that hangs or dies fails its recording alone as well. Large languages spread over partitions by a second key.
    """
    fields = [x.split()[0].strip("`") for x in schema.split(", ")]
    name = f"{name}/{hashlib.sha256(cloudpickle.dumps((load, load_aligner))).hexdigest()[:16]}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cadence.operators import inference as own  # the module of this worker, with its models, not a copy of them

        for frame in frames:
            out, rows = [], frame.to_dict("records")
            at = 0
            while at < len(rows):
                to = at + 1
                while many and to < len(rows) and to - at < batch_size and rows[to]["language"] == rows[at]["language"]:
                    to += 1
                how = (load, load_aligner, transcribe, many, batch_size)
                made = own.work_on(rows[at:to], name, *how) if limit is None else own.work_within(rows[at:to], limit, load_limit, name, *how)
                out += [{"recording_id": r["recording_id"]} | m for r, m in zip(rows[at:to], made, strict=True)]
                at = to
            yield pd.DataFrame(out, columns=["recording_id", *fields, "status", "error"])

    kind = recordings.schema["recording_id"].dataType.simpleString()
    parts = max(1, recordings.sparkSession.sparkContext.defaultParallelism)
    dealt = recordings.repartition(F.col("language"), F.pmod(F.xxhash64("recording_id"), F.lit(parts))).sortWithinPartitions("language", "recording_id")
    return dealt.mapInPandas(run, f"recording_id {kind}, {schema}, status string, error string")


def split_outcomes(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(completed, failed)."""
    return done.filter("status = 'completed'").drop("error"), done.filter("status = 'failed'").select("recording_id", "status", "error")
