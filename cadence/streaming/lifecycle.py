"""Jobs as a stateful stream operator with timers: a job that stays silent while it is under way is interrupted, and one that has ended is
forgotten after a while.

Events wait in the job's state until the watermark has passed them, and are then taken in the order of (ts, seq). So what
comes out doesn't depend on the batches in which events come, as long as none is later than the watermark's delay. A job's state is a few
values, and the events of the last ``delay``. A timer stands for the next thing that can happen without an event: a waiting event
becomes due, the job has been silent for too long, or it may be forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Events that came together are one entry of the state, a JSON array of [at, seq, kind, stage]: each entry costs more than what it holds.
EVENTS = "events string"
LIFE = "status string, stage string, attempts long, error string, n_events long, interruptions long, seen_us long, timer_ms long, version long"
OUTPUT = "status string, stage string, attempts long, error string, n_events long, interruptions long, seen_us long, version long"
FRESH = ("queued", "waiting", 0, None, 0, 0, 0, -1, 0)


class Lives(StatefulProcessor):
    """silence, forget: microseconds of the events' own time."""

    def __init__(self, key: str, silence: int, forget: int):
        self.key, self.silence, self.forget = key, silence, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life, self.waiting = handle.getValueState("life", LIFE), handle.getListState("waiting", EVENTS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.waiting.appendValue((json.dumps([(r.at_us, r.seq, r.kind, r.stage) for r in rows]),))
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: Any, watermark: int) -> Iterator[Row]:
        """Takes all that is due at the watermark, and sets the timer anew."""
        now = watermark * 1000
        before = tuple(self.life.get()) if self.life.exists() else FRESH
        life, events = dict(zip([x.split()[0] for x in LIFE.split(", ")], before, strict=True)), sorted((tuple(e) for part in self.waiting.get() for e in json.loads(part[0])), key=lambda e: (e[0], e[1])) if self.waiting.exists() else []
        due = [e for e in events if e[0] <= now]
        for at, _, kind, stage in due:
            self._until(life, at - 1)
            if self._forgotten(life, at - 1):
                life = dict(zip(life, (*FRESH[:-2], life["timer_ms"], life["version"]), strict=True))
            self._event(life, at, kind, stage)
        self._until(life, now)
        if due:
            rest = events[len(due) :]
            self.waiting.put([(json.dumps(rest),)]) if rest else self.waiting.clear()
            events = rest
        gone = self._forgotten(life, now) and not events
        changed = tuple(life.values())[:7] != before[:7]
        if changed:
            life["version"] += 1
        ahead = [e[0] for e in events[:1]]
        if life["n_events"]:
            ahead.append(life["seen_us"] + (self.silence if life["status"] == "processing" else self.forget))
        timer = -1 if gone or not ahead else -(-min(ahead) // 1000)
        if timer != life["timer_ms"]:
            if life["timer_ms"] > watermark:
                self.handle.deleteTimer(life["timer_ms"])
            if timer >= 0:
                self.handle.registerTimer(timer)
            life["timer_ms"] = timer
        if gone:
            self.life.clear()
        else:
            self.life.update(tuple(life.values()))
        if changed:
            own = dict(life)
            own.pop("timer_ms")
            yield Row(**{self.key: key[0]}, **own)

    def _forgotten(self, life: dict, now: int) -> bool:
        return bool(life["n_events"]) and life["status"] != "processing" and life["seen_us"] + self.forget <= now

    def _until(self, life: dict, now: int) -> None:
        if life["status"] == "processing" and life["seen_us"] + self.silence <= now:
            life |= {"status": "interrupted", "interruptions": life["interruptions"] + 1}

    def _event(self, life: dict, at: int, kind: str, stage: str) -> None:
        life |= {"n_events": life["n_events"] + 1, "seen_us": at}
        if kind == "started":
            life |= {"status": "processing", "stage": "initializing", "attempts": life["attempts"] + 1, "error": None}
        elif kind == "completed":
            life |= {"status": "completed", "stage": "finished", "error": None}
        elif kind == "failed":
            life |= {"status": "failed", "stage": stage, "error": None if stage is None else f"failed in {stage}"}
        elif kind != "progress":
            life |= {"status": "queued", "stage": "waiting"}
        elif life["status"] == "processing":
            life["stage"] = stage


def lives(events: DataFrame, silence: float, forget: float, delay: float, job: str = "job_id") -> DataFrame:
    """events(job_id, seq, ts, kind, stage) as a stream -> job_id, status, stage, attempts, error, n_events, interruptions, seen_us, version, in update mode.

    silence: seconds after which a job that is under way and says nothing is interrupted; its next start is a new attempt. forget: seconds after which
    the state of a job that isn't under way goes. delay: seconds that an event may come late. ts without a time zone is taken as it stands, as UTC.
    The highest version of a job counts; version goes on counting while the state is kept.
    """
    zone_free = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = events.select(F.col(job), F.col("seq").cast("long").alias("seq"), "kind", "stage", zone_free.alias("at_us"))
    e = e.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", f"{int(delay * 1000)} milliseconds")
    kind = e.schema[job].dataType.simpleString()
    return e.groupBy(job).transformWithState(Lives(job, int(silence * 1_000_000), int(forget * 1_000_000)), f"`{job}` {kind}, {OUTPUT}", "update", "EventTime")
