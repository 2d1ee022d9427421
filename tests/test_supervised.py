"""Models in child processes: hangs, deaths and exceptions fail one recording."""

import os
import time

import pytest

from cadence.operators import inference
from cadence.operators.supervised import Child


def test_answers_errors_hangs_and_deaths():
    def serve():
        def answer(x):
            print("noise")
            if x == "sleep":
                time.sleep(60)
            if x == "die":
                os._exit(7)
            if x == "fail":
                raise KeyError("x")
            return x * 2

        return answer

    c = Child(serve, 60)
    assert c.ask(4, 30) == 8 and c.ask("y" * 3_000_000, 30) == "y" * 6_000_000
    with pytest.raises(KeyError):
        c.ask("fail", 30)
    assert c.ask(1, 30) == 2  # it lives on
    with pytest.raises(TimeoutError, match=r"no answer within 0.5 s"):
        c.ask("sleep", 0.5)
    assert not c.alive
    with pytest.raises(ChildProcessError, match="code 7"):
        Child(serve, 60).ask("die", 30)

    def broken():
        raise OSError("no weights")

    with pytest.raises(OSError, match="no weights"):
        Child(broken, 60)


def test_one_bad_recording_fails_alone(spark):
    def transcribe(model, aligner, row, batch_size):
        if row["text"] == "hang":
            time.sleep(60)
        if row["text"] == "die":
            os._exit(9)
        return {"n": model(row["text"])}

    texts = ["a", "hang", "bb", "die", "ccc", "d"]
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "recording_id long, language string, text string").coalesce(1)
    many = lambda m, a, rs, n: [transcribe(m, a, r, n) for r in rs]
    for together in (None, many):
        out = {r.recording_id: (r.n, r.status, r.error) for r in inference.map_recordings(rows, lambda: len, transcribe, "n long", limit=2.0, many=together).collect()}
        good = {i: (len(t), "completed", None) for i, t in enumerate(texts) if t not in ("hang", "die")}
        assert out == good | {1: (None, "failed", "TimeoutError: no answer within 2 s"), 3: (None, "failed", "ChildProcessError: the model's process ended with code 9")}


def test_a_new_child_starts_without_imports():
    """Forty deaths, each followed by a new child: less than it takes to start Python and import what a child needs so often."""

    def serve():
        return lambda x: os._exit(x)

    with pytest.raises(ChildProcessError, match="code 3"):
        Child(serve, 60).ask(3, 30)
    start = time.monotonic()
    for _ in range(40):
        with pytest.raises(ChildProcessError, match="code 4"):
            Child(serve, 60).ask(4, 30)
    assert time.monotonic() - start < 8
