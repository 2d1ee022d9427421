"""Texts are exchanged once, and what is derived from them stays where it is."""

import contextlib
import io
import re

import pytest

from cadence.plans import queries as plans


def exchanges(df):
    """Every exchange of a plan, but for those that deal out the given texts."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return [line for line in out.getvalue().splitlines() if re.search(r"\bExchange\b", line) and "REPARTITION_BY_NUM" not in line]


@pytest.mark.parametrize("name", ["word_features", "word_info_text", "syllable_features", "voiced_in_spans", "payload_counts_both"])
def test_words_and_frames_are_not_exchanged(spark, sf, name):
    assert not exchanges(plans.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["compare_labels", "compare_labels_once"])
def test_compared_features_take_a_few_bytes_a_word(spark, sf, name, tmp_path):
    """The checkpoint folder holds fewer bytes after a comparison than twelve a word."""
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before, words = size(), plans.QUERIES["word_features"](spark, sf).count()
    plans.QUERIES[name](spark, sf).collect()
    assert 0 < size() - before < 12 * words


def test_events_that_come_together_are_one_state_entry():
    """A job's waiting events cost one entry for each batch they came in, and are taken in order whatever their batches were."""
    from types import SimpleNamespace

    from cadence.streaming.lifecycle import Lives

    class Held(list):
        appendValue, get = list.append, lambda self: iter(self)  # noqa: RUF012
        exists, put = lambda self: bool(self), lambda self, values: self.__setitem__(slice(None), values)

    class One:
        value = None
        exists, get = lambda self: self.value is not None, lambda self: self.value

        def update(self, value):
            self.value = value

    job = Lives("job_id", 10_000_000, 1_000_000_000)
    job.waiting, job.life = Held(), One()
    job.handle = SimpleNamespace(registerTimer=lambda at: None, deleteTimer=lambda at: None)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    event = lambda s, kind: SimpleNamespace(at_us=s * 1_000_000, seq=s, kind=kind, stage="x")
    list(job.handleInputRows((1,), iter([event(3, "completed"), event(1, "queued"), event(9, "started")]), at(0)))
    list(job.handleInputRows((1,), iter([event(2, "started")]), at(0)))
    assert len(job.waiting) == 2
    (out,) = job.handleExpiredTimer((1,), at(5_000), None)
    assert (out.status, out.attempts, out.n_events) == ("completed", 1, 3) and len(job.waiting) == 1


@pytest.mark.parametrize("name", ["result_files", "result_arrays"])
def test_documents_lie_compressed(spark, sf, name):
    """Documents that a query writes to read them again take less than a hundred bytes a word."""
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before, words = size(), plans.QUERIES["syllabify"](spark, sf).count()
    plans.QUERIES[name](spark, sf)
    assert 0 < size() - before < 100 * words


def test_both_features_are_not_exchanged(spark, sf):
    from cadence.operators import features
    from cadence.plans.fixtures import Inputs

    i = Inputs(spark, sf)
    assert not any(exchanges(x) for x in features.both_features(i.words(), i.frames()))


def test_only_lines_are_exchanged(spark, sf):
    """Lines leave the layout as rows and are exchanged once: to be looked up, to where the texts of their recordings lie."""
    assert len(exchanges(plans.QUERIES["caption_times"](spark, sf))) == 1
    assert not exchanges(plans.QUERIES["syllables_in_lines"](spark, sf))


@pytest.mark.parametrize("name", ["caption_events", "caption_file"])
def test_caption_events_stay_where_the_texts_lie(spark, sf, name):
    """Lines go to where the texts of their recordings lie; words, syllables and events are not exchanged by a plan of their own."""
    assert not exchanges(plans.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["result_files", "result_arrays"])
def test_documents_are_parsed_once(spark, sf, name, monkeypatch):
    """What is read back comes from one table of both kinds, not from two that each parse every document."""
    from cadence.sources import results

    monkeypatch.setattr(results, "read_results", None)
    assert plans.QUERIES[name](spark, sf).count() > 0
