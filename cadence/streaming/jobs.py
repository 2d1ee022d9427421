"""Job events and requests as streams; each gives the same rows as its batch form over the same events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators import state as S
from cadence.streaming import lifecycle
from cadence.streaming.ledger import Ledger, not_done


def fold_progress(events: DataFrame, job: str = "job_id") -> DataFrame:
    """The running state of each job: use output mode update or complete. One row of state per job."""
    return S.fold_progress(events, job)


def lifecycle_updates(events: DataFrame, job: str = "job_id") -> DataFrame:
    """The lifecycle of each job in complete or update mode, whatever order the events come in: the state is three
    events and two counts per job, however many events it has."""
    return S.lifecycle(events, job)


def lives_to_table(events: DataFrame, path: str, checkpoint: str, silence: float, forget: float, delay: float, job: str = "job_id") -> DataFrame:
    """The state of each job by lifecycle.lives(), as far as the watermark has come, as a table. The state is kept in RocksDB."""
    conf, (name, provider) = events.sparkSession.conf, lifecycle.PROVIDER
    before = conf.get(name)
    conf.set(name, provider)
    try:
        return run_to_table(lifecycle.lives(events, silence, forget, delay, job), path, checkpoint, job, "version")
    finally:
        conf.set(name, before)


def admit_jobs(requests: DataFrame) -> DataFrame:
    """Stateless: accepted and rejected requests, each with its id or reason."""
    return S.admit(requests)


def process_incrementally(
    items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], state_path: str, checkpoint: str, stop_on_error: bool = False,
    outputs: Callable[[], DataFrame] | None = None,
) -> None:
    """Runs ``work`` (a batch of items -> key, status, ...) over all items of the stream that aren't done yet, then ends.

    The state is what is done by key, not by batch: each run of a batch adds a folder of its own and none is overwritten, so
    neither a crash nor a new stream checkpoint loses or repeats finished work. Items that failed are tried
    again when they come again. ``outputs`` gives the keys whose results exist: completed items without one are worked on again.
    A ledger merges the keys that are done, so that each batch reads a bounded number of folders. One stream writes to a state at a time.
    """
    ledger = Ledger(items.sparkSession, state_path, key)

    def one(batch: DataFrame, number: int) -> None:
        fresh, done = batch.dropDuplicates([key]), ledger.done()
        if done is not None and outputs:
            done = done.join(outputs().select(key).distinct(), key, "left_semi")
        folder = ledger.new_folder(number)
        work(not_done(fresh, done, key)).write.parquet(folder)
        ledger.add(folder)
        if stop_on_error and batch.sparkSession.read.parquet(folder).filter("status = 'failed'").limit(1).count():
            raise RuntimeError(f"a job of batch {number} failed")

    items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(rows: DataFrame, path: str, checkpoint: str, key: str | None = None, newest: str | None = None) -> DataFrame:
    """All that is there now, through a stream, as a table in the folder: of each key what the last batch says of it, or, without a
    key (rows that have no state), all rows. newest: a column that grows from row to row of a key in one batch. A batch that
    runs again replaces what it wrote."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.outputMode("update" if key else "append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = rows.sparkSession.read.parquet(path)
    if key:
        out = out.withColumn("_last", F.row_number().over(Window.partitionBy(key).orderBy(F.col("batch").desc(), *([F.col(newest).desc()] if newest else [])))).filter("_last = 1")
    return out.select(*rows.columns)


def run_to_memory(rows: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, folded by a stream into an in-memory table: for tests."""
    query = rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
