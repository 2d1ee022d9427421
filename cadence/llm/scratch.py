"""Checkpoints and exchanges that are done with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

DROP_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def forget(*frames: DataFrame) -> None:
    """Deletes the files of frames that checkpoint() gave. Nothing that is still to be computed may come from them: what does has to be
    checkpointed itself before, so that lost executors can't ask for them again."""
    for frame in frames:
        file = frame._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a function of a frame that works in many steps, each of which ends in a checkpoint or a number: Spark drops a step's exchanges
    from the executors' disks when the step ends, and not when the driver happens to collect its garbage. The frame that is
    returned is a new one, under the session's own setting: it may be run more than once."""

    @wraps(make)
    def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
        conf = rows.sparkSession.conf
        before = conf.get(DROP_EXCHANGES)
        conf.set(DROP_EXCHANGES, "true")
        try:
            out = make(rows, *args, **kwargs)
        finally:
            conf.set(DROP_EXCHANGES, before)
        return out.select("*")

    return run
