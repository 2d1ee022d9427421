"""Which keys are done, kept so that a new batch reads a bounded number of folders, however many batches there were.

Each batch writes its results into a folder of its own. The ledger lists the folders that count, as a versioned snapshot: a folder of
results at level 0, and at the levels above folders of keys only, merged from FAN folders of the level below. So n batches are read from
fewer than FAN folders for each power of FAN in n, and each key is rewritten once a level.

A batch's results count from the moment its folder is complete: should the process end before the ledger's next version is written, the next
one finds the folder by its number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.sources import files, snapshots

#: Folders of a level that are merged into one of the next.
FAN = 8
#: Versions of the ledger that stay, with all folders of keys that they name, for readers that are under way.
KEEP = 3
SCHEMA = "folder string, level int, upto long"


class Ledger:
    """results: the folder of all results, one run=<number>-<id>/batch=<batch> for each batch; the ledger lies beside it."""

    def __init__(self, spark: SparkSession, results: str, key: str):
        self.spark, self.results, self.key, self.path = spark, results, key, f"{results.rstrip('/')}_ledger"
        self.entries = self.read()
        self.recover()

    def read(self, version: int | None = None) -> list[tuple[str, int, int]]:
        """(folder, level, last number in it): fewer than FAN a level."""
        index = snapshots.read_state(self.spark, f"{self.path}/index", version)
        return [tuple(r) for r in index.collect()] if index is not None else []

    def next_number(self) -> int:
        return max((upto for _, _, upto in self.entries), default=-1) + 1

    def new_folder(self, batch: int) -> str:
        return f"{self.results}/run={self.next_number():09d}-{uuid.uuid4().hex}/batch={batch}"

    def recover(self) -> None:
        """Takes in complete results that no version names yet. Lists the results once, when a stream starts."""
        after = self.next_number()
        for run in files.names(self.spark, self.results):
            number = run.removeprefix("run=").split("-")[0]
            if run.startswith("run=") and number.isdigit() and int(number) >= after:
                for batch in files.names(self.spark, f"{self.results}/{run}"):
                    folder = f"{self.results}/{run}/{batch}"
                    if files.exists(self.spark, f"{folder}/_SUCCESS"):
                        self.add(folder)

    def done(self) -> DataFrame | None:
        """The keys that any batch completed; None before the first one."""
        return self._keys(self.entries)

    def _keys(self, entries: list[tuple[str, int, int]]) -> DataFrame | None:
        fresh, merged = [f for f, level, _ in entries if not level], [f for f, level, _ in entries if level]
        parts = []
        if fresh:
            parts.append(self.spark.read.parquet(*fresh).filter("status = 'completed'").select(self.key))
        if merged:
            parts.append(self.spark.read.parquet(*merged).select(self.key))
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None

    def add(self, folder: str) -> None:
        """A complete folder of results counts from now on; full levels are merged."""
        entries = list(self.entries)
        number = max([int(folder.rsplit("run=", 1)[1].split("-")[0]), *(upto for _, _, upto in entries)])
        entries.append((folder, 0, number))
        level = 0
        while len(full := [e for e in entries if e[1] == level]) >= FAN:
            merged = f"{self.path}/keys/{uuid.uuid4().hex}"
            self._keys(full).distinct().write.parquet(merged)
            entries = [e for e in entries if e[1] != level] + [(merged, level + 1, max(e[2] for e in full))]
            level += 1
        index = f"{self.path}/index"
        snapshots.write_state(self.spark.createDataFrame(entries, SCHEMA).coalesce(1), index, KEEP)
        self.entries = entries
        if level:
            named = {f.rsplit("/", 1)[1] for v in snapshots.versions(self.spark, index) for f, at, _ in self.read(v) if at}
            for old in set(files.names(self.spark, f"{self.path}/keys")) - named:
                files.delete(self.spark, f"{self.path}/keys/{old}")


def not_done(batch: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows of the batch whose key isn't done. Only done keys that the batch asks for are compared, so a small batch is all that is sent round."""
    if done is None:
        return batch
    asked = done.join(batch.select(F.col(key).alias("_asked")), F.col(key) == F.col("_asked"), "left_semi").distinct()
    return batch.join(asked, key, "left_anti")
