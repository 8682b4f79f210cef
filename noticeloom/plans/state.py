"""The job's tables as snapshots: a manifest names the files of every table, and it is written last.

``data/TABLE/ID`` holds versions of a table and ``manifests/NUMBER.json`` which of them make a snapshot. A table that a run doesn't
change keeps its files. A reader sees one snapshot to its end; a run that breaks leaves files that no manifest names. Two runs
at once can't both write the same manifest: the rename of the later one fails, and with it that run. A folder without
manifests holds the tables themselves, as snapshot 0.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from noticeloom import schemas


class State:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.number, self.paths, self.settled = 0, {}, []
        found = [n for n in self._names("manifests") if n.endswith(".json")]
        if found:
            held = json.loads(spark.read.text(f"{self.folder}/manifests/{max(found)}", wholetext=True).first()[0])
            self.number, self.paths, self.settled = int(max(found).split(".")[0]), held["tables"], held["settled"]

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, files = self._place(name)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def read(self, name: str, needed: bool = False) -> DataFrame:
        """A table of the snapshot; empty where the state is older than the table, unless it is ``needed``."""
        path = f"{self.folder}/{self.paths.get(name, name)}"
        try:
            return schemas.conformed(self.spark.read.parquet(path), name)
        except AnalysisException as e:
            if needed or e.getCondition() != "PATH_NOT_FOUND":
                raise
            return schemas.empty(self.spark, name)

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table's next version, which the next manifest names, and give it back as it was written."""
        path = f"data/{name}/{uuid.uuid4().hex}"
        schemas.conformed(rows, name).write.parquet(f"{self.folder}/{path}")
        self.paths = {**self.paths, name: path}
        return self.read(name)

    def commit(self, settled: list[str] = ()) -> None:
        """Make what was staged the snapshot. ``settled``: outboxes whose messages are recorded in it."""
        self.settled = [*self.settled, *settled]
        target, files = self._place(f"manifests/{self.number + 1:08d}.json")
        draft, _ = self._place(f"manifests/draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.writeBytes(json.dumps({"tables": self.paths, "settled": self.settled}))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise RuntimeError(f"another run has written snapshot {self.number + 1} meanwhile")
        self.number += 1

    def open_outboxes(self) -> list[str]:
        """Outboxes that a run filled and no snapshot has recorded: it broke in between."""
        return sorted(n for n in self._names("outbox") if n not in self.settled and self._names(f"outbox/{n}/entries"))
