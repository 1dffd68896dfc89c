"""Tables between the rounds of a job, in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; where that is unset a local
session takes a temporary folder, and a cluster is an error.  A table that was written cuts
the lineage: an executor that is lost costs its running tasks, not earlier rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession) -> str:
    """The shared folder of a session."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="lexaria-rounds-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Rounds:
    """Tables of one job, deleted when the session ends, or as soon as they are dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{folder_of(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._jvm_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._jvm_path(self.root))
        self._where: dict[int, str] = {}

    def written(self, rows: DataFrame) -> DataFrame:
        """The rows, written and read again."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        rows.write.parquet(path)
        back = self.spark.read.schema(rows.schema).parquet(path)
        self._where[id(back)] = path
        return back

    def drop(self, rows: DataFrame) -> None:
        """Deletes a table of this job that nothing will read again."""
        self._files.delete(self._jvm_path(self._where.pop(id(rows))), True)
