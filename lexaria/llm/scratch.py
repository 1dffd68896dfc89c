"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and
the session is local (tests, a notebook on one machine) a temporary folder takes
its place, and on a cluster that is an error.  Tables are written by Spark and read
again by Spark, so a lost executor costs no more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lexaria-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)

    def table(self, df: DataFrame, codec: str = "zstd", by: list[str] | None = None) -> DataFrame:
        """Write df, in a folder for each value of by if there is one, and return what was written."""
        self._made += 1
        path = f"{self.folder}/{self._made:03d}"
        df.write.option("compression", codec).partitionBy(*by or []).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path), True)  # type: ignore[attr-defined]


def least_count(rows: DataFrame, count: str, most: int, floor: int = 1) -> int:
    """The least count, floor or more, that at most so many rows reach; from a histogram of counts, so no row is sorted."""
    of = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("long")
    classes = rows.filter(F.col(count) >= floor).groupBy(of.alias("k")).agg(F.min(count).alias("least"), F.count("*").alias("n")).orderBy(F.desc("k")).collect()
    held, least = 0, (1 << 63) - 1
    for c in classes:  # a thousand at most
        held += c.n
        if held > most:
            break
        least = c.least
    return least


#: Bytes up to which a table is broadcast; a long takes 8, and a row some 24 on top.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """A broadcast hint only where the counted rows take few bytes; else Spark's own choice of join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
