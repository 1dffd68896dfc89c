"""Locks in a shared folder: one owner at a time for each shard, taken over when it is lost, and unlocks that happen once.

A lock is a row of files ``name.1``, ``name.2``, ...: each is made by an exclusive
create, which one of several sessions wins, and says until when it holds.  The file with the
largest number is the lock in force; when it has expired or was given back, the next
number may be made.  What an owner writes carries its number, and a shard is
committed by one more exclusive create that names the number, so an owner that was taken
for lost and comes back late changes nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """Small files of a folder that all sessions see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = self.path(folder)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.files.getUri().getScheme() == "file"
        self.files.mkdirs(self.root)

    def create(self, name: str, content: str) -> bool:
        """Makes a file; false if it is there."""
        at = self.path(self.root, name)
        if self.local:  # Hadoop's local create looks first and writes then
            try:
                with open(at.toUri().getPath(), "x") as f:
                    f.write(content)
                return True
            except FileExistsError:
                return False
        try:
            out = self.files.create(at, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or self.files.exists(at):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def read(self, name: str) -> tuple[str, float]:
        """Content and time of the last change."""
        at = self.path(self.root, name)
        changed = self.files.getFileStatus(at).getModificationTime() / 1000
        stream = self.files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode(), changed
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self.root)]


class Locks:
    """Locks of one owner."""

    def __init__(self, spark: SparkSession, folder: str, owner: str, seconds: float, clock: Callable[[], float] = time.time):
        self.folder, self.owner, self.seconds, self.clock = Folder(spark, folder), owner, seconds, clock

    def _numbers(self, name: str) -> list[int]:
        found = (n.rsplit(".", 1) for n in self.folder.names() if n.startswith(f"{name}."))
        return sorted(int(number) for head, number in found if head == name and number.isdigit())

    def _free(self, name: str, number: int) -> bool:
        if f"{name}.{number}.free" in self.folder.names():
            return True
        content, made = self.folder.read(f"{name}.{number}")
        until = json.loads(content)["until"] if content else made + self.seconds  # its owner was lost between making and writing it
        return self.clock() > until

    def take(self, name: str) -> int | None:
        """The lock's number, or none if another owner holds it."""
        numbers = self._numbers(name)
        if numbers and not self._free(name, numbers[-1]):
            return None
        number = (numbers[-1] if numbers else 0) + 1
        said = json.dumps({"owner": self.owner, "until": self.clock() + self.seconds})
        return number if self.folder.create(f"{name}.{number}", said) else None

    def release(self, name: str, number: int) -> None:
        self.folder.create(f"{name}.{number}.free", self.owner)


def unlock_once(spark: SparkSession, folder: str, name: str, who: str) -> bool:
    """Opens what may be opened once (a test split): true for the first caller, false for all later ones."""
    return Folder(spark, folder).create(f"unlocked-{name}", json.dumps({"by": who, "at": time.time()}))


def unlocked_by(spark: SparkSession, folder: str, name: str) -> str | None:
    """Who opened it; none if nobody did."""
    held = Folder(spark, folder)
    return json.loads(held.read(f"unlocked-{name}")[0])["by"] if f"unlocked-{name}" in held.names() else None


def run_shards(plan: DataFrame, keys: list[str], folder: str, work: Callable[[DataFrame], DataFrame], shards: int, locks: Locks, deadline: float | None = None) -> int:
    """Works off the shards of a plan that nobody has done or holds; returns how many aren't done yet. Several sessions may run it at a time."""
    done = Folder(plan.sparkSession, f"{folder}/done")
    for shard in range(shards):
        if deadline is not None and locks.clock() > deadline:
            break
        if str(shard) in done.names():
            continue
        number = locks.take(f"shard-{shard}")
        if number is None:
            continue
        if str(shard) not in done.names():
            part = plan.filter(F.pmod(F.xxhash64(*keys), F.lit(shards)) == shard)
            work(part).write.mode("overwrite").parquet(f"{folder}/cells/{shard}.{number}")
            done.create(str(shard), str(number))
        locks.release(f"shard-{shard}", number)
    return shards - len(done.names())


def cells(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The cells of the shards that are done, each as its committed owner wrote it."""
    done = Folder(spark, f"{folder}/done")
    paths = [f"{folder}/cells/{shard}.{done.read(shard)[0]}" for shard in sorted(done.names())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
