"""Execution of designed experiments: frozen plans, signatures, preflight, resumable cells, stores, staleness, blind sheets.

State is tables in a folder that Spark's file systems reach.  A plan and a cell are
written once; work left is an anti join of the plan against what is done.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Stale(RuntimeError):
    """Something that was frozen has changed."""


def signature(*parts: object) -> str:
    """SHA-256 of values as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def files_signature(paths: Iterable[str]) -> str:
    from lexaria.sources.sinks import sha256

    return signature({p: sha256(p) for p in sorted(paths)})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def freeze(plan: DataFrame, folder: str, identity: dict[str, str]) -> None:
    """Writes a plan (config, id, ...) and its identity; a folder that has one is an error."""
    spark = plan.sparkSession
    if _exists(spark, f"{folder}/plan"):
        raise FileExistsError(f"{folder} has a plan")
    twice = plan.groupBy("config", "id").agg(F.count("*").alias("n")).filter("n > 1").count()
    if twice:
        raise ValueError(f"{twice} cells repeat")
    plan.write.mode("errorifexists").parquet(f"{folder}/plan")
    spark.createDataFrame(
        [(k, v) for k, v in sorted(identity.items())], "name string, value string"
    ).coalesce(1).write.mode("errorifexists").json(f"{folder}/identity")


def preflight(spark: SparkSession, folder: str, identity: dict[str, str]) -> None:
    """Raises Stale where a frozen value differs from what it is now."""
    held = {r.name: r.value for r in spark.read.schema("name string, value string").json(f"{folder}/identity").collect()}
    changed = sorted(k for k in held.keys() | identity.keys() if held.get(k) != identity.get(k))
    if changed:
        raise Stale(f"changed since the plan was frozen: {', '.join(changed)}")


def done(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The cells that are done."""
    return spark.read.schema(schema).parquet(f"{folder}/cells") if _exists(spark, f"{folder}/cells") else spark.createDataFrame([], schema)


def todo(plan: DataFrame, cells: DataFrame, shards: int = 1, shard: int = 0) -> DataFrame:
    """Planned cells that aren't done, of one shard of them."""
    left = plan.join(cells.select("config", "id").distinct(), ["config", "id"], "left_anti")
    return left if shards == 1 else left.filter(F.pmod(F.xxhash64("config", "id"), F.lit(shards)) == shard)


def run_cells(
    spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], schema: str, identity: dict[str, str], shards: int = 1,
    deadline: float | None = None
) -> int:
    """Works off what is left shard by shard, each written with one append, until done or past the deadline; returns the number of cells left.

    Frozen values are checked before and after each shard. A shard that is cut
    leaves nothing, and a second run goes on from what is there.
    """
    plan = spark.read.parquet(f"{folder}/plan")
    for shard in range(shards):
        if deadline is not None and time.time() > deadline:
            break
        preflight(spark, folder, identity)
        work(todo(plan, done(spark, folder, schema), shards, shard)).write.mode("append").parquet(f"{folder}/cells")
        preflight(spark, folder, identity)
    return todo(plan, done(spark, folder, schema)).count()


def reuse(wanted: DataFrame, stores: list[DataFrame], key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Values of the first store that has a key, and the keys that none has."""
    ranked = None
    for i, store in enumerate(stores):
        rows = store.select(key, value, F.lit(i).alias("__rank"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    held = ranked.groupBy(key).agg(F.min_by(value, "__rank").alias(value))
    return wanted.join(held, key), wanted.join(held.select(key), key, "left_anti")


def compatible(a: dict[str, str], b: dict[str, str], needed: Iterable[str]) -> list[str]:
    """Names whose values keep results of one plan from being used in another."""
    return sorted(k for k in needed if a.get(k) is None or a.get(k) != b.get(k))


def stale_cells(cells: DataFrame, identity: Column) -> DataFrame:
    """Cells whose recorded identity differs from what it is now."""
    return cells.filter(~F.col("identity").eqNullSafe(identity))


def staged(scores: DataFrame, score: str, thresholds: dict[str, float], keys: list[str]) -> DataFrame:
    """Scores are worked out once; every arm is a threshold on them: config, keys, accepted."""
    arms = F.array(*(F.struct(F.lit(k).alias("config"), (F.col(score) >= t).alias("accepted")) for k, t in sorted(thresholds.items())))
    return scores.select(*keys, F.explode(arms).alias("x")).select("x.config", *keys, "x.accepted")


def blind_sheet(items: DataFrame, seed: str, arms: str = "system", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Items for raters without their arm, under a hash and in its order; and the key that says which is which."""
    code = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), arms), 256), 1, 16)
    coded = items.withColumn("item", code)
    return coded.drop(arms, key).orderBy("item"), coded.select("item", key, arms)


def import_ratings(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """Ratings with what they rate; an unknown item fails."""
    out = ratings.join(key.withColumn("__known", F.lit(True)), "item", "left")
    return out.withColumn("item", F.when(F.col("__known"), F.col("item")).otherwise(F.raise_error(F.concat(F.lit("no item "), F.col("item"))))).drop("__known")
