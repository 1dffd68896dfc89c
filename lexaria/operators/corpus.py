"""Corpus preparation: exclusion, deduplication, filters with reasons, deterministic samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclude(rows: DataFrame, key: str, excluded: DataFrame, excluded_key: str) -> DataFrame:
    """Rows whose key is not in the excluded set."""
    return rows.join(excluded.select(F.col(excluded_key).alias("__x")).distinct(), F.col(key) == F.col("__x"), "left_anti")


def first_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key; by a minimum that combines on the map side, so that a hot key costs one row a task."""
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("__f"))
    return first.select(*key, *(F.col("__f")[c].alias(c) for c in others)).select(rows.columns)


def hash_order(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons: a deterministic order."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def smallest_hashes(rows: DataFrame, key: Column, n: int) -> DataFrame:
    return rows.withColumn("hash", key).orderBy("hash").limit(n)


def class_quota(rows: DataFrame, by: str, key: Column, quota: int) -> DataFrame:
    """At most quota rows of each class in hash order (a top-k window, cut on the map side)."""
    w = Window.partitionBy(by).orderBy("hash")
    return rows.withColumn("hash", key).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= quota)


def hex_mod(digest: Column, modulus: int) -> Column:
    """A hexadecimal number of any length modulo a small one, digit by digit."""
    digits = F.split(digest, "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: F.pmod(a * 16 + F.conv(d, 16, 10).cast("long"), F.lit(modulus)))


def islands(rows: DataFrame, by: str, at: str, keep: Column) -> DataFrame:
    """Runs of consecutive positions where keep holds: by, first, last, n."""
    w = Window.partitionBy(by).orderBy(at)
    kept = rows.filter(keep).withColumn("__island", F.col(at) - F.row_number().over(w))
    return kept.groupBy(by, "__island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("__island")
