"""Greedy samples in which no key comes twice, by rounds in place of one pass in order.

Going through rows in order and taking each one none of whose keys was seen gives the
first maximal independent set of the graph in which rows that share a key are
neighbours.  A row that is the first of the undecided ones under *all* its keys is in
it, whatever comes later; the other rows of its keys are out.  Taking and dropping such
rows leaves a smaller table, and for an order by hash the number of rounds grows with
the logarithm of the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.sources.shared import Rounds


def greedy_sample(rows: DataFrame, id_col: str, keys: Column, order: Column) -> DataFrame:
    """id, place and round of the rows that the greedy pass takes.

    ``keys`` is an array (null elements don't count; a row without keys is taken in the
    first round), ``order`` must tell rows apart together with the id.  Per round the first
    place of each key is an aggregate, so a key that a third of the rows have is
    combined before it is shuffled.
    """
    job = Rounds(rows.sparkSession, "greedy")
    held = F.array_distinct(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull()))
    left = job.written(rows.select(F.col(id_col).alias("id"), F.struct(order.alias("o"), F.col(id_col).alias("i")).alias("place"), held.alias("keys")))
    done = [left.filter(F.size("keys") == 0).select("id", "place", F.lit(0).alias("round"))]
    left = job.written(left.filter(F.size("keys") > 0).select("id", "place", "keys"))
    turn = 0
    while not left.isEmpty():
        turn += 1
        by_key = left.select("place", F.size("keys").alias("n"), F.explode("keys").alias("key"))
        first = by_key.groupBy("key").agg(F.min(F.struct("place", "n")).alias("first"))
        # a row that is the first of as many keys as it has
        taken = job.written(first.groupBy("first.place", "first.n").agg(F.count("*").alias("k"), F.collect_list("key").alias("keys")).filter("k = n"))
        done.append(taken.select(F.col("place.i").alias("id"), "place", F.lit(turn).alias("round")))
        used = taken.select(F.explode("keys").alias("key"))
        gone = by_key.select("place", "key").join(used, "key", "left_semi").select("place").distinct()
        before, left = left, job.written(left.join(gone, "place", "left_anti").select("id", "place", "keys"))
        job.drop(before)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("id", F.col("place.o").alias("place"), "round")
