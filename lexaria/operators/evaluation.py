"""Evaluation analytics over (system, passage, value) rows: grouped means, gates, fronts, thresholds, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaria.sources.shared import Rounds


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b.cast("double"))


def system_means(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, how many are not null, and their mean, by system."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count(value).alias("n_values"), F.avg(value).alias("mean"))


def missing_cells(rows: DataFrame, system: str, passage: str, systems: DataFrame, passages: DataFrame) -> DataFrame:
    """Cells of the (systems x passages) matrix that rows lack. systems is a small dimension, whose size is counted."""
    n = systems.count()
    small = F.broadcast(systems) if n <= 1000 else systems
    return passages.join(small).join(rows.select(system, passage).distinct(), [system, passage], "left_anti")


def ranges(rows: DataFrame, order: str) -> Column:
    """A number for each range of a numeric column, ranges of about equal numbers of rows, as many as shuffle partitions. Null and NaN values come first."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile(order, [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order).cast("double")))


def before(rows: DataFrame, order: str, value: Column, name: str, descending: bool = False) -> DataFrame:
    """rows with the sum of a value over all rows that come before by the order (a unique column).

    Sums run inside ranges of the order, and each range starts from the sum of the
    ranges before it, of which one number a range is collected: no task sees all rows.
    The rows are written first, since they are read three times: for the ranges, their sums, and the result.
    """
    rows = Rounds(rows.sparkSession, "before").written(rows)
    rows = rows.withColumn("__r", ranges(rows, order)).withColumn("__v", value)
    sums = sorted((r["__r"], r.s or 0) for r in rows.groupBy("__r").agg(F.sum("__v").alias("s")).collect())
    start, total = {}, 0
    for k, s in reversed(sums) if descending else sums:
        start[k], total = total, total + s
    first = F.get(F.array(*(F.lit(start.get(k, 0)) for k in range(max(start, default=0) + 1))), F.col("__r"))
    by = F.desc(order) if descending else F.asc(order)
    inside = F.sum("__v").over(Window.partitionBy("__r").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, first + F.coalesce(inside, F.lit(0))).drop("__r", "__v")


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """value, count and average-tie rank of each distinct value; ranks come from counts, so rows aren't sorted."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    return before(counts, value, F.col("n"), "__before").withColumn("rank", F.col("__before") + (F.col("n") + 1) / F.lit(2.0)).drop("__before")


def average_ranks_weighted(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, rank_value: average-tie ranks inside each group of cells that count k rows."""
    c = counts.groupBy(*by, value).agg(F.sum("k").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select(*by, value, (before + (F.col("n") + 1) / F.lit(2.0)).alias(f"rank_{value}"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with credit for ties; null if a class is empty."""
    counts = rows.groupBy(score).agg(F.sum(label).cast("long").alias("pos"), F.count("*").alias("n"))
    ranked = before(counts, score, F.col("n"), "__before").withColumn("rank", F.col("__before") + (F.col("n") + 1) / F.lit(2.0))
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(
        F.col("p").alias("n_pos"), F.col("q").alias("n_neg"),
        divide(F.col("r") - F.col("p") * (F.col("p") + 1) / F.lit(2.0), F.col("p") * F.col("q")).alias("auc")
    )


def confusion(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Counts and ratios at each threshold (score >= threshold predicts 1); one pass, all thresholds as columns."""
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        aggs += [F.count_if(hit & (F.col(label) == 1)).alias(f"tp{i}"), F.count_if(hit & (F.col(label) == 0)).alias(f"fp{i}")]
    one = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"), *aggs)
    cells = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)))
    long = one.select("p", "q", F.explode(cells).alias("c")).select(
        F.col("c.threshold").alias("threshold"), F.col("c.tp").alias("tp"), F.col("c.fp").alias("fp"), (F.col("p") - F.col("c.tp")).alias("fn"),
        (F.col("q") - F.col("c.fp")).alias("tn")
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return long.withColumns(
        {"precision": divide(tp, tp + fp), "recall": divide(tp, tp + fn), "specificity": divide(tn, tn + fp), "f1": divide(tp * 2, tp * 2 + fp + fn)}
    ).withColumn("balanced", (F.col("recall") + F.col("specificity")) / 2.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Rate and its interval."""
    p = divide(hits, n)
    base = F.lit(1.0) + F.lit(z * z) / n
    mid = (p + F.lit(z * z / 2) / n) / base
    half = F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z / 4) / (n * n)) * z / base
    return p, F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def pareto(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Rows that no other row beats: smaller low and larger high are better.

    A running maximum over distinct lows inside ranges; each range starts from the
    largest high of the ranges before it, of which one number a range is collected.
    """
    best = rows.groupBy(low).agg(F.max(high).alias("__top"))
    best = best.withColumn("__r", ranges(best, low))
    tops = sorted((r["__r"], r.t) for r in best.groupBy("__r").agg(F.max("__top").alias("t")).collect())
    first, so_far = F.lit(None), None
    for k, t in tops:
        if so_far is not None:
            first = F.when(F.col("__r") == k, F.lit(so_far)).otherwise(first)
        so_far = t if so_far is None else max(so_far, t)
    inside = F.max("__top").over(Window.partitionBy("__r").orderBy(low).rowsBetween(Window.unboundedPreceding, -1))
    beaten = F.greatest(first.cast(dict(best.dtypes)["__top"]), inside)
    front = best.withColumn("__before", beaten).filter(F.col("__before").isNull() | (F.col("__top") > F.col("__before"))).select(low, "__top")
    return rows.join(front, [low]).filter(F.col(high) == F.col("__top")).drop("__top")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], parts: int = 64) -> DataFrame:
    """by, q0, q1, ...: exact quantiles (linear between neighbours) of each group.

    Approximate cuts deal a group's values to parts; counts say which part holds the
    rank asked for, and only such parts are sorted, so no task holds a group.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), F.col(value).cast("double").alias("__v"))
    keys = [f"__g{i}" for i in range(len(by))]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("__v", [i / parts for i in range(1, parts)], 10_000).alias("__c"), F.count("*").alias("__n"))
    cut = F.broadcast(cuts.select(*(F.col(k).alias(f"{k}c") for k in keys), "__c"))  # a row a group, 64 numbers each
    on = [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in keys]
    placed = (rows.join(cut, on) if on else rows.crossJoin(cut)).select(*keys, "__v", F.size(F.filter("__c", lambda c: c < F.col("__v"))).alias("__p"))
    sizes = placed.groupBy(*keys, "__p").agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    sizes = sizes.withColumns({"__n": F.sum("__k").over(w), "__to": F.sum("__k").over(w.orderBy("__p"))}).withColumn("__from", F.col("__to") - F.col("__k"))
    ranks = [(F.col("__n") - 1) * F.lit(float(q)) for q in shares]
    wanted = F.lit(False)
    for r in ranks:
        for k in (F.floor(r), F.ceil(r)):
            wanted = wanted | ((F.col("__from") <= k) & (k < F.col("__to")))
    need = sizes.filter(wanted).select(*(F.col(k).alias(f"{k}d") for k in keys), F.col("__p").alias("__pd"), "__n", "__from")
    hit = placed.join(F.broadcast(need), [*(F.col(k).eqNullSafe(F.col(f"{k}d")) for k in keys), F.col("__p") == F.col("__pd")])  # at most two parts a share
    at = F.col("__from") + F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("__v")) - 1
    ranked = hit.select(*keys, "__v", "__n", at.alias("__at"))
    out = []
    for i, r in enumerate(ranks):
        lo, up = F.max(F.when(F.col("__at") == F.floor(r), F.col("__v"))), F.max(F.when(F.col("__at") == F.ceil(r), F.col("__v")))
        out.append((lo + (up - lo) * F.max(r - F.floor(r))).alias(f"q{i}"))
    return ranked.groupBy(*keys).agg(*out).select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), *(f"q{i}" for i in range(len(shares))))


#: Rows of the table in one product with the queries.
PRODUCT = 256


def nearest(table: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, block: int = 4096) -> DataFrame:
    """q_id, id, cosine: the k nearest rows of each query (but itself), of equal ones the smaller id; cosines rounded to nine digits.

    Queries are normalised and broadcast as matrices of at most block rows; a few
    rows of the table at a time meet a matrix in one product, and a task holds its best k
    for each query, so what is shuffled is k rows a query and task. Each block is one pass.
    """
    import numpy as np
    import pyarrow as pa

    def matrix(column: pa.Array) -> np.ndarray:
        x = np.array(column.to_pylist(), dtype=np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    parts = -(-asked.count() // block)
    best = None
    for p in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toArrow()
        held = spark.sparkContext.broadcast((own.column("id").to_numpy(), matrix(own.column("v").combine_chunks())))

        def near(batches, held=held):
            q_ids, q = held.value
            ids, top = np.zeros((len(q_ids), 0), np.int64), np.zeros((len(q_ids), 0))
            for part in (batch.slice(at, PRODUCT) for batch in batches for at in range(0, batch.num_rows, PRODUCT)):
                own = part.column(0).to_numpy()
                cosine = np.round(q @ matrix(part.column(1)).T, 9)
                cosine[q_ids[:, None] == own[None, :]] = -2
                ids, top = np.hstack([ids, np.broadcast_to(own, cosine.shape)]), np.hstack([top, cosine])
                order = np.lexsort((ids, -top), axis=1)[:, :k]
                ids, top = np.take_along_axis(ids, order, 1), np.take_along_axis(top, order, 1)
            keep = top > -2
            yield pa.record_batch([pa.array(np.repeat(q_ids, keep.sum(1))), pa.array(ids[keep]), pa.array(top[keep])], ["q_id", "id", "cosine"])

        found = rows.mapInArrow(near, "q_id long, id long, cosine double")
        best = found if best is None else best.unionByName(found)
    if best is None:
        return spark.createDataFrame([], "q_id long, id long, cosine double")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("cosine"), "id"))
    return best.withColumn("place", place).filter(F.col("place") <= k)


def interval_alpha(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """Krippendorff's alpha for interval values, from sums by unit; units with one value are left out."""
    units = rows.groupBy(unit).agg(
        F.count(value).alias("m"), F.sum(value).cast("double").alias("s"), F.sum(F.col(value) * F.col(value)).cast("double").alias("q")
    ).filter("m > 1")
    observed = F.sum((F.col("m") * F.col("q") - F.col("s") * F.col("s")) * 2.0 / (F.col("m") - 1))
    sums = units.agg(F.sum("m").cast("double").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), observed.alias("o"))
    expected = (F.col("n") * F.col("q") - F.col("s") * F.col("s")) * 2.0 / (F.col("n") * (F.col("n") - 1))
    return sums.select(F.col("n").cast("long").alias("n_values"), (F.lit(1.0) - divide(F.col("o") / F.col("n"), expected)).alias("alpha"))


def hash_draw(key: Column) -> Column:
    """A 32-bit number from a key, the same in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def bootstrap_means(rows: DataFrame, key: str, stratum: str, value: str, draws: int) -> DataFrame:
    """Mean by draw, each stratum weighted by its size: each row counts 0 to 4 times, by a Poisson(1) table on a hash of key and draw.

    Rows are not sent anywhere: draws are summed where the rows are.
    """
    # Cumulative Poisson(1) probabilities, times 2**32.
    steps = [1580030169, 3160060337, 3950075421, 4213413783]
    count = lambda h: sum((F.when(h >= s, 1).otherwise(0) for s in steps[1:]), F.when(h >= steps[0], 1).otherwise(0))
    long = rows.select(stratum, value, F.col(key).alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    long = long.withColumn("__n", count(hash_draw(F.concat(F.col("__key").cast("string"), F.lit(":"), F.col("draw").cast("string")))))
    by = long.groupBy("draw", stratum).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col(value)).alias("s"), F.count("*").alias("size"))
    by = by.filter("n > 0")
    return by.groupBy("draw").agg((F.sum(F.col("s") / F.col("n") * F.col("size")) / F.sum("size")).alias("mean"))
