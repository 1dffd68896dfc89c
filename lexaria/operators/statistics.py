"""Statistics of studies: intervals by resampling, adoption and verdict rules, spans, choices on grids, agreement, graphs.

Resampling draws by hash: a row (or cluster) counts Poisson(1) times in a draw, by a
table on a hash of its key and the draw, so draws are summed where the rows are and
are the same on every machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaria.operators.evaluation import divide, hash_draw, wilson

# Cumulative Poisson(1) probabilities, times 2**32.
POISSON = (1580030169, 3160060337, 3950075421, 4213413783)


def times_drawn(key: Column, draw: Column) -> Column:
    h = hash_draw(F.concat_ws(":", key.cast("string"), draw.cast("string")))
    return sum((F.when(h >= s, 1).otherwise(0) for s in POISSON), F.lit(0))


def percentile_interval(draws: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, low, high: the 2.5th and 97.5th percentile of the draws (a bounded number of rows a group)."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 4)
    return draws.groupBy(*by).agg(p(0.025).alias("low"), p(0.975).alias("high"))


def mean_interval(rows: DataFrame, by: list[str], key: str, stratum: str, value: str, draws: int) -> DataFrame:
    """by, n, mean, low, high: mean and percentile interval of a bootstrap inside strata, each weighted by its size. Null values are left out."""
    rows = rows.filter(F.col(value).isNotNull())
    long = rows.select(*by, stratum, value, F.col(key).alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("__draw"))
    long = long.withColumn("__k", times_drawn(F.col("__key"), F.col("__draw")))
    cells = long.groupBy(*by, "__draw", stratum).agg(
        F.sum("__k").alias("k"), F.sum(F.col("__k") * F.col(value)).alias("s"), F.count("*").alias("size")
    ).filter("k > 0")
    means = cells.groupBy(*by, "__draw").agg((F.sum(F.col("s") / F.col("k") * F.col("size")) / F.sum("size")).alias("m"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return _joined(whole, percentile_interval(means, "m", by), by)


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b, by) if by else a.crossJoin(F.broadcast(b))


def paired_interval(rows: DataFrame, system: str, baseline: str, by: list[str], key: str, stratum: str, value: str, draws: int) -> DataFrame:
    """Each system less the baseline on the same keys: n, mean, low, high, and keys whose difference isn't zero."""
    base = rows.filter(F.col(system) == baseline).select(F.col(key), F.col(value).alias("__base"))
    d = rows.filter(F.col(system) != baseline).join(base, key).withColumn("delta", F.col(value) - F.col("__base"))
    out = mean_interval(d, [system, *by], key, stratum, "delta", draws)
    changed = d.filter("delta is not null").groupBy(system, *by).agg(F.count_if(F.abs("delta") > 1e-12).alias("n_nonzero"))
    return out.join(changed, [system, *by])


def cluster_interval(rows: DataFrame, by: list[str], cluster: str, hits: Column, among: Column, draws: int) -> DataFrame:
    """by, k, n, rate, low, high of the share of hits among rows, resampling whole clusters: sums by cluster first, so draws touch clusters and not rows."""
    sums = rows.groupBy(*by, cluster).agg(F.count_if(hits & among).alias("k"), F.count_if(among).alias("n"))
    long = sums.select(
        *by, "k", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("__draw"), cluster
    ).withColumn("__t", times_drawn(F.col(cluster), F.col("__draw")))
    drawn = long.groupBy(*by, "__draw").agg(F.sum(F.col("__t") * F.col("k")).alias("k"), F.sum(F.col("__t") * F.col("n")).alias("n")).filter("n > 0")
    interval = percentile_interval(drawn.withColumn("rate", F.col("k") / F.col("n")), "rate", by)
    whole = sums.groupBy(*by).agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("rate", F.round(divide(F.col("k"), F.col("n")), 6))
    return _joined(whole, interval, by)


def rates_below(rows: DataFrame, by: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """by, threshold, k, n, rate, low, high: share of values below each threshold with its Wilson interval; one pass, thresholds as columns."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), *(F.count_if(F.col(value) < t).alias(f"k{i}") for i, t in enumerate(thresholds))
    )
    cells = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k{i}").alias("k")) for i, t in enumerate(thresholds)))
    long = counts.select(*by, "n", F.explode(cells).alias("c")).select(*by, "c.threshold", "c.k", "n")
    p, low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return long.select(*by, "threshold", "k", "n", F.round(p, 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def gates(nli_mean: Column, below: Column, n: Column, failed: Column, entities: Column, reference: Column) -> dict[str, Column]:
    """The four gates of a system's summary: mean entailment, passages below the floor, facts kept, names against the reference system."""
    return {
        "nli_mean": F.coalesce(nli_mean >= 0.95, F.lit(False)), "nli_floor": below <= n * 0.05, "facts": failed == 0,
        "entities": F.coalesce(entities >= reference - 1e-12, F.lit(False))
    }


def adoption(gates_pass: Column, over_edit: Column, grade_mean: Column, grade_high: Column, nli_mean: Column) -> dict[str, Column]:
    """Whether a system replaces the incumbent: gates, over-editing, grade beyond a tie, its interval below zero, entailment not much worse; and all of them."""
    parts = {"gates": gates_pass, "over_edit": over_edit, "beyond_tie": grade_mean <= -0.1, "below_zero": grade_high < 0, "nli_kept": nli_mean >= -0.01}
    whole = None
    for c in parts.values():
        whole = c if whole is None else whole & c
    return parts | {"adopt": whole}


def verdict(reads_easier: Column, keeps_meaning: Column, edits_little: Column) -> Column:
    return F.when(reads_easier & keeps_meaning & edits_little, "confirmed").otherwise("not confirmed")


def span_scores(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """kind (exact, overlap), n_found, n_gold, precision, recall, f1 of spans (key, a, b), half open; a key has few spans."""
    per = gold.groupBy(key).agg(F.collect_set(F.struct("a", "b")).alias("g")).join(
        found.groupBy(key).agg(F.collect_set(F.struct("a", "b")).alias("p")), key, "full"
    )
    none = F.array().cast("array<struct<a:long,b:long>>")
    g, p = (F.coalesce(F.col(c).cast("array<struct<a:long,b:long>>"), none) for c in "gp")
    meets = lambda x, y: (x["a"] < y["b"]) & (y["a"] < x["b"])
    sums = per.select(
        F.size(F.array_intersect(g, p)).alias("both"), F.size(p).alias("np"), F.size(g).alias("ng"),
        F.size(
            F.filter(p, lambda x: F.exists(g, lambda y: meets(x, y)))
        ).alias("hp"), F.size(F.filter(g, lambda x: F.exists(p, lambda y: meets(x, y)))).alias("hg"),
    ).agg(*(F.sum(c).alias(c) for c in ("both", "np", "ng", "hp", "hg")))
    cells = F.array(
        F.struct(F.lit("exact").alias("kind"), F.col("both").alias("p"), F.col("both").alias("g")),
        F.struct(F.lit("overlap").alias("kind"), F.col("hp").alias("p"), F.col("hg").alias("g"))
    )
    long = sums.select("np", "ng", F.explode(cells).alias("c"))
    precision, recall = F.coalesce(divide(F.col("c.p"), F.col("np")), F.lit(0.0)), F.coalesce(divide(F.col("c.g"), F.col("ng")), F.lit(0.0))
    f1 = F.coalesce(divide(precision * recall * 2, precision + recall), F.lit(0.0))
    return long.select(
        "c.kind", F.col("np").alias("n_found"), F.col("ng").alias("n_gold"),
        *(F.round(c, 6).alias(n) for c, n in ((precision, "precision"), (recall, "recall"), (f1, "f1")))
    )


def ordinal_alpha(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """Krippendorff's alpha for ordinal values, from coincidences of distinct values (few).

    Coincidences are summed as whole numbers for each number of ratings a unit has, and divided afterwards; a value's own sum is a whole number.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count("*").alias("k"))
    m = counts.groupBy(unit).agg(F.sum("k").alias("m"), F.collect_list(F.struct(F.col(value).alias("v"), "k")).alias("vs")).filter("m > 1")
    one = m.select("m", F.explode("vs").alias("x"), "vs").select("m", "x", F.explode("vs").alias("y"))
    whole = one.groupBy(F.col("x.v").alias("c"), F.col("y.v").alias("d"), "m").agg(
        F.sum(F.when(F.col("x.v") == F.col("y.v"), F.col("x.k") * (F.col("x.k") - 1)).otherwise(F.col("x.k") * F.col("y.k"))).alias("o")
    )
    pairs = whole.groupBy("c", "d").agg(F.sum(F.col("o") / (F.col("m") - 1)).alias("o"))
    n = pairs.groupBy("c").agg(F.round(F.sum("o")).alias("n"))
    up = n.select("c", "n", F.sum("n").over(Window.partitionBy().orderBy("c")).alias("cum"))  # one row a distinct value
    a, b = up.select("c", F.col("n").alias("nc"), F.col("cum").alias("cc")), up.select(F.col("c").alias("d"), F.col("n").alias("nd"), F.col("cum").alias("cd"))
    grid = a.crossJoin(F.broadcast(b)).join(pairs, ["c", "d"], "left").fillna(0.0, ["o"])
    between = F.greatest("cc", "cd") - F.least(F.col("cc") - F.col("nc"), F.col("cd") - F.col("nd"))
    delta = F.pow(between - (F.col("nc") + F.col("nd")) / 2, F.lit(2.0))
    s = grid.filter("c <> d").agg(F.sum(F.col("o") * delta).alias("o"), F.sum(F.col("nc") * F.col("nd") * delta).alias("e"))
    total = n.agg(F.sum("n").alias("n"))
    return s.crossJoin(F.broadcast(total)).select(
        F.col("n").cast("long").alias("n_values"), F.round(F.lit(1.0) - divide(F.col("o") * (F.col("n") - 1), F.col("e")), 9).alias("alpha")
    )


def choose_setting(grid: DataFrame, least_precision: float = 0.9) -> DataFrame:
    """The setting (window, threshold) of best balanced accuracy among those precise enough, else of all; ties: precision, smaller window (null last), higher threshold."""
    able = F.coalesce(F.col("precision") >= least_precision, F.lit(False))
    order = [F.desc("able"), F.desc_nulls_last("balanced"), F.desc_nulls_last("precision"), F.asc_nulls_last("window"), F.desc("threshold")]
    return grid.withColumn("able", able).orderBy(*order).limit(1)


def accept_best(cases: DataFrame, case: str, probability: str, gold: str, thresholds: list[float]) -> DataFrame:
    """threshold, edits, correct, net, precision: the most probable guarded candidate of a case is taken at or above each threshold."""
    best = cases.filter("guard").groupBy(case).agg(
        F.max_by(F.struct(probability, gold), F.struct(F.col(probability), -F.col("candidate"), F.col(gold))).alias("b")
    ).select(F.col(f"b.{probability}").alias("p"), F.col(f"b.{gold}").cast("int").alias("g"))
    sums = best.agg(
        *(F.count_if(F.col("p") >= t).alias(f"n{i}") for i, t in enumerate(thresholds)),
        *(F.count_if((F.col("p") >= t) & (F.col("g") == 1)).alias(f"c{i}") for i, t in enumerate(thresholds))
    )
    cells = F.array(
        *(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("edits"), F.col(f"c{i}").alias("correct")) for i, t in enumerate(thresholds))
    )
    return sums.select(F.explode(cells).alias("x")).select("x.*").withColumns(
        {"net": F.col("correct") * 2 - F.col("edits"), "precision": F.round(F.coalesce(divide(F.col("correct"), F.col("edits")), F.lit(0.0)), 3)}
    )


def closure(edges: DataFrame, most: int = 20) -> DataFrame:
    """(a, b, steps): every node that edges (a, b) reach within so many steps, by the fewest; doubling, so a path of 2**k takes k joins."""
    reach = edges.select("a", "b").distinct().withColumn("steps", F.lit(1))
    span = 1
    while span < most:
        far = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select(
            F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.steps") + F.col("y.steps")).alias("steps")
        )
        reach = reach.unionByName(far.filter(F.col("steps") <= most)).groupBy("a", "b").agg(F.min("steps").alias("steps"))
        span *= 2
    return reach


def related_words(words: DataFrame, senses: DataFrame, links: DataFrame) -> DataFrame:
    """(word, other, relation, senses): words of senses that a word's senses link to (or share), by the closest relation (rank), with the senses that lead there."""
    mine = words.join(senses, "word").select("word", "sense")
    same = mine.select("word", "sense", F.col("sense").alias("far"), F.lit(0).alias("rank"))
    linked = mine.join(links, "sense").select("word", "sense", "far", "rank")
    out = same.unionByName(linked).join(senses.select(F.col("word").alias("other"), F.col("sense").alias("far")), "far").filter("other <> word")
    return out.groupBy("word", "other").agg(F.min("rank").alias("relation"), F.sort_array(F.collect_set("sense")).alias("senses"))


def relation_mass(left: DataFrame, right: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key, relation, mass: joint probability of sense pairs by the relation between them (0 the same, null unlinked); a key has few senses."""
    both = left.select(key, "sense", "p").join(right.select(key, F.col("sense").alias("far"), F.col("p").alias("q")), key)
    both = both.join(links, ["sense", "far"], "left").withColumn("relation", F.when(F.col("sense") == F.col("far"), 0).otherwise(F.col("rank")))
    return both.groupBy(key, "relation").agg(F.round(F.sum(F.col("p") * F.col("q")), 9).alias("mass"))
