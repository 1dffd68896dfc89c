"""Queries on matrices of (system, passage, value), ratings, labels and vectors.

In the tables, ``events`` is the matrix (event_type = system, user_id = passage,
value = metric), ``lineitem`` holds ratings (order = unit, line = rater),
``part`` the candidates of a front, and ``labels`` the gold of detectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaria.functions.batches import dealt_for_fit
from lexaria.operators import evaluation as ev
from lexaria.plans.text_queries import read

GRID = [round(0.1 + 0.05 * i, 2) for i in range(17)]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("system"), F.col("user_id").alias("passage"), "value", "event_id")


def _mean(value: str):
    """Mean of a column, from its exact sum where all values have at most ten decimals: it then doesn't hang on the order of rows, so a mean that equals a bound or another mean does so in every run."""
    exact = F.col(value).try_cast("decimal(38,10)")
    inexact = F.count_if(F.col(value).isNotNull() & ~F.coalesce(exact.cast("double") == F.col(value), F.lit(False)))
    return F.when(inexact == 0, F.try_sum(exact).cast("double") / F.count(value)).otherwise(F.avg(value))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each (system, passage)."""
    return _events(spark, sf_dir).groupBy("system", "passage").agg(_mean("value").alias("value"), F.count("*").alias("n"))


def letter_share() -> Column:
    """Share of a text's characters that are letters or spaces; of an empty text NaN, as in SQL, where Spark's 0 / 0 is an error."""
    n = F.length("text")
    return F.coalesce(ev.divide(F.length(F.regexp_replace("text", r"[^\p{L} ]", "")), n), F.when(n == 0, F.lit(float("nan"))))


def floored(x: Column, parts: int) -> Column:
    """The number rounded down to a part of one; NaN stays, of which Spark's floor makes 0."""
    return F.when(F.isnan(x), x).otherwise(F.floor(x * parts) / float(parts))


def text_features() -> dict[str, Column]:
    """Length, share of letters and sentences a character of a text; 0 each where it is empty or null, so every text has them."""
    n = F.length("text")
    return {
        "f": F.log1p(F.greatest(F.coalesce("n_chars", n), F.lit(0))), "g": F.nanvl(F.coalesce(letter_share(), F.lit(0.0)), F.lit(0.0)),
        "h": F.coalesce(ev.divide(F.size(F.split("text", r"[.!?]")), n), F.lit(0.0))
    }


def _scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels with a score: the share of the text's characters that are letters or spaces, in hundredths."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", letter_share().alias("s"))
    return read(spark, sf_dir, "labels").join(d, "doc_id").withColumn("score", floored(F.col("s"), 100))


def system_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.system_means(_events(spark, sf_dir), "system", "value").withColumn("mean", F.round("mean", 6))


def grouping_sets_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All and changed cells (value over 50), overall and by panel (passage modulo 4)."""
    x = _events(spark, sf_dir).withColumn("panel", F.col("passage") % 4)
    changed = F.col("value") > 50
    by = x.groupingSets([["system"], ["system", "panel"], []], "system", "panel")
    return by.agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.count_if(changed).alias("n_changed"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(changed, F.col("value"))), 6).alias("mean_changed")
    )


def study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per system: cells, cells below 20 (null counts as below), whether all have several events, and the least value."""
    c = _cells(spark, sf_dir)
    return c.groupBy("system").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.col("value"), F.lit(0.0)) < 20).alias("n_below"),
        F.bool_and(F.col("n") > 1).alias("all_repeated"), F.round(F.min("value"), 6).alias("least")
    )


def matrix_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return ev.missing_cells(rows, "system", "passage", rows.select("system").distinct(), rows.select("passage").distinct()).select("system", "passage")


def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system against 'view' on the same passages: mean difference, non-zero differences, paired t."""
    c = _cells(spark, sf_dir)
    base = c.filter("system = 'view'").select("passage", F.col("value").alias("base"))
    d = c.filter("system <> 'view'").join(base, "passage").withColumn("d", F.col("value") - F.col("base"))
    sd = F.stddev_samp("d")
    return d.groupBy("system").agg(
        F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_delta"), F.count_if(F.abs("d") > 1e-12).alias("n_changed"),
        F.round(F.when(sd > 0, F.avg("d") / (sd / F.sqrt(F.count("*")))).otherwise(0.0), 6).alias("t")
    )


def bootstrap_stratified_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 draws of the mean text length, stratified by language (``bootstrap_interval`` has the percentile interval)."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("v"))
    return ev.bootstrap_means(rows, "doc_id", "lang", "v", 40).select(F.col("draw").cast("int").alias("draw"), F.round("mean", 4).alias("mean"))


def gates_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the brands that pass all gates against the overall row, those within 2 of the least mean price; the largest size wins."""
    by = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    ref = read(spark, sf_dir, "part").agg(F.avg("p_size").alias("ref_size"), F.avg("p_retailprice").alias("ref_price"))
    gated = by.crossJoin(F.broadcast(ref)).filter("n >= 3 AND size >= ref_size - 5 AND price <= ref_price + 50")
    least = gated.agg(F.min("price").alias("least"))
    near = gated.crossJoin(F.broadcast(least)).filter("price <= least + 2")
    return near.orderBy(F.desc("size"), "price", "p_brand").limit(1).select(
        "p_brand", "n", F.round("price", 6).alias("price"), F.round("size", 6).alias("size")
    )


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pareto(
        read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "p_size"
    ).select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("p_retailprice"))


def confusion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.confusion(_scored_labels(spark, sf_dir), "score", "quality", GRID)
    return out.select("threshold", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "f1", "balanced")))


def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score with the largest TPR - FPR, from counts by distinct score."""
    c = _scored_labels(spark, sf_dir).groupBy("score").agg(F.sum("quality").cast("long").alias("p"), F.count("*").alias("n"))
    t = c.agg(F.sum("p").alias("tp"), F.sum(F.col("n") - F.col("p")).alias("tn"))
    j = ev.before(c, "score", F.col("p"), "pb")
    j = ev.before(j, "score", F.col("n") - F.col("p"), "nb").crossJoin(F.broadcast(t))
    j = j.withColumns({"hp": F.col("tp") - F.col("pb"), "hn": F.col("tn") - F.col("nb")})
    j = j.withColumn("j", F.round(F.col("hp") / F.col("tp") - F.col("hn") / F.col("tn"), 9))
    return j.orderBy(F.desc("j"), "score").limit(1).select("score", "j")


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.auc(_scored_labels(spark, sf_dir), "score", "quality").withColumn("auc", F.round("auc", 9))


def wilson_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of labelled texts with a score under 0.9, by language, with its Wilson interval."""
    c = _scored_labels(spark, sf_dir).groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("score") < 0.9).cast("double").alias("k"))
    p, low, high = ev.wilson(F.col("k"), F.col("n"))
    return c.select(
        "lang", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), F.round(p, 6).alias("rate"), F.round(low, 6).alias("low"),
        F.round(high, 6).alias("high")
    )


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = floored(F.col("score"), 10)
    return _scored_labels(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("share"))


def macro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class precision, recall, F1 and support of 'score >= 0.9 means quality 1'; zero where undefined."""
    x = _scored_labels(spark, sf_dir).select(F.col("quality").alias("y"), (F.col("score") >= 0.9).cast("int").alias("z"))
    cls = x.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("label"), "y", "z").groupBy("label").agg(
        F.count_if((F.col("y") == F.col("label")) & (F.col("z") == F.col("label"))).alias("tp"),
        F.count_if(F.col("z") == F.col("label")).alias("said"), F.count_if(F.col("y") == F.col("label")).alias("support")
    )
    p, r = F.coalesce(ev.divide(F.col("tp"), F.col("said")), F.lit(0.0)), F.coalesce(ev.divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return cls.select(
        "label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(F.coalesce(ev.divide(p * r * 2, p + r), F.lit(0.0)), 6).alias("f1")
    )


def accuracy_at_k_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the vectors with an id divisible by 100 as queries against all: accuracy at 5 and MRR within 20, gold = same label."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    top = ev.nearest(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 20)
    labels = e.select(F.col("vec_id").alias("id"), "label")
    gold = top.join(labels, "id").join(labels.select(F.col("id").alias("q_id"), F.col("label").alias("q_label")), "q_id")
    per = gold.groupBy("q_id").agg(F.min(F.when(F.col("label") == F.col("q_label"), F.col("place"))).alias("first"))
    return per.agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("first") <= 5, 1.0).otherwise(0.0)), 6).alias("accuracy_at_5"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("rater"),
        (F.floor(F.col("l_quantity") / 10.0) + 1).cast("double").alias("rating"), "l_extendedprice", "l_discount"
    )


def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.interval_alpha(_ratings(spark, sf_dir), "unit", "rating").withColumn("alpha", F.round("alpha", 9))


def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of rating and price, and of their average ranks (ranks come from counts of distinct values)."""
    r = _ratings(spark, sf_dir).groupBy("rating", F.floor(F.col("l_extendedprice") / 1000.0).cast("double").alias("price")).agg(F.count("*").alias("k"))
    # cells of both values with their counts stand for the rows from here on
    ranked = r.join(ev.average_ranks_weighted(r, "rating", []), "rating").join(ev.average_ranks_weighted(r, "price", []), "price")

    def corr(a: str, b: str):
        n, sa, sb = F.sum("k").cast("double"), F.sum(F.col("k") * F.col(a)), F.sum(F.col("k") * F.col(b))
        spread = lambda c, s: F.sum(F.col("k") * F.col(c) * F.col(c)) - s * s / n
        return F.round((F.sum(F.col("k") * F.col(a) * F.col(b)) - sa * sb / n) / F.sqrt(spread(a, sa) * spread(b, sb)), 6)

    return ranked.agg(corr("rating", "price").alias("pearson"), corr("rank_rating", "rank_price").alias("spearman"))


def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the mean ratings of odd and even raters, stepped up by Spearman and Brown."""
    u = _ratings(spark, sf_dir).groupBy("unit").agg(
        F.avg(F.when(F.col("rater") % 2 == 1, F.col("rating"))).alias("a"), F.avg(F.when(F.col("rater") % 2 == 0, F.col("rating"))).alias("b")
    ).filter("a IS NOT NULL AND b IS NOT NULL")
    r = F.corr("a", "b")
    return u.agg(F.count("*").alias("n"), F.round(r, 6).alias("r"), F.round(r * 2 / (r + 1), 6).alias("stepped_up"))


def vote_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's most frequent rating; of equal counts the smaller."""
    c = _ratings(spark, sf_dir).groupBy("unit", "rating").agg(F.count("*").alias("n"))
    best = c.groupBy("unit").agg(F.max(F.struct("n", (-F.col("rating")).alias("low"))).alias("b"))
    return best.groupBy((-F.col("b.low")).alias("rating")).agg(F.count("*").alias("n_units"), F.sum("b.n").alias("n_votes"))


def softmax_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of mean values over the systems of a passage, temperature 10; the share of each system that comes first."""
    w = Window.partitionBy("passage")
    x = _cells(spark, sf_dir).filter("value IS NOT NULL").withColumn(
        "e", F.exp((F.col("value") - F.max("value").over(w)) / 10.0)
    ).withColumn("p", F.col("e") / F.sum("e").over(w))
    return x.groupBy("system").agg(F.round(F.sum("p"), 4).alias("mass"), F.count_if(F.col("e") == 1.0).alias("n_first"))


def neighbour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its passage's neighbours: systems before and after, running maximum, mean of three before."""
    w = Window.partitionBy("passage").orderBy("event_id")
    e = _events(spark, sf_dir)
    return e.select(
        "event_id", F.lag("system", 1, "BOS").over(w).alias("before"), F.lead("system", 1, "EOS").over(w).alias("after"),
        F.round(F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("top"),
        F.round(F.avg("value").over(w.rowsBetween(-3, -1)), 6).alias("mean3")
    )


def asof_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its passage's last view at or before it, by a running last value and not by a range join."""
    e = read(spark, sf_dir, "events").filter("event_type IN ('purchase', 'view')").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("ts")), True).over(w)
    return e.withColumn("view_ts", last).filter("event_type = 'purchase'").select(
        "event_id", F.unix_micros(F.col("view_ts").cast("timestamp")).alias("view_us")
    )


def resume_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are not done: planned cells without a finished event (value of 90 or more)."""
    plan = _events(spark, sf_dir).select("system", "passage").distinct()
    done = _events(spark, sf_dir).filter("value >= 90").select("system", "passage").distinct()
    return plan.join(done, ["system", "passage"], "left_anti")


def design_factorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All level combinations of three factors, and the one-factor-at-a-time changes of the first."""
    levels = {
        "a": read(spark, sf_dir, "region").select(F.col("r_name").alias("a")), "b": spark.createDataFrame([("on",), ("off",)], "b string"),
        "c": spark.createDataFrame([(0,), (1,), (2,)], "c int")
    }
    full = levels["a"].crossJoin(F.broadcast(levels["b"])).crossJoin(F.broadcast(levels["c"]))
    one = (F.when(F.col("a") != "AFRICA", 1).otherwise(0) + F.when(F.col("b") != "off", 1).otherwise(0) + F.when(F.col("c") != 0, 1).otherwise(0)) <= 1
    return full.select(
        F.concat_ws("|", F.concat(F.lit("a="), "a"), F.concat(F.lit("b="), "b"), F.concat(F.lit("c="), F.col("c").cast("string"))).alias("config"),
        one.alias("single")
    )


def simplex_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of weights on a simplex of tenths, those whose mix of three features correlates best with price."""
    x = read(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50.0).alias("f"), (F.col("l_discount") * 10.0).alias("g"), (F.col("l_tax") * 10.0).alias("h"),
        F.col("l_extendedprice").alias("y")
    )
    m = x.agg(
        F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "fghy"),
        *(F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("ff", "gg", "hh", "yy", "fg", "fh", "gh", "fy", "gy", "hy"))
    )
    grid = spark.range(11).select((F.col("id") / 10.0).alias("a")).crossJoin(
        spark.range(11).select((F.col("id") / 10.0).alias("b"))
    ).filter("a + b <= 1.0000001").withColumn("c", F.round(F.lit(1.0) - F.col("a") - F.col("b"), 1))
    r = grid.crossJoin(F.broadcast(m)).selectExpr(
        "a", "b", "c", "n * (a*sfy + b*sgy + c*shy) - (a*sf + b*sg + c*sh) * sy AS cov",
        "n * (a*a*sff + b*b*sgg + c*c*shh + 2*a*b*sfg + 2*a*c*sfh + 2*b*c*sgh) - power(a*sf + b*sg + c*sh, 2) AS vx", "n * syy - sy * sy AS vy",
    )
    return r.withColumn("r", F.round(F.expr("cov / sqrt(vx * vy)"), 6)).orderBy(F.desc("r"), F.desc("a"), F.desc("b")).limit(5).select("a", "b", "c", "r")


def logistic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic classifier of quality from three text features, fitted on four fifths by id and judged on the rest."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    d = read(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in text_features().items()))
    labels = read(spark, sf_dir, "labels")
    x = VectorAssembler(inputCols=["f", "g", "h"], outputCol="raw").transform(
        dealt_for_fit(labels.join(d, "doc_id").withColumn("y", F.col("quality").cast("double")), "doc_id", labels.count())
    ).cache()
    train, test = x.filter("doc_id % 5 <> 0"), x.filter("doc_id % 5 = 0")
    scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01, maxIter=30).fit(scale.transform(train))
    return model.transform(scale.transform(test)).select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (system_aggregate, grouping_sets_changed, study_summary, matrix_validate, baseline_delta, bootstrap_stratified_hash, gates_selection, pareto_front, confusion_sweep, youden_threshold, auc_rank, wilson_rates, calibration_bins, macro_prf, accuracy_at_k_mrr,
              krippendorff_alpha, pearson_spearman, split_half, vote_mode, softmax_group, neighbour_features, asof_snap, resume_cells, design_factorial, simplex_grid_fit, logistic_quality)
}

_E = "e AS (SELECT event_type AS system, user_id AS passage, value, event_id FROM events)"
_C = f"{_E}, c AS (SELECT system, passage, avg(value) AS value, count(*) AS n FROM e GROUP BY 1, 2)"
_L = "x AS (SELECT l.doc_id, l.quality, d.lang, floor(length(regexp_replace(d.text, '[^\\p{L} ]', '', 'g'))::DOUBLE / length(d.text) * 100) / 100.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"
_R = "r AS (SELECT l_orderkey AS unit, l_linenumber AS rater, floor(l_quantity / 10.0::DOUBLE) + 1 AS rating, floor(l_extendedprice / 1000.0::DOUBLE) AS price FROM lineitem)"

ORACLES = {
    "system_aggregate": f"WITH {_E} SELECT system, count(*) AS n, count(value) AS n_values, round(avg(value), 6) AS mean FROM e GROUP BY 1",
    "grouping_sets_changed": f"""WITH {_E}, p AS (SELECT *, passage % 4 AS panel FROM e)
        SELECT system, panel, CAST(grouping(system, panel) AS BIGINT) AS level, count(*) AS n, count_if(value > 50)::BIGINT AS n_changed, round(avg(value),
            6) AS mean, round(avg(value) FILTER (WHERE value > 50), 6) AS mean_changed
        FROM p GROUP BY GROUPING SETS ((system), (system, panel), ())""",
    "study_summary": f"WITH {_C} SELECT system, count(*) AS n, count_if(coalesce(value, 0) < 20)::BIGINT AS n_below, bool_and(n > 1) AS all_repeated, round(min(value), 6) AS least FROM c GROUP BY 1",
    "matrix_validate": f"WITH {_E} SELECT s.system, p.passage FROM (SELECT DISTINCT system FROM e) s CROSS JOIN (SELECT DISTINCT passage FROM e) p ANTI JOIN e ON e.system = s.system AND e.passage = p.passage",
    "baseline_delta": f"""WITH {_C}, d AS (SELECT c.system, c.value - b.value AS d FROM c JOIN c b ON b.passage = c.passage AND b.system = 'view'
        WHERE c.system <> 'view')
        SELECT system, count(*) AS n, round(avg(d), 6) AS mean_delta, count_if(abs(d) > 1e-12)::BIGINT AS n_changed, round(CASE WHEN stddev_samp(d) > 0
            THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) ELSE 0 END, 6) AS t FROM d GROUP BY 1""",
    "bootstrap_stratified_hash": """WITH k AS (SELECT draw, lang, n_chars::DOUBLE AS v, ('0x' || substr(md5(doc_id || ':' || draw), 1, 8))::BIGINT AS h
        FROM documents, range(40) t(draw)),
        w AS (SELECT *, (h >= 1580030169)::INT + (h >= 3160060337)::INT + (h >= 3950075421)::INT + (h >= 4213413783)::INT AS n FROM k),
        s AS (SELECT draw, lang, sum(n) AS n, sum(n * v) AS s, count(*) AS size FROM w GROUP BY 1, 2)
        SELECT draw::INT AS draw, round(sum(s / n * size) / sum(size), 4) AS mean FROM s WHERE n > 0 GROUP BY draw""",
    "gates_selection": """WITH b AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY 1),
        r AS (SELECT avg(p_size) AS rs, avg(p_retailprice) AS rp FROM part),
        g AS (SELECT b.* FROM b, r WHERE n >= 3 AND size >= rs - 5 AND price <= rp + 50)
        SELECT p_brand, n, round(price, 6) AS price, round(size, 6) AS size FROM g WHERE price <= (SELECT min(price) FROM g) + 2 ORDER BY g.size DESC,
            g.price, p_brand LIMIT 1""",
    "pareto_front": """SELECT p_partkey, p_size, round(p_retailprice, 2) AS p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b
        WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))""",
    "confusion_sweep": f"""WITH {_L}, t AS (SELECT unnest({GRID}::DOUBLE[]) AS threshold),
        k AS (SELECT threshold, count_if(score >= threshold AND quality = 1)::BIGINT AS tp, count_if(score >= threshold AND quality = 0)::BIGINT AS fp,
            count_if(score < threshold AND quality = 1)::BIGINT AS fn, count_if(score < threshold AND quality = 0)::BIGINT AS tn FROM x, t GROUP BY 1),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall,
            CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END AS specificity, CASE WHEN 2 * tp + fp + fn > 0
            THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM k)
        SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1,
            6) AS f1, round((recall + specificity) / 2.0::DOUBLE, 6) AS balanced FROM q""",
    "youden_threshold": f"""WITH {_L}, t AS (SELECT DISTINCT score FROM x), n AS (SELECT sum(quality) AS p, sum(1 - quality) AS q FROM x)
        SELECT t.score, round(sum(CASE WHEN x.score >= t.score THEN quality ELSE 0 END)::DOUBLE / any_value(p) - sum(CASE WHEN x.score >= t.score
            THEN 1 - quality ELSE 0 END)::DOUBLE / any_value(q), 9) AS j FROM t, x, n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "auc_rank": f"""WITH {_L}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rank FROM x)
        SELECT sum(quality)::BIGINT AS n_pos, sum(1 - quality)::BIGINT AS n_neg,
            round((sum(rank) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / (sum(quality) * sum(1 - quality)), 9) AS auc
            FROM r""",
    "wilson_rates": f"""WITH {_L}, k AS (SELECT lang, count(*) AS n, count_if(score < 0.9)::BIGINT AS k FROM x GROUP BY 1), p AS (SELECT *,
        k::DOUBLE / n AS p, 3.8416::DOUBLE AS z FROM k)
        SELECT lang, n, k, round(p, 6) AS rate,
            round(greatest((p + z / 2 / n) / (1 + z / n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + z / 4 / (n * n)) / (1 + z / n), 0), 6) AS low,
            round(least((p + z / 2 / n) / (1 + z / n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + z / 4 / (n * n)) / (1 + z / n), 1), 6) AS high FROM p""",
    "calibration_bins": f"WITH {_L} SELECT floor(score * 10) / 10.0::DOUBLE AS bin, count(*) AS n, round(avg(quality), 6) AS share FROM x GROUP BY 1",
    "macro_prf": f"""WITH {_L}, z AS (SELECT quality AS y, (score >= 0.9)::INT AS z FROM x), k AS (SELECT label, count_if(y = label AND z = label) AS tp,
        count_if(z = label) AS said, count_if(y = label)::BIGINT AS support FROM z, (VALUES (0), (1)) c(label) GROUP BY 1),
        q AS (SELECT label, support, CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp::DOUBLE / support
            ELSE 0 END AS r FROM k)
        SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
            FROM q""",
    "accuracy_at_k_mrr": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        s AS (SELECT q.vec_id AS q_id, e.vec_id, e.label = q.label AS gold, round(list_sum(list_transform(range(1, len(e.v) + 1),
            lambda i: e.v[i] * q.v[i])) / (sqrt(list_sum(list_transform(e.v, lambda a: a * a))) * sqrt(list_sum(list_transform(q.v, lambda a: a * a)))),
            9) AS cosine
            FROM v e JOIN v q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
        t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, vec_id) AS place FROM s), f AS (SELECT q_id,
            min(place) FILTER (WHERE gold) AS first FROM t WHERE place <= 20 GROUP BY 1)
        SELECT count(*) AS n, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy_at_5, round(avg(coalesce(1.0::DOUBLE / first, 0)),
            6) AS mrr FROM f""",
    "krippendorff_alpha": f"""WITH {_R}, u AS (SELECT unit, count(rating) AS m, sum(rating) AS s, sum(rating * rating) AS q FROM r
        GROUP BY 1 HAVING count(rating) > 1), t AS (SELECT sum(m) AS n, sum(s) AS s, sum(q) AS q, sum(2 * (m * q - s * s) / (m - 1)) AS o FROM u)
        SELECT n::BIGINT AS n_values, round(1 - (o / n) / (2 * (n * q - s * s) / (n * (n - 1))), 9) AS alpha FROM t""",
    "pearson_spearman": f"""WITH {_R}, k AS (SELECT rating, price,
        rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0::DOUBLE AS ra,
        rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS rb FROM r)
        SELECT round(corr(rating, price), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM k""",
    "split_half": f"""WITH {_R}, u AS (SELECT unit, avg(rating) FILTER (WHERE rater % 2 = 1) AS a, avg(rating) FILTER (WHERE rater % 2 = 0) AS b FROM r
        GROUP BY 1), c AS (SELECT count(*) AS n, corr(a, b) AS r FROM u WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT n, round(r, 6) AS r, round(2 * r / (1 + r), 6) AS stepped_up FROM c""",
    "vote_mode": f"""WITH {_R}, c AS (SELECT unit, rating, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY unit
        ORDER BY n DESC, rating) AS k FROM c)
        SELECT rating, count(*) AS n_units, sum(n)::BIGINT AS n_votes FROM b WHERE k = 1 GROUP BY 1""",
    "softmax_group": f"""WITH {_C}, x AS (SELECT *, exp((value - max(value) OVER (PARTITION BY passage)) / 10.0::DOUBLE) AS e FROM c
        WHERE value IS NOT NULL), p AS (SELECT *, e / sum(e) OVER (PARTITION BY passage) AS p FROM x)
        SELECT system, round(sum(p), 4) AS mass, count_if(e = 1.0)::BIGINT AS n_first FROM p GROUP BY 1""",
    "neighbour_features": f"""WITH {_E} SELECT event_id, lag(system, 1, 'BOS') OVER w AS before, lead(system, 1, 'EOS') OVER w AS after,
        round(max(value) OVER (PARTITION BY passage ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS top,
            round(avg(value) OVER (PARTITION BY passage ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS mean3
                FROM e WINDOW w AS (PARTITION BY passage ORDER BY event_id)""",
    "asof_snap": """SELECT p.event_id, epoch_us(v.ts) AS view_us FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "resume_cells": f"WITH {_E} SELECT DISTINCT e.system, e.passage FROM e ANTI JOIN (SELECT * FROM e WHERE value >= 90) d ON d.system = e.system AND d.passage = e.passage",
    "design_factorial": """SELECT 'a=' || r_name || '|b=' || b || '|c=' || c AS config, (r_name <> 'AFRICA')::INT + (b <> 'off')::INT + (c <> 0)::INT <= 1 AS single FROM region, (VALUES ('on'), ('off')) x(b), (VALUES (0), (1), (2)) y(c)""",
    "simplex_grid_fit": """WITH x AS (SELECT l_quantity / 50.0::DOUBLE AS f, l_discount * 10.0::DOUBLE AS g, l_tax * 10.0::DOUBLE AS h, l_extendedprice AS y
        FROM lineitem), i AS (SELECT a / 10.0::DOUBLE AS a, b / 10.0::DOUBLE AS b, round(1 - a / 10.0::DOUBLE - b / 10.0::DOUBLE, 1) AS c
        FROM range(11) s(a), range(11) t(b) WHERE a + b <= 10)
        SELECT a, b, c, round(corr(a * f + b * g + c * h, y), 6) AS r FROM i, x GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1 DESC, 2 DESC LIMIT 5""",
}
