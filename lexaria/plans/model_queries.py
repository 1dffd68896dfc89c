"""Queries of fitted models: least squares, simplex fits over splits, naive Bayes, boosting, stacking, out-of-fold scores, tags to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaria.functions import text
from lexaria.functions.batches import dealt_for_fit
from lexaria.plans import evaluation_queries as eq
from lexaria.plans.text_queries import _W, read

FOLDS = 5


def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of quantity and discount (and a constant) that fit prices best: from sums of products, by Cramer's rule."""
    x = read(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50.0).alias("f"), (F.col("l_discount") * 10.0).alias("g"), (F.col("l_extendedprice") / 1000.0).alias("y")
    )
    m = x.agg(
        F.count("*").cast("double").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "fgy"),
        *(F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("ff", "gg", "fg", "fy", "gy"))
    )
    c = m.selectExpr(
        "sff - sf*sf/n AS a", "sfg - sf*sg/n AS b", "sgg - sg*sg/n AS d", "sfy - sf*sy/n AS p", "sgy - sg*sy/n AS q", "sf/n AS mf", "sg/n AS mg",
        "sy/n AS my", "n"
    )
    w = c.selectExpr("(p*d - q*b) / (a*d - b*b) AS wf", "(a*q - b*p) / (a*d - b*b) AS wg", "mf", "mg", "my", "n")
    return w.select(
        F.col("n").cast("long").alias("n"), F.round("wf", 6).alias("quantity"), F.round("wg", 6).alias("discount"),
        F.round(F.col("my") - F.col("wf") * F.col("mf") - F.col("wg") * F.col("mg"), 6).alias("constant")
    )


def split_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of five splits by order: the weights on a simplex of fifths that correlate best with price on the other four parts, and their correlation on the part."""
    x = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % FOLDS).cast("int").alias("fold"), (F.col("l_quantity") / 50.0).alias("f"),
        (F.col("l_discount") * 10.0).alias("g"), (F.col("l_tax") * 10.0).alias("h"), F.col("l_extendedprice").alias("y")
    )
    names = [*"fghy", *(a + b for a, b in ("ff", "gg", "hh", "yy", "fg", "fh", "gh", "fy", "gy", "hy"))]
    cells = [F.sum(F.col(c) if len(c) == 1 else F.col(c[0]) * F.col(c[1])).alias(f"s{c}") for c in names]
    by = x.groupBy("fold").agg(F.count("*").cast("double").alias("n"), *cells)
    total = by.agg(*(F.sum(c).alias(f"t_{c}") for c in by.columns if c != "fold"))
    both = by.crossJoin(F.broadcast(total))  # one row against a handful
    rest = both.select("fold", *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in by.columns if c != "fold"))
    i = spark.range(6).select((F.col("id") / 5.0).alias("a")).crossJoin(
        spark.range(6).select((F.col("id") / 5.0).alias("b"))
    ).filter("a + b <= 1.0000001").withColumn("c", F.round(F.lit(1.0) - F.col("a") - F.col("b"), 1))

    def r(sums: DataFrame) -> DataFrame:
        q = sums.crossJoin(F.broadcast(i)).selectExpr(
            "fold", "a", "b", "c", "n * (a*sfy + b*sgy + c*shy) - (a*sf + b*sg + c*sh) * sy AS cov",
            "n * (a*a*sff + b*b*sgg + c*c*shh + 2*a*b*sfg + 2*a*c*sfh + 2*b*c*sgh) - power(a*sf + b*sg + c*sh, 2) AS vx", "n * syy - sy * sy AS vy",
        )
        return q.select("fold", "a", "b", "c", F.round(F.expr("cov / sqrt(vx * vy)"), 6).alias("r"))

    best = r(rest).groupBy("fold").agg(F.max(F.struct("r", "a", "b", "c")).alias("x")).select("fold", "x.a", "x.b", "x.c", F.col("x.r").alias("train_r"))
    return best.join(r(by).withColumnRenamed("r", "test_r"), ["fold", "a", "b", "c"]).select("fold", "a", "b", "c", "train_r", "test_r")


def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each test item by word counts of documents: smoothed log prior plus the mean smoothed log likelihood of its known words; ties to the first language.

    Counts are by (language, word); items bring their few words to them, so no item meets all words.
    """
    d = read(spark, sf_dir, "documents").filter("lang is not null")
    per = d.groupBy("lang").agg(F.count("*").alias("docs"))
    counts = d.select("lang", F.explode(text.words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("k"))
    totals = counts.groupBy("lang").agg(F.sum("k").alias("total"))
    size = counts.agg(F.count_distinct("w").alias("v"))
    langs = per.join(totals, "lang").crossJoin(F.broadcast(size)).withColumn(
        "prior",
        F.log((F.col("docs") + 0.5) / (F.sum("docs").over(Window.partitionBy(F.lit(1))) + 0.5 * F.count("*").over(Window.partitionBy(F.lit(1)))))
    )
    items = read(spark, sf_dir, "benchmark").select(
        "item_id", F.explode(text.words(F.col("text"))).alias("w")
    ).groupBy("item_id", "w").agg(F.count("*").alias("c"))
    # the languages' counts of a word in one row, so that an item's word meets it once
    wide = counts.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("lang", "k"))).alias("by"))
    known = items.join(wide, "w").crossJoin(F.broadcast(langs)).select(
        "item_id", "lang", "prior", "c",
        F.log((F.coalesce(F.try_element_at("by", F.col("lang")), F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("v"))).alias("ll")
    )
    scored = known.groupBy("item_id", "lang").agg(F.round(F.first("prior") + F.sum(F.col("c") * F.col("ll")) / F.sum("c"), 6).alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "lang")
    return scored.withColumn("place", F.row_number().over(best)).filter("place = 1").select("item_id", "lang", "score")


def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of consecutive turns (B where the role changes to assistant, I while it stays, O else) as spans."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    tag = F.when(F.col("role") != "assistant", "O").when(F.lag("role").over(w).eqNullSafe(F.lit("assistant")), "I").otherwise("B")
    t = t.withColumn("tag", tag).withColumn("span", F.sum(F.when(F.col("tag") == "B", 1).otherwise(0)).over(w)).filter("tag <> 'O'")
    return t.groupBy("conv_id", "span").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", *(c.alias(k) for k, c in eq.text_features().items()))
    labels = read(spark, sf_dir, "labels")
    x = labels.join(d, "doc_id").withColumn("y", F.col("quality").cast("double")).withColumn("fold", (F.crc32(F.coalesce("source", F.lit(""))) % FOLDS).cast("int"))
    return dealt_for_fit(x, "doc_id", labels.count())


def _assembled(rows: DataFrame, columns: list[str], out: str, invalid: str = "skip") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid=invalid).transform(rows)


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of quality of each labelled text by a logistic model of the other folds; folds are whole sources."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    x = _assembled(_features(spark, sf_dir), ["f", "g", "h"], "raw", "error").cache()
    out = None
    for k in range(FOLDS):
        train = x.filter(F.col("fold") != k)
        if train.select("y").distinct().count() < 2:
            continue
        model = Pipeline(
            stages=[StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", regParam=0.1, maxIter=20)]
        ).fit(train)
        part = model.transform(x.filter(F.col("fold") == k)).select("doc_id", "source", "quality", F.round(vector_to_array("probability")[1], 4).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, source string, quality int, p double")


def boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient boosting and a logistic model fitted on four folds: each one's probability on the fifth, and their weighted decision."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import vector_to_array

    x = _assembled(_features(spark, sf_dir), ["f", "g", "h"], "x", "error").cache()
    train, test = x.filter("fold <> 0"), x.filter("fold = 0")
    p = lambda df, name: df.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    out = p(GBTClassifier(featuresCol="x", labelCol="y", maxIter=10, maxDepth=3, seed=7).fit(train).transform(test), "boosted")
    out = p(LogisticRegression(featuresCol="x", labelCol="y", regParam=0.1).fit(train).transform(out), "logistic")
    return out.select(
        "doc_id", "quality", F.round("boosted", 4).alias("boosted"), F.round("logistic", 4).alias("logistic"),
        ((F.col("boosted") * 0.6 + F.col("logistic") * 0.4) >= 0.5).alias("accepted")
    )


def boosted_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts by boosted trees on six features, clipped to the range seen; fitted on four fifths by key."""
    from pyspark.ml.regression import GBTRegressor

    p = read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("a"), F.length("p_name").cast("double").alias("b"),
        F.length("p_type").cast("double").alias("c"), (F.col("p_partkey") % 10).cast("double").alias("d"), (F.col("p_partkey") / 1000.0).alias("e"),
        F.length("p_brand").cast("double").alias("g")
    )
    x = _assembled(dealt_for_fit(p, "p_partkey", p.count()), ["a", "b", "c", "d", "e", "g"], "x")
    train = x.filter("p_partkey % 5 <> 0")
    low, high = train.agg(F.min("y"), F.max("y")).first()
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=10, maxDepth=4, seed=7).fit(train)
    return model.transform(x.filter("p_partkey % 5 = 0")).select(
        "p_partkey", F.round(F.least(F.greatest("prediction", F.lit(low)), F.lit(high)), 2).alias("price")
    )


QUERIES = {f.__name__: f for f in (least_squares, split_robustness, naive_bayes, bio_spans, out_of_fold, boosted_quality, boosted_price)}

ORACLES = {
    "least_squares": """WITH x AS (SELECT l_quantity / 50.0::DOUBLE AS f, l_discount * 10.0::DOUBLE AS g, l_extendedprice / 1000.0::DOUBLE AS y
        FROM lineitem),
        c AS (SELECT count(*) AS n, covar_pop(f, f) AS a, covar_pop(f, g) AS b, covar_pop(g, g) AS d, covar_pop(f, y) AS p, covar_pop(g, y) AS q,
            avg(f) AS mf, avg(g) AS mg, avg(y) AS my FROM x), w AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS wf,
            (a * q - b * p) / (a * d - b * b) AS wg FROM c)
        SELECT n, round(wf, 6) AS quantity, round(wg, 6) AS discount, round(my - wf * mf - wg * mg, 6) AS constant FROM w""",
    "split_robustness": """WITH x AS (SELECT (l_orderkey % 5)::INT AS fold, l_quantity / 50.0::DOUBLE AS f, l_discount * 10.0::DOUBLE AS g, l_tax * 10.0::DOUBLE AS h, l_extendedprice AS y FROM lineitem),
        i AS (SELECT a / 5.0::DOUBLE AS a, b / 5.0::DOUBLE AS b, round(1 - a / 5.0::DOUBLE - b / 5.0::DOUBLE, 1) AS c FROM range(6) s(a), range(6) t(b) WHERE a + b <= 5), k AS (SELECT DISTINCT fold AS k FROM x),
        r AS (SELECT k AS fold, a, b, c, round(corr(a * f + b * g + c * h, y) FILTER (WHERE fold <> k), 6) AS train_r, round(corr(a * f + b * g + c * h, y) FILTER (WHERE fold = k), 6) AS test_r FROM x, i, k GROUP BY ALL),
        s AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_r DESC, a DESC, b DESC, c DESC) AS place FROM r) SELECT fold, a, b, c, train_r, test_r FROM s WHERE place = 1""",
    "naive_bayes": f"""WITH d AS (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY 1), c AS (SELECT lang, w, count(*) AS k
        FROM (SELECT lang, unnest({_W}) AS w FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2), t AS (SELECT lang, sum(k) AS total FROM c GROUP BY 1),
        v AS (SELECT count(DISTINCT w) AS v FROM c), l AS (SELECT lang, total, v, ln((docs + 0.5::DOUBLE) / ((SELECT sum(docs)
            FROM d) + 0.5::DOUBLE * (SELECT count(*) FROM d))) AS prior FROM d JOIN t USING (lang), v),
        i AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({_W}) AS w FROM benchmark) WHERE w IN (SELECT w FROM c) GROUP BY 1, 2),
        s AS (SELECT item_id, l.lang, round(any_value(prior) + sum(n * ln((coalesce(k, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * v))) / sum(n), 6) AS score
            FROM i CROSS JOIN l LEFT JOIN c ON c.lang = l.lang AND c.w = i.w GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lang) AS place FROM s) SELECT item_id, lang, score FROM r
            WHERE place = 1""",
    "bio_spans": """WITH t AS (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN 'O' WHEN lag(role) OVER w = 'assistant' THEN 'I' ELSE 'B' END AS tag
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        s AS (SELECT *, sum((tag = 'B')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM t) SELECT conv_id, span::BIGINT AS span,
            min(turn) AS first, max(turn) AS last, count(*) AS n FROM s WHERE tag <> 'O' GROUP BY 1, 2""",
}
