"""Queries of studies: records of the formulas, SARI with counts, thresholds, agreement, bands, funnels and lookups."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaria.functions import measures, text
from lexaria.functions.batches import column_of, rows_of
from lexaria.operators import corpus
from lexaria.operators import evaluation as ev
from lexaria.plans import evaluation_queries as eq
from lexaria.plans import text_queries as tq
from lexaria.plans.text_queries import read

# Endings that a lookup takes off.
ENDINGS = ["s", "es", "ed", "ing"]


def formula_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity, simplicity, preservation, utility and verdict of each text and its rewrite."""
    r = rows_of(tq._rewrites(spark, sf_dir).filter("a is not null and b is not null"), measures.record, measures.RECORD, ["doc_id"], ["a", "b"])
    names = [f.split()[0] for f in measures.RECORD.split(", ")]
    return r.select("doc_id", *(F.round(c, 6).alias(c) for c in names if c != "accepted"), "accepted")


def formula_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every value, number of records and share of accepted ones; no records are an error."""
    r = formula_record(spark, sf_dir)
    means = r.agg(
        F.count("*").alias("records"), *(F.round(F.avg(c), 5).alias(f"mean_{c}") for c in r.columns if c not in ("doc_id", "accepted")),
        F.round(F.avg(F.col("accepted").cast("double")), 6).alias("accepted_rate")
    )
    return means.withColumn("records", F.when(F.col("records") == 0, F.raise_error(F.lit("there are no records"))).otherwise(F.col("records")))


def sari_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARI of 13a tokens and gram counts against two references; empty sets count 1."""
    score = column_of(lambda t, o, r: measures.sari(t, o, r), "double")
    return tq._turns(spark, sf_dir).select("conv_id", "turn", F.round(score(F.col("t"), F.col("o"), F.array("r", "q")), 6).alias("sari"))


def sari_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean sentence SARI; every sentence has two references."""
    return sari_sentence(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("sari"), 5).alias("sari"))


def threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest threshold of a grid with the largest F1."""
    c = ev.confusion(eq._scored_labels(spark, sf_dir), "score", "quality", eq.GRID).withColumn("f1", F.round("f1", 9))
    return c.orderBy(F.desc_nulls_last("f1"), "threshold").limit(1).select("threshold", "tp", "fp", "f1")


def bootstrap_cluster_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 draws of the mean text length with whole sources drawn: sums by source first, so draws touch sources and not rows."""
    by = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("s"), F.count("*").alias("n"))
    long = by.select("source", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("draw"))
    h = ev.hash_draw(F.concat("source", F.lit(":"), F.col("draw").cast("string")))
    # Cumulative Poisson(1) probabilities, times 2**32.
    times = sum((F.when(h >= s, 1).otherwise(0) for s in (1580030169, 3160060337, 3950075421, 4213413783)), F.lit(0))
    d = long.withColumn("k", times).groupBy("draw").agg(F.sum(F.col("k") * F.col("s")).alias("s"), F.sum(F.col("k") * F.col("n")).alias("n"))
    return d.filter("n > 0").select("draw", F.round(F.col("s") / F.col("n"), 4).alias("mean"))


def bigram_context_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log probability ln((c(a b) + 0.1) / (c(a) + 0.1 V)) of each document's word pairs; counts over all documents.

    A document's pairs are counted where its row is, so one row a document and distinct
    pair goes on, with 64-bit hashes in place of words; it is shuffled once, to meet the
    pair's count (a pair that most documents have is split by adaptive execution). Tables of
    words and pairs grow with the documents: they are sorted and merged, and never broadcast.
    """

    def pairs(t: str) -> list[tuple[str, str, int]]:
        w = ["<s>", *re.findall("[a-z]+(?:['-][a-z]+)*", t.lower()), "</s>"]
        return [(a, b, n) for (a, b), n in Counter(zip(w, w[1:])).items()]

    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    per = rows_of(docs, pairs, "a string, b string, n long", ["doc_id"], ["text"]).select("doc_id", F.xxhash64("a").alias("a"), F.xxhash64("a", "b").alias("ab"), "n")
    both = per.groupBy("ab", "a").agg(F.sum("n").alias("k"))
    one = both.groupBy("a").agg(F.sum("k").alias("na"))
    size = one.agg(F.count("*").cast("double").alias("v"))
    scored = both.join(one.hint("merge"), "a").crossJoin(F.broadcast(size)).select("ab", F.log((F.col("k") + 0.1) / (F.col("na") + F.col("v") * 0.1)).alias("lp"))
    sums = per.select("doc_id", "ab", "n").join(scored.hint("merge"), "ab").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("lp")).alias("s"))
    return sums.select("doc_id", "n", F.round(F.col("s") / F.col("n"), 6).alias("score"))


def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, the pairs of lines whose spans [ship day, ship day + quantity) overlap, half open. An order has seven lines at most."""
    s = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).alias("a"),
        F.col("l_quantity").cast("int").alias("n")
    ).withColumn("b", F.col("a") + F.col("n"))
    t = s.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("a").alias("c"), F.col("b").alias("d"))
    hit = s.join(t, "l_orderkey").filter("l_linenumber < m AND a < d AND c < b")
    return hit.groupBy("l_orderkey").agg(F.count("*").alias("n_pairs"), F.sum(F.least("b", "d") - F.greatest("a", "c")).alias("days"))


def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark in the lexicon of all document words: exact, else with the first ending off that is there, else the lexicon's median."""
    words = read(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("value"))
    # the median from counts of values, as values are few and words are many
    by = words.groupBy("value").agg(F.count("*").alias("n"))
    median = by.agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("median"))
    b = read(spark, sf_dir, "benchmark").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    tries = F.array(F.col("word"), *(F.when(F.col("word").endswith(e), F.expr(f"left(word, length(word) - {len(e)})")) for e in ENDINGS))
    found = b.select("word", F.posexplode(tries).alias("place", "stem")).join(words, "stem", "left").groupBy("word").agg(
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("place"))).alias("value")
    )
    return found.crossJoin(F.broadcast(median)).select(
        "word", F.coalesce(F.col("value").cast("double"), F.col("median")).alias("value"), F.col("value").isNotNull().alias("known")
    )


def locked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a locked list names by id or by text hash: a semi join for each way, united, in place of one join on 'or'."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    lock = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    hashes = d.join(lock, "doc_id", "left_semi").select("h").distinct()
    return d.join(lock, "doc_id", "left_semi").unionByName(d.join(hashes, "h", "left_semi").select("doc_id", "h")).select("doc_id").distinct()


def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage's value from the first system that has one: purchase, then click, then view."""
    order = F.when(F.col("system") == "purchase", 0).when(F.col("system") == "click", 1).when(F.col("system") == "view", 2)
    c = eq._cells(spark, sf_dir).withColumn("p", order).filter("p IS NOT NULL AND value IS NOT NULL")
    return c.groupBy("passage").agg(F.min_by("system", "p").alias("system"), F.round(F.min_by("value", "p"), 6).alias("value"))


def nominal_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha for nominal values, from counts by unit and value."""
    c = eq._ratings(spark, sf_dir).groupBy("unit", "rating").agg(F.count("*").cast("double").alias("k"))
    u = c.withColumn("m", F.sum("k").over(Window.partitionBy("unit"))).filter("m > 1")
    v = u.groupBy("rating").agg(F.sum("k").alias("nc"), F.sum(F.col("k") * (F.col("m") - F.col("k")) / (F.col("m") - 1)).alias("o"))
    s = v.agg(F.sum("nc").alias("n"), F.sum("o").alias("o"), F.sum(F.col("nc") * F.col("nc")).alias("q"))
    return s.select(
        F.col("n").cast("long").alias("n_values"),
        F.round(F.lit(1.0) - (F.col("n") - 1) * F.col("o") / (F.col("n") * F.col("n") - F.col("q")), 9).alias("alpha")
    )


def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tests of the labelled texts (score below 0.9, under 400 characters) against each other, with the correlation of their values."""
    x = eq._scored_labels(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    a, b = F.col("score") < 0.9, F.col("n_chars") < 400
    return x.agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"),
        F.count_if(~a & ~b).alias("neither"), F.round(F.corr("score", F.col("n_chars").cast("double")), 6).alias("r")
    )


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eq._scored_labels(spark, sf_dir).withColumn(
        "band", F.when(F.col("score") >= 0.95, 3).when(F.col("score") >= 0.9, 2).when(F.col("score") >= 0.8, 1).otherwise(0)
    )


def weighted_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of 'band 2 or more means quality', weighted so that each band counts as it does among all documents."""
    d = read(spark, sf_dir, "documents").select(eq.letter_share().alias("s")).withColumn("score", eq.floored(F.col("s"), 100))
    pop = d.groupBy(
        F.when(F.col("score") >= 0.95, 3).when(F.col("score") >= 0.9, 2).when(F.col("score") >= 0.8, 1).otherwise(0).alias("band")
    ).agg(F.count("*").cast("double").alias("n_all"))
    by = _banded(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))
    w = by.join(pop, "band").withColumns({"w_good": F.col("good") * F.col("n_all") / F.col("n"), "hit": F.col("band") >= 2})
    tp, said, gold = F.sum(F.when(F.col("hit"), F.col("w_good"))), F.sum(F.when(F.col("hit"), F.col("n_all"))), F.sum("w_good")
    return w.agg(F.sum("n").alias("n"), F.round(tp / said, 6).alias("precision"), F.round(tp / gold, 6).alias("recall"))


def band_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(spark, sf_dir).groupBy("band").agg(
        F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"),
        F.min("score").alias("least")
    )


def precise_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the grid's thresholds with a precision of 0.5 or more on 20 hits or more, the one with most hits; of equal ones the smallest."""
    c = ev.confusion(eq._scored_labels(spark, sf_dir), "score", "quality", eq.GRID).withColumn("hits", F.col("tp") + F.col("fp"))
    return c.filter("precision >= 0.5 AND hits >= 20").orderBy(F.desc("hits"), "threshold").limit(1).select(
        "threshold", "hits", F.round("precision", 6).alias("precision")
    )


def best_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loosest score with most right decisions (accept at or above it), and the middle between it and the next lower score."""
    c = eq._scored_labels(spark, sf_dir).groupBy("score").agg(F.sum("quality").cast("long").alias("good"), F.count("*").alias("n"))
    total = c.agg(F.sum(F.col("n") - F.col("good")).alias("bad"))
    x = ev.before(c, "score", F.col("good") * 2 - F.col("n"), "above", descending=True).withColumn("right", F.col("above") + F.col("good") * 2 - F.col("n"))
    best = x.crossJoin(F.broadcast(total)).select("score", (F.col("right") + F.col("bad")).alias("right")).orderBy(F.desc("right"), "score").limit(1)
    below = best.join(c.select(F.col("score").alias("s")), F.col("s") < F.col("score"), "left").groupBy("score", "right").agg(F.max("s").alias("below"))
    return below.select("score", "right", F.round((F.col("score") + F.coalesce("below", "score")) / 2.0, 6).alias("cutoff"))


def miss_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages without a purchase, by the first stage that has no event; the others as found."""
    c = eq._events(spark, sf_dir).groupBy("passage").agg(*(F.count_if(F.col("system") == s).alias(s) for s in ("view", "click", "purchase")))
    stage = F.when(F.col("purchase") > 0, "found").when(F.col("view") == 0, "view").when(F.col("click") == 0, "click").otherwise("purchase")
    return c.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def sole_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per check of the parts: how many fail it, and how many fail it alone."""
    p = read(spark, sf_dir, "part")
    failed = F.filter(
        F.array(
            F.when(F.col("p_size") > 40, "size"), F.when(F.col("p_retailprice") > 1500, "price"), F.when(F.length("p_name") > 30, "name"),
            F.when(F.col("p_type").startswith("P"), "type")
        ),
        lambda c: c.isNotNull()
    )
    return p.select(failed.alias("f")).select(F.explode("f").alias("check"), F.size("f").alias("k")).groupBy("check").agg(
        F.count("*").alias("failed"), F.count_if(F.col("k") == 1).alias("sole")
    )


def rating_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of each supplier by return flag as columns, and its number of distinct parts."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    return g.agg(
        *(F.round(F.avg(F.when(F.col("l_returnflag") == k, F.col("l_quantity"))), 6).alias(f"mean_{k.lower()}") for k in "ANR"),
        F.count_distinct("l_partkey").alias("n_parts")
    )


def rating_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of ratings on one scale: quantity / 50 and (discount * 100 + 2) / 12, mean by source and part."""
    li = read(spark, sf_dir, "lineitem")
    both = li.select(
        F.explode(
            F.array(
                F.struct(F.lit("q").alias("source"), (F.col("l_quantity") / 50.0).alias("y")),
                F.struct(F.lit("d").alias("source"), ((F.col("l_discount") * 100.0 + 2.0) / 12.0).alias("y"))
            )
        ).alias("x"),
        "l_partkey"
    )
    return both.groupBy("x.source", "l_partkey").agg(F.round(F.avg("x.y"), 6).alias("mean"), F.count("*").alias("n"))


def listwise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell of a passage: value less the passage's best, place, and number of cells."""
    by = Window.partitionBy("passage")
    return eq._cells(spark, sf_dir).select(
        "passage", "system", F.round(F.col("value") - F.max("value").over(by), 6).alias("behind"),
        F.row_number().over(by.orderBy(F.desc("value"), "system")).cast("long").alias("place"), F.count("*").over(by).alias("size")
    )


def passage_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two systems of a passage with the largest value times the root of their events (a top-k window, cut on the map side)."""
    c = eq._cells(spark, sf_dir).withColumn("key", F.round(F.col("value") * F.sqrt("n"), 6))
    place = F.row_number().over(Window.partitionBy("passage").orderBy(F.desc("key"), "system"))
    return c.withColumn("place", place.cast("long")).filter("place <= 2").select("passage", "system", "key", "place")


def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand by the sum of their places by price and by size; the best three."""
    by = Window.partitionBy("p_brand")
    x = read(spark, sf_dir, "part").withColumn(
        "total", F.row_number().over(by.orderBy("p_retailprice", "p_partkey")) + F.row_number().over(by.orderBy(F.desc("p_size"), "p_partkey"))
    )
    return x.withColumn(
        "place", F.row_number().over(by.orderBy("total", "p_partkey")).cast("long")
    ).filter("place <= 3").select("p_brand", "p_partkey", F.col("total").cast("long").alias("total"), "place")


def modal_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent size of each brand's parts, the smaller of equals; from counts."""
    c = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return c.groupBy("p_brand").agg(F.max(F.struct("n", (-F.col("p_size")).alias("low"))).alias("b")).select("p_brand", (-F.col("b.low")).alias("edge"), "b.n")


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the state their passage is in: the last view, click or purchase at or before them, 'front' before any."""
    w = Window.partitionBy("passage").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(F.when(F.col("system").isin("click", "purchase"), F.col("system")), True).over(w), F.lit("front"))
    return eq._events(spark, sf_dir).withColumn("state", state).groupBy("state", "system").agg(F.count("*").alias("n"))


def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration ids back into their parameters, without those at their default."""
    m = F.str_to_map("config", F.lit("[|]"), F.lit("="))
    return eq.design_factorial(spark, sf_dir).select("config", m["a"].alias("a"), F.nullif(m["b"], F.lit("off")).alias("b"), m["c"].cast("int").alias("c"))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their median and largest value, overall, by system, and by system and weekday."""
    x = read(spark, sf_dir, "events").select("event_type", F.weekday("ts").alias("day"), "value")
    none = {"event_type": F.lit(None).cast("string"), "day": F.lit(None).cast("int")}
    out = None
    for level, by in ((0, ["event_type", "day"]), (1, ["event_type"]), (3, [])):
        sums = x.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("most"))
        median = ev.exact_quantiles(x, by, "value", [0.5])
        both = sums.join(median, by, "left") if by else sums.crossJoin(F.broadcast(median))
        part = both.select(
            *(F.col(c) if c in by else none[c].alias(c) for c in none), F.lit(level).cast("long").alias("level"), "n",
            F.round("q0", 6).alias("median"), "most"
        )
        out = part if out is None else out.unionByName(part)
    return out


def conversation_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and grade of each conversation's assistant turns; counts add up, so the texts are never put together."""
    c = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    n = rows_of(c, text.counts_f, text.COUNTS_F, ["conv_id"], ["text"])
    s = n.groupBy("conv_id").agg(*(F.sum(k).alias(k) for k in ("n_words", "n_sentences", "n_syllables", "n_poly", "n_long")))
    return s.select("conv_id", "n_words", "n_sentences", F.round(text.scores_f({k: F.col(k) for k in s.columns})["grade"], 6).alias("grade"))


def panel_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of the test items and the documents, less normalised texts of toxic documents: the 50 smallest hashes."""
    norm = F.sha2(text.normalised(F.col("text")), 256)
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "doc_id", norm.alias("norm"))
    b = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), norm.alias("norm"))
    bad = d.join(read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id")
    panel = corpus.exclude(d.select("id", "norm").unionByName(b), "norm", bad, "norm")
    return corpus.smallest_hashes(panel.select("id"), corpus.hash_order(F.lit("15"), F.col("id")), 50)


QUERIES = {
    f.__name__: f
    for f in (formula_record, formula_summary, sari_sentence, sari_corpus, threshold_f1, bootstrap_cluster_hash, bigram_context_score, span_overlap, lexicon_lookup, locked_rows, priority_lookup, nominal_alpha, cross_tab, weighted_precision, band_means, precise_threshold,
              best_cutoff, miss_partition, sole_failures, rating_pivot, rating_union, listwise_features, passage_shortlist, rank_sum, modal_edge, event_states, config_parse, latency_summary, conversation_grade, panel_assembly)
}

_E, _C, _L, _R = eq._E, eq._C, eq._L, eq._R
_NORM = "sha256(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' '))"
_BAND = "CASE WHEN score >= 0.95 THEN 3 WHEN score >= 0.9 THEN 2 WHEN score >= 0.8 THEN 1 ELSE 0 END"
_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_NUM = r"'\b\d[\d,]*(?:\.\d+)?\b'"
_DAY = r"'(?i)\b(?:\d{1,4}[/-]\d{1,2}[/-]\d{1,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b'"
_QTY = r"'(?i)\b\d[\d,]*(?:\.\d+)?\s*(?:kg|g|lb|lbs|m|cm|km|%|percent)\b'"
_FOLD = lambda x: f"replace(lower({x}), 'ß', 'ss')"
_HAS = lambda items: f"len({items}) AS n_{items}, len(list_filter({items}, lambda i: contains(fb, {_FOLD('i')}))) AS k_{items}"
_FORMULA = f"""{tq._TEXTS_SQL}, {tq._sums_sql(measures.DEFAULT_WORD)},
    j AS (SELECT doc_id, coalesce(sum(k) FILTER (WHERE side = 'a'), 0) AS a, coalesce(sum(k) FILTER (WHERE side = 'b'), 0) AS b FROM k
        WHERE w IN {_IN(measures.TERMS)} GROUP BY 1),
    o AS (SELECT doc_id, w, coalesce(sum(k) FILTER (WHERE side = 'a'), 0) AS a, coalesce(sum(k) FILTER (WHERE side = 'b'), 0) AS b FROM k GROUP BY 1, 2),
    v AS (SELECT doc_id, sum(least(o.a, o.b))::DOUBLE AS shared, count_if(o.a > 0 AND o.b > 0)::DOUBLE AS twice, count(*) AS many,
        list(w) FILTER (WHERE o.a > 0 AND w IN {_IN(measures.NEGATIONS)}) AS neg,
        count_if(o.a > 0 AND w IN {_IN(measures.TERMS)}) AS n_term, count_if(o.a > 0 AND o.b > 0 AND w IN {_IN(measures.TERMS)}) AS k_term FROM o GROUP BY 1),
    i AS (SELECT t.doc_id, {_FOLD("b")} AS fb, list_filter(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x,
        '[A-Z][a-z]+')) AS name, list_transform(regexp_extract_all(a, {_NUM}), lambda x: replace(x, ',', '')) AS num,
        list_transform(regexp_extract_all(b, {_NUM}), lambda x: replace(x, ',', '')) AS num_b, regexp_extract_all(a, {_DAY}) AS day, regexp_extract_all(a,
            {_QTY}) AS qty, coalesce(neg, []) AS neg, coalesce(shared, 0) AS shared, coalesce(twice, 0) AS twice,
        greatest(coalesce(many, 0), 1) AS many, coalesce(n_term, 0) AS n_term, coalesce(k_term, 0) AS k_term FROM t LEFT JOIN v USING (doc_id)),
    u AS (SELECT *, {_HAS("name")}, len(num) AS n_num, len(list_filter(num, lambda x: list_contains(num_b, x))) AS k_num, {_HAS("day")}, {_HAS("qty")},
        {_HAS("neg")} FROM i),
    g AS (SELECT doc_id, shared, twice / many AS m_embedding,
        list_filter([{", ".join(f"CASE WHEN n_{c} > 0 THEN k_{c}::DOUBLE / n_{c} END" for c in ("name", "num", "day", "qty", "neg", "term"))}],
        lambda x: x IS NOT NULL) AS p FROM u),
    d AS (SELECT g.doc_id, ra.c AS word_complexity_before, rb.c AS word_complexity_after, {tq._reduced("ra.hard", "rb.hard")} AS s_lex, least(1, greatest(0,
        rb.score - ra.score + 0.5)) AS s_read, {tq._reduced("coalesce(j.a, 0)", "coalesce(j.b, 0)")} AS s_jargon,
        shared / ra.m AS m_tfidf, m_embedding, (shared / ra.m + shared / rb.m) / 2 AS m_nli, CASE WHEN len(p) = 0 THEN 1.0::DOUBLE
            ELSE list_sum(p) / len(p) END AS p_critical
        FROM g JOIN r ra ON ra.doc_id = g.doc_id AND ra.side = 'a' JOIN r rb ON rb.doc_id = g.doc_id AND rb.side = 'b' LEFT JOIN j ON j.doc_id = g.doc_id),
    l AS (SELECT *, (s_lex + s_read + s_jargon) / 3 AS s, (m_tfidf + m_embedding + m_nli) / 3 AS m_avg FROM d), z AS (SELECT *,
        0.5 * m_avg + 0.5 * p_critical AS p_meaning FROM l), zz AS (SELECT *, 1 - p_meaning AS loss_info, s - (1 - p_meaning) AS u FROM z),
    y AS (SELECT doc_id, {", ".join(f"round({c}, 6) AS {c}" for c in ("word_complexity_before", "word_complexity_after", "s_lex", "s_read", "s_jargon", "s", "m_tfidf", "m_embedding", "m_nli", "m_avg", "p_critical", "p_meaning", "loss_info", "u"))},
        loss_info <= 0.2 AND p_critical = 1 AS accepted FROM zz)"""
_VALUES = [c.split()[0] for c in measures.RECORD.split(",") if not c.endswith("boolean")]


def _tok(x: str) -> str:
    """SQL for the 13a tokens of a text."""
    x = f"replace(replace(replace(lower({x}), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"' ' || {x} || ' '"
    for pattern, by in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


_ALL_GRAMS = " UNION ALL ".join(
    f"SELECT conv_id, turn, {n} AS n, '{k}' AS k, unnest(CASE WHEN len({c}) >= {n} THEN list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' ')) ELSE [] END) AS g FROM l" for c,
    k in (("t", "s"), ("o", "c"), ("r", "r"), ("q", "r")) for n in range(1, 5)
)
_SARI = f"""w AS (SELECT conv_id, turn, role, text AS t, lead(text) OVER w AS o, lead(text, 2) OVER w AS r, lead(text, 3) OVER w AS q
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    l AS (SELECT conv_id, turn, {", ".join(f"{_tok(c)} AS {c}" for c in "torq")} FROM w WHERE role = 'user' AND t IS NOT NULL AND o IS NOT NULL
        AND r IS NOT NULL AND q IS NOT NULL),
    x AS ({_ALL_GRAMS}), c AS (SELECT conv_id, turn, n, g, count_if(k = 's')::BIGINT AS s, count_if(k = 'c')::BIGINT AS c, count_if(k = 'r')::BIGINT AS r
        FROM x GROUP BY ALL),
    d AS (SELECT *, 2 * least(s, c) AS keep, 2 * greatest(s - c, 0) AS gone, least(2 * s, r) AS wanted FROM c), e AS (SELECT conv_id, turn, unnest([1, 2, 3,
        4]) AS n FROM l),
    m AS (SELECT e.conv_id, e.turn, e.n, coalesce(avg(least(keep, r)::DOUBLE / keep) FILTER (WHERE keep > 0), 1) AS p, CASE WHEN sum(wanted) > 0
        THEN sum(least(keep, r))::DOUBLE / sum(wanted) ELSE 1 END AS q,
        coalesce(avg(greatest(gone - r, 0)::DOUBLE / gone) FILTER (WHERE gone > 0), 1) AS d, coalesce(avg((r > 0)::INT) FILTER (WHERE s = 0 AND c > 0),
            1) AS u, coalesce(avg((c > 0)::INT) FILTER (WHERE s = 0 AND r > 0), 1) AS v
        FROM e LEFT JOIN d ON d.conv_id = e.conv_id AND d.turn = e.turn AND d.n = e.n GROUP BY ALL),
    y AS (SELECT conv_id, turn, round(sum(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END + d + CASE WHEN u + v > 0 THEN 2 * u * v / (u + v)
        ELSE 0 END) / 12.0::DOUBLE * 100, 6) AS sari FROM m GROUP BY 1, 2)"""
_GRID = f"""{_L}, t AS (SELECT unnest({eq.GRID}::DOUBLE[]) AS threshold), k AS (SELECT threshold, count_if(score >= threshold AND quality = 1)::BIGINT AS tp,
    count_if(score >= threshold AND quality = 0)::BIGINT AS fp, count_if(score < threshold AND quality = 1)::BIGINT AS fn FROM x, t GROUP BY 1)"""

ORACLES = {
    "formula_record": f"WITH {_FORMULA} SELECT * FROM y",
    "formula_summary": f"WITH {_FORMULA} SELECT count(*) AS records, {', '.join(f'round(avg({c}), 5) AS mean_{c}' for c in _VALUES)}, round(avg(accepted::INT), 6) AS accepted_rate FROM y",
    "sari_sentence": f"WITH {_SARI} SELECT * FROM y",
    "sari_corpus": f"WITH {_SARI} SELECT count(*) AS n, round(avg(sari), 5) AS sari FROM y",
    "threshold_f1": f"WITH {_GRID} SELECT threshold, tp, fp, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM k ORDER BY 4 DESC NULLS LAST, 1 LIMIT 1",
    "bootstrap_cluster_hash": """WITH b AS (SELECT source, sum(n_chars)::DOUBLE AS s, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT draw, s, n,
        ('0x' || substr(md5(source || ':' || draw), 1, 8))::BIGINT AS h FROM b, range(30) t(draw)),
        w AS (SELECT *, (h >= 1580030169)::INT + (h >= 3160060337)::INT + (h >= 3950075421)::INT + (h >= 4213413783)::INT AS k FROM k)
            SELECT draw::INT AS draw, round(sum(k * s) / sum(k * n), 4) AS mean FROM w GROUP BY 1 HAVING sum(k * n) > 0""",
    "bigram_context_score": f"""WITH w AS (SELECT doc_id, list_concat(['<s>'], {tq._W}, ['</s>']) AS w FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM w),
        ab AS (SELECT p, count(*) AS ab FROM p GROUP BY 1), a AS (SELECT p[1] AS a, count(*) AS na FROM p GROUP BY 1), v AS (SELECT count(*)::DOUBLE AS v
            FROM a)
        SELECT doc_id, count(*) AS n, round(avg(ln((ab + 0.1::DOUBLE) / (na + v * 0.1::DOUBLE))), 6) AS score FROM p JOIN ab USING (p)
            JOIN a ON a.a = p.p[1], v GROUP BY 1""",
    "span_overlap": """WITH s AS (SELECT l_orderkey, l_linenumber AS m, l_shipdate::DATE - DATE '1970-01-01' AS a,
        l_shipdate::DATE - DATE '1970-01-01' + l_quantity::INT AS b FROM lineitem)
        SELECT s.l_orderkey, count(*) AS n_pairs, sum(least(s.b, t.b) - greatest(s.a, t.a))::BIGINT AS days FROM s JOIN s t ON s.l_orderkey = t.l_orderkey
            AND s.m < t.m AND s.a < t.b AND t.a < s.b GROUP BY 1""",
    "lexicon_lookup": f"""WITH x AS (SELECT stem, count(*) AS value FROM (SELECT unnest({tq._W}) AS stem FROM documents) GROUP BY 1),
        b AS (SELECT DISTINCT unnest({tq._W}) AS word FROM benchmark),
        t AS (SELECT word, 0 AS place, word AS stem
            FROM b {" ".join(f"UNION ALL SELECT word, {i + 1}, left(word, length(word) - {len(e)}) FROM b WHERE word LIKE '%{e}'" for i, e in enumerate(ENDINGS))}),
        f AS (SELECT word, arg_min(value, place) FILTER (WHERE value IS NOT NULL) AS value FROM t LEFT JOIN x USING (stem) GROUP BY 1) SELECT word,
            coalesce(value::DOUBLE, (SELECT median(value)::DOUBLE FROM x)) AS value, value IS NOT NULL AS known FROM f""",
    "locked_rows": "WITH t AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id FROM documents WHERE doc_id IN (FROM t) OR sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id IN (FROM t))",
    "priority_lookup": f"""WITH {_C}, p AS (SELECT *, CASE system WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS p FROM c
        WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY p) AS k FROM p WHERE p IS NOT NULL)
        SELECT passage, system, round(value, 6) AS value FROM r WHERE k = 1""",
    "nominal_alpha": f"""WITH {_R}, u AS (SELECT unit, rating, count(*)::DOUBLE AS k FROM r GROUP BY 1, 2), v AS (SELECT *,
        sum(k) OVER (PARTITION BY unit) AS m FROM u), o AS (SELECT sum(k) AS n, sum(k * (m - k) / (m - 1)) AS o FROM v WHERE m > 1),
        e AS (SELECT sum(nc * nc) AS q FROM (SELECT rating, sum(k) AS nc FROM v WHERE m > 1 GROUP BY 1)) SELECT n::BIGINT AS n_values,
            round(1 - (n - 1) * o / (n * n - q), 9) AS alpha FROM o, e""",
    "cross_tab": f"""WITH {_L}, d AS (SELECT x.*, n_chars FROM x JOIN documents USING (doc_id)) SELECT count_if(score < 0.9
        AND n_chars < 400)::BIGINT AS "both", count_if(score < 0.9 AND n_chars >= 400)::BIGINT AS first_only, count_if(score >= 0.9
        AND n_chars < 400)::BIGINT AS second_only,
        count_if(score >= 0.9 AND n_chars >= 400)::BIGINT AS neither, round(corr(score, n_chars), 6) AS r FROM d""",
    "weighted_precision": f"""WITH {_L}, a AS (SELECT floor(length(regexp_replace(text, '[^\\p{{L}} ]', '',
        'g'))::DOUBLE / length(text) * 100) / 100.0::DOUBLE AS score FROM documents), p AS (SELECT {_BAND} AS band, count(*)::DOUBLE AS n_all FROM a
        GROUP BY 1),
        b AS (SELECT {_BAND} AS band, count(*) AS n, sum(quality) AS good FROM x GROUP BY 1), w AS (SELECT *, good * n_all / n AS g FROM b
            JOIN p USING (band))
        SELECT sum(n)::BIGINT AS n, round(sum(g) FILTER (WHERE band >= 2) / sum(n_all) FILTER (WHERE band >= 2), 6) AS precision,
            round(sum(g) FILTER (WHERE band >= 2) / sum(g), 6) AS recall FROM w""",
    "band_means": f"WITH {_L}, y AS (SELECT x.*, toxic FROM x JOIN labels USING (doc_id)) SELECT ({_BAND})::INT AS band, count(*) AS n, round(avg(y.quality), 6) AS quality, round(avg(toxic), 6) AS toxic, min(score) AS least FROM y GROUP BY 1",
    "precise_threshold": f"WITH {_GRID} SELECT threshold, tp + fp AS hits, round(tp::DOUBLE / (tp + fp), 6) AS precision FROM k WHERE tp + fp >= 20 AND tp::DOUBLE / (tp + fp) >= 0.5 ORDER BY 2 DESC, 1 LIMIT 1",
    "best_cutoff": f"""WITH {_L}, s AS (SELECT DISTINCT score FROM x), r AS (SELECT s.score,
        count_if((x.score >= s.score) = (quality = 1))::BIGINT AS right_, max(x.score) FILTER (WHERE x.score < s.score) AS below FROM s, x GROUP BY 1)
        SELECT score, right_ AS "right", round((score + coalesce(below, score)) / 2.0::DOUBLE, 6) AS cutoff FROM r ORDER BY 2 DESC, 1 LIMIT 1""",
    "miss_partition": f"""WITH {_E}, c AS (SELECT passage, count_if(system = 'view') AS v, count_if(system = 'click') AS k,
        count_if(system = 'purchase') AS p FROM e GROUP BY 1) SELECT CASE WHEN p > 0 THEN 'found' WHEN v = 0 THEN 'view' WHEN k = 0 THEN 'click'
        ELSE 'purchase' END AS stage, count(*) AS n FROM c GROUP BY 1""",
    "sole_failures": """WITH f AS (SELECT p_size > 40 AS a, p_retailprice > 1500 AS b, length(p_name) > 30 AS c, p_type LIKE 'P%' AS d FROM part),
        k AS (SELECT *, a::INT + b::INT + c::INT + d::INT AS k FROM f),
        l AS (SELECT 'size' AS "check", k FROM k WHERE a UNION ALL SELECT 'price', k FROM k WHERE b UNION ALL SELECT 'name', k FROM k WHERE c UNION ALL
            SELECT 'type', k FROM k WHERE d) SELECT "check", count(*) AS failed, count_if(k = 1)::BIGINT AS sole FROM l GROUP BY 1""",
    "rating_pivot": "SELECT l_suppkey, " + ", ".join(
        f"round(avg(l_quantity) FILTER (WHERE l_returnflag = '{k}'), 6) AS mean_{k.lower()}" for k in "ANR"
    ) + ", count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1",
    "rating_union": """WITH u AS (SELECT 'q' AS source, l_partkey, l_quantity / 50.0::DOUBLE AS y FROM lineitem UNION ALL SELECT 'd', l_partkey, (l_discount * 100.0::DOUBLE + 2) / 12.0::DOUBLE FROM lineitem) SELECT source, l_partkey, round(avg(y), 6) AS mean, count(*) AS n FROM u GROUP BY 1, 2""",
    "listwise_features": f"WITH {_C} SELECT passage, system, round(value - max(value) OVER (PARTITION BY passage), 6) AS behind, row_number() OVER (PARTITION BY passage ORDER BY value DESC NULLS LAST, system) AS place, count(*) OVER (PARTITION BY passage) AS size FROM c",
    "passage_shortlist": f"WITH {_C}, k AS (SELECT passage, system, round(value * sqrt(n), 6) AS key FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY key DESC NULLS LAST, system) AS place FROM k) SELECT * FROM r WHERE place <= 2",
    "rank_sum": """WITH t AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice,
        p_partkey) + row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS total FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY total, p_partkey) AS place FROM t) SELECT * FROM r WHERE place <= 3""",
    "modal_edge": "WITH c AS (SELECT p_brand, p_size AS edge, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, edge) AS k FROM c) SELECT p_brand, edge, n FROM r WHERE k = 1",
    "event_states": f"""WITH {_E}, s AS (SELECT system, coalesce(last_value(CASE WHEN system IN ('click', 'purchase')
        THEN system END IGNORE NULLS) OVER (PARTITION BY passage ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'front') AS state
        FROM e) SELECT state, system, count(*) AS n FROM s GROUP BY 1, 2""",
    "config_parse": """SELECT 'a=' || r_name || '|b=' || b || '|c=' || c AS config, r_name AS a, nullif(b, 'off') AS b, c FROM region, (VALUES ('on'), ('off')) x(b), (VALUES (0), (1), (2)) y(c)""",
    "latency_summary": """WITH x AS (SELECT event_type, (isodow(ts) - 1)::INT AS day, value FROM events) SELECT event_type, day, grouping(event_type, day)::BIGINT AS level, count(*) AS n, round(median(value), 6) AS median, round(max(value), 6) AS most FROM x GROUP BY GROUPING SETS ((event_type, day), (event_type), ())""",
    "conversation_grade": f"""WITH c AS (SELECT conv_id, {tq._counts_sql("text")} FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id,
        sum(n_words)::BIGINT AS n_words, sum(n_sentences)::BIGINT AS n_sentences, sum(n_syllables) AS y FROM c GROUP BY 1)
        SELECT conv_id, n_words, n_sentences, round(CASE WHEN n_words > 0
            THEN 0.39::DOUBLE * n_words / n_sentences + 11.8::DOUBLE * y / n_words - 15.59::DOUBLE END, 6) AS grade FROM s""",
    "panel_assembly": f"""WITH d AS (SELECT 'd' || doc_id AS id, doc_id, {_NORM} AS norm FROM documents), p AS (SELECT id, norm FROM d UNION ALL
        SELECT 'b' || item_id, {_NORM} FROM benchmark)
        SELECT id, sha256('15:' || id) AS hash FROM p WHERE norm NOT IN (SELECT norm FROM d JOIN labels USING (doc_id) WHERE toxic = 1)
            ORDER BY hash LIMIT 50""",
}
