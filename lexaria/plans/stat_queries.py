"""Queries of the statistics, filters, scans and graphs, over tables that stand for a study's.

As in ``evaluation_queries``: events are (system, passage, value) rows, orders and
line items units and ratings, parts the cells of a grid, documents the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaria.functions import text
from lexaria.operators import evaluation as ev
from lexaria.operators import filters, selection
from lexaria.operators import statistics as st
from lexaria.plans import evaluation_queries as eq
from lexaria.plans import execution
from lexaria.plans.text_queries import RULES, read
from lexaria.sources import lines

DRAWS = 40


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eq._cells(spark, sf_dir).withColumn("domain", F.col("passage") % 4)


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each system with its percentile interval, stratified by domain."""
    return st.mean_interval(_events(spark, sf_dir), ["system"], "passage", "domain", "value", DRAWS)


def paired_delta_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system less 'view' on the same passages, with interval and number of changed passages."""
    return st.paired_interval(_events(spark, sf_dir), "system", "view", [], "passage", "domain", "value", DRAWS)


def cluster_rate_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of labelled texts of quality with a score below 0.9, resampling whole sources."""
    x = eq._scored_labels(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return st.cluster_interval(x, [], "source", F.col("score") < 0.9, F.col("quality") == 1, DRAWS)


def threshold_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rates_below(eq._scored_labels(spark, sf_dir), ["lang"], "score", [0.5, 0.7, 0.8, 0.9, 0.95, 0.97])


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a system: n, mean share (value / 100), passages below 0.2, cells without a value, and a stand-in for kept names."""
    c = _events(spark, sf_dir)
    return c.groupBy("system").agg(
        F.count("*").alias("n"), F.avg(F.col("value") / 100 + 0.46).alias("nli_mean"), F.count_if(
            F.coalesce(F.col("value"), F.lit(0.0)) < 2
        ).alias("below"), F.count_if(F.col("value").isNull()).alias("failed"), F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("entities")
    )


def system_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four gates of each system against 'view' as the reference."""
    s = _summaries(spark, sf_dir)
    ref = s.filter("system = 'view'").select(F.col("entities").alias("ref"))
    g = st.gates(F.col("nli_mean"), F.col("below"), F.col("n"), F.col("failed"), F.col("entities"), F.col("ref"))
    return s.crossJoin(F.broadcast(ref)).select("system", *(c.alias(k) for k, c in g.items()))


def adoption_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each system would replace 'view': all five conditions, and the verdict."""
    d = paired_delta_interval(spark, sf_dir).join(system_gates(spark, sf_dir), "system")
    passes = F.col("nli_mean") & F.col("nli_floor") & F.col("facts") & F.col("entities")
    a = st.adoption(passes, F.col("n_nonzero") <= F.col("n") * 0.1, F.col("mean"), F.col("high"), F.col("mean") / 100)
    return d.select(
        "system", *(c.alias(k) for k, c in a.items()), st.verdict(F.col("high") < 0, passes, F.col("n_nonzero") <= F.col("n") * 0.1).alias("verdict")
    )


def regate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every system under every veto rule: where a passage's value doesn't pass, its 'view' value stands in; swaps kept, mean, and whether the mean gate holds."""
    c = _events(spark, sf_dir)
    base = c.filter("system = 'view'").select("passage", F.col("value").alias("base"))
    both = c.filter("system <> 'view'").join(base, "passage")
    rules = F.array(
        *(F.struct(F.lit(k).alias("rule"), (F.col("value") >= t).alias("keep")) for k, t in (("none", -1.0), ("low", 25.0), ("middle", 50.0), ("high", 75.0)))
    )
    x = both.select("system", "value", "base", F.explode(rules).alias("r")).withColumn(
        "used", F.when(F.coalesce(F.col("r.keep"), F.lit(False)), F.col("value")).otherwise(F.col("base"))
    )
    return x.groupBy("system", "r.rule").agg(
        F.count_if("r.keep").alias("swaps"), F.count("*").alias("n"), F.round(F.avg("used"), 6).alias("mean")
    ).withColumn("passes", F.col("mean") >= 50)


def amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of a passage's value against 'view' by band of its own value: n, mean change, share that drops by more than 5."""
    c = _events(spark, sf_dir)
    d = c.filter("system <> 'view'").join(
        c.filter("system = 'view'").select("passage", F.col("value").alias("base")), "passage"
    ).withColumn("d", F.col("value") - F.col("base"))
    return d.groupBy(text.band(F.col("value") / 100).alias("band")).agg(
        F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_delta"),
        F.round(F.avg(F.when(F.col("d") < -5, 1.0).otherwise(0.0)), 6).alias("dropped")
    )


def status_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase against click by domain: mean difference with the sign turned so that more is better, and which is ahead."""
    c = _events(spark, sf_dir).groupBy("domain", "system").agg(F.avg("value").alias("value"), F.avg("n").alias("n"))
    a, b = (c.filter(F.col("system") == s) for s in ("purchase", "click"))
    j = a.select("domain", F.col("value").alias("va"), F.col("n").alias("na")).join(
        b.select("domain", F.col("value").alias("vb"), F.col("n").alias("nb")), "domain"
    )
    metrics = F.array(
        F.struct(F.lit("value").alias("metric"), (F.col("va") - F.col("vb")).alias("d")),
        F.struct(F.lit("n").alias("metric"), (F.col("nb") - F.col("na")).alias("d"))
    )
    return j.select("domain", F.explode(metrics).alias("m")).select(
        "domain", "m.metric", F.round("m.d", 6).alias("delta"), (F.round("m.d", 6) > 0).alias("ahead")
    )


def twin_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations with their twin, the same but for 'b=off': identities, and why one has none."""
    d = eq.design_factorial(spark, sf_dir).select("config")
    keyed = d.withColumn("twin", F.regexp_replace("config", "b=[a-z]+", "b=off"))
    out = keyed.join(d.select(F.col("config").alias("twin"), F.lit(True).alias("found")), "twin", "left")
    reason = F.when(F.col("config") == F.col("twin"), "is a twin").when(F.col("found").isNull(), "no twin").otherwise("paired")
    return out.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("config").alias("first"))


def cube_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems by domain and kind (passage parity), with all totals."""
    c = _events(spark, sf_dir).withColumn("kind", F.when(F.col("passage") % 2 == 0, "standard").otherwise("control"))
    return c.cube("system", "domain", "kind").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"),
        F.count_if(F.col("value") > 50).alias("n_changed")
    )


def matrix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the matrix of systems and passages: cells missing, repeated, beyond the plan (passages divisible by 7 aren't planned), and drifted values, by system."""
    e = eq._events(spark, sf_dir)
    planned = e.select("passage").distinct().filter("passage % 7 <> 0")
    systems = e.select("system").distinct()
    cells = e.groupBy("system", "passage").agg(F.count("*").alias("k"), F.round(F.max("value") - F.min("value"), 6).alias("drift"))
    grid = planned.crossJoin(F.broadcast(systems)).withColumn("planned", F.lit(True))  # systems are a handful
    both = cells.join(grid, ["system", "passage"], "full")
    return both.groupBy("system").agg(
        F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("k") > 1).alias("repeated"),
        F.count_if(F.col("planned").isNull()).alias("unexpected"), F.count_if(F.col("drift") > 50).alias("drifted")
    )


def matrix_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems whose planned passages all have one value ('complete'), several ('conflict') or too few ('pending')."""
    c = matrix_report(spark, sf_dir)
    return c.select("system", F.when(F.col("drifted") > 0, "conflict").when(F.col("missing") > 0, "pending").otherwise("complete").alias("state"))


def span_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and overlapping spans: of each order, the lines with tax under 0.05 as gold, those with discount under 0.06 as found, both as days of shipping and quantity."""
    day = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("long")
    s = read(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b"), "l_tax", "l_discount")
    return st.span_scores(s.filter("l_tax < 0.045").select("l_orderkey", "a", "b"), s.filter("l_discount < 0.055").select("l_orderkey", "a", "b"), "l_orderkey")


def ordinal_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.ordinal_alpha(eq._ratings(spark, sf_dir), "unit", "rating")


def grid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window (of characters, null the whole) and threshold with the best balanced accuracy, precise enough if any is."""
    x = eq._scored_labels(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    share = lambda w: F.col("score") if w is None else F.when(F.col("n_chars") < w, F.col("score")).otherwise(F.col("score") - 0.02)
    grid = None
    for w in (200, 800, None):
        c = ev.confusion(x.withColumn("s", share(w)), "s", "quality", [0.8, 0.85, 0.9, 0.95]).withColumn("window", F.lit(w).cast("int"))
        grid = c if grid is None else grid.unionByName(c)
    grid = grid.withColumns({"balanced": F.round("balanced", 9), "precision": F.round("precision", 9)})
    return st.choose_setting(grid).select("window", "threshold", "tp", "fp", "able", "balanced")


def edit_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, correct ones, net and precision by threshold: the lines of an order are candidates, discount times ten the probability, a tax of 0.04 or more the guard, flag R the gold."""
    c = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("candidate"), F.round(F.col("l_discount") * 10, 4).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("gold"), (F.col("l_tax") >= 0.04).alias("guard")
    )
    return st.accept_best(c, "l_orderkey", "p", "gold", [0.1, 0.3, 0.5, 0.7])


def best_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each size of part, the one with the largest price, of equal ones the largest key."""
    return read(spark, sf_dir, "part").groupBy("p_size").agg(
        F.max(F.struct(F.round("p_retailprice", 2).alias("price"), "p_partkey")).alias("b")
    ).select("p_size", "b.price", "b.p_partkey")


def exclusive_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of account balances by nation, by the exclusive method: positions (n + 1) p among the values, from counts of distinct values and not of rows."""
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey", F.round("c_acctbal", 2).alias("v")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("c_nationkey").orderBy("v")
    c = c.withColumns({"hi": F.sum("k").over(w), "n": F.sum("k").over(Window.partitionBy("c_nationkey"))})
    aggs = []
    for i in (1, 2, 3):
        place = (F.col("n") + 1) * i / 4.0
        low = F.least(F.greatest(F.floor(place), F.lit(1)), F.col("n") - 1)
        lo, up = (F.min(F.when(F.col("hi") >= p, F.col("v"))) for p in (low, low + 1))
        part = F.max(place - low)
        aggs.append(F.round(lo + (up - lo) * part, 4).alias(f"q{i}"))
    return c.filter("n > 1").groupBy("c_nationkey").agg(F.max("n").alias("n"), *aggs)


def sense_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label of vectors: how many, and the length of their sum (the centroid's), with the smoothed log prior."""
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    sums = e.groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    by = sums.groupBy("label").agg(F.max("n").alias("n"), F.round(F.sqrt(F.sum(F.col("s") * F.col("s"))), 3).alias("norm"))
    total = by.agg(F.sum("n").alias("total"), F.count("*").alias("senses"))
    return by.crossJoin(F.broadcast(total)).select(
        "label", "n", "norm", F.round(F.log((F.col("n") + 0.5) / (F.col("total") + F.col("senses") * 0.5)), 6).alias("prior")
    )


def warning_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings (end marks by kind) that a rewrite adds, resolves and shares, as multisets: words shortened by the rules, counted by first letter."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.split(F.trim(F.col("text")), " +").alias("a"))
    from lexaria.operators import rewrite

    x = d.withColumn("b", rewrite.dictionary(F.col("a"), RULES))
    tagged = F.concat(
        F.transform("a", lambda w: F.struct(F.lower(F.substring(w, 1, 1)).alias("g"), F.lit(1).alias("old"), F.lit(0).alias("new"))),
        F.transform("b", lambda w: F.struct(F.lower(F.substring(w, 1, 1)).alias("g"), F.lit(0).alias("old"), F.lit(1).alias("new")))
    )
    c = x.select("doc_id", F.explode(tagged).alias("x")).groupBy("doc_id", "x.g").agg(F.sum("x.old").alias("o"), F.sum("x.new").alias("n"))
    return c.groupBy("doc_id").agg(
        F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).alias("resolved"),
        F.sum(F.least("o", "n")).alias("shared")
    )


def relation_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint mass of two distributions over nations by relation: an order's customers' and suppliers' nations of each region; 0 the same nation, 1 the same region."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    links = n.select(F.col("n_nationkey").alias("sense"), "n_regionkey").join(
        n.select(F.col("n_nationkey").alias("far"), "n_regionkey"), "n_regionkey"
    ).filter("sense <> far").select("sense", "far", F.lit(1).alias("rank"))
    share = lambda c: F.col("k") / F.sum("k").over(Window.partitionBy("key"))
    left = read(spark, sf_dir, "customer").groupBy(
        F.col("c_mktsegment").alias("key"), F.col("c_nationkey").alias("sense")
    ).agg(F.count("*").alias("k")).select("key", "sense", share("k").alias("p"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("sense")).agg(F.count("*").alias("k"))
    right = left.select("key").distinct().crossJoin(F.broadcast(s)).select("key", "sense", share("k").alias("p"))  # segments and nations are a handful
    return st.relation_mass(left, right, links, "key")


def related_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations related to each nation: by region (0) or by the region after it (1), with the regions that lead there."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), F.col("n_regionkey").alias("sense"))
    links = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("sense"), ((F.col("r_regionkey") + 1) % 5).alias("far"), F.lit(1).alias("rank"))
    return st.related_words(n.select("word"), n, links).select("word", "other", "relation", F.size("senses").alias("n_senses"))


def edge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations of consecutive keys by the relation between their regions: same, next, or unlinked."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    m = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_regionkey").alias("other"))
    kind = F.when(F.col("n_regionkey") == F.col("other"), "same").when(
        (F.col("n_regionkey") + 1) % 5 == F.col("other"), "narrower"
    ).when((F.col("other") + 1) % 5 == F.col("n_regionkey"), "broader").otherwise("unlinked")
    return n.join(m, "n_nationkey").groupBy(kind.alias("relation")).agg(F.count("*").alias("n"))


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach of the nations under 'key halves': each nation links to the one with half its key; nodes reached and the longest path."""
    e = read(spark, sf_dir, "nation").filter("n_nationkey > 0").select(
        F.col("n_nationkey").alias("a"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("b")
    )
    return st.closure(e, 8).groupBy("a").agg(F.count("*").alias("n"), F.max("steps").alias("steps"))


def top_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of each order that passes the guard (a tax of 0.04 or more), by price then line."""
    li = read(spark, sf_dir, "lineitem").filter("l_tax >= 0.04")
    return li.groupBy("l_orderkey").agg(
        F.max(F.struct(F.round("l_extendedprice", 2).alias("price"), (-F.col("l_linenumber")).alias("k"))).alias("b")
    ).select("l_orderkey", "b.price", (-F.col("b.k")).alias("l_linenumber"))


def first_proposer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of three proposers of part keys (by size, by price, by name), each kept under the first that proposes it."""
    p = read(spark, sf_dir, "part")
    a = p.filter("p_size > 40").select("p_partkey", F.lit(0).alias("rank"))
    b = p.filter("p_retailprice > 1200").select("p_partkey", F.lit(1).alias("rank"))
    c = p.filter(F.length("p_name") > 30).select("p_partkey", F.lit(2).alias("rank"))
    return a.unionByName(b).unionByName(c).groupBy("p_partkey").agg(F.min("rank").alias("proposer"))


def distinct_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three types of each brand by price, letters' case and finish aside (a top-k window)."""
    p = read(spark, sf_dir, "part").select(
        "p_brand", F.lower(F.substring_index("p_type", " ", 1)).alias("kind"), "p_retailprice"
    ).groupBy("p_brand", "kind").agg(F.round(F.max("p_retailprice"), 2).alias("price"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("price"), "kind"))
    return p.withColumn("place", place.cast("long")).filter("place <= 3").select("p_brand", "kind", "price", "place")


def stride_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by id, the first 50 (a sampling operator)."""
    return read(spark, sf_dir, "documents").filter("doc_id % 10 = 3").orderBy("doc_id").limit(50).select("doc_id", "lang")


def key_exclusion_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in hash order of which no two share a text or a source, as the greedy pass takes them: the first 40."""
    keys = F.array(F.sha2(text.normalised(F.col("text")), 256), F.concat(F.lit("source "), "source"))
    order = F.sha2(F.concat(F.lit("3:"), F.col("doc_id").cast("string")), 256)
    docs = read(spark, sf_dir, "documents")
    taken = selection.greedy_sample(docs, "doc_id", keys, order).orderBy("place").limit(40)
    return docs.select("doc_id", "source").join(taken.select(F.col("id").alias("doc_id")), "doc_id")


def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches by length within each source, so that a batch's texts are of like length: longest and shortest of each batch of 32."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    b = d.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id")) - 1) / 32))
    return b.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def either_key_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of which neither the text nor the next turn's is a text that a system turn has: an anti join for each key."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    norm = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", norm.alias("a")).withColumn("b", F.lead("a").over(w))
    bad = t.filter("role = 'system'").select(F.col("a").alias("x")).distinct()
    return t.filter("role <> 'system'").join(
        bad, F.col("a") == F.col("x"), "left_anti"
    ).join(bad, F.col("b") == F.col("x"), "left_anti").select("conv_id", "turn")


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first line: the line of the order whose interval [ship day, ship day + quantity) holds the first line's end, the smallest; none where none does."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).alias("a"),
        F.col("l_quantity").cast("int").alias("q")
    ).withColumn("b", F.col("a") + F.col("q"))
    p = li.filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("b").alias("x"))
    i = li.filter("l_linenumber > 1").select("l_orderkey", F.col("l_linenumber").alias("line"), "a", "b")
    hit = p.join(i, "l_orderkey", "left").withColumn("line", F.when((F.col("a") <= F.col("x")) & (F.col("x") < F.col("b")), F.col("line")))
    return hit.groupBy("l_orderkey").agg(F.first("x").alias("x"), F.min("line").alias("line"))


def asof_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its passage's last view at or before it, else the first view after: two running values and no range join."""
    e = read(spark, sf_dir, "events").filter("event_type IN ('purchase', 'view')").select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type"
    )
    view = F.when(F.col("event_type") == "view", F.col("us"))
    up = Window.partitionBy("user_id").orderBy("us", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("user_id").orderBy("us", F.desc("event_type")).rowsBetween(0, Window.unboundedFollowing)
    return e.withColumns(
        {"before": F.last(view, True).over(up), "after": F.first(view, True).over(down)}
    ).filter("event_type = 'purchase'").select("event_id", F.coalesce("before", "after").alias("view_us"))


def verdict_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities that an earlier review (the finished orders) has a verdict on, reused by clerk and priority; empty where there is none."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus")
    verdicts = o.filter("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.lit("yes")).alias("v"))
    j = o.filter("o_orderstatus = 'O'").join(verdicts, ["o_custkey", "o_orderpriority"], "left")
    return j.groupBy(F.coalesce("v", F.lit("")).alias("verdict")).agg(F.count("*").alias("n"))


def rating_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings joined to what they rate by the key: mean quantity of each segment and condition (order parity)."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    key = o.select(
        F.col("o_orderkey").cast("string").alias("item"), "c_mktsegment",
        F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("condition")
    )
    ratings = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("item"), "l_quantity"
    ).join(key.select("item"), "item", "left_semi")
    return execution.import_ratings(ratings, key).groupBy("c_mktsegment", "condition").agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean")
    )


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman (average ranks) of rating against three metrics in three subsets; ranks come from counts of distinct values."""
    r = read(spark, sf_dir, "lineitem").select(
        (F.floor(F.col("l_quantity") / 10) + 1).cast("double").alias("y"), "l_returnflag", F.round(F.col("l_discount") * 100, 0).alias("discount"),
        F.round(F.col("l_tax") * 100, 0).alias("tax"), (F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) % 50).cast("double").alias("day")
    )
    long = r.select(
        "y", F.col("l_returnflag").alias("subset"),
        F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("discount", "tax", "day")))).alias("m")
    ).groupBy("subset", "m.metric", "m.x", "y").agg(F.count("*").alias("k"))
    # a cell is a pair of values with its count; ranks of each side from the counts below
    by = ["subset", "metric"]
    side = lambda c: ev.average_ranks_weighted(long, c, by)
    ranked = long.join(side("x"), [*by, "x"]).join(side("y"), [*by, "y"])

    def corr(a, b):
        n, sa, sb = F.sum("k").cast("double"), F.sum(F.col("k") * F.col(a)), F.sum(F.col("k") * F.col(b))
        cov = F.sum(F.col("k") * F.col(a) * F.col(b)) - sa * sb / n
        return F.round(cov / F.sqrt((F.sum(F.col("k") * F.col(a) * F.col(a)) - sa * sa / n) * (F.sum(F.col("k") * F.col(b) * F.col(b)) - sb * sb / n)), 6)

    return ranked.groupBy(*by).agg(F.sum("k").alias("n"), corr("x", "y").alias("pearson"), corr("rank_x", "rank_y").alias("spearman"))


def votes_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's most frequent rating, of equal counts the one seen first."""
    r = eq._ratings(spark, sf_dir).groupBy("unit", "rating").agg(F.count("*").alias("n"), F.min("rater").alias("first"))
    best = r.groupBy("unit").agg(F.max(F.struct("n", (-F.col("first")).alias("seen"), "rating")).alias("b"))
    return best.groupBy(F.col("b.rating").alias("rating")).agg(F.count("*").alias("n_units"), F.sum("b.n").alias("n_votes"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what a rewrite and its checks do: copied, blocked by which check alone, changed."""
    from lexaria.plans.text_queries import _pairs

    p = _pairs(spark, sf_dir).select(
        "doc_id", "lang", F.size("source").alias("n"),
        F.size(F.filter(F.zip_with("source", "output", lambda a, b: a != b), lambda x: x)).alias("changed")
    )
    failed = F.filter(F.array(F.when(F.col("changed") > F.col("n") * 0.2, "over-edit"), F.when(F.col("n") < 20, "short")), lambda c: c.isNotNull())
    state = F.when(F.col("changed") == 0, "copy").when(F.size("failed") == 0, "changed").when(
        F.size("failed") == 1, F.concat(F.lit("blocked by "), F.get("failed", F.lit(0)))
    ).otherwise("blocked by several")
    return p.withColumn("failed", failed).groupBy("lang", state.alias("state")).agg(F.count("*").alias("n"))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade of each conversation's assistant turns put together in order."""
    from lexaria.functions.batches import rows_of

    t = read(spark, sf_dir, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    joined = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    n = rows_of(joined, text.counts_f, text.COUNTS_F, ["conv_id"], ["text"])
    return n.select("conv_id", "n_words", "n_sentences", F.round(text.scores_f({k: F.col(k) for k in n.columns})["grade"], 6).alias("grade"))


def locked_rows_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents locked by id, by text hash, or by their id behind a prefix (ids from 500 on have it)."""
    d = read(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") >= 500, F.concat(F.lit("ose-"), (F.col("doc_id") - 500).cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("id"),
        "text"
    )
    lock = read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    listed = lock.withColumn("sha256", F.lit(None).cast("string")).unionByName(
        d.join(lock, "id", "left_semi").select(F.lit(None).cast("string").alias("id"), F.sha2("text", 256).alias("sha256"))
    )
    return lines.locked_rows(d, listed).select("id")


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling pairs of part names and types: shared start of the words, and whether they differ by spelling variant only."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"))
    return p.select(
        "p_partkey", F.round(text.shared_prefix(F.col("a"), F.coalesce("b", F.lit(""))), 6).alias("share"),
        F.coalesce(text.spelling_variant(F.col("a"), F.col("b")), F.lit(False)).alias("variant")
    )


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paraphrase rules out of lines (part names against types), with why each goes."""
    p = read(spark, sf_dir, "part").filter("p_partkey % 2 = 0 OR p_size > 5")
    value = F.concat_ws(
        "\t", "p_name", F.lower("p_type"), F.when(F.col("p_size") % 7 == 0, F.lit("x")).otherwise(((F.col("p_size") - 10) / 10.0).cast("string")),
        (F.col("p_retailprice") / 300).cast("decimal(10,2)").cast("string")
    )
    rules = lines.paraphrase_rules(p.select(F.col("p_partkey").cast("long").alias("line"), value.alias("value")))
    return rules.groupBy(
        filters.phrase_rule_reason(F.col("complex"), F.col("simple"), F.col("complexity"), F.col("quality")).alias("reason")
    ).agg(F.count("*").alias("n"), F.round(F.sum("complexity"), 4).alias("complexity"))


def lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rescaled lexicon out of lines of customers: repeated words (segment and nation), bad values and a header."""
    c = read(spark, sf_dir, "customer")
    value = F.concat_ws(
        "\t", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")), F.lit("t"),
        F.when(F.col("c_custkey") % 5 == 0, "bad").otherwise(F.round(F.col("c_acctbal") / 100, 2).cast("string"))
    )
    return lines.lexicon(
        c.select((F.col("c_custkey") - 1).cast("long").alias("line"), value.alias("value")), "concreteness"
    ).select("word", F.round("value", 6).alias("value"))


def ranked_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutes out of lines: an order's priority as target, the flags of its lines as what annotators wrote."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x")
    )
    o = li.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus"), "k").select(
        F.col("k").cast("long").alias("line"),
        F.concat_ws("\t", F.lit("s "), "o_orderstatus", F.array_join(F.transform("x", lambda r: F.concat(F.lit(" "), r["l_returnflag"])), "\t")).alias("value")
    )
    r = lines.ranked_substitutes(o)
    return r.select(
        "line", F.size("ranked").alias("n"), F.get("ranked", F.lit(0))["word"].alias("first"),
        F.get("ranked", F.lit(0))["n"].cast("int").alias("votes")
    )


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of eleven fields into complex words: parts as instances, lines with fewer fields left out."""
    p = read(spark, sf_dir, "part")
    value = F.concat_ws(
        "\t", F.col("p_partkey").cast("string"), "p_name", F.lit("0"), F.length("p_name").cast("string"), F.substring_index("p_name", " ", 1),
        *[F.lit("1")] * 4, F.when(F.col("p_size") > 25, "1").otherwise("0"),
        F.when(F.col("p_size") % 4 != 0, F.round(F.col("p_size") / 50, 2).cast("string"))
    )
    return lines.complex_words(
        p.select(F.col("p_partkey").cast("long").alias("line"), value.alias("value"))
    ).select("id", F.col("end").alias("size"), "target", "binary", "probability")


def line_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line i of an original (nation names) with line i of two references, of which the second is shorter."""
    n = read(spark, sf_dir, "nation")
    f = lambda c, d: d.select(F.col("n_nationkey").cast("long").alias("line"), c.alias("value"))
    a = lines.aligned(f(F.col("n_name"), n), [f(F.lower("n_name"), n), f(F.concat(F.lit("x "), "n_name"), n.filter("n_nationkey < 20"))])
    return a.select("line", "original", F.array_join("references", "|").alias("refs"))


def expected_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mini-grammar 'a => b | c ; d => e' out of nations by region."""
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("x"))
    g = n.select(
        "n_regionkey",
        F.concat(F.lit("First => "), F.array_join("x", " | "), F.lit(" ; Count => "), F.size("x").cast("string"), F.lit(" ; none")).alias("t")
    )
    m = lines.expected_phrases(F.col("t"))
    return g.select("n_regionkey", F.explode(m).alias("phrase", "words")).select("n_regionkey", "phrase", F.array_join("words", "|").alias("words"))


def block_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two lines between lines of asterisks, out of nations by region; of equal keys the first."""
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("x"))
    t = n.select("n_regionkey", F.array_join(F.transform("x", lambda c: F.concat(F.substring(c, 1, 1), F.lit("\n"), c, F.lit("\n"))), "*******\n").alias("t"))
    return t.select("n_regionkey", F.explode(lines.blocks(F.col("t"))).alias("b")).select("n_regionkey", "b.key", "b.value")


def sentence_splits_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pairs out of lines: conversations' turns as 'source <tab> first <::::> second'; every second line."""
    p = read(spark, sf_dir, "part")
    value = F.concat_ws("\t", "p_name", F.concat("p_type", F.when(F.col("p_size") % 3 == 0, " <::::> ").otherwise(" "), F.lit("end")))
    return lines.sentence_splits(p.select(F.col("p_partkey").cast("long").alias("line"), value.alias("value")), 2)


QUERIES = {
    f.__name__: f
    for f in (
        bootstrap_interval, paired_delta_interval, cluster_rate_interval, threshold_rates, system_gates, adoption_rule, regate, amplification, status_deltas, twin_join, cube_report, matrix_report, matrix_assembly,
        span_prf, ordinal_alpha, grid_choice, edit_precision, best_rule, exclusive_quartiles, sense_counts, warning_deltas, relation_mass, related_words, edge_classes, closure, top_candidate, first_proposer,
        distinct_shortlist, stride_scan, key_exclusion_sample, length_batches, either_key_exclusion, point_in_interval, asof_fallback, verdict_reuse, rating_key, correlations, votes_first_seen, funnel,
        document_sections, locked_rows_three, column_edges, phrase_rules, lexicon_scan, ranked_substitutes, source_scan, line_zip, expected_phrases, block_file, sentence_splits_scan,
    )
}
ORACLES: dict[str, str] = {}
