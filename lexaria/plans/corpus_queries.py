"""Queries that prepare corpora: exclusion, deduplication, filters, samples, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaria.functions import text
from lexaria.operators import corpus
from lexaria.operators import evaluation as ev
from lexaria.plans.text_queries import read


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").withColumn("norm", F.sha2(text.normalised(F.col("text")), 256))


def exclusion_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose normalised text equals no text of a labelled toxic document."""
    d = _docs(spark, sf_dir)
    bad = d.join(read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return corpus.exclude(d, "norm", bad, "norm").select("doc_id")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_by_key(_docs(spark, sf_dir).select("norm", "doc_id", "lang"), ["norm"], "doc_id").select("doc_id", "lang")


def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents go, first reason first; accepted ones too. One pass: rows are counted by text and own reason, and all but a text's first document are its duplicates."""
    own = (
        F.when(
            F.col("text").isNull() | (F.trim("text") == ""), "empty"
        ).when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 20000, "long").when(F.col("text").rlike("https?://|<[a-z]+>"), "markup").otherwise("accepted")
    )
    d = _docs(spark, sf_dir).select("norm", "doc_id", own.alias("own"))
    names = ("empty", "short", "long", "markup", "accepted")
    by = d.groupBy("norm").agg(F.min_by("own", "doc_id").alias("first"), *(F.count_if(F.col("own") == n).alias(n) for n in names))
    good = F.when(F.col("first") == "accepted", 1).otherwise(0)
    sums = by.agg(*(F.sum(n).alias(n) for n in names[:-1]), F.sum(F.col("accepted") - good).alias("duplicate"), F.sum(good).alias("accepted"))
    cells = F.array(*(F.struct(F.lit(n).alias("reason"), F.col(n).cast("long").alias("n")) for n in (*names[:-1], "duplicate", "accepted")))
    return sums.select(F.explode(cells).alias("x")).select("x.reason", "x.n").filter("n > 0")


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus.smallest_hashes(d, corpus.hash_order(F.lit("4701"), F.col("doc_id")), 100)


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus.class_quota(d, "lang", corpus.hash_order(F.lit("7"), F.col("doc_id")), 25).select("doc_id", "lang", "place")


def roundrobin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 documents, one of each source in turn, each source in hash order. No source gives more than 60."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.class_quota(
        d, "source", corpus.hash_order(F.lit("9"), F.col("doc_id")), 60
    ).orderBy("place", "source").limit(60).select("doc_id", "source", "place")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source go to dev if the hash of the source modulo 10 is 0, else to train."""
    s = corpus.hex_mod(F.sha2("source", 256), 10)
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("bucket", s).select(
        "source", "n", "bucket", F.when(F.col("bucket") == 0, "dev").otherwise("train").alias("split")
    )


def document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in hash order fill dev until it has a third of the rows. The window runs over sources, not rows."""
    c = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.concat(F.lit("s:"), "source"), 256))
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = c.agg(F.sum("n").alias("total"))
    return c.withColumn("before", before).crossJoin(F.broadcast(total)).select(
        "source", "n", F.when(F.col("before") * 3 < F.col("total"), "dev").otherwise("test").alias("split")
    )


def shard_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").filter(F.pmod("doc_id", F.lit(8)) == 3).select("doc_id")


def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive turns of a conversation with more than 300 characters."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return corpus.islands(t, "conv_id", "turn", F.length("text") > 300)


def turn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group starts where the role changes; groups are numbered by a running sum, and the last system turn carries on."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    t = t.withColumn("start", F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1))
    t = t.withColumns({"grp": F.sum("start").over(w), "system_turn": F.last(F.when(F.col("role") == "system", F.col("turn")), True).over(w)})
    return t.groupBy("conv_id", "grp").agg(F.count("*").alias("n_turns"), F.sum("n").alias("n_chars"), F.max("system_turn").alias("system_turn"))


def token_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that user turns have more often than assistant turns, as multisets."""
    w = read(spark, sf_dir, "conversations").select("role", F.explode(text.words(F.col("text"))).alias("word"))
    c = w.groupBy("word").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return c.filter("u > a").select("word", (F.col("u") - F.col("a")).alias("more"))


def price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ev.exact_quantiles(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [0.25, 0.5, 0.75])
    return q.select("o_orderpriority", *(F.round(f"q{i}", 4).alias(f"q{i + 1}") for i in range(3)))


def cross_split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts that occur in more than one of the two splits by source parity."""
    d = _docs(spark, sf_dir).withColumn("side", F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 2)
    return d.groupBy("norm").agg(F.count_distinct("side").alias("sides"), F.count("*").alias("n")).filter("sides > 1").select("norm", "n")


QUERIES = {
    f.__name__: f
    for f in (
        exclusion_antijoin, dedup_first, filter_reasons, hash_sample, balanced_sample, roundrobin_sample, group_split, document_split, shard_select,
        gaps_islands, turn_groups, token_multiset_difference, price_quartiles, cross_split_disjoint
    )
}

_N = "n AS (SELECT *, sha256(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ')) AS norm FROM documents)"

ORACLES = {
    "exclusion_antijoin": f"WITH {_N} SELECT doc_id FROM n WHERE norm NOT IN (SELECT norm FROM n JOIN labels USING (doc_id) WHERE toxic = 1)",
    "dedup_first": f"WITH {_N}, r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS k FROM n) SELECT doc_id, lang FROM r WHERE k = 1",
    "filter_reasons": f"""WITH {_N}, r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS k FROM n)
        SELECT CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000
            THEN 'long' WHEN regexp_matches(text, 'https?://|<[a-z]+>') THEN 'markup' WHEN k > 1 THEN 'duplicate' ELSE 'accepted' END AS reason,
            count(*) AS n FROM r GROUP BY 1""",
    "hash_sample": "SELECT doc_id, lang, sha256('4701:' || doc_id) AS hash FROM documents ORDER BY hash LIMIT 100",
    "balanced_sample": "SELECT doc_id, lang, place::INT AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id)) AS place FROM documents) WHERE place <= 25",
    "roundrobin_sample": "SELECT doc_id, source, place::INT AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('9:' || doc_id)) AS place FROM documents) ORDER BY place, source LIMIT 60",
    "group_split": """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT *, list_reduce(list_prepend(0::BIGINT,
        list_transform(string_split(sha256(source), ''), lambda d: ('0x' || d)::BIGINT)), lambda a, d: (a * 16 + d) % 10) AS bucket FROM s)
        SELECT source, n, bucket, CASE WHEN bucket = 0 THEN 'dev' ELSE 'train' END AS split FROM b""",
    "document_split": """WITH c AS (SELECT source, count(*) AS n, sha256('s:' || source) AS h FROM documents GROUP BY 1), r AS (SELECT *,
        coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM c)
        SELECT source, n, CASE WHEN before * 3 < total THEN 'dev' ELSE 'test' END AS split FROM r""",
    "shard_select": "SELECT doc_id FROM documents WHERE doc_id % 8 = 3",
    "gaps_islands": """WITH t AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations
        WHERE length(text) > 300)
        SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM t GROUP BY conv_id, g""",
    "turn_groups": """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0
        ELSE 1 END AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        g AS (SELECT *, sum(start) OVER w AS grp, last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER w AS system_turn
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, grp::BIGINT AS grp, count(*) AS n_turns, sum(n)::BIGINT AS n_chars, max(system_turn) AS system_turn FROM g GROUP BY conv_id, grp""",
    "token_multiset_difference": """WITH w AS (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z]+(?:[''-][a-z]+)*')) AS word FROM conversations),
        c AS (SELECT word, count_if(role = 'user') AS u, count_if(role = 'assistant') AS a FROM w GROUP BY 1)
        SELECT word, (u - a)::BIGINT AS more FROM c WHERE u > a""",
    "price_quartiles": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1",
    "cross_split_disjoint": f"WITH {_N}, s AS (SELECT norm, regexp_extract(source, '([0-9]+)$', 1)::INT % 2 AS side FROM n) SELECT norm, count(*) AS n FROM s GROUP BY norm HAVING count(DISTINCT side) > 1",
}
