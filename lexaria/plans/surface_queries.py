"""Queries of the user-function kinds, of layouts, scoreboards and reports that the other modules don't have."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaria.functions import partial, registry
from lexaria.operators import evaluation as ev
from lexaria.operators import stages
from lexaria.plans import evaluation_queries as eq
from lexaria.plans import execution
from lexaria.plans.text_queries import RULES, read
from lexaria.sources import layout, lines

registry.register("system", "first words", lambda t: " ".join(t.split(" ")[:3]))
registry.register("rewriter", "no spaces", lambda t: {"output": t.replace(" ", ""), "score": float(len(t)), "checks": {"short": len(t) < 400}})
registry.register("stage", "rules", stages.dictionary(RULES))
registry.register("veto", "longer", lambda a, b: len(b) > len(a))
registry.register("generator", "endings", lambda w: [(w[:k], float(k)) for k in range(1, min(4, len(w)) + 1)])
registry.register("scorer", "shared letters", lambda slot, c: [len(set(slot) & set(x)) for x in c])
registry.register("aggregate", "middle of extremes", lambda v: (v.max() + v.min()) / 2 if len(v) else float("nan"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size", "p_retailprice")


def udf_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", registry.system("first words", F.col("text")).alias("output"))


def udf_rewriter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", registry.rewriter("no spaces", F.col("text")).alias("r"))
    return d.select("doc_id", F.length("r.output").alias("n"), "r.score", "r.passed")


def udf_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the rule stage by replacement."""
    d = read(spark, sf_dir, "documents").select(F.explode(registry.stage("rules", F.col("text"))["edits"]).alias("e"))
    return d.groupBy(F.lower("e.replacement").alias("replacement")).agg(F.count("*").alias("n"))


def udf_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", registry.veto("longer", F.col("p_name"), F.col("p_type")).alias("vetoed"))


def udf_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the words of each part's name that the name of the part before it has."""
    p = _parts(spark, sf_dir)
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("premise"))
    return p.join(before, "p_partkey").select("p_partkey", F.round(registry.entailment("overlap", F.col("premise"), F.col("p_name")), 6).alias("p"))


def udf_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.generate(
        "endings", _parts(spark, sf_dir), "p_brand", ["p_partkey"]
    ).groupBy("candidate").agg(F.count("*").alias("n"), F.max("score").alias("score"))


def udf_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select("p_partkey", registry.scores("shared letters", F.lower("p_name"), F.array(F.lower("p_type"), F.lit("abc"))).alias("s"))
    return p.select("p_partkey", p["s"][0].alias("a"), p["s"][1].alias("b"))


def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each brand's extreme prices, from one state of two numbers a task."""
    extremes = partial.Partial(lambda v: np.array([v.min(), v.max()]), lambda s: np.array([s[:, 0].min(), s[:, 1].max()]), lambda s: (s[0] + s[1]) / 2)
    found = partial.partial_aggregate(_parts(spark, sf_dir), ["p_brand"], "p_retailprice", extremes)
    return found.select("p_brand", F.round("value", 4).alias("middle"))


def udtf_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best starts of the words of each brand's parts, the longest of the longest words first, by a table function over partitions."""
    words = _parts(spark, sf_dir).select("p_brand", F.explode(F.split("p_name", " ")).alias("word"))
    return partial.best_candidates(words, "word", "p_brand", lambda w: [(w[:k], k + len(w) / 100) for k in range(3, len(w) + 1)], 5)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as page elements: a document for each brand and two thousand keys, ten pages, two columns; tops from the size."""
    k = F.col("p_partkey").cast("long")
    return _parts(spark, sf_dir).select(
        F.concat_ws("-", "p_brand", F.floor(k / 2000).cast("string")).alias("doc"), (k % 10 + 1).alias("page"), (F.floor(k / 10) % 2).alias("col"), (F.col("p_size") * 3).cast("double").alias("top"), (k % 7 * 100).cast("double").alias("left"),
        (k % 7 * 100 + 50).cast("double").alias("right"), F.lit(10.0).alias("size"), F.lit("plain").alias("kind"), F.col("p_name").alias("text"),
    )


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the pages that the parts make, by size and left edge: each line's first top, left edge and whole text."""
    return layout.page_lines(_elements(spark, sf_dir)).select("doc", "page", "col", "top", "left", "text")


def layout_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of conversations as documents: turns are lines, system turns abstracts, user turns headings, and a long turn is indented."""
    c = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), F.lit(1).cast("long").alias("page"), F.lit(0).cast("long").alias("col"), F.col("turn").cast("double").alias("top"), F.when(F.length("text") > 300, 20.0).otherwise(0.0).alias("left"),
        F.when(F.col("role") == "user", "heading").when(F.col("role") == "system", "abstract").otherwise("body").alias("kind"), F.col("text"),
    )
    return layout.paragraphs(c).select("doc", "place", F.length("text").alias("n_chars"))


def attributed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of part names with their last word as target, all exactly at their offsets."""
    p = _parts(spark, sf_dir).withColumn("target", F.substring_index("p_name", " ", -1))
    cases = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), "target", (F.length("p_name") - F.length("target")).alias("start"),
        F.length("p_name").alias("end"), F.col("p_brand").alias("source")
    )
    return layout.attributed_cases(cases).select("id", "target", "start")


def finder_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found against gold phrases by source: hits, false finds and misses, right suggestions among hits; lines are phrases, their flag the source, equal status the right suggestion."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    gold = li.filter("l_quantity > 20").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("g"), F.min("l_linestatus").alias("gs"))
    found = li.filter("l_discount > 0.045").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("fs"))
    x = gold.join(found, ["l_orderkey", "l_linenumber"], "full")
    hit = F.col("g").isNotNull() & F.col("f").isNotNull()
    by = x.groupBy(F.coalesce("f", "g").alias("source")).agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"),
        F.count_if(hit & (F.col("gs") == F.col("fs"))).alias("right")
    )
    ratio = lambda a, b: F.round(F.coalesce(ev.divide(a, b), F.lit(0.0)), 6)
    return by.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "suggestions": ratio(F.col("right"), F.col("tp"))
        }
    )


def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language and kind (short texts or long): positives, negatives, and the AUC of the score, ties counted half."""
    x = eq._scored_labels(spark, sf_dir).join(
        read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    ).withColumn("kind", F.when(F.col("n_chars") < 1000, "short").otherwise("long"))
    by = ["lang", "kind"]
    cells = x.groupBy(*by, "score").agg(F.count("*").alias("k"), F.sum("quality").cast("long").alias("p"), F.sum(1 - F.col("quality")).cast("long").alias("q"))
    before = F.sum("k").over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("score")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = cells.withColumn("rank_score", F.coalesce(before, F.lit(0)) + (F.col("k") + 1) / F.lit(2.0))
    s = ranked.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("rank_score") * F.col("p")).alias("r"))
    return s.select(
        *by, "n_pos", "n_neg",
        F.round(ev.divide(F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, F.col("n_pos") * F.col("n_neg")), 9).alias("auc")
    )


def structure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language's rewrites: changed ones, those with a shorter longest word, copies kept where the reference (the even ids) asks for one."""
    from lexaria.plans.text_queries import _pairs

    longest = lambda c: F.array_max(F.transform(c, lambda w: F.length(w)))
    p = _pairs(spark, sf_dir).select(
        "doc_id", "lang", (F.array_join("source", " ") != F.array_join("output", " ")).alias("changed"),
        (longest("output") < longest("source")).alias("shorter")
    )
    return p.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), F.count_if("shorter").alias("n_shorter"),
        F.count_if((F.col("doc_id") % 2 == 0) & ~F.col("changed")).alias("copies_kept")
    )


def reference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that both simplification files have: inner join of two files of lines on the source."""
    n = read(spark, sf_dir, "nation")
    line = lambda d, v: d.select(F.col("n_nationkey").cast("long").alias("line"), F.concat_ws("\t", "n_name", v).alias("value"))
    a = lines.fields(line(n.filter("n_nationkey % 2 = 0"), F.lower("n_name")), exactly=2).select(F.col("f")[0].alias("source"), F.col("f")[1].alias("first"))
    b = lines.fields(
        line(n.filter("n_nationkey % 3 = 0"), F.substring("n_name", 1, 3)), exactly=2
    ).select(F.col("f")[0].alias("source"), F.col("f")[1].alias("second"))
    return a.join(b, "source")


def containment_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names of which none contains, or is contained in, a region's name; regions are a handful, so the comparison is a broadcast one."""
    r = read(spark, sf_dir, "region").select(F.lower(F.substring("r_name", 1, 2)).alias("r"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("n"))
    return n.join(F.broadcast(r), F.contains("n", "r") | F.contains("r", "n"), "left_anti").select("n_nationkey")


def connector_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which occurrence of the most frequent role change of a conversation dominates: the number (1, 2, ...) of its longest turn among the turns of its role."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    t = read(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").alias("n"), F.row_number().over(w).cast("long").alias("k"))
    return t.groupBy("conv_id", "role").agg(F.max(F.struct("n", (-F.col("k")).alias("k"))).alias("b")).select(
        "conv_id", "role", (-F.col("b.k")).alias("occurrence"), F.col("b.n").alias("n")
    )


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct flags of each order's lines, in order of first occurrence."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return li.select("l_orderkey", F.array_join(F.array_distinct(F.transform("x", lambda r: r["l_returnflag"])), ",").alias("flags"))


def exposure_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents that a trainer sees which takes 300 of them in hash order an epoch, after one, two and three epochs with an order of their own."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    seen = None
    for epoch in range(3):
        h = F.sha2(F.concat(F.lit(f"{epoch}:"), F.col("doc_id").cast("string")), 256)
        part = d.orderBy(h).limit(300).withColumn("epoch", F.lit(epoch))
        seen = part if seen is None else seen.unionByName(part)
    first = seen.groupBy("doc_id").agg(F.min("epoch").alias("epoch"))
    return first.groupBy("epoch").agg(F.count("*").alias("new"))


def staged_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores once, arms as thresholds on them: accepted passages of each arm."""
    cells = eq._cells(spark, sf_dir)
    return execution.staged(
        cells, "value", {"low": 40.0, "middle": 50.0, "high": 60.0}, ["system", "passage"]
    ).groupBy("config", "system").agg(F.count_if("accepted").alias("n"))


def blind_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blind order of two arms' parts, joined back by the key: how many of each arm come in the first half."""
    p = _parts(spark, sf_dir).select(
        F.col("p_partkey").alias("id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("system"), "p_name"
    )
    sheet, key = execution.blind_sheet(p, "s1")
    return sheet.join(key, "item").filter("item < '8'").groupBy("system").agg(F.count("*").alias("n"), F.min("item").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        udf_system, udf_rewriter, udf_stage, udf_veto, udf_entailment, udf_generator, udf_scorer, udf_aggregate, udtf_best, layout_lines, layout_paragraphs, attributed_cases, finder_scoreboard, calibration_report, structure_metrics,
        reference_pairs, containment_exclusion, connector_dominance, ordered_distinct, exposure_replay, staged_arms, blind_sheet,
    )
}

ORACLES = {
    "udf_system": "SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS output FROM documents",
    "udf_rewriter": "SELECT doc_id, CASE WHEN length(text) < 400 THEN length(replace(text, ' ', '')) ELSE length(text) END::INT AS n, length(text)::DOUBLE AS score, length(text) < 400 AS passed FROM documents",
    "udf_stage": r"""WITH t AS (SELECT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS t FROM documents) SELECT m[t] AS replacement, count(*) AS n
        FROM t, (SELECT MAP {""" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(RULES.items())) + """} AS m) WHERE m[t] IS NOT NULL GROUP BY 1""",
    "udf_veto": "SELECT p_partkey, length(p_type) > length(p_name) AS vetoed FROM part",
    "udf_entailment": r"""WITH p AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '\w+') AS w FROM part) SELECT a.p_partkey, round(len(list_filter(a.w, lambda x: list_contains(b.w, x)))::DOUBLE / len(a.w), 6) AS p FROM p a JOIN p b ON b.p_partkey = a.p_partkey - 1""",
    "udf_generator": "WITH c AS (SELECT unnest(range(1, least(4, length(p_brand)) + 1)) AS k, p_brand FROM part) SELECT left(p_brand, k) AS candidate, count(*) AS n, max(k)::DOUBLE AS score FROM c GROUP BY 1",
    "udf_scorer": """WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), '')) AS n, list_distinct(string_split(lower(p_type), '')) AS t
        FROM part)
        SELECT p_partkey, len(list_filter(n, lambda x: x <> '' AND list_contains(t, x)))::DOUBLE AS a, len(list_filter(n, lambda x: list_contains(['a', 'b',
            'c'], x)))::DOUBLE AS b FROM p""",
    "udf_aggregate": "SELECT p_brand, round((max(p_retailprice) + min(p_retailprice)) / 2, 4) AS middle FROM part GROUP BY 1",
    "udtf_best": """WITH w AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part),
        c AS (SELECT p_brand, left(w, k) AS candidate, max(k + length(w) / 100.0::DOUBLE) AS score FROM w, range(3, 100) r(k) WHERE k <= length(w) GROUP BY 1, 2)
        SELECT p_brand, candidate, score FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, candidate) <= 5""",
    "layout_lines": """WITH RECURSIVE e AS (SELECT p_brand || '-' || (p_partkey // 2000) AS doc, p_partkey % 10 + 1 AS page, (p_partkey // 10) % 2 AS col, p_size * 3 AS top,
            p_partkey % 7 * 100 AS l, p_partkey % 7 * 100 + 50 AS r, p_name AS text FROM part),
        s AS (SELECT doc, page, col, min(top) AS start FROM e GROUP BY 1, 2, 3
            UNION ALL SELECT s.doc, s.page, s.col, min(e.top) FROM s JOIN e USING (doc, page, col) WHERE e.top > s.start + 4 GROUP BY s.doc, s.page, s.col, s.start),
        a AS (SELECT e.doc, e.page, e.col, l, r, text, max(start) AS line FROM e JOIN s ON s.doc = e.doc AND s.page = e.page AND s.col = e.col AND s.start <= e.top
            GROUP BY e.doc, e.page, e.col, l, r, text, e.top),
        j AS (SELECT *, CASE WHEN l - lag(r) OVER w > 2 THEN ' ' ELSE '' END || text AS piece FROM a WINDOW w AS (PARTITION BY doc, page, col, line ORDER BY l, r, text))
        SELECT doc, page, col, line::DOUBLE AS top, min(l)::DOUBLE AS "left", string_agg(piece, '' ORDER BY l, r, text) AS text FROM j GROUP BY doc, page, col, line""",
    "layout_paragraphs": """WITH t AS (SELECT conv_id AS doc, turn, CASE role WHEN 'user' THEN 'heading' WHEN 'system' THEN 'abstract'
        ELSE 'body' END AS kind, CASE WHEN length(text) > 300 THEN 20 ELSE 0 END AS l, text FROM conversations),
        c AS (SELECT doc, l, count(*) AS n FROM t WHERE kind <> 'heading' GROUP BY 1, 2), e AS (SELECT doc, l AS edge FROM (SELECT *,
            row_number() OVER (PARTITION BY doc ORDER BY n DESC, l) AS k FROM c) WHERE k = 1),
        f AS (SELECT t.*, CASE WHEN coalesce(lag(kind) OVER w, 'heading') = 'heading' OR lag(kind) OVER w <> kind OR l - coalesce(edge, l) > 5 THEN 1
            ELSE 0 END AS start FROM t LEFT JOIN e USING (doc) WINDOW w AS (PARTITION BY doc ORDER BY turn)),
        g AS (SELECT *, sum(start) OVER (PARTITION BY doc ORDER BY turn) AS place FROM f WHERE kind <> 'heading'), j AS (SELECT doc, place, string_agg(text,
            chr(10) ORDER BY turn) AS x FROM g GROUP BY 1, 2)
        SELECT doc, place::BIGINT AS place, length(replace(regexp_replace(x, '([a-z])-\\n([a-z])', '\\1\\2', 'g'), chr(10), ' '))::INT AS n_chars FROM j""",
    "attributed_cases": "SELECT p_partkey AS id, string_split(p_name, ' ')[-1] AS target, (length(p_name) - length(string_split(p_name, ' ')[-1]))::INT AS start FROM part",
    "finder_scoreboard": """WITH g AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS g, min(l_linestatus) AS gs FROM lineitem WHERE l_quantity > 20
        GROUP BY 1, 2), f AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f, max(l_linestatus) AS fs FROM lineitem WHERE l_discount > 0.045
        GROUP BY 1, 2),
        x AS (SELECT coalesce(f, g) AS source, count_if(g IS NOT NULL AND f IS NOT NULL)::BIGINT AS tp, count_if(g IS NULL)::BIGINT AS fp,
            count_if(f IS NULL)::BIGINT AS fn, count_if(gs = fs)::BIGINT AS right_ FROM g FULL JOIN f USING (l_orderkey, l_linenumber) GROUP BY 1)
        SELECT source, tp, fp, fn, right_ AS "right", round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall,
            round(right_::DOUBLE / tp, 6) AS suggestions FROM x""",
    "calibration_report": f"""WITH {eq._L}, y AS (SELECT x.*, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS kind FROM x
        JOIN documents d USING (doc_id)),
        r AS (SELECT *, rank() OVER (PARTITION BY lang, kind ORDER BY score) + (count(*) OVER (PARTITION BY lang, kind, score) - 1) / 2.0::DOUBLE AS rank
            FROM y), s AS (SELECT lang, kind, sum(quality)::BIGINT AS p, sum(1 - quality)::BIGINT AS n, sum(rank) FILTER (WHERE quality = 1) AS r FROM r
            GROUP BY 1, 2)
        SELECT lang, kind, p AS n_pos, n AS n_neg, round(CASE WHEN p * n > 0 THEN (r - p * (p + 1) / 2.0::DOUBLE) / (p * n) END, 9) AS auc FROM s""",
    "reference_pairs": "SELECT n_name AS source, lower(n_name) AS first, left(n_name, 3) AS second FROM nation WHERE n_nationkey % 6 = 0",
    "containment_exclusion": "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE contains(lower(n_name), lower(left(r_name, 2))) OR contains(lower(left(r_name, 2)), lower(n_name)))",
    "connector_dominance": """WITH t AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY n DESC NULLS LAST, k) AS j FROM t) SELECT conv_id, role, k AS occurrence, n::INT AS n FROM r WHERE j = 1""",
    "ordered_distinct": "WITH f AS (SELECT l_orderkey, l_returnflag, min((l_linenumber, l_returnflag)) AS k FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY k) AS flags FROM f GROUP BY 1",
    "exposure_replay": """WITH d AS (SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256(epoch || ':' || doc_id)) AS k FROM documents, range(3) t(epoch)), f AS (SELECT doc_id, min(epoch) AS epoch FROM d WHERE k <= 300 GROUP BY 1) SELECT epoch::INT AS epoch, count(*) AS "new" FROM f GROUP BY 1""",
    "staged_arms": f"WITH {eq._C}, a(config, t) AS (VALUES ('low', 40.0), ('middle', 50.0), ('high', 60.0)) SELECT config, system, count_if(value >= t)::BIGINT AS n FROM c, a GROUP BY 1, 2",
    "blind_sheet": "WITH x AS (SELECT s AS system, left(sha256('s1:' || p_partkey || ':' || s), 16) AS item FROM part, (VALUES ('a'), ('b')) t(s)) SELECT system, count(*) AS n, min(item) AS first FROM x WHERE item < '8' GROUP BY 1",
}


def _structure_sql() -> str:
    from lexaria.plans import text_queries as tq

    return f"""WITH {tq._PAIRS_SQL}, c AS (SELECT d.lang, q.doc_id, array_to_string(q.source, ' ') <> array_to_string(q.output, ' ') AS changed,
        list_max(list_transform(q.output, lambda w: length(w))) < list_max(list_transform(q.source, lambda w: length(w))) AS shorter FROM q
        JOIN documents d USING (doc_id))
        SELECT lang, count(*) AS n, count_if(changed)::BIGINT AS n_changed, count_if(shorter)::BIGINT AS n_shorter, count_if(doc_id % 2 = 0
            AND NOT changed)::BIGINT AS copies_kept FROM c GROUP BY 1"""


ORACLES["structure_metrics"] = _structure_sql()
