"""Queries that need an algorithm of their own: greedy matching, simplex weights, a sequence tagger, terms of all lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.functions.batches import dealt
from lexaria.operators import dictionaries, fitting, selection, tagger, terms
from lexaria.plans.text_queries import _W, read

#: Turns of a conversation that make one sequence at most.
TURNS, BINS = 64, 1 << 14


def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in hash order of which no two share a customer or a day: what the greedy pass takes, and in which round."""
    keys = F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("d"), F.col("o_orderdate").cast("string")))
    order = F.sha2(F.concat(F.lit("3:"), F.col("o_orderkey").cast("string")), 256)
    return selection.greedy_sample(read(spark, sf_dir, "orders"), "o_orderkey", keys, order).select(F.col("id").alias("o_orderkey"), "round")


def simplex_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of quantity, discount and tax on the simplex whose mix correlates best with price, by return flag and line status."""
    x = read(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_quantity") / 50.0).alias("f"), (F.col("l_discount") * 10.0).alias("g"), (F.col("l_tax") * 10.0).alias("h"),
        F.col("l_extendedprice").alias("y")
    )
    fitted = fitting.simplex_fit(x, ["f", "g", "h"], "y", ["l_returnflag", "l_linestatus"])
    w = [F.round(F.col("weights")[i], 3).alias(c) for i, c in enumerate("fgh")]
    return fitted.select("l_returnflag", "l_linestatus", "n", *w, F.round("r", 6).alias("r"))


def role_sequences(spark: SparkSession, sf_dir: str, roles: list[str]) -> DataFrame:
    """Conversations in sequences of at most TURNS turns: features and roles (a number) of each turn."""
    c = read(spark, sf_dir, "conversations").filter(F.col("role").isin(roles))
    label = F.array_position(F.array(*map(F.lit, roles)), F.col("role")).cast("int") - 1
    turn = F.struct("turn", F.xxhash64("text").alias("tie"), tagger.hashed_words(F.col("text"), BINS).alias("features"), label.alias("label"))
    part = F.floor(F.coalesce("turn", F.lit(0)) / TURNS)
    rows = c.select("conv_id", part.alias("part"), turn.alias("t")).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("t"))
    held = F.crc32(F.col("conv_id").cast("string")) % 5 == 1
    return rows.select("conv_id", held.alias("held_out"), F.col("t.turn").alias("turns"), F.col("t.features").alias("features"), F.col("t.label").alias("labels"))


def role_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of every turn as a tagger of sequences tells it from the turns' words; conversations that are held out weren't learned from."""
    roles = sorted(r.role for r in read(spark, sf_dir, "conversations").filter("role is not null").select("role").distinct().limit(65).collect())
    if len(roles) > 64:
        raise ValueError("a tagger's labels are few: there are more than 64 roles")
    rows = role_sequences(spark, sf_dir, roles)
    model = tagger.train(rows.filter("not held_out"), roles, BINS, penalty=1.0, steps=12)
    told = model.marginals(rows, ["conv_id", "held_out", "turns", "labels"])
    best = F.transform("marginals", lambda p: F.array_position(p, F.array_max(p)).cast("int") - 1)
    each = told.select("conv_id", "held_out", F.explode(F.arrays_zip("turns", "labels", best.alias("best"))).alias("x"))
    name = lambda c: F.get(F.array(*map(F.lit, roles)), F.col(c))
    return each.select("conv_id", "held_out", F.col("x.turns").alias("turn"), name("x.labels").alias("role"), name("x.best").alias("role_pred"))


def term_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two to five words, each item's first ones, in all documents: places and distinct terms by document."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    items = read(spark, sf_dir, "benchmark").select(w.alias("w"), F.explode(F.array(*map(F.lit, range(2, 6)))).alias("k")).filter(F.size("w") >= F.col("k"))
    known = items.select(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("term"))
    docs = dealt(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = terms.find_terms(docs, known, ["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n_places"), F.count_distinct("term").alias("n_terms"), F.sum(F.col("stop") - F.col("start")).alias("n_chars"))


def _spoken(words: DataFrame, more: int) -> DataFrame:
    """Words with sounds: a stressed one for each vowel letter, and so many more."""
    vowels = F.size(F.regexp_extract_all("word", F.lit("[aeiou]"), F.lit(0)))
    return words.select("word", F.concat(F.lit("K"), F.repeat(F.lit(" AH1"), vowels + more), F.lit(" T")).alias("sounds"))


def dictionary_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables of all words of the documents by a dictionary of the test items' words (two pronunciations each), which one of the parts' words overrides."""
    items, parts = (dictionaries.corpus_words(read(spark, sf_dir, t), c).select("word") for t, c in (("benchmark", "text"), ("part", "p_name")))
    own = dictionaries.override_union([_spoken(parts, 0), _spoken(items, 1).unionByName(_spoken(items, 2))], "word")
    words = dictionaries.corpus_words(read(spark, sf_dir, "documents"))
    return dictionaries.dictionary_syllables(words, own)


def dictionary_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of all words of the documents: forms in -ly are listed with what they are made of, the test items' words are the lexicon, endings come last."""
    words = dictionaries.corpus_words(read(spark, sf_dir, "documents"))
    lexicon = dictionaries.corpus_words(read(spark, sf_dir, "benchmark"))
    listed = lexicon.filter("word like '%ly'").select(F.col("word").alias("form"), F.expr("left(word, length(word) - 2)").alias("lemma"))
    found = dictionaries.lemmas(words, listed, lexicon.select("word"))
    return found.groupBy("lemma", "how").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (greedy_pairs, simplex_fit, role_tagger, term_places, dictionary_syllables, dictionary_lemmas)}

#: Rounds of the greedy pass: a row that is first under both keys is taken, the others of its keys are gone.
_ROUNDS = """r AS (SELECT *, 0 AS round, 'open' AS state FROM o
        UNION ALL SELECT id, h, c, d, round + 1, CASE WHEN won THEN 'taken' WHEN bool_or(won) OVER (PARTITION BY c) OR bool_or(won) OVER (PARTITION BY d) THEN 'gone' ELSE 'open' END
        FROM (SELECT *, h = min(h) OVER (PARTITION BY c) AND h = min(h) OVER (PARTITION BY d) AS won FROM r WHERE state = 'open'))"""
_SYMBOLS = r"list_transform(regexp_extract_all(lower({0}), '[\s-]+|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s-]'), lambda x: CASE WHEN regexp_matches(x, '^[\s-]') THEN ' ' ELSE x END)"

_CUT = " UNION ALL ".join(
    f"SELECT word, {i} AS place, left(word, length(word) - {len(end)}) || '{to}' AS lemma FROM o WHERE word LIKE '%{end}'" for i, (end, to) in enumerate(dictionaries.ENDINGS)
)

ORACLES = {
    "dictionary_syllables": f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_W}) AS word FROM documents) GROUP BY 1),
        i AS (SELECT DISTINCT unnest({_W}) AS word FROM benchmark), p AS (SELECT DISTINCT unnest({_W.replace("text", "p_name")}) AS word FROM part),
        s AS (SELECT word, length(regexp_replace(word, '[^aeiou]', '', 'g')) AS k FROM p
            UNION ALL SELECT word, length(regexp_replace(word, '[^aeiou]', '', 'g')) + 1 FROM i WHERE word NOT IN (SELECT word FROM p)),
        g AS (SELECT word, n, regexp_replace(word, '[^a-z]', '', 'g') AS plain FROM w),
        r AS (SELECT *, len(regexp_extract_all(plain, '[aeiouy]+')) AS groups FROM g)
        SELECT word, n, coalesce(k, CASE WHEN length(plain) <= 3 THEN 1 ELSE greatest(1, groups - CASE WHEN plain LIKE '%e' AND groups > 1 THEN 1 ELSE 0 END) END) AS syllables,
            k IS NOT NULL AS known FROM r LEFT JOIN s USING (word)""",
    "dictionary_lemmas": f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_W}) AS word FROM documents) GROUP BY 1),
        l AS (SELECT DISTINCT unnest({_W}) AS word FROM benchmark),
        o AS (SELECT word FROM w WHERE word NOT IN (SELECT word FROM l)), t AS ({_CUT}),
        f AS (SELECT t.word, t.lemma FROM t JOIN l ON l.word = t.lemma QUALIFY row_number() OVER (PARTITION BY t.word ORDER BY place) = 1),
        r AS (SELECT w.word, n, CASE WHEN l.word LIKE '%ly' THEN left(l.word, length(l.word) - 2) WHEN l.word IS NOT NULL THEN l.word ELSE f.lemma END AS lemma,
            CASE WHEN l.word LIKE '%ly' THEN 'listed' WHEN l.word IS NOT NULL THEN 'whole' WHEN f.lemma IS NOT NULL THEN 'ending' END AS how
            FROM w LEFT JOIN l USING (word) LEFT JOIN f USING (word))
        SELECT lemma, how, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""",
    "greedy_pairs": f"""WITH RECURSIVE o AS (SELECT o_orderkey AS id, sha256('3:' || o_orderkey) AS h, o_custkey AS c, o_orderdate AS d FROM orders), {_ROUNDS}
        SELECT id AS o_orderkey, round FROM r WHERE state = 'taken'""",
    # the best weights on every face of the simplex, solved
    "simplex_fit": """WITH x AS (SELECT l_returnflag, l_linestatus, l_quantity / 50.0::DOUBLE AS f, l_discount * 10.0::DOUBLE AS g, l_tax * 10.0::DOUBLE AS h, l_extendedprice::DOUBLE AS y FROM lineitem),
        m AS (SELECT l_returnflag, l_linestatus, count(*) AS n, var_pop(f) AS ff, var_pop(g) AS gg, var_pop(h) AS hh, covar_pop(f, g) AS fg, covar_pop(f, h) AS fh,
            covar_pop(g, h) AS gh, covar_pop(f, y) AS fy, covar_pop(g, y) AS gy, covar_pop(h, y) AS hy, var_pop(y) AS yy FROM x GROUP BY 1, 2),
        w AS (SELECT *, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM m UNION ALL SELECT *, 0, 1, 0 FROM m UNION ALL SELECT *, 0, 0, 1 FROM m
            UNION ALL SELECT *, gg * fy - fg * gy, ff * gy - fg * fy, 0 FROM m UNION ALL SELECT *, hh * fy - fh * hy, 0, ff * hy - fh * fy FROM m
            UNION ALL SELECT *, 0, hh * gy - gh * hy, gg * hy - gh * gy FROM m
            UNION ALL SELECT *, fy * (gg * hh - gh * gh) - gy * (fg * hh - gh * fh) + hy * (fg * gh - gg * fh),
                -fy * (fg * hh - gh * fh) + gy * (ff * hh - fh * fh) - hy * (ff * gh - fg * fh),
                fy * (fg * gh - gg * fh) - gy * (ff * gh - fg * fh) + hy * (ff * gg - fg * fg) FROM m),
        r AS (SELECT *, (a * fy + b * gy + c * hy) / sqrt((a * a * ff + b * b * gg + c * c * hh + 2 * a * b * fg + 2 * a * c * fh + 2 * b * c * gh) * yy) AS r
            FROM w WHERE a >= 0 AND b >= 0 AND c >= 0 AND a + b + c > 0)
        SELECT l_returnflag, l_linestatus, n, round(a / (a + b + c), 3) AS f, round(b / (a + b + c), 3) AS g, round(c / (a + b + c), 3) AS h, round(r, 6) AS r
        FROM r QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY r DESC) = 1""",
    "term_places": rf"""WITH i AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
        t AS (SELECT DISTINCT array_to_string(w[1:k], ' ') AS term, 2 * k - 1 AS k FROM i, range(2, 6) r(k) WHERE len(w) >= k),
        f AS (SELECT DISTINCT string_split(term, ' ')[1] AS f FROM t),
        d AS (SELECT doc_id, {_SYMBOLS.format("text")} AS s, regexp_extract_all(text, '[\s-]+|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s-]') AS raw FROM documents),
        p AS (SELECT doc_id, unnest(list_transform(range(1, len(s) + 1), lambda i: s[i:i + 8])) AS s, unnest(list_transform(range(1, len(s) + 1), lambda i: raw[i:i + 8])) AS raw FROM d),
        q AS (SELECT doc_id, s, raw FROM p JOIN f ON f.f = s[1]),
        m AS (SELECT q.doc_id, t.term, length(array_to_string(raw[1:k], '')) AS chars FROM q, range(2, 6) r(h) JOIN t ON t.k = 2 * h - 1
            AND t.term = array_to_string(s[1:2 * h - 1], ''))
        SELECT doc_id, count(*) AS n_places, count(DISTINCT term) AS n_terms, CAST(sum(chars) AS BIGINT) AS n_chars FROM m GROUP BY 1""",
}
