"""Queries on texts and on pairs of a text and its rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaria.functions import alignment, counted, measures, pairs, preserve, text
from lexaria.functions.batches import column_of, dealt, rows_of
from lexaria.operators import rewrite
from lexaria.sources import loaders

#: The rewrite rules of the queries: frequent tokens of the tables.
RULES = {"the": "a", "thereon": "on", "within": "in", "thing": "item", "nicht": "kein", "dans": "en", "entre": "en", "tion": "act", "ing": "do"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return dealt(docs.select(*(c for c in ("doc_id", "lang", "text") if c in docs.columns)))


def readability_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counted.with_measures(_docs(spark, sf_dir).select("lang", "text"), "text", "x")
    n = {f"n_{c}": F.col("x_sum")[c] for c in ("sentences", "syllables", "poly", "long")} | {"n_words": F.col("x_sum")["n"]}
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(n["n_words"]).alias("n_words"), *(F.round(F.avg(c), 6).alias(f"mean_{k}") for k, c in text.scores_f(n).items())
    )


def readability_family_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report metrics: words, sentences by the split, reading ease, grade, fog, smog, mean sentence and word length, technical terms."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    rows = counted.with_measures(docs, "text", "x", counted.syllables_r, text.WORD_R)
    s = F.col("x_sum")
    sentences = F.when(s["n"] > 0, F.greatest(F.size(text.sentences(F.col("text"))), F.lit(1))).otherwise(0).cast("long")
    counts = counted.once(rows, n_sentences=sentences).select(
        "doc_id", s["n"].alias("n_words"), "n_sentences", s["syllables"].alias("n_syllables"), s["poly"].alias("n_poly"), s["letters"].alias("n_letters"), s["poly"].alias("n_terms")
    )
    scores = text.scores_r({c: F.col(c) for c in counts.columns})
    scores |= {
        "sentence_length": F.when(F.col("n_words") > 0, F.col("n_words") / F.col("n_sentences")),
        "word_length": F.when(F.col("n_words") > 0, F.col("n_letters") / F.col("n_words"))
    }
    return counts.select("doc_id", "n_words", "n_sentences", "n_syllables", "n_poly", "n_terms", *(F.round(c, 6).alias(k) for k, c in scores.items()))


def word_complexity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most complex (text, word) pairs, each word among the other words of its text."""

    rows = counted.with_complexities(counted.with_measures(_docs(spark, sf_dir).select("doc_id", "text"), "text", "x"), "x", measures.DEFAULT_WORD)
    # only a text's 50 best can be among the 50 best of all
    best = F.slice(F.array_sort(F.transform("x_c", lambda x: F.struct((-F.round(x["c"], 9)).alias("c"), x["w"].alias("w")))), 1, 50)
    scored = rows.select("doc_id", F.explode(best).alias("x")).select("doc_id", F.col("x.w").alias("word"), (-F.col("x.c")).alias("complexity"))
    return scored.orderBy(F.desc("complexity"), "doc_id", "word").limit(50).select("doc_id", "word", "complexity")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "lang", "text", F.split(F.trim(F.col("text")), " +").alias("source"))
    return d.withColumn("output", rewrite.dictionary(F.col("source"), RULES))


def dictionary_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    changed = F.size(F.filter(F.zip_with("source", "output", lambda a, b: a != b), lambda x: x))
    return p.select(
        "doc_id", F.size("source").alias("n_tokens"), changed.alias("n_changed"),
        F.md5(F.array_join("output", " ").cast("binary")).alias("output_md5")
    )


def _rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with single spaces (a) and its rewrite (b)."""
    return _pairs(spark, sf_dir).select("doc_id", F.array_join("source", " ").alias("a"), F.array_join("output", " ").alias("b"))


def simplicity_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S with the weights fitted to ratings, from the reductions of complex words and of rare terms and the gain in reading score."""
    parts = rows_of(
        _rewrites(spark, sf_dir), lambda a, b: measures.trained_simplicity(a or "", b or ""), "s_lex double, s_read double, s_jargon double, s double", ["doc_id"], ["a", "b"]
    )
    return parts.select("doc_id", *(F.round(c, 6).alias(c) for c in ("s_lex", "s_read", "s_jargon", "s")))


def explicit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept shares of numbers, dates, names, negating words and tenses, and the numbers, negating words and names that are lost."""
    c = rows_of(_rewrites(spark, sf_dir), preserve.explicit_checks, preserve.CHECKS, ["doc_id"], ["a", "b"])
    return c.select(
        "doc_id", "n_numbers", *(F.round(k, 6).alias(k) for k in ("numbers", "dates", "entities", "capitalised", "negations", "tenses")),
        "lost_numbers", "lost_negations", "lost_entities"
    )


def item_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of explicit_checks that patterns alone decide."""
    return explicit_checks(spark, sf_dir).select("doc_id", "n_numbers", "numbers", "dates", "negations", "lost_numbers")


def tfidf_pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the TF-IDF vectors of source and output, lower-cased words, the pair as corpus; 0 where a side has none. A pair never leaves its row."""
    p = _rewrites(spark, sf_dir)
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    rows = counted.once(p, source=tokens("a"), output=tokens("b"))
    return counted.tfidf_cosine(rows).select("doc_id", F.round(F.coalesce("cosine", F.lit(0.0)), 6).alias("cosine"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the turn after it as output and the two after that as references."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("t"))
    return t.withColumns({"o": F.lead("t").over(w), "r": F.lead("t", 2).over(w), "q": F.lead("t", 3).over(w)}).filter(
        "role = 'user' and t is not null and o is not null and r is not null and q is not null"
    )


def sari_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARI on sets of 1 to 4 grams against one reference."""
    tokens = preserve.metric_tokens
    score = column_of(lambda t, o, r: measures.sari_sets(tokens(t), tokens(o), tokens(r)), "double")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(score("t", "o", "r"), 6).alias("sari"))


def changed_token_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed tokens over source tokens, from the longest-match alignment."""
    return _rewrites(spark, sf_dir).select("doc_id", F.round(column_of(alignment.changed_token_rate, "double")("a", "b"), 6).alias("rate"))


def metric_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal (source, output) pairs are scored once: by the row that has the smallest doc_id of its pair; the score is joined back by the pair's hash."""
    p = _pairs(spark, sf_dir).select(
        "doc_id", "source", "output", F.sha2(F.concat(F.array_join("source", " "), F.lit("\n"), F.array_join("output", " ")), 256).alias("pair")
    )
    of = p.groupBy("pair").agg(F.min("doc_id").alias("first"), F.count("*").alias("uses"))
    scored = p.join(of.select(F.col("first").alias("doc_id"), "uses"), "doc_id").select(
        "pair", "uses", F.size("source").alias("n"),
        F.round(pairs.jaccard(F.array_distinct("source"), F.array_distinct("output")), 6).alias("jaccard")
    )
    return p.select("doc_id", "pair").join(scored, "pair").select("doc_id", "n", "jaccard", "uses")


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.concat(F.array(F.lit("<s>")), text.words(F.col("text")), F.array(F.lit("</s>")))
    two = _docs(spark, sf_dir).select(F.explode(F.arrays_zip(F.slice(w, 1, 1 << 30).alias("a"), F.slice(w, 2, 1 << 30).alias("b"))).alias("p"))
    return two.filter("p.b is not null").groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def bigram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of the language model with sentence markers: bigrams; words, where b is null; and the vocabulary's size, where a is null too."""
    two = _bigrams(spark, sf_dir)
    # each word but the last marker begins as many bigrams as it occurs
    ends = read(spark, sf_dir, "documents").agg(F.count("text").alias("n")).filter("n > 0").select(F.lit("</s>").alias("a"), "n")
    one = two.groupBy("a").agg(F.sum("n").alias("n")).unionByName(ends)
    none = F.lit(None).cast("string")
    size = one.agg(F.count("*").alias("n"))
    return two.unionByName(one.select("a", none.alias("b"), "n")).unionByName(size.select(none.alias("a"), none.alias("b"), "n"))


def corpus_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipf frequency log10(1e9 * count / total) of every word."""
    n = _docs(spark, sf_dir).select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").cast("double").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("word", "n", F.round(F.log10(F.col("n") / F.col("total") * 1e9), 6).alias("zipf"))


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of test items (each item's words by sixes) in documents, by n-gram equality and not by search: every place, and which are kept.

    Items with an even id are the first source, the others the second: inside a
    source a place that overlaps an earlier one of equal length goes, and the first source beats the second.
    """
    six = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 6).cast("int") - 1), lambda k: F.array_join(F.slice("w", k * 6 + 1, 6), " "))
    items = read(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("w")).filter(F.size("w") >= 6)
    phrases = items.select(F.explode(six).alias("phrase"), (F.col("item_id") % 2).alias("k")).groupBy("phrase").agg(F.min("k").alias("source"))
    # the generator keeps the words from being extracted again for every n-gram
    tokens = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(text.words(F.col("text")))).alias("w"))
    grams = tokens.select("doc_id", F.posexplode(pairs.ngrams(F.col("w"), 6)).alias("place", "phrase"))
    found = grams.join(phrases, "phrase").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("source", "place", "phrase"))).alias("found"))
    # a document's few places, first source and first place first: one is kept unless it overlaps one that is
    free = lambda kept, x: ~F.exists(kept, lambda y: F.abs(y["place"] - x["place"]) < 6)
    kept = F.aggregate("found", F.slice("found", 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return found.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.place", "x.phrase", "x.source")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.length)).alias("longest")
    )


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(loaders.html_blocks(F.col("html"))).alias("place", "block"))


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.normalised(F.col("text")), 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        readability_by_lang, readability_family_r, word_complexity_topk, dictionary_rewrite, simplicity_s, explicit_checks, item_checks, tfidf_pair_cosine, sari_proxy, changed_token_rate,
        metric_reuse, bigram_lm, corpus_zipf, phrase_match, sentence_split, html_blocks, normalise_text,
    )
}

_W = "regexp_extract_all(lower(text), '[a-z]+(?:[''-][a-z]+)*')"
_WR = "regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')"


def _syll_f(w: str) -> str:
    p = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    g = f"len(regexp_extract_all({p}, '[aeiouy]+'))"
    return f"CASE WHEN length({p}) <= 3 THEN 1 ELSE greatest({g} - CASE WHEN {p} LIKE '%e' AND {g} > 1 THEN 1 ELSE 0 END, 1) END"


def _syll_r(w: str) -> str:
    return f"greatest(len(regexp_extract_all({w}, '[aeiouy]+')) - CASE WHEN {w} LIKE '%e' THEN 1 ELSE 0 END, 1)"


def _counts_sql(x: str) -> str:
    w = _W.replace("text", x)
    return f"""CAST(len({w}) AS BIGINT) AS n_words, CAST(greatest(len(regexp_extract_all({x}, '[.!?]+')), 1) AS BIGINT) AS n_sentences,
        CAST(coalesce(list_sum(list_transform({w}, lambda w: {_syll_f("w")})), 0) AS BIGINT) AS n_syllables,
        CAST(len(list_filter({w}, lambda w: ({_syll_f("w")}) >= 3)) AS BIGINT) AS n_poly, CAST(len(list_filter({w},
            lambda w: length(w) >= 7)) AS BIGINT) AS n_long"""


_RULE_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(RULES.items())) + "}"
_PAIRS_SQL = f"""p AS (SELECT doc_id, text, regexp_split_to_array(trim(text, ' '), ' +') AS source FROM documents),
    q AS (SELECT doc_id, text, source, list_transform(source, lambda t: coalesce({_RULE_SQL}[t], t)) AS output FROM p)"""


def _grams(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) >= {n} THEN list_distinct(list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))) ELSE [] END"


def _sari_sql() -> str:
    parts = []
    for n in range(1, 5):
        s, o, r = f"s{n}", f"o{n}", f"r{n}"
        both = lambda a, b: f"len(list_intersect({a}, {b}))"
        minus = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
        keep, keep_r, add, add_r, gone, gone_r = f"list_intersect({s}, {o})", f"list_intersect({s}, {r})", minus(o, s), minus(r, s), minus(s, o), minus(s, r)
        for a, b in ((keep, keep_r), (add, add_r)):
            parts.append(f"CASE WHEN len({a}) + len({b}) > 0 THEN 2.0::DOUBLE * {both(a, b)} / (len({a}) + len({b})) ELSE 0 END")
        parts.append(f"CASE WHEN len({gone}) > 0 THEN {both(gone, gone_r)}::DOUBLE / len({gone}) ELSE 0 END")
    return " + ".join(parts)


_SENTENCES = r"""list_filter(string_split(regexp_replace(text, '([.!?]["'')\]]*\s+)([\p{Lu}\p{Nd}"''(\[“‘])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_matches(s, '\S'))"""


def _sums_sql(weights: dict[str, float]) -> str:
    """Common tables k (words of each side), n (their sums) and h (mean complexity and complex words) from t (doc_id, a, b)."""
    return f"""e AS (SELECT doc_id, 'a' AS side, lower(unnest(regexp_extract_all(a, '[A-Za-z]+(?:[''-][A-Za-z]+)*'))) AS w FROM t
            UNION ALL SELECT doc_id, 'b', lower(unnest(regexp_extract_all(b, '[A-Za-z]+(?:[''-][A-Za-z]+)*'))) FROM t),
        k AS (SELECT doc_id, side, w, count(*) AS k, length(w) AS l, {_syll_f("w")} AS y FROM e GROUP BY ALL),
        n AS (SELECT doc_id, side, sum(k)::DOUBLE AS n, sum(k * l) AS letters, sum(k * y) AS syll, coalesce(sum(k) FILTER (WHERE l >= 7), 0) AS long_,
            coalesce(sum(k) FILTER (WHERE y >= 3), 0) AS poly FROM k GROUP BY ALL),
        x AS (SELECT doc_id, side, w, k, 1 / (1 + exp(-({weights["A"]}::DOUBLE - {weights["B"]}::DOUBLE * (6 - l / 2.0::DOUBLE) + {weights["C"]}::DOUBLE * l + {weights["D"]}::DOUBLE * y
            + {weights["E"]}::DOUBLE * coalesce((letters + syll - k * (l + y)) / nullif(n - k, 0), 0)))) AS c FROM k JOIN n USING (doc_id, side)),
        h AS (SELECT doc_id, side, sum(k * c) / sum(k) AS c, coalesce(sum(k) FILTER (WHERE c > 0.5), 0) AS hard FROM x GROUP BY ALL),
        f AS (SELECT doc_id, side, coalesce(n, 0) AS n, greatest(n, 1) AS m, greatest(1, len(regexp_extract_all(txt, '[.!?]+')))::DOUBLE AS s,
            coalesce(letters, 0) AS letters, coalesce(syll, 0) AS syll, coalesce(long_, 0) AS long_, coalesce(poly, 0) AS poly,
            coalesce(c, 0) AS c, coalesce(hard, 0) AS hard FROM (SELECT doc_id, 'a' AS side, a AS txt FROM t UNION ALL SELECT doc_id, 'b', b FROM t) LEFT
                JOIN n USING (doc_id, side) LEFT JOIN h USING (doc_id, side)),
        r AS (SELECT *, (least(1, greatest(0, (206.835::DOUBLE - 1.015::DOUBLE * (m / s) - 84.6::DOUBLE * (syll / m)) / 100)) + 1 - least(1, greatest(0,
            (0.39::DOUBLE * (m / s) + 11.8::DOUBLE * (syll / m) - 15.59::DOUBLE) / 18))
            + 1 - least(1, greatest(0, 0.4::DOUBLE * (m / s + 100 * long_ / m) / 20)) + 1 - least(1, greatest(0,
                (1.043::DOUBLE * sqrt(30 * poly) + 3.1291::DOUBLE) / 20))
            + 1 - least(1, greatest(0, m / s / 40)) + 1 - least(1, greatest(0, letters / m / 12))) / 6 AS score FROM f)"""


def _reduced(a: str, b: str) -> str:
    return f"least(1, greatest(0, ({a} - {b})::DOUBLE / greatest(1, {a})))"


_TEXTS_SQL = f"""{_PAIRS_SQL}, t AS (SELECT doc_id, array_to_string(source, ' ') AS a, array_to_string(output, ' ') AS b FROM q)"""

_FOLDED = "replace(lower({0}), 'ß', 'ss')"
_DATE_SQL = r"'(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b'"
_NUMBER_SQL = r"'(?i)\b\d+(?:,\d{3})*(?:\.\d+)?\b|\b\d+\s*(?:%|percent|dollars?|USD|million|billion|thousand)\b'"


def _kept(items: str) -> str:
    """Share of the distinct items that b has as whole words in any case."""
    held = f"list_filter(list_distinct({items}), lambda i: regexp_matches(' ' || lower(b) || ' ', '[^\\p{{L}}\\p{{N}}_]' || regexp_escape(lower(i)) || '[^\\p{{L}}\\p{{N}}_]'))"
    return f"CASE WHEN len({items}) = 0 THEN 1 ELSE len({held})::DOUBLE / len(list_distinct({items})) END"


ORACLES = {
    "readability_by_lang": f"""
        WITH c AS (SELECT doc_id, lang, {_counts_sql("text")} FROM documents)
        SELECT lang, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS n_words,
            round(avg(CASE WHEN n_words > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * n_words / n_sentences - 84.6::DOUBLE * n_syllables / n_words END),
                6) AS mean_flesch,
            round(avg(CASE WHEN n_words > 0 THEN 0.39::DOUBLE * n_words / n_sentences + 11.8::DOUBLE * n_syllables / n_words - 15.59::DOUBLE END),
                6) AS mean_grade,
            round(avg(CASE WHEN n_words > 0 THEN 0.4::DOUBLE * (n_words::DOUBLE / n_sentences + 100.0::DOUBLE * n_long / n_words) END), 6) AS mean_fog,
            round(avg(CASE WHEN n_words > 0 THEN 1.043::DOUBLE * sqrt(30.0::DOUBLE * n_poly) + 3.1291::DOUBLE END), 6) AS mean_smog
        FROM c GROUP BY lang""",
    "readability_family_r": f"""
        WITH c AS (SELECT doc_id, CAST(len({_WR}) AS BIGINT) AS n_words,
            CAST(CASE WHEN len({_WR}) > 0 THEN greatest(len({_SENTENCES}), 1) ELSE 0 END AS BIGINT) AS n_sentences,
            CAST(coalesce(list_sum(list_transform({_WR}, lambda w: {_syll_r("w")})), 0) AS BIGINT) AS n_syllables,
            CAST(len(list_filter({_WR}, lambda w: {_syll_r("w")} >= 3)) AS BIGINT) AS n_poly, coalesce(list_sum(list_transform({_WR}, lambda w: length(w))),
                0) AS letters FROM documents)
        SELECT * EXCLUDE (letters), n_poly AS n_terms, round(CASE WHEN n_words > 0
            THEN 206.835::DOUBLE - 1.015::DOUBLE * n_words / n_sentences - 84.6::DOUBLE * n_syllables / n_words END, 6) AS ease,
            round(CASE WHEN n_words > 0 THEN 0.39::DOUBLE * n_words / n_sentences + 11.8::DOUBLE * n_syllables / n_words - 15.59::DOUBLE END, 6) AS grade,
            round(CASE WHEN n_words > 0 THEN 0.4::DOUBLE * (n_words::DOUBLE / n_sentences + 100.0::DOUBLE * n_poly / n_words) END, 6) AS fog,
            round(CASE WHEN n_words > 0 THEN 1.043::DOUBLE * sqrt(30.0::DOUBLE * n_poly / n_sentences) + 3.1291::DOUBLE END, 6) AS smog,
            round(CASE WHEN n_words > 0 THEN n_words::DOUBLE / n_sentences END, 6) AS sentence_length, round(CASE WHEN n_words > 0
                THEN letters::DOUBLE / n_words END, 6) AS word_length
        FROM c""",
    "sentence_split": f"SELECT doc_id, len({_SENTENCES})::INT AS n_sentences, list_max(list_transform({_SENTENCES}, lambda s: length(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))))::INT AS longest FROM documents",
    "word_complexity_topk": f"""
        WITH t AS (SELECT doc_id, text AS a, NULL AS b FROM documents), {_sums_sql(measures.DEFAULT_WORD)}
        SELECT doc_id, w AS word, round(c, 9) AS complexity FROM x ORDER BY complexity DESC, doc_id, word LIMIT 50""",
    "dictionary_rewrite": f"""
        WITH {_PAIRS_SQL} SELECT doc_id, CAST(len(source) AS INT) AS n_tokens,
            CAST(len(list_filter(range(1, len(source) + 1), lambda i: source[i] <> output[i])) AS INT) AS n_changed, md5(array_to_string(output,
                ' ')) AS output_md5 FROM q""",
    "simplicity_s": f"""
        WITH {_TEXTS_SQL}, {_sums_sql(measures.TRAINED_WORD)},
        j AS (SELECT doc_id, coalesce(sum(k) FILTER (WHERE side = 'a' AND l > 6), 0) AS a, coalesce(sum(k) FILTER (WHERE side = 'b' AND l > 6
            AND w IN (SELECT w FROM k z WHERE z.doc_id = k.doc_id AND z.side = 'a')), 0) AS b FROM k GROUP BY 1),
        pp AS (SELECT a.doc_id, {_reduced("a.hard", "b.hard")} AS s_lex, least(1, greatest(0, b.score - a.score + 0.5)) AS s_read,
            {_reduced("coalesce(j.a, 0)", "coalesce(j.b, 0)")} AS s_jargon
            FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.side = 'a' AND b.side = 'b' LEFT JOIN j ON j.doc_id = a.doc_id)
        SELECT doc_id, round(s_lex, 6) AS s_lex, round(s_read, 6) AS s_read, round(s_jargon, 6) AS s_jargon,
            round({measures.TRAINED_SENTENCE[0]}::DOUBLE * s_lex + {measures.TRAINED_SENTENCE[1]}::DOUBLE * s_read + {measures.TRAINED_SENTENCE[2]}::DOUBLE * s_jargon, 6) AS s FROM pp""",
    "item_checks": f"""
        WITH {_TEXTS_SQL}, i AS (SELECT doc_id, b, list_distinct(regexp_extract_all(a, {_NUMBER_SQL})) AS n, regexp_extract_all(b, {_NUMBER_SQL}) AS m,
            regexp_extract_all(a, {_DATE_SQL}) AS d,
            list_filter(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+(?:\\s+[\\p{{L}}\\p{{N}}_]+)*'), lambda x: true) AS runs, a FROM t),
        c AS (SELECT *, list_filter(list_transform(regexp_extract_all(a, '(?:^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,3}}'),
            lambda x: regexp_replace(x, '^[^A-Z]+', '')), lambda x: true) AS caps,
            list_distinct(list_filter(list_transform(regexp_extract_all(a, '[A-Za-z]+(?:''[A-Za-z]+)?|n''t\\b'), lambda x: lower(x)),
                lambda x: list_contains([{", ".join("'" + w.replace("'", "''") + "'" for w in preserve.NEGATIONS)}], x))) AS g FROM i)
        SELECT doc_id, len(n)::INT AS n_numbers, round(CASE WHEN len(n) = 0 THEN 1 ELSE len(list_intersect(n, m))::DOUBLE / len(n) END, 6) AS numbers,
            round({_kept("d")}, 6) AS dates, round({_kept("g")}, 6) AS negations,
            array_to_string(list_sort(list_filter(n, lambda x: NOT list_contains(m, x))), '|') AS lost_numbers FROM c""",
    "tfidf_pair_cosine": f"""
        WITH {_PAIRS_SQL}, k AS (SELECT doc_id, {", ".join(f"regexp_extract_all(lower(array_to_string({c}, ' ')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS {c}" for c in ("source", "output"))} FROM q),
        r AS (SELECT doc_id, unnest(source) AS w, 1 AS a, 0 AS b FROM k UNION ALL SELECT doc_id, unnest(output), 0, 1 FROM k),
        t AS (SELECT doc_id, w, sum(a) AS a, sum(b) AS b FROM r GROUP BY 1, 2),
        v AS (SELECT *, pow(ln(3.0::DOUBLE / (1 + CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END)) + 1, 2) AS i FROM t),
        c AS (SELECT doc_id, round(sum(a * b * i) / sqrt(sum(a * a * i) * sum(b * b * i)), 6) AS cosine FROM v GROUP BY doc_id)
        SELECT doc_id, coalesce(cosine, 0) AS cosine FROM q LEFT JOIN c USING (doc_id)""",
    "sari_proxy": f"""
        WITH l AS (SELECT conv_id, turn, role, text AS t, lead(text) OVER w AS o, lead(text, 2) OVER w AS r, lead(text, 3) OVER w AS q
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        m AS (SELECT conv_id, turn, {", ".join(f"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS {c}" for c in "tor")} FROM l WHERE role = 'user' AND t IS NOT NULL AND o IS NOT NULL AND r IS NOT NULL AND q IS NOT NULL),
        g AS (SELECT conv_id, turn, {", ".join(f"{_grams(x, n)} AS {y}{n}" for x, y in (("t", "s"), ("o", "o"), ("r", "r")) for n in range(1, 5))} FROM m)
        SELECT conv_id, turn, round(({_sari_sql()}) / 12.0::DOUBLE * 100.0::DOUBLE, 6) AS sari FROM g""",
    "metric_reuse": f"""
        WITH {_PAIRS_SQL}, h AS (SELECT doc_id, source, output, array_to_string(source, ' ') AS k FROM q)
        SELECT doc_id, CAST(len(source) AS INT) AS n, round(len(list_intersect(list_distinct(source),
            list_distinct(output)))::DOUBLE / len(list_distinct(list_concat(source, output))), 6) AS jaccard, count(*) OVER (PARTITION BY k) AS uses
            FROM h""",
    "bigram_lm": f"""
        WITH w AS (SELECT list_concat(['<s>'], {_W}, ['</s>']) AS w FROM documents WHERE text IS NOT NULL),
        u AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM w) GROUP BY 1),
        b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM w), c AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n
            FROM b GROUP BY 1, 2)
        SELECT a, b, n FROM c UNION ALL SELECT t, NULL, n FROM u UNION ALL SELECT NULL, NULL, count(*) FROM u""",
    "corpus_zipf": f"""
        WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_W}) AS word FROM documents) GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total FROM w)
        SELECT word, n, round(log10(n / total * 1e9::DOUBLE), 6) AS zipf FROM w, t""",
    "normalise_text": "SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ')) AS sha256 FROM documents",
}
