"""Words of a text with their counts, in the text's own row: nothing is shuffled and no Python worker is started.

Words are cut once, sorted, and the places where the sorted array changes give distinct words
and counts; sums, overlaps and formulas then run over distinct words.  Each step
is a column of its own behind a generator, so the optimizer doesn't work it out again
in every expression that uses it.  All steps but the sorts are linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.functions import measures, text

#: Vowel groups of a word; what is between them.
_V, _C = "[aeiouy]", "[^aeiouy]"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def lowered(column: Column, pattern: str = text.WORD_F) -> Column:
    """The lower-cased words of a text."""
    joined = F.array_join(text.matches(F.coalesce(column, F.lit("")), pattern), " ")
    return F.array_remove(F.split(F.lower(joined), " "), "")


def total(array: Column, value) -> Column:
    """Sum of a value over an array, as a double."""
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x))


def with_counts(df: DataFrame, words: Column, name: str) -> DataFrame:
    """Adds name: an array of (w, k), distinct words in order and how often each comes."""
    df = once(df, __s=F.sort_array(words))
    changes = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda i: (i == 0) | (F.get("__s", i) != F.get("__s", i - 1)))
    df = once(df, __i=F.when(F.size("__s") > 0, changes).otherwise(F.array().cast("array<int>")))
    k = lambda i, j: F.coalesce(F.get("__i", j + 1), F.size("__s")) - i
    return once(df, **{name: F.transform("__i", lambda i, j: F.struct(F.get("__s", i).alias("w"), k(i, j).cast("long").alias("k")))}).drop("__s", "__i")


def with_pairs(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds name: an array of (w, ka, kb), each word of either side once with its counts on both."""
    one = lambda x, ka, kb: F.struct(x["w"].alias("w"), ka.alias("ka"), kb.alias("kb"))
    zero = F.lit(0).cast("long")
    both = F.concat(F.transform(a, lambda x: one(x, x["k"], zero)), F.transform(b, lambda x: one(x, zero, x["k"])))
    df = once(df, __u=F.sort_array(both))
    at = lambda j: F.get("__u", j)
    same = lambda x, j: F.coalesce(at(j)["w"] == x["w"], F.lit(False))
    # of equal words the side without a count of a comes first
    merged = F.transform("__u", lambda x, j: F.when(same(x, j + 1), one(x, at(j + 1)["ka"], x["kb"])).when(~same(x, j - 1), x))
    return once(df, **{name: F.filter(merged, lambda x: x.isNotNull())}).drop("__u")


def syllables(word: Column) -> Column:
    """Of a lower-cased word, as text.syllables_f."""
    plain = F.regexp_replace(word, "[^a-z]", "")
    groups = F.length(F.regexp_replace(plain, f"{_C}+|(?<={_V}){_V}+", ""))
    less = F.when(plain.endswith("e") & (groups > 1), groups - 1).otherwise(groups)
    return F.when(F.length(plain) <= 3, F.lit(1)).otherwise(F.greatest(less, F.lit(1)))


def syllables_r(word: Column) -> Column:
    """Of a lower-cased word, as text.syllables_r."""
    groups = F.length(F.regexp_replace(word, f"{_C}+|(?<={_V}){_V}+", ""))
    return F.greatest(groups - F.when(word.endswith("e"), 1).otherwise(0), F.lit(1))


def with_measures(df: DataFrame, text_col: str, side: str, rule=syllables, pattern: str = text.WORD_F) -> DataFrame:
    """Adds side (an array of (w, k, size, y): word, count, letters, syllables) and side_sum (n, letters, syllables, long, poly, sentences)."""
    df = with_counts(df, lowered(F.col(text_col), pattern), "__w")
    measured = F.transform("__w", lambda x: F.struct(x["w"].alias("w"), x["k"].alias("k"), F.length(x["w"]).alias("size"), rule(x["w"]).alias("y")))
    df = once(df.withColumn("__t", F.col(text_col)), **{side: measured}).drop("__w")
    add = lambda value: F.aggregate(side, F.lit(0).cast("long"), lambda a, x: a + x["k"] * value(x))
    when = lambda test: F.when(test, 1).otherwise(0)
    sums = F.struct(
        add(lambda x: F.lit(1)).alias("n"), add(lambda x: x["size"]).alias("letters"), add(lambda x: x["y"]).alias("syllables"), add(lambda x: when(x["size"] >= 7)).alias("long"),
        add(lambda x: when(x["y"] >= 3)).alias("poly"), text.sentence_count(F.coalesce("__t", F.lit(""))).cast("long").alias("sentences"),
    )
    return once(df, **{f"{side}_sum": sums}).drop("__t")


def with_complexities(df: DataFrame, side: str, weights: dict[str, float]) -> DataFrame:
    """Adds side_c: an array of (w, k, c), each word's complexity among the other words of its text."""
    s = F.col(f"{side}_sum")

    def one(x: Column) -> Column:
        rest = s["n"] - x["k"]
        context = F.when(rest > 0, (s["letters"] + s["syllables"] - x["k"] * (x["size"] + x["y"])) / rest).otherwise(0.0)
        z = weights["A"] - (6.0 - x["size"] / 2.0) * weights["B"] + x["size"] * weights["C"] + x["y"] * weights["D"] + context * weights["E"]
        return F.struct(x["w"].alias("w"), x["k"].alias("k"), text.sigmoid(z).alias("c"))

    return once(df, **{f"{side}_c": F.transform(side, one)})


def reading_score(s: Column) -> Column:
    """0 to 1: mean of six readings of sums, each against its scale."""
    n, sentences = F.greatest(s["n"], F.lit(1)).cast("double"), s["sentences"].cast("double")
    per_sentence, per_word = s["n"] / sentences, s["syllables"] / n
    easy = text.clamp((206.835 - per_sentence * 1.015 - per_word * 84.6) / 100)
    grade, fog = per_sentence * 0.39 + per_word * 11.8 - 15.59, (per_sentence + s["long"] * 100 / n) * 0.4
    smog = F.sqrt(s["poly"] * 30.0) * 1.043 + 3.1291
    scaled = [(grade, 18), (fog, 20), (smog, 20), (per_sentence, 40), (s["letters"] / n, 12)]
    return (easy + sum((1 - text.clamp(x / F.lit(float(most))) for x, most in scaled), F.lit(0.0))) / 6


def reduction(before: Column, after: Column) -> Column:
    return text.clamp((before - after) / F.greatest(before, F.lit(1.0)))


def with_simplicity(df: DataFrame, weights: dict[str, float], jargon) -> DataFrame:
    """Adds s_lex, s_read, s_jargon to rows with both sides measured and paired (pairs); jargon(x) tells which words are terms."""
    for side in "ab":
        df = with_complexities(df, side, weights)
    hard = [total(F.col(f"{side}_c"), lambda x: F.when(x["c"] > measures.COMPLEX, x["k"]).otherwise(0)) for side in "ab"]
    terms = [total(F.col("pairs"), lambda x, k=k: F.when(jargon(x), x[k]).otherwise(0)) for k in ("ka", "kb")]
    gain = text.clamp(reading_score(F.col("b_sum")) - reading_score(F.col("a_sum")) + 0.5)
    return once(df, s_lex=reduction(*hard), s_read=gain, s_jargon=reduction(*terms))


def measured_pairs(df: DataFrame) -> DataFrame:
    """Rows with texts a and b, measured on both sides (a, b become arrays, the texts ta and tb) and paired."""
    df = df.withColumnsRenamed({"a": "ta", "b": "tb"})
    return with_pairs(with_measures(with_measures(df, "ta", "a"), "tb", "b"), "a", "b", "pairs")


def trained_simplicity(df: DataFrame) -> DataFrame:
    """Rows with texts a and b, and s_lex, s_read, s_jargon, s with the weights fitted to ratings; terms are the source's words of a Zipf value below 3."""
    rows = with_simplicity(measured_pairs(df), measures.TRAINED_WORD, lambda x: (x["ka"] > 0) & (6.0 - F.length(x["w"]) / 2.0 < 3.0))
    g, h, i = measures.TRAINED_SENTENCE
    return rows.withColumn("s", F.col("s_lex") * g + F.col("s_read") * h + F.col("s_jargon") * i)


def _shares(df: DataFrame) -> Column:
    """For each kind of protected fact of a, the share that b has; null without facts of the kind."""
    low = F.lower("tb")
    kept = lambda facts: F.filter(facts, lambda x: low.contains(F.lower(x)))
    share = lambda held, of: F.when(of > 0, held / of.cast("double"))
    by_text = [text.matches(F.col("ta"), "(?U)" + p.pattern) for p in (measures.NAME,)]
    by_text += [text.matches(F.col("ta"), "(?Ui)" + p.pattern) for p in (measures.DATE, measures.QUANTITY)]
    shares = [share(F.size(kept(x)), F.size(x)) for x in by_text]
    number = total(F.col("numbers"), lambda x: x["ka"]), total(F.col("numbers"), lambda x: F.when(x["kb"] > 0, x["ka"]).otherwise(0))
    denied = F.filter("pairs", lambda x: (x["ka"] > 0) & x["w"].isin(measures.NEGATIONS))
    technical = F.filter("pairs", lambda x: (x["ka"] > 0) & x["w"].isin(measures.TERMS))
    shares.append(share(number[1], number[0]))
    shares.append(share(F.size(F.filter(denied, lambda x: low.contains(x["w"]))), F.size(denied)))
    shares.append(share(F.size(F.filter(technical, lambda x: x["kb"] > 0)), F.size(technical)))
    return F.filter(F.array(*shares), lambda x: x.isNotNull())


def record(df: DataFrame, threshold: float = 0.2, loss_weight: float = 1.0) -> DataFrame:
    """Rows with texts a and b (neither null), and all values of measures.RECORD."""
    rows = measured_pairs(df)
    number = lambda c: F.transform(text.matches(F.col(c), "(?U)" + measures.NUMBER.pattern), lambda x: F.lower(F.replace(x, F.lit(","), F.lit(""))))
    rows = with_pairs(with_counts(with_counts(rows, number("ta"), "na"), number("tb"), "nb"), "na", "nb", "numbers")
    rows = with_simplicity(rows, measures.DEFAULT_WORD, lambda x: x["w"].isin(measures.TERMS))
    n = {side: F.greatest(F.col(f"{side}_sum")["n"], F.lit(1)).cast("double") for side in "ab"}
    mean = {side: total(F.col(f"{side}_c"), lambda x: x["c"] * x["k"]) / n[side] for side in "ab"}
    shared = total(F.col("pairs"), lambda x: F.least(x["ka"], x["kb"]))
    common = F.size(F.filter("pairs", lambda x: (x["ka"] > 0) & (x["kb"] > 0)))
    rows = once(rows, shares=_shares(rows), m_tfidf=shared / n["a"], backward=shared / n["b"], m_embedding=common / F.greatest(F.size("pairs"), F.lit(1)).cast("double"))
    rows = rows.withColumn("m_nli", (F.col("m_tfidf") + F.col("backward")) / 2).withColumn("m_avg", (F.col("m_tfidf") + F.col("m_embedding") + F.col("m_nli")) / 3)
    critical = F.when(F.size("shares") > 0, F.aggregate("shares", F.lit(0.0), lambda a, x: a + x) / F.size("shares")).otherwise(1.0)
    rows = once(rows, p_critical=critical, word_complexity_before=mean["a"], word_complexity_after=mean["b"])
    rows = rows.withColumn("p_meaning", F.col("m_avg") * 0.5 + F.col("p_critical") * 0.5).withColumn("loss_info", 1 - F.col("p_meaning"))
    rows = rows.withColumn("s", (F.col("s_lex") + F.col("s_read") + F.col("s_jargon")) / 3).withColumn("u", F.col("s") - F.col("loss_info") * loss_weight)
    return rows.withColumn("accepted", (F.col("loss_info") <= threshold) & (F.col("p_critical") == 1.0))


def tfidf_cosine(df: DataFrame) -> DataFrame:
    """Rows with token arrays source and output, and the cosine of their TF-IDF vectors, the pair as corpus: smooth idf ln(3 / (1 + df)) + 1."""
    rows = with_pairs(with_counts(with_counts(df, F.col("source"), "x"), F.col("output"), "y"), "x", "y", "pairs")
    weight = lambda p: F.when((p["ka"] > 0) & (p["kb"] > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1.0)
    length = lambda k: total(F.col("pairs"), lambda p: F.pow(p[k] * weight(p), F.lit(2.0)))
    norm = F.sqrt(length("ka") * length("kb"))
    return rows.withColumn("cosine", F.when(norm > 0, total(F.col("pairs"), lambda p: p["ka"] * p["kb"]) / norm))
