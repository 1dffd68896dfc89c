"""Quality rules: plain counts, and the divergence of a text's histograms from its language's.

References: for every language with enough words, the histogram of character classes
of all its texts, and the shares of its ``common`` most frequent words and of all others
together.  A text is compared with the reference of its own language by the
Jensen-Shannon distance (square root of the divergence to base 2, from 0 to 1), for
characters if it has ``min_chars`` code points and for words if it has ``min_words``: short
texts differ from any reference by chance.

Everything is Spark expressions.  The first pass counts words by language (combined before
the shuffle); the second takes each text apart in its own row and writes its counts, a
few numbers a text; references and distances come from these.  No text is ever shuffled.  Repeated windows are looked for only in a text in which some window comes
twice: by 64-bit hashes, first all by a part of their hash in one long each, then those
that may be repeated by the whole.

Definitions: a null text is empty; an empty text fails the base rules; without a
language, or with one that has no reference, a text has no distances and the base rules
alone decide; repeated rows are judged one by one and count in the references; an
empty table gives an empty result.  Texts of any length are taken whole.  Only the
three named columns are read; others may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexaria.llm.scratch import Scratch, broadcast_if_small

#: What words are cut at.
SPACE = r"[\x20\x09-\x0D]+"
VOWELS = "aeiou"
#: Character classes in the order in which they are taken out of a text; what is left is the last.  The first counts as two: vowels, and other small letters.
CLASSES = (r"[a-z]+", SPACE, r"[A-Z]+", r"\p{L}+", r"\p{Nd}+", r"[.,;:!?'\"()-]+")
SYMBOLS = "#*$%&|<>"
#: Stands before every word where common words are taken out.
START = "\x01"


def _once(df: DataFrame, name: str, value: Column, *drop: str) -> DataFrame:
    """df with a value worked out once: behind a generator the optimizer doesn't put it into the expressions that use it."""
    return df.select(*(c for c in df.columns if c not in drop), F.explode(F.array(value)).alias(name))


def _classed(df: DataFrame) -> DataFrame:
    """Adds classes (a count for each class, long) and rest (symbols and all else) to rows with a text."""
    df = df.withColumn("r0", F.col("text"))
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", pattern, ""))
    size = [F.length(f"r{i}") for i in range(len(CLASSES) + 1)]
    vowels = F.length("text") - F.length(reduce(lambda x, v: F.replace(x, F.lit(v), F.lit("")), VOWELS, F.col("text")))
    df = df.withColumn("vowels", vowels)
    small, *taken = (a - b for a, b in zip(size, size[1:], strict=False))
    counts = F.array(*(c.cast("long") for c in (F.col("vowels"), small - F.col("vowels"), *taken, size[-1])))
    df = df.withColumn("classes", counts).withColumn("rest", F.col(f"r{len(CLASSES)}"))
    return df.drop("vowels", *(f"r{i}" for i in range(len(CLASSES) + 1)))


def _letters(text: Column) -> Column:
    """Lower-cased runs of letters with single spaces between them."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def common_words(docs: DataFrame, common: int, min_reference: int) -> DataFrame:
    """lang, ref_words, ref_counts (of the words, then of all others), pattern: one row for each language with min_reference words."""
    words = docs.filter("lang is not null").select("lang", F.explode(F.split(_letters(F.col("text")), " ")).alias("word")).filter("word <> ''")
    words = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = words.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= common)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))  # common at most
    rows = top.join(words.groupBy("lang").agg(F.sum("n").alias("total")), "lang").filter(F.col("total") >= min_reference)
    others = F.col("total") - F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    # one pattern of the words, by first letters, so that a word tries few alternatives
    letters = F.array_distinct(F.transform("top", lambda x: F.substring(x["word"], 1, 1)))
    rest = lambda c: F.transform(F.filter("top", lambda x: x["word"].startswith(c)), lambda x: F.substring(x["word"], F.lit(2), F.length(x["word"])))
    groups = F.transform(letters, lambda c: F.concat(c, F.lit("(?:"), F.array_join(rest(c), "|"), F.lit(")")))
    pattern = F.concat(F.lit(f"{START}("), F.array_join(groups, "|"), F.lit(") "))
    return rows.select("lang", F.col("top.word").alias("ref_words"), F.concat("top.n", F.array(others)).alias("ref_counts"), pattern.alias("pattern"))


def _with_held(rows: DataFrame) -> DataFrame:
    """Adds held: how often the text has each word of ref_words, then all others; null where the text isn't compared (compared) or has no word.

    Every word stands between a mark and a space of its own; one pattern of the language's common words takes them out.
    """
    rows = _once(rows, "z", F.when(F.col("compared"), _letters(F.col("text"))))
    marked = F.concat(F.lit(START), F.replace("z", F.lit(" "), F.lit(f" {START}")), F.lit(" "))
    rows = _once(rows, "common", F.regexp_extract_all(marked, F.col("pattern"), F.lit(1)))
    # numbers of the words in order: a run of equal ones ends where the next number begins
    rows = _once(rows, "codes", F.sort_array(F.transform("common", lambda x: F.array_position("ref_words", x))), "common")
    begins = F.filter(F.sequence(F.lit(0), F.size("codes") - 1), lambda i: (i == 0) | (F.get("codes", i) != F.get("codes", i - 1)))
    rows = _once(rows, "begins", F.when(F.size("codes") > 0, begins).otherwise(F.array().cast("array<int>")))
    runs = F.transform("begins", lambda i, j: F.struct(F.get("codes", i).alias("code"), (F.coalesce(F.get("begins", j + 1), F.size("codes")) - i).cast("long").alias("n")))
    rows = _once(rows, "runs", runs, "begins", "codes")
    place = lambda k: F.array_position(F.col("runs.code"), (k + 1).cast("long")).cast("int")
    count = lambda k: F.coalesce(F.get("runs", place(k) - 1)["n"], F.lit(0).cast("long"))
    rows = _once(rows, "found", F.when(F.col("z") != "", F.transform("ref_words", lambda _, k: count(k))), "runs")
    n = F.length("z") - F.length(F.replace("z", F.lit(" "), F.lit(""))) + 1
    others = n.cast("long") - F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("held", F.when(F.col("found").isNotNull(), F.concat("found", F.array(others)))).drop("z", "found")


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Distance of two arrays of counts; both must hold something."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    # the sums are variables of outer lambdas, so that each is made once
    sums = F.array(F.struct(total(counts).cast("double").alias("p"), total(reference).cast("double").alias("q")))

    def distance(n: Column) -> Column:
        pairs = F.zip_with(counts, reference, lambda a, b: F.struct((a / n["p"]).alias("p"), (b / n["q"]).alias("q")))
        halves = F.transform(pairs, lambda x: part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2))
        return F.sqrt(F.greatest(F.aggregate(halves, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))

    return F.get(F.transform(sums, distance), F.lit(0))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Replaces words by n_words and n_repeat_words: words in three-word windows that come twice or more."""
    three = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, 1 << 30).alias("b"), F.slice("words", 3, 1 << 30).alias("c"))
    windows = F.slice(three, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    hashed = F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    df = _once(df.withColumn("n_words", F.size("words").cast("long")), "h", hashed).drop("words")
    some = F.size(F.array_distinct("h")) < F.size("h")
    # hashes whose low bits make room for the place sort as plain longs; what has a neighbour with the same high bits may be repeated
    bits = F.ceil(F.log2(F.size("h") + 1)).cast("int")
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    df = _once(df, "bits", bits)
    packed = F.transform("h", lambda x, i: F.call_function("shiftleft", high(x), F.col("bits")).bitwiseOR(i.cast("long")))
    df = _once(df, "s", F.when(some, F.sort_array(packed)))
    beside = lambda x, j: (high(x) == high(F.get("s", j - 1))) | (high(x) == high(F.get("s", j + 1)))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    df = _once(df, "c", F.transform(F.filter("s", lambda x, j: F.coalesce(beside(x, j), F.lit(False))), place), "s", "bits")
    df = _once(df, "s", F.sort_array(F.transform("c", lambda i: F.struct(F.get("h", i).alias("h"), i.alias("i")))), "c", "h")
    again = lambda x, j: F.coalesce(F.get("s", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", j + 1)["h"] == x["h"], F.lit(False))
    df = _once(df, "p", F.sort_array(F.transform(F.filter("s", again), lambda x: x["i"])), "s")
    # a window adds the words that the one before doesn't cover
    steps = F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(x - F.get("p", j - 1), F.lit(3))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def judge_quality(
    docs: DataFrame, common: int = 64, min_chars: int = 200, min_words: int = 200, min_reference: int = 1000, max_chars: float = 0.3, max_words: float = 0.4,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, the base counts, base_failed, js_chars, js_words (null where a guard or the reference is missing), kept."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    scratch = Scratch(docs.sparkSession, "divergence")
    words = scratch.table(common_words(docs, common, min_reference))
    languages = words.count()
    rows = docs.join(broadcast_if_small(words, languages, 64 * (common + 4)), "lang", "left")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = _once(_classed(rows), "lines", lines)
    rows = rows.select(
        "doc_id", "lang", "text", "classes", "ref_words", "ref_counts", "pattern", (F.length("text") - F.get("classes", F.lit(2))).cast("long").alias("word_chars"),
        (F.length("rest") - F.length(F.translate("rest", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.length("text").alias("n_chars")
    )
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    rows = _once(rows, "words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    rows = _repeated_words(rows)
    rows = _with_held(rows.withColumn("compared", F.col("ref_words").isNotNull() & (F.col("n_words") >= min_words)))
    # what is left of a text is a few numbers: they are written, so that the sums of classes don't take the texts apart again
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = scratch.table(rows.select("doc_id", "lang", *counts, "n_chars", "classes", "held"))
    sums = rows.filter("lang is not null").groupBy("lang").agg(F.array(*(F.sum(F.get("classes", F.lit(i))) for i in range(len(CLASSES) + 2))).alias("ref_classes"))
    refs = words.select("lang", "ref_counts").join(sums, "lang")
    rows = rows.join(broadcast_if_small(refs, languages, 64 * (common + 4)), "lang", "left")
    far = F.when((F.col("n_chars") >= min_chars) & F.col("ref_classes").isNotNull(), jensen_shannon(F.col("classes"), F.col("ref_classes")))
    rows = rows.withColumn("js_chars", F.round(far, 6))
    rows = rows.withColumn("js_words", F.round(F.when(F.col("held").isNotNull(), jensen_shannon(F.col("held"), F.col("ref_counts"))), 6))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = (F.coalesce("js_chars", F.lit(0.0)) > max_chars) | (F.coalesce("js_words", F.lit(0.0)) > max_words)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"), "js_chars",
        "js_words"
    )
