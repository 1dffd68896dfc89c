"""Dictionaries of pronunciations and inflections as tables, met by the distinct words of a corpus.

Several tables are united with override: a word's rows come from the first table that has the
word.  Words are counted first, so a join is on distinct words and not on texts; Spark
chooses how to join from the sizes of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.functions import text

#: A pronunciation is a list of sounds; those with a stress digit are syllables.
STRESSED = r"[0-2](?=\s|$)"
# Endings of forms, and what takes their place in a lemma, in the order in which they are tried.
ENDINGS = [("ies", "y"), ("es", ""), ("s", ""), ("ied", "y"), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("er", ""), ("est", "")]


def read_pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """word, sounds of lines 'WORD  S OW1 ...'; variants 'WORD(2)' are further rows of the word, lines that start with ;;; are comments."""
    lines = spark.read.text(path).filter(~F.col("value").startswith(";;;") & F.col("value").rlike(r"^\S+\s+\S"))
    word = F.lower(F.regexp_replace(F.regexp_extract("value", r"^(\S+)", 1), r"\(\d+\)$", ""))
    return lines.select(word.alias("word"), F.trim(F.regexp_replace("value", r"^\S+\s+", "")).alias("sounds"))


def override_union(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables, of each key those of the first table that has it."""
    ranked = [t.withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    first = rows.groupBy(key).agg(F.min("__rank").alias("__rank"))
    return rows.join(first, [key, "__rank"], "left_semi").drop("__rank")


def spoken_syllables(sounds: Column) -> Column:
    return F.size(F.regexp_extract_all(sounds, F.lit(STRESSED), F.lit(0)))


def corpus_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n of all texts."""
    return texts.select(F.explode(text.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def dictionary_syllables(words: DataFrame, pronunciations: DataFrame) -> DataFrame:
    """The words with syllables, the fewest of their pronunciations, and known; a word without one has the syllables of the letter rule."""
    least = pronunciations.groupBy("word").agg(F.min(spoken_syllables(F.col("sounds"))).alias("spoken"))
    rows = words.join(least, "word", "left")
    return rows.select(*words.columns, F.when(F.col("word").isNotNull(), F.coalesce("spoken", text.syllables_f(F.col("word")))).alias("syllables"), F.col("spoken").isNotNull().alias("known"))


def lemmas(words: DataFrame, inflections: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The words with lemma and how it was found: the table of inflections (form, lemma), the lexicon (word) itself, an ending taken off, or none (null).

    Of several lemmas of a form the first in order; of several endings the first whose lemma the lexicon has.
    """
    known = lexicon.select(F.col("word").alias("lemma")).distinct()
    listed = inflections.groupBy("form").agg(F.min("lemma").alias("listed")).withColumnRenamed("form", "word")
    rows = words.join(listed, "word", "left").join(known.select(F.col("lemma").alias("word"), F.lit(True).alias("whole")), "word", "left")
    open_ = rows.filter("listed is null and whole is null").select("word")
    cut = [
        F.struct(F.lit(i).alias("place"), F.concat(F.expr(f"left(word, length(word) - {len(end)})"), F.lit(to)).alias("lemma"), F.endswith("word", F.lit(end)).alias("fits"))
        for i, (end, to) in enumerate(ENDINGS)
    ]
    tried = open_.select("word", F.explode(F.array(*cut)).alias("t")).filter("t.fits").select("word", "t.place", "t.lemma")
    found = tried.join(known, "lemma").groupBy("word").agg(F.min(F.struct("place", "lemma")).alias("m")).select("word", F.col("m.lemma").alias("cut"))
    how = F.when(F.col("listed").isNotNull(), "listed").when(F.col("whole"), "whole").when(F.col("cut").isNotNull(), "ending")
    lemma = F.coalesce("listed", F.when(F.col("whole"), F.col("word")), "cut")
    return rows.join(found, "word", "left").select(*words.columns, lemma.alias("lemma"), how.alias("how"))
