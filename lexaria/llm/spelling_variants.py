"""Spelling variants: an even-partition pigeonhole join of all words within one edit.

Words are counted over all texts.  Each word of length l is indexed by its two even
segments: the first ``l // 2`` code points and the rest.  One edit leaves one of two
segments whole, so a word within one edit, of equal length or one longer, has that
segment as its head or as its tail: the tail begins one place later in a longer word.
Every word probes the index of its own length and of the length before it with these
four substrings; pairs that share a segment are verified on what is left of both.

A segment may be common.  Where index entries times probes of one key exceed
``PAIRS``, the same step is applied to what is left: the two sides share the segment
and differ by one edit in the rest, so the rest is cut evenly again and the key grows by
a segment of it.  This goes on until a key is rare or one code point is left, where
distinct words of one key differ in that code point alone.  So no group of words is ever paired
with itself as a whole, and no pair is lost.

A word's form is its near word of most occurrences, if that has ``times`` as many;
forms are followed to the root by doubling (each step multiplies the occurrences by
``times``, so a chain is short).  Levels and roots are written to the shared folder.

Definitions: a null text has no words; a null id counts as the empty string; repeated rows
count again; words of any length are taken whole; ties of n go to the smaller word in
code-point order; an empty table gives an empty result.  Only the two named columns are
read; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Index entries times probes of one key beyond which the key is cut finer.
PAIRS = 4096


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_n: int = 5, slip: int = 199) -> DataFrame:
    """word, n of all letter runs; one run in ``slip``, told by a checksum of id and run, loses one code point."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _sides(words: DataFrame) -> DataFrame:
    """Every word as an index entry, as a probe of its length, and as a probe of the length before: the key is the length, nothing matched yet."""
    size = F.length("word")
    shift = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))  # -1: index entry
    rows = words.select("word", size.cast("int").alias("size"), shift.alias("shift"))
    base = F.col("size") - F.greatest("shift", F.lit(0))
    return rows.select("word", "shift", base.alias("left"), F.col("word").alias("rest"), F.xxhash64(base).alias("key"))


def _halve(rows: DataFrame) -> DataFrame:
    """Each row twice: keyed by the first half of what is left of the index entry, and by the second.

    ``left`` is the length of the entry's rest; a probe's rest has ``shift`` more,
    so its tail is counted from its end.
    """
    half, size = F.floor(F.col("left") / 2).cast("int"), F.length("rest")
    tail = (F.col("left") - half).cast("int")

    def side(number: int, segment: Column, rest: Column, left: Column) -> Column:
        return F.struct(left.alias("left"), rest.alias("rest"), F.xxhash64("key", F.lit(number), segment).alias("key"), segment.alias("segment"))

    head = side(1, F.substring("rest", F.lit(1), half), F.substring("rest", half + 1, size), tail)
    back = side(2, F.substring("rest", size - tail + 1, tail), F.substring("rest", F.lit(1), size - tail), half)
    return rows.select("word", "shift", F.explode(F.array(head, back)).alias("s")).select("word", "shift", "s.left", "s.rest", "s.key")


def near_pairs(words: DataFrame, pairs: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """a, b of all distinct words within one edit, each pair once; b is longer, or of equal length and greater."""
    most = PAIRS if pairs is None else pairs
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    level = scratch.table(_halve(_sides(words.select("word"))))
    found = []
    while True:
        probe = F.col("shift") >= 0
        sizes = level.groupBy("key").agg(F.count_if(~probe).alias("entries"), F.count_if(probe).alias("probes"), F.max("left").alias("left"))
        hot = scratch.table(sizes.filter((F.col("entries") * F.col("probes") > most) & (F.col("left") > 1)).select("key"))
        any_hot = not hot.isEmpty()
        rare = level.join(hot, "key", "left_anti") if any_hot else level
        entry = rare.filter(~probe).select("key", F.col("word").alias("a"), F.col("rest").alias("a_rest"))
        probes = rare.filter(probe).select("key", F.col("word").alias("b"), F.col("rest").alias("b_rest"), "shift")
        ordered = (F.col("shift") == 1) | (F.col("a") < F.col("b"))
        near = F.levenshtein("a_rest", "b_rest", 1) == 1
        # equal keys could come from a collision: what is verified then is the whole words
        whole = F.levenshtein("a", "b", 1) == 1
        found.append(scratch.table(entry.join(probes, "key").filter(ordered & near & whole).select("a", "b")))
        if not any_hot:
            break
        level = scratch.table(_halve(level.join(hot, "key", "left_semi")))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union.distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of every word that has a form: paths are doubled until none changes."""
    at = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.table(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_n: int = 5, times: int = 5, slip: int = 199) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(count_words(docs, id_col, text_col, least_chars, least_n, slip))
    pairs = scratch.table(near_pairs(words, scratch=scratch))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.withColumnRenamed("word", "b"), "b").select(F.col("a").alias("word"), "b", "n")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("k"), "b")).alias("m"))
    best = best.select("word", "n_near", F.col("m.b").alias("near"), (-F.col("m.k")).alias("near_n"))
    rows = words.join(best, "word", "left")
    enough = F.col("near_n") >= times * F.col("n")
    rows = scratch.table(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("near")).alias("form"),
            F.when(enough, F.col("near_n")).alias("form_n")
        )
    )
    roots = _roots(rows.filter("form is not null"), scratch)
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
