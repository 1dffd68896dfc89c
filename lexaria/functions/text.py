"""Functions on one text: words, syllables, readability, sentences.

Column functions are built-in and higher-order expressions and stay in the JVM.
Counts over all words of a text are plain functions for Arrow batches: a text's
words are then cut once and counted by distinct word, where lambdas in the JVM
would work every count out from the text again.  Syllable and sentence rules come in families that differ on purpose; names say
which (``f`` for the formulas, ``r`` for the reports).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaria.functions import measures, preserve

WORD_F = r"[A-Za-z]+(?:['-][A-Za-z]+)*"
WORD_R = r"[A-Za-z]+(?:'[A-Za-z]+)?"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column, pattern: str = WORD_F) -> Column:
    """Lower-cased words."""
    return matches(F.lower(text), pattern.replace("A-Z", ""))


def syllables_f(word: Column) -> Column:
    """Vowel groups, less one for a final e; words of up to three letters have one."""
    plain = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.size(matches(plain, "[aeiouy]+"))
    less = F.when(plain.endswith("e") & (groups > 1), groups - 1).otherwise(groups)
    return F.when(F.length(plain) <= 3, F.lit(1)).otherwise(F.greatest(less, F.lit(1)))


def syllables_r(word: Column) -> Column:
    """Vowel groups, less one for a final e, at least one; no rule for short words; empty has none."""
    groups = F.size(matches(F.lower(word), "[aeiouy]+"))
    less = F.when(F.lower(word).endswith("e"), groups - 1).otherwise(groups)
    return F.when(F.length(word) == 0, F.lit(0)).otherwise(F.greatest(less, F.lit(1)))


def total(array: Column, value) -> Column:
    """Sum of value(x) over an array, as a long."""
    return F.aggregate(F.transform(array, lambda x: value(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sentence_count(text: Column) -> Column:
    return F.greatest(F.size(matches(text, "[.!?]+")), F.lit(1))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def counts_f(text: str | None) -> tuple[int, ...]:
    """Words, sentences, syllables, words of three syllables or more, words of seven letters or more, and letters of the formula family; scores_f makes the scores of them."""
    t = measures.Text(text or "")
    return t.n, max(1, len(re.findall("[.!?]+", t.text))), t.syllables, t.poly, t.long, t.letters


COUNTS_F = "n_words long, n_sentences long, n_syllables long, n_poly long, n_long long, n_letters long"


def scores_f(n: dict[str, Column]) -> dict[str, Column]:
    """Flesch ease, grade, fog and smog from counts; null without words."""
    w, s = n["n_words"].cast("double"), n["n_sentences"].cast("double")
    some = n["n_words"] > 0
    per_sentence, per_word = w / s, n["n_syllables"] / w
    return {
        "flesch": F.when(some, F.lit(206.835) - per_sentence * 1.015 - per_word * 84.6),
        "grade": F.when(some, per_sentence * 0.39 + per_word * 11.8 - 15.59),
        "fog": F.when(some, (per_sentence + n["n_long"] / w * 100.0) * 0.4),
        "smog": F.when(some, F.sqrt(n["n_poly"] * 30.0) * 1.043 + 3.1291),
    }


@lru_cache(maxsize=1 << 16)
def _syllables_r(word: str) -> int:
    return max(1, len(re.findall("[aeiouy]+", word)) - word.endswith("e"))


def counts_r(text: str | None) -> tuple[int, ...]:
    """Words, sentences, syllables, words of three syllables or more, letters, and technical terms (three syllables or more, where no table of frequencies is at hand) of the report family."""
    words = Counter(w.lower() for w in re.findall(WORD_R, text or ""))
    n = words.total()
    parts = [(k, len(w), _syllables_r(w)) for w, k in words.items()]
    poly = sum(k for k, _, y in parts if y >= 3)
    return n, max(1, len(preserve.sentence_spans(text or ""))) if n else 0, sum(k * y for k, _, y in parts), poly, sum(k * size for k, size, _ in parts), poly


COUNTS_R = "n_words long, n_sentences long, n_syllables long, n_poly long, n_letters long, n_terms long"


def scores_r(n: dict[str, Column]) -> dict[str, Column]:
    """Reading ease, grade, fog and smog; null without words."""
    w, s = n["n_words"].cast("double"), n["n_sentences"].cast("double")
    some = n["n_words"] > 0
    return {
        "ease": F.when(some, F.lit(206.835) - w / s * 1.015 - n["n_syllables"] / w * 84.6),
        "grade": F.when(some, w / s * 0.39 + n["n_syllables"] / w * 11.8 - 15.59),
        "fog": F.when(some, (w / s + n["n_poly"] / w * 100.0) * 0.4),
        "smog": F.when(some, F.sqrt(n["n_poly"] * 30.0 / s) * 1.043 + 3.1291),
    }


def normalised(text: Column) -> Column:
    """Lower-cased letters and digits, separated by single spaces."""
    return F.array_join(matches(F.lower(text), r"[\p{L}\p{N}]+"), " ")


def sentences(text: Column) -> Column:
    """Sentences without white space around them: a new one begins after an end mark, closing quotes or brackets and white space, before a capital, digit, quote or bracket."""
    marked = F.regexp_replace(text, r"([.!?][\"')\]]*\s+)(?=[\p{Lu}\p{Nd}\"'(\[“‘])", "$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def spelling_variant(a: Column, b: Column) -> Column:
    """Whether two words differ by British and American spelling only."""

    def plain(w: Column) -> Column:
        w = F.lower(w)
        # Spellings that are taken for one another.
        for x, y in (("isa", "iza"), ("ise", "ize"), ("yse", "yze"), ("our", "or"), ("tre", "ter")):
            w = F.replace(w, F.lit(x), F.lit(y))
        return w

    return (F.lower(a) != F.lower(b)) & (plain(a) == plain(b))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common start over the first word's length."""
    x, y = F.split(F.lower(a), ""), F.split(F.lower(b), "")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & (p != ""))
    first = F.array_position(same, F.lit(False))
    n = F.when(first == 0, F.least(F.length(a), F.length(b))).otherwise(first - 1)
    return n / F.greatest(F.length(a), F.lit(1)).cast("double")


def band(score: Column) -> Column:
    """Entailment bands."""
    return F.when(score >= 0.95, "≥0.95").when(score >= 0.90, "0.90–0.95").when(score >= 0.80, "0.80–0.90").otherwise("<0.80")
