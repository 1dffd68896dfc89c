"""Terms of a table in the texts of another, of all lengths in one pass.

While the terms are small (their bytes are counted first) one automaton of them all is
broadcast and texts are read once, never shuffled.  Beyond that each term is
filed under the rarest of its words (the one that the fewest terms have); a text meets
the terms filed under its words by a join on the word, and gets an automaton of
these alone.  Both ways find the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.functions.automata import FLEXIBLE, TermIndex

#: Bytes of terms up to which their automaton is broadcast; it takes about ten times as much.
BROADCAST_TERMS = 4 << 20


def words_of(text: str) -> list[str]:
    """The distinct lower-cased symbols of a text, white space and hyphens left out."""
    return list(dict.fromkeys(m[0].lower() for m in FLEXIBLE.finditer(text) if not m[1]))


def _rows_in(batch: pa.RecordBatch, keep: list[str], found: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    row, start, end, term = zip(*found, strict=True) if found else ([], [], [], [])
    place = pa.array(row, pa.int64())
    values = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(term, pa.string())]
    return pa.RecordBatch.from_arrays([*(batch[c].take(place) for c in keep), *values], [*keep, "start", "stop", "term"])


def _broadcast(texts: DataFrame, text_col: str, terms: list[str], keep: list[str], schema: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast((TermIndex(terms), terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = sent.value
        by_number: dict[int, list[str]] = {}
        for name, number in zip(names, index.of, strict=True):
            by_number.setdefault(number, []).append(name)
        for batch in batches:
            found = [
                (i, s, e, name) for i, text in enumerate(batch[text_col].to_pylist()) if text for s, e, number in index.occurrences(text)
                for name in by_number[number]
            ]
            yield _rows_in(batch, keep, found)

    return texts.mapInArrow(run, schema)


def _joined(texts: DataFrame, text_col: str, terms: DataFrame, keep: list[str], schema: str) -> DataFrame:
    words = F.arrow_udf(lambda column: pa.array([words_of(x or "") for x in column.to_pylist()], pa.list_(pa.string())), "array<string>")
    term_words = terms.select("term", F.explode(words("term")).alias("word"))
    held = term_words.groupBy("word").agg(F.count("*").alias("n"))
    filed = term_words.join(held, "word").groupBy("term").agg(F.min(F.struct("n", "word")).alias("x")).select("term", F.col("x.word").alias("word"))
    # texts by what they say: copies share their candidates
    keyed = texts.withColumn("__key", F.sha2(F.col(text_col), 256))
    said = keyed.select("__key", F.col(text_col).alias("__text")).dropDuplicates(["__key"]).select("__key", F.explode(words("__text")).alias("word"))
    candidates = said.join(filed, "word").groupBy("__key").agg(F.collect_set("term").alias("__terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (text, names) in enumerate(zip(batch[text_col].to_pylist(), batch["__terms"].to_pylist(), strict=True)):
                index = TermIndex(names)
                by_number: dict[int, list[str]] = {}
                for name, number in zip(names, index.of, strict=True):
                    by_number.setdefault(number, []).append(name)
                found += [(i, s, e, name) for s, e, number in index.occurrences(text) for name in by_number[number]]
            yield _rows_in(batch, keep, found)

    return keyed.join(candidates, "__key").mapInArrow(run, schema)


def find_terms(texts: DataFrame, terms: DataFrame, keep: list[str], text_col: str = "text", term_col: str = "term", most_bytes: int = BROADCAST_TERMS) -> DataFrame:
    """The keep columns, start, stop, term: every place of every distinct term in the texts, those that overlap too.

    A term has no word character on either side; case doesn't count, and white space and
    hyphens stand for one another.  Null texts and terms, and terms without a word or a mark, have no places.
    """
    known = terms.select(F.col(term_col).cast("string").alias("term")).filter(F.col("term").rlike(r"(?U)[^\s-]")).distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("bytes")).first().bytes
    types = dict(texts.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["start int", "stop int", "term string"])
    rows = texts.select(*keep, *([] if text_col in keep else [text_col])).filter(F.col(text_col).isNotNull())
    if size <= most_bytes:
        return _broadcast(rows, text_col, sorted(r.term for r in known.collect()), keep, schema)
    return _joined(rows, text_col, known, keep, schema)
