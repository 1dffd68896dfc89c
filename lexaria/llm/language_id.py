"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 0 to ``ORDER``, learned from a
bounded sample of labelled texts and then frozen.  A byte's code length is that
of PPM with escape method C and exclusion: in the longest known context with
``t`` occurrences of ``q`` distinct symbols, a symbol seen ``c`` times costs
``-log2(c / (t + q))``; otherwise the escape, ``-log2(q / (t + q))``, and the
cost in the next shorter context, where symbols already seen are excluded; in
the end all byte values not seen at all are equally likely.  A text's code length
is the sum over its bytes; the shortest wins.

The trees of all languages share their nodes, which are kept sparsely with each
language's own counts: memory follows the contexts of the sample, not the number
of languages or of byte values, and no context is left out.  What follows a context
excludes just the symbols seen in it, so the denominators below a context are kept
with it, and code lengths are exact.  Those of all windows of the sample are
worked out once; scoring looks a window up, and only windows that no language has
walk the trees.

Training takes at most ``per_language`` texts of each language (those with the
smallest hash of the id): this is the bound on the sample.

Score.  The posterior of the chosen language with equal priors, per byte and not per
text (texts of any length would otherwise all come to 1), times the fit: 1 up to the
bound on the rate, and then the bound's share of the rate.  The rate is the bits a
byte of the text's words of letters, so that numbers and keys don't count against a
language; the bound is ``SLACK`` times the median of the sample's own rates.

Definitions: null text and text without a letter get ``und`` with score 0.
Ties go to the first language in sorted order.  Null languages are not learned;
with nothing to learn from every text is ``und``, and a filter keeps all texts with
a letter and warns.  Whole texts are scored, in pieces of bounded size that keep
their context.  Repeated rows are judged alike; an empty table gives an empty
result.  Only the named columns are read; others may have any name.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaria.llm.scratch import Scratch
from lexaria.llm.words import SEGMENT, HashIndex, bound_batches, chunks, mix

ORDER = 3
UNDETERMINED = "und"
#: A text fits as long as its rate is no more than so many times the sample's median.
SLACK = 3.0
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == remainder


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: occurrences of each window of ORDER + 1 bytes (zeros before the text)."""
    total: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(b"\0" * ORDER + text.encode(), dtype=np.uint8).astype(np.int64)
            m = len(x) - ORDER
            grams = np.zeros(m, dtype=np.int64)
            for i in range(ORDER + 1):
                grams = grams * 256 + x[i : i + m]
            own = total.setdefault(lang, {})
            for g, n in zip(*(v.tolist() for v in np.unique(grams, return_counts=True)), strict=True):
                own[g] = own.get(g, 0) + n
    for lang, own in total.items():
        yield pa.record_batch([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


class _Level:
    """Contexts of one order: each language's totals and distinct symbols, what they exclude one level below, and counts by symbol."""

    def __init__(self, lang: np.ndarray, key: np.ndarray, n: np.ndarray, langs: int, below: _Level | None):
        keys, at = np.unique(key, return_inverse=True)  # context and symbol
        self.count = np.zeros((len(keys), langs))
        np.add.at(self.count, (at, lang), n)
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        self.edge, self.node = HashIndex(mix(keys.astype(np.uint64))), HashIndex(mix(contexts.astype(np.uint64)))
        self.total, self.distinct, self.excluded = (np.zeros((len(contexts), langs)) for _ in range(3))
        np.add.at(self.total, of, self.count)
        np.add.at(self.distinct, of, (self.count > 0).astype(float))
        if below is not None:
            shorter = below.counts(keys & below.mask)
            np.add.at(self.excluded, of, np.where(self.count > 0, shorter, 0.0))
        self.keys, self.mask = keys, 0

    def counts(self, key: np.ndarray) -> np.ndarray:
        at = self.edge.find(mix(key.astype(np.uint64)))
        return np.where((at >= 0)[:, None], self.count[at], 0.0)


def _in_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, whether it belongs to a word of letters only (bytes beyond ASCII count as letters)."""
    inside = _ALNUM[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = inside[first]
    run = np.cumsum(start)
    digit = np.bincount(run[inside & (data < 58)], minlength=int(run[-1]) + 1 if len(run) else 1) > 0
    return inside & ~digit[run]


class PpmModel:
    """Frozen context trees of all languages, and the costs of the sample's windows."""

    def __init__(self, languages: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray):
        self.languages, self.levels, below = languages, [], None
        for k in range(ORDER + 1):
            mask = (1 << 8 * (k + 1)) - 1
            level = _Level(lang, grams & mask, n, len(languages), below)
            level.mask = mask
            self.levels.append(level)
            below = level
        self.windows = self.levels[-1].edge
        self.cost = self._costs(self.levels[-1].keys).astype(np.float32)
        #: Bits a byte up to which a text fits; set by train.
        self.bound = float("inf")

    def _costs(self, window: np.ndarray) -> np.ndarray:
        """Cost of each window's last byte after the bytes before it, in each language."""
        shape = (len(window), len(self.languages))
        out, open_ = np.zeros(shape), np.ones(shape, dtype=bool)
        seen, dropped = np.zeros(shape), np.zeros(shape)  # symbols excluded so far, and their counts here
        for level in reversed(self.levels):
            key = window & level.mask
            node = level.node.find(mix((key >> 8).astype(np.uint64)))
            known = (node >= 0)[:, None]
            count, total, distinct = level.counts(key), np.where(known, level.total[node], 0.0), np.where(known, level.distinct[node], 0.0)
            rest, fresh = total - dropped, distinct - seen
            base = np.log2(np.maximum(rest + fresh, 1))
            hit = open_ & (count > 0)
            out = np.where(hit, out + base - np.log2(np.maximum(count, 1)), out)
            open_ &= ~hit
            out = np.where(open_ & (rest > 0), out + base - np.log2(np.maximum(fresh, 1)), out)
            seen, dropped = distinct, np.where(known, level.excluded[node], 0.0)
        return np.where(open_, out + np.log2(np.maximum(256 - seen, 1)), out)

    def _symbol_costs(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Cost of each byte in each language; place: how far into its text it is."""
        window = data.astype(np.int64)
        for i in range(1, ORDER + 1):
            before = np.zeros(len(data), dtype=np.int64)
            before[i:] = data[:-i]
            before[place < i] = 0
            window |= before << 8 * i
        at = self.windows.find(mix(window.astype(np.uint64)))
        cost = self.cost[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            some, which = np.unique(window[miss], return_inverse=True)
            cost[miss] = self._costs(some).astype(np.float32)[which]
        return cost

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code length of each row (offsets into data) in each language, that of its words of letters, and the bytes of these."""
        rows, langs = len(offsets) - 1, len(self.languages)
        out, words = np.zeros((rows, langs)), np.zeros((rows, langs))
        inside = _in_words(data, offsets)
        sizes, full = np.diff(offsets), np.flatnonzero(np.diff(offsets))
        letters = np.zeros(rows)
        if len(full):
            letters[full] = np.add.reduceat(inside.astype(np.int64), offsets[:-1][full])
        if len(sizes) == 1:  # a long text, piece by piece
            for at in range(0, len(data), SEGMENT):
                low = max(0, at - ORDER)
                piece = data[low : at + SEGMENT]
                cost = self._symbol_costs(piece, np.arange(low, low + len(piece)))[at - low :]
                out[0] += cost.sum(0, dtype=np.float64)
                words[0] += cost[inside[at : at + SEGMENT]].sum(0, dtype=np.float64)
        elif len(full):
            cost = self._symbol_costs(data, np.arange(len(data)) - np.repeat(offsets[:-1], sizes))
            out[full] = np.add.reduceat(cost, offsets[:-1][full], axis=0, dtype=np.float64)
            words[full] = np.add.reduceat(cost * inside[:, None], offsets[:-1][full], axis=0, dtype=np.float64)
        return out, words, letters

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the language of the shortest code, the score, the rate (0 without words of letters), and whether it fits."""
        bits, words, letters = self.bits(data, offsets)
        best, least = bits.argmin(1), bits.min(1, keepdims=True)
        posterior = 1.0 / np.exp2((least - bits) / np.maximum(np.diff(offsets), 1)[:, None]).sum(1)
        rate = words[np.arange(len(best)), best] / np.maximum(letters, 1)
        # the first bytes of a text have no context and cost more: they are allowed as many bits as bytes can have
        allowed = self.bound + 8.0 * ORDER / np.maximum(letters, 1)
        return best, posterior * np.minimum(1.0, allowed / np.maximum(rate, 1e-9)), rate, rate <= allowed


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> PpmModel | None:
    """The model of at most per_language texts of each non-null language; None if there is none."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    # a first cut by hash leaves about twice the sample, so that the ranking below sees few rows
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (2 * per_language + 50) / n))).otherwise(share)
    few = rows.filter(F.col("h").cast("double") < (share - 0.5) * float(1 << 64))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = few.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "text")
    sample = Scratch(docs.sparkSession, "language_id").table(sample)  # read twice below
    grams = sample.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(grams["lang"].unique())
    if not languages:
        return None
    index = {x: i for i, x in enumerate(languages)}
    model = PpmModel(languages, grams["lang"].map(index).to_numpy(), grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.judge(data, offsets)[2] for _, _, data, offsets in chunks(batch.column(0))]
            yield pa.record_batch([pa.array(np.concatenate(out) if out else np.zeros(0))], ["rate"])

    measured = sample.filter(F.octet_length("text") > 8 * ORDER).select("text").mapInArrow(rates, "rate double").agg(
        F.percentile("rate", F.lit(0.5)).alias("r")
    ).first().r
    if measured:
        model.bound = SLACK * measured
    return model


def predict(docs: DataFrame, model: PpmModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    kind = dict(rows.dtypes)["doc_id"]
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = held.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best = np.zeros(batch.num_rows, dtype=np.int64)
            score = np.zeros(batch.num_rows)
            names = np.array([UNDETERMINED] if ppm is None else [*ppm.languages, UNDETERMINED], dtype=object)
            if ppm is not None:
                for first, last, data, offsets in chunks(batch.column(1)):
                    best[first:last], score[first:last], _, _ = ppm.judge(data, offsets)
            best[~letters] = len(names) - 1
            score[~letters] = 0.0
            if ppm is None:
                score[:] = 0.0
            yield pa.record_batch([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language can be told, in one pass; all columns stay as they are.

    Rejected are texts that are null or have no letter, and those whose rate in the
    best language is beyond the bound (see the score): noise, and languages that
    weren't learned. Learns from the rows that are not held out
    (CRC-32 of the id modulo 4 is not 2). Where none of them has a language, all
    texts with a letter stay, with a warning.
    """
    bound_batches(docs.sparkSession)
    model = train(docs.filter(~held_out(id_col, 4, 2)), id_col, text_col, lang_col)
    lettered = docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        warnings.warn("no text has a language to learn from: no text is rejected for its language", stacklevel=2)
        return lettered
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fits(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), dtype=bool)
        for first, last, data, offsets in chunks(texts):
            out[first:last] = held.value.judge(data, offsets)[3]
        return pa.array(out)

    return lettered.filter(F.arrow_udf(fits, "boolean")(F.col(text_col).cast("string")))
