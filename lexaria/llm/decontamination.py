"""Benchmark decontamination: BM25 with block-max WAND, then verified overlap.

The test items are the indexed side and every passage of every document is a query.
Items go to classes by length: the class's ``span`` is a power of two, at least the
item's words.  A passage of a class is a window of ``2 * span`` words that starts at a
multiple of ``span``, so each copy of an item lies within one passage, and a long item
doesn't widen the passages of short ones.

A passage holds an item if at least 0.8 of the item's distinct 5-word shingles occur in
the passage, and among them at least one of the question and one of the answer, where
these have any.  The last quarter of an item's words is its answer; shingles that touch
it are the answer's, the others the question's.

An item's scores are normalised by the score of the item itself.  Its threshold is the
least score that any passage holding it can have: shingles that may be missing free some
words of the item, at its ends most cheaply, and what the heaviest such words weigh is
the most that can be lost.  So retrieval loses no passage that verification would accept.

Of each item the most common words, up to ``COMMON`` of its threshold, aren't in the
inverted index: a passage that reaches the threshold must reach the rest of it by the
other, essential words.  Each passage walks the essential postings by WAND: cursors are
kept in the order of their items, the pivot is the first item at which the lists' maxima
add up to the threshold, and only where the maxima of the blocks around the pivot do so
too are its impacts added up; else cursors jump to the pivot, or beyond the block.  All
passages of a batch walk at a time.  Candidates are then scored with all their words,
and all at or above the threshold are verified, without a limit.

Definitions: null or empty items are in no result; items of fewer than five words count
as one shingle, the answer's, that equals a document of just these words.  Null texts
have no passages.  Of several passages that hold an item the one with most hits counts,
of those the first.  Repeated documents are found one by one; items with equal ids and
texts count once, and items with equal ids and different texts are found one by one.
Empty tables give empty results.  Whole texts of any length are searched.  Only the named
columns are read; others may have any name.  Items are held in shards of ``SHARD_WORDS``
words at most (or one item), so what is broadcast is bounded; each shard is one more
pass over the documents.  Document frequencies and the mean length are those of all items,
so shards don't change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.ngram_join import WORDS
from lexaria.llm.scratch import Scratch
from lexaria.llm.words import HashIndex, bound_batches, chunk_words, chunks, expand, hash_text, shingle_hashes, short_hash

K1, B = 1.2, 0.75
#: Share of an item's threshold that words outside of the inverted index may have.
COMMON = 0.5
BLOCK = 16
SHARD_WORDS = 2_000_000
LEAST_SPAN = 8
_NEARLY = 1 - 1e-9


class Statistics:
    """Document frequencies of words (by hash), number and mean length of all items."""

    def __init__(self):
        self.terms, self.df = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.items = self.words = 0

    def add(self, hashes: list[np.ndarray]) -> None:
        some = np.concatenate([self.terms, *(np.unique(h) for h in hashes)])
        n = np.concatenate([self.df, np.ones(len(some) - len(self.df), dtype=np.int64)])
        self.terms, at = np.unique(some, return_inverse=True)
        self.df = np.bincount(at, weights=n, minlength=len(self.terms)).astype(np.int64)
        self.items += len(hashes)
        self.words += sum(map(len, hashes))

    def weigh(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of an item: its distinct words, their document frequencies, and their shares of the item's own BM25 score."""
        terms, tf = np.unique(h, return_counts=True)
        df = self.df[np.searchsorted(self.terms, terms)]
        idf = np.log1p((self.items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * len(h) / max(1.0, self.words / max(1, self.items)))
        impact = idf * tf * (K1 + 1) / (tf + norm)
        return terms, df, impact / impact.sum()


def _shingles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an item: distinct shingles, whether each is the answer's, and how often each occurs."""
    if len(h) >= WORDS:
        s = shingle_hashes(h, WORDS)
        late = np.arange(len(s)) + WORDS > len(h) - max(1, len(h) // 4)
    else:
        s, late = short_hash(h), np.ones(1, dtype=bool)
    order = np.argsort(late, kind="stable")  # a shingle that occurs in both parts is the question's
    u, where, times = np.unique(s[order], return_index=True, return_counts=True)
    return u, late[order][where], times


def least_score(h: np.ndarray, terms: np.ndarray, share: np.ndarray, times: np.ndarray) -> float:
    """A lower bound of the normalised score of any passage with at least 0.8 of the item's distinct shingles.

    A word is surely there if any shingle over it is. ``r`` missing shingles at an
    end free ``r`` words, elsewhere at most ``r - 4``, wherever these weigh most.
    """
    may = len(times) - -(-4 * len(times) // 5)
    spare = int(np.sort(times)[::-1][:may].sum())
    if spare >= len(h) - WORDS + 1:
        return 0.0
    at = np.searchsorted(terms, h)
    weight = share[at] / np.bincount(at, minlength=len(terms))[at]
    front = np.concatenate([[0.0], np.cumsum(weight)])
    back = np.concatenate([[0.0], np.cumsum(weight[::-1])])
    inner = np.concatenate([np.zeros(WORDS), np.cumsum(np.sort(weight)[::-1])])  # by missing shingles
    lost = 0.0
    for p in range(spare + 1):
        q = np.arange(spare - p + 1)
        lost = max(lost, float((front[p] + back[q] + inner[spare - p - q]).max()))
    return 1.0 - lost


class ClassIndex:
    """Items of one class: essential postings with list and block maxima, all words, and shingles."""

    def __init__(self, span: int, ids: list[int], hashes: list[np.ndarray], stats: Statistics):
        self.span, self.ids = span, np.array(ids, dtype=np.int64)
        self.shingles, self.answer, words, impacts, essential = [], [], [], [], []
        for h in hashes:
            u, late, times = _shingles(h)
            self.shingles.append(u)
            self.answer.append(late)
            terms, df, share = stats.weigh(h)
            impact = share / max(least_score(h, terms, share, times), 1e-6)  # 1 is the threshold from here on
            order = np.lexsort((terms, -df))
            words.append(terms[order])
            impacts.append(impact[order])
            essential.append(np.cumsum(impact[order]) > COMMON)
        size = np.array([len(w) for w in words], dtype=np.int64)
        flat, self.impact = np.concatenate(words), np.concatenate(impacts)
        own, keep = np.repeat(np.arange(len(words)), size), np.concatenate(essential)
        terms, code = np.unique(flat, return_inverse=True)
        self.terms, self.n_terms, self.n_items = HashIndex(terms), len(terms), len(ids)
        self.word, self.first, self.size = code, np.cumsum(size) - size, size
        # what an item's essential words must reach, made 1
        need = 1.0 - np.bincount(own[~keep], weights=self.impact[~keep], minlength=len(words))
        order = np.lexsort((own[keep], code[keep]))
        self.item = own[keep][order]
        self.posting = code[keep][order] * self.n_items + self.item
        self.value = (self.impact[keep] / need[own[keep]])[order]
        term = self.posting // self.n_items
        self.start = np.searchsorted(term, np.arange(len(terms)))
        self.end = np.searchsorted(term, np.arange(len(terms)), side="right")
        self.list_max = np.zeros(len(terms))
        np.maximum.at(self.list_max, term, self.value)
        self.blocks = -(-self.n_items // BLOCK)
        self.block, at = np.unique(term * self.blocks + self.item // BLOCK, return_inverse=True)
        self.block_max = np.zeros(len(self.block))
        np.maximum.at(self.block_max, at, self.value)

    def _advance(self, term: np.ndarray, cursor: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Cursors moved to the first posting of an item or a later one."""
        return np.maximum(cursor, np.minimum(np.searchsorted(self.posting, term * self.n_items + item), self.end[term]))

    def _around(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Maxima of the blocks of these lists around an item."""
        key = term * self.blocks + item // BLOCK
        at = np.minimum(np.searchsorted(self.block, key), len(self.block) - 1)
        return np.where(self.block[at] == key, self.block_max[at], 0.0)

    def walk(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) whose essential words reach what they must; input: distinct (passage, term) pairs."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live = self.start[term] < self.end[term]
        passage, term = passage[live], term[live]
        if len(passage):
            able = np.bincount(passage, weights=self.list_max[term])[passage] >= _NEARLY
            passage, term = passage[able], term[able]
        cursor = self.start[term]
        while len(passage):
            now = self.item[cursor]
            order = np.argsort(passage * self.n_items + now, kind="stable")
            passage, term, cursor, now = passage[order], term[order], cursor[order], now[order]
            head = np.ones(len(passage), dtype=bool)
            head[1:] = passage[1:] != passage[:-1]
            first = np.flatnonzero(head)
            group = np.cumsum(head) - 1
            bound = np.cumsum(self.list_max[term])
            bound -= (bound[first] - self.list_max[term[first]])[group]
            over = np.flatnonzero(bound >= _NEARLY)
            pivot = np.full(len(first), -1)
            g, at = np.unique(group[over], return_index=True)
            pivot[g] = now[over[at]]
            at_pivot = pivot[group]
            keep = at_pivot >= 0  # the others can't reach the threshold any more
            before = keep & (now <= at_pivot)
            blocks = np.bincount(group[before], weights=self._around(term[before], at_pivot[before]), minlength=len(first)) >= _NEARLY
            ready = blocks & (now[first] == pivot)
            scored = np.flatnonzero(before & ready[group])
            total = np.bincount(group[scored], weights=self.value[cursor[scored]], minlength=len(first))
            hit = np.flatnonzero(ready & (total >= _NEARLY))
            found.append((passage[first[hit]], pivot[hit]))
            # beyond a block that can't, but not beyond the next cursor's item
            after = np.full(len(first), self.n_items)
            np.minimum.at(after, group[keep & ~before], now[keep & ~before])
            target = np.where(blocks, np.where(ready, pivot + 1, pivot), np.minimum((pivot // BLOCK + 1) * BLOCK, after))
            move = np.flatnonzero(before & (now < target[group]))
            cursor[move] = self._advance(term[move], cursor[move], target[group[move]])
            keep &= cursor < self.end[term]
            passage, term, cursor = passage[keep], term[keep], cursor[keep]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score over the item's threshold) of all at or above it; input: (passage, term) pairs, sorted and distinct."""
        p, i = self.walk(passage, term)
        if not len(p):
            return p, i, np.zeros(0)
        have = passage * self.n_terms + term
        entry, of = expand(self.first[i], self.size[i])
        key = p[of] * self.n_terms + self.word[entry]
        at = np.minimum(np.searchsorted(have, key), len(have) - 1)
        score = np.bincount(of, weights=np.where(have[at] == key, self.impact[entry], 0.0), minlength=len(p))
        good = score >= _NEARLY
        return p[good], i[good], score[good]

    def search(self, h: np.ndarray, bounds: np.ndarray, shingles: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int, int]]:
        """(row, item, score, n_question, n_answer, question_hits, answer_hits) of verified items in rows of word hashes."""
        term = self.terms.find(h)
        at = np.flatnonzero(term >= 0)
        if not len(at):
            return
        row = np.searchsorted(bounds, at, side="right") - 1
        windows = -(-np.diff(bounds) // self.span)
        base = np.cumsum(windows) - windows
        own = (at - bounds[row]) // self.span
        here, back = base[row] + own, np.flatnonzero(own > 0)
        both = np.unique(np.concatenate([here, here[back] - 1]) * self.n_terms + np.concatenate([term[at], term[at[back]]]))
        best: dict[tuple[int, int], tuple] = {}
        known, known_at = None, -1
        passage, item, score = self.retrieve(both // self.n_terms, both % self.n_terms)
        for k in np.lexsort((item, passage)).tolist():
            p, i = int(passage[k]), int(item[k])
            r = int(np.searchsorted(base, p, side="right")) - 1
            if p != known_at:
                lo = int(bounds[r]) + (p - int(base[r])) * self.span
                hi = min(int(bounds[r + 1]), lo + 2 * self.span)
                n = int(bounds[r + 1] - bounds[r])
                known = np.unique(shingles[lo : hi - WORDS + 1]) if hi - lo >= WORDS else short_hash(h[lo:hi]) if n < WORDS else h[:0]
                known_at = p
            hit = np.isin(self.shingles[i], known, assume_unique=True)
            late = self.answer[i]
            n_a, a = int(late.sum()), int((hit & late).sum())
            n_q, q = len(late) - n_a, int(hit.sum()) - a
            if 5 * (q + a) >= 4 * (n_q + n_a) and (q or not n_q) and (a or not n_a):
                old = best.get((r, i))
                if old is None or q + a > old[3] + old[4]:
                    best[r, i] = (float(score[k]), n_q, n_a, q, a)
        for (r, i), x in sorted(best.items()):
            yield r, int(self.ids[i]), *x


def _hashes(texts: list[str]) -> list[np.ndarray]:
    return [hash_text(np.frombuffer(t.encode(), dtype=np.uint8))[2] for t in texts]


def build(ids: list[int], texts: list[str], stats: Statistics) -> list[ClassIndex]:
    """The indexes of a shard's items, shortest class first."""
    classes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, h in zip(ids, _hashes(texts), strict=True):
        classes.setdefault(max(LEAST_SPAN, 1 << (len(h) - 1).bit_length()), []).append((i, h))
    return [ClassIndex(span, [i for i, _ in rows], [h for _, h in rows], stats) for span, rows in sorted(classes.items())]


_OUT = "doc_id long, item_id long, score double, n_question long, n_answer long, question_hits long, answer_hits long"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [pa.float64() if c.endswith("double") else pa.int64() for c in _OUT.split(", ")]


def find_in(indexes: list[ClassIndex], texts: pa.Array) -> Iterator[tuple]:
    """A row for each verified (document, item) pair; documents by their place."""
    for first, _, data, offsets in chunks(texts):
        _, _, h, bounds = chunk_words(data, offsets)
        shingles = shingle_hashes(h, WORDS)
        for index in indexes:
            for r, *found in index.search(h, bounds, shingles):
                yield first + r, *found


def _shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[ClassIndex]]:
    """Indexes of the items by parts whose words are bounded."""
    rows = items.select(
        F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")
    ).filter(F.col("text").rlike(r"[^ \t-\r]")).distinct()
    words = rows.agg(F.sum(F.size(F.split("text", r"[ \t-\r]+"))).alias("n")).first().n or 0
    parts = -(-words * 2 // SHARD_WORDS) if words > SHARD_WORDS else 1
    stats, last = Statistics(), None
    for k in range(parts):
        last = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        stats.add(_hashes([r.text for r in last]))
    for k in range(parts):
        if parts > 1:
            last = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        if last:
            yield build([r.item_id for r in last], [r.text for r in last], stats)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The verified (document, item) pairs: score (normalised BM25 over the item's threshold), shingle counts and hits."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for shard in _shards(items, item_col, item_text_col):
        held = spark.sparkContext.broadcast(shard)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = list(find_in(held.value, batch.column(1)))
                ids = batch.column(0).take(pa.array([r[0] for r in out], pa.int64()))
                columns = list(zip(*out, strict=True))[1:] if out else [[]] * (len(_NAMES) - 1)
                yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(columns, _TYPES[1:], strict=True))], _NAMES)

        found.append(texts.mapInArrow(search, _OUT))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _OUT)


def _flag(held):
    """A column function: whether a text holds an item of a broadcast shard."""

    def flag(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), dtype=bool)
        for hit in find_in(held.value, texts):
            out[hit[0]] = True
        return pa.array(out)

    return F.arrow_udf(flag, "boolean")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no test item. Rows with a null id are judged like others; each shard of items is a pass of its own."""
    spark = docs.sparkSession
    bound_batches(spark)
    for k, shard in enumerate(_shards(items, item_col, item_text_col)):
        if k:
            docs = Scratch(spark, "decontamination").table(docs)  # one shard's index at a time
        docs = docs.filter(~_flag(spark.sparkContext.broadcast(shard))(F.col(text_col).cast("string")))
    return docs
