"""Language-model scores of whole texts, with a unigram baseline.

A text is its lower-cased words, each with a space before it, and one end; the
model gives the probability of this sequence in subword ids of a public
tokenizer.  Word counts, subword counts (which fix the model's vocabulary, its
output biases and the shares of rare tokens), the baseline and the weights come
from all training texts.  The attention model starts on whole texts of some
``START_TOKENS`` subwords, drawn by hash.  Then every block of every training
text is taken once: texts are dealt by hash to ``ROUNDS`` rounds, and in a round
to shards of some ``SHARD_TOKENS`` (up to ``GROWN`` times as many where there is much
text, with steps as much larger); each shard's task goes on from the weights
of the round before, and their average, by numbers of targets, is what the next
round gets.  Steps so grow with the tokens, and weights don't depend on how rows
lie in partitions.  Every token of every text is scored once, in overlapping
windows that see the block before (see ``attention``).

The model's probability of a word, or of the end, is a mixture: ``1 - PRIOR`` times the
product of its subwords' by attention, plus ``PRIOR`` times its share of the training
words.  The share is that of the baseline, rounded down to ``1 / STEP`` of a decimal
logarithm, and that of a word never seen where the word is not a frequent one; so the
mixture's probabilities add up to at most 1.

Counts of the most frequent words, ``FREQUENT`` at most, are broadcast; those of all
other words come by a join on the word's 64-bit hash, so no table that grows
with the corpus is broadcast, and the two ways give the same sums.

Definitions: null text is empty and has the end only.  A null id counts as the
empty string for the split.  Repeated rows are scored one by one.  With no
training text all counts are zero, and the model gives its starting weights.  An
empty table gives an empty result.  Whole texts of any length are read; a text's
subwords take some 8 bytes for each of its words.  Only the id, the text and what the
split reads are used; other columns may have any name.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.llm.attention import Attention, Vocabulary, blocks_of
from lexaria.llm.scratch import Scratch, least_count
from lexaria.llm.words import HashIndex, bound_batches, chunk_words, chunks, expand, give_back, keep_freed, one_thread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FREQUENT = 1 << 18
START_TOKENS, STEPS = 1 << 21, 700
#: Passes over parts of the texts, which together are all texts; a shard's subwords; most shards of a round (beyond it they grow).
ROUNDS, SHARD_TOKENS, SHARDS = 8, 1 << 18, 256
#: Blocks of a step, and how many times larger steps and shards get where a round has some shards for each of 8 tasks.
BATCH, GROWN = 192, 4
#: Adam's rate in the first round; it falls to nearly nothing in the last.
RATE = 0.006
#: Weight of a word's share in the mixture, and steps of a decimal logarithm that shares are kept in.
PRIOR, STEP = 0.4, 2048
#: Marks a word's first subword.
FIRST = 1 << 14
#: Subwords scored at a time.
SCORED = 1 << 17
#: Words gathered in a task before they are counted.
FLUSH = 1 << 21
#: Words spelt in one row, and words whose subwords a worker keeps.
ROW, KEPT = 1 << 14, 1 << 19
#: White space that a word may hold, with which a row could be cut otherwise than its words.
GAP = re.compile(r"[^\S ]")
# Fixed value: how the tokenizer's vocabulary was made to split text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What a worker process has built from broadcasts, by the run's key.
_LIVE: dict[str, object] = {}


class Subwords:
    """Subword ids of words, from the bytes of a tiktoken rank file."""

    def __init__(self, file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.size = max(ranks.values()) + 1
        self.length = np.zeros(self.size, dtype=np.int64)
        self.length[list(ranks.values())] = [len(b) for b in ranks]
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode())

    def _row(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As many, of words that no other white space touches: in a row with a space before each, a piece never runs over a word's end."""
        ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(words)).decode()), dtype=np.int32)
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.diff(np.searchsorted(np.cumsum(self.length[ids]), ends, "right"), prepend=0), ids

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of subword ids of words, and the ids of all."""
        sizes, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for i in range(0, len(words), ROW):
            some = words[i : i + ROW]
            if not GAP.search(b" ".join(some).decode()):
                size, own = self._row(some)
            else:
                odd = np.array([GAP.search(w.decode()) is not None for w in some])
                lists = [self(w) for w, o in zip(some, odd.tolist(), strict=True) if o]
                size = np.zeros(len(some), dtype=np.int64)
                size[odd] = [len(x) for x in lists]
                plain = [w for w, o in zip(some, odd.tolist(), strict=True) if not o]
                size[~odd], row = self._row(plain) if plain else (0, ids[0])
                own, first = np.zeros(int(size.sum()), dtype=np.int32), np.cumsum(size) - size
                own[expand(first[odd], size[odd])[0]] = [i for x in lists for i in x]
                own[expand(first[~odd], size[~odd])[0]] = row
            sizes.append(size)
            ids.append(own)
        return np.concatenate(sizes), np.concatenate(ids)


class _Known:
    """Subword ids of words that came twice or more in one go, by hash."""

    def __init__(self):
        self.keys, self.first, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, keys: np.ndarray, n: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words, given their hashes in order, their counts, and what spells the words at some places."""
        at = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), dtype=bool)
        inside = np.flatnonzero(at < len(self.keys))
        old[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~old)
        sizes, ids = spell(new)
        first, size = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        first[old], size[old] = self.first[at[old]], self.size[at[old]]
        first[new], size[new] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        out = np.concatenate([self.pool, ids])[expand(first, size)[0]]
        kept = new[n[new] > 1]
        if len(self.keys) + len(kept) > KEPT:
            self.__init__()
        elif len(kept):
            ends = np.cumsum(size[kept])
            spelt = out[expand((np.cumsum(size) - size)[kept], size[kept])[0]]
            self.keys, self.size = np.insert(self.keys, at[kept], keys[kept]), np.insert(self.size, at[kept], size[kept])
            self.first = np.insert(self.first, at[kept], len(self.pool) + ends - size[kept])
            self.pool = np.concatenate([self.pool, spelt])
        return size, out


def _live(key: str, make):
    """One such object for each worker process; those of earlier runs go."""
    if key not in _LIVE:
        run = key.partition(":")[0]
        for old in [k for k in _LIVE if not k.startswith(run)]:
            del _LIVE[old]
        _LIVE[key] = make()
    return _LIVE[key]


def _counter(run: str, held):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 1: word hash and count; kind 2: subword id and count; kind 3: number of texts."""
        keep_freed()
        tokenizer = _live(f"{run}:words", lambda: Subwords(held.value))
        subword = np.zeros(tokenizer.size, dtype=np.int64)
        known = _live(f"{run}:known", _Known)
        texts = words = 0
        parts: list[tuple] = []

        def sent() -> pa.RecordBatch:
            u, at, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
            base = np.cumsum([0] + [len(p[3]) for p in parts])
            s, e = (np.concatenate([p[k] + b for p, b in zip(parts, base, strict=False)])[at] for k in (1, 2))
            data = b"".join(p[3] for p in parts)

            def spell(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return tokenizer.many([data[a:b] for a, b in zip(s[some].tolist(), e[some].tolist(), strict=True)])

            size, ids = known(u, n, spell)
            np.add(subword, np.bincount(ids, weights=np.repeat(n, size), minlength=len(subword)).astype(np.int64), out=subword)
            return pa.record_batch([pa.array(np.full(len(u), 1, dtype=np.int8)), pa.array(u.view(np.int64)), pa.array(n)], ["kind", "h", "n"])

        for batch in batches:
            texts += batch.num_rows
            for _, _, data, offsets in chunks(batch.column(0)):
                s, e, h, _ = chunk_words(data, offsets)
                parts.append((h, s, e, data.tobytes().lower()))
                words += len(h)
                if words >= FLUSH:
                    yield sent()
                    parts.clear()
                    words = 0
        if words:
            yield sent()
        some = np.flatnonzero(subword)
        yield pa.record_batch(
            [pa.array(np.append(np.full(len(some), 2), 3).astype(np.int8)), pa.array(np.append(some, 0)), pa.array(np.append(subword[some], texts))],
            ["kind", "h", "n"]
        )

    return count


def _shorts(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of two bytes of all rows, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    return np.frombuffer(data or b"", dtype=kind)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model ids of all rows, where each row's begin, and where words begin."""
    marked, bounds = _shorts(column, np.int16)
    return marked & (FIRST - 1), bounds, np.flatnonzero(marked & FIRST)


def _rounded(log: np.ndarray) -> np.ndarray:
    """Decimal logarithms of probabilities in steps, rounded down."""
    return np.minimum(np.ceil(-log * STEP), 65535).astype(np.uint16)


def mixed(logs: np.ndarray, bounds: np.ndarray, starts: np.ndarray, prior: np.ndarray, end_prior: float) -> np.ndarray:
    """Each text's decimal log probability under the mixture.

    logs: by attention, of each text's subwords and then its end; bounds: of texts in
    the subwords without ends; starts: where words begin there; prior: logarithms of each word's share.
    """
    texts = len(bounds) - 1
    text = np.searchsorted(bounds, starts, side="right") - 1
    ends = bounds[1:] + np.arange(texts)
    units = np.sort(np.concatenate([starts + text, ends]))
    sums = np.add.reduceat(logs, units) if len(units) else np.zeros(0)
    share = np.full(len(units), end_prior)
    is_end = np.zeros(len(units), dtype=bool)
    is_end[np.searchsorted(units, ends)] = True
    share[~is_end] = prior
    both = np.logaddexp(sums * np.log(10) + np.log1p(-PRIOR), share * np.log(10) + np.log(PRIOR)) / np.log(10)
    edges = np.concatenate([[0], np.searchsorted(units, ends) + 1])
    return np.add.reduceat(both, edges[:-1]) if texts else np.zeros(0)


def _trainer(shared, rate: float, steps: int | None, batch: int):
    def train(table: pa.Table) -> pa.Table:
        """The weights after this shard's texts, and its number of targets; with steps, random blocks of them, else each block once."""
        one_thread()
        keep_freed()
        # an order that doesn't depend on how rows came; equal rows may trade places
        held = sorted(zip(table.column("key").to_pylist(), table.column("ids").to_pylist(), strict=True))
        tokens, bounds, _ = _tokens(pa.array([x for _, x in held], pa.binary()))
        model = shared.value.copy()
        if steps is None:
            n = model.train_once(tokens, bounds, rate, batch)
        else:
            n = len(model.train(tokens, bounds, steps=steps)) and len(tokens) + len(held)
        give_back()
        return pa.table({"n": pa.array([n], pa.int64()), "weights": pa.array([model.weights().tobytes()], pa.binary())})

    return train


def _rounds(tokens: int) -> int:
    return max(1, min(ROUNDS, tokens // SHARD_TOKENS))


def _growth(tokens: int) -> int:
    """How many times larger steps and shards are: of more text, each round's average takes as many steps of more blocks, which cost less a block."""
    return max(1, min(GROWN, tokens // (8 * ROUNDS * SHARD_TOKENS)))


def _fit(model: Attention, texts: DataFrame, tokens: int, steps: int) -> None:
    """Trains the model on texts (round, key, ids) with this many tokens in all; a round reads no other's texts where the table is cut by round."""
    sc, grown = texts.sparkSession.sparkContext, _growth(tokens)

    def average(rows: DataFrame, rate: float, steps: int | None) -> None:
        shared = sc.broadcast(model)
        done = rows.groupBy("shard").applyInArrow(_trainer(shared, rate, steps, BATCH * grown), "n long, weights binary").collect()
        shared.destroy()
        # in a fixed order, as sums of floats depend on it
        done = sorted((r.n, bytes(r.weights)) for r in done if r.n)
        if done:
            model.take(sum(np.frombuffer(w, dtype=np.float32).astype(np.float64) * n for n, w in done) / sum(n for n, _ in done))

    place = F.xxhash64(F.col("key"), F.lit(1))
    cut = F.lit(min(1.0, START_TOKENS / max(tokens, 1)) - 0.5) * float(1 << 64)
    average(texts.filter(place.cast("double") < cut).select(F.lit(0).alias("shard"), "key", "ids"), 0.0, steps)
    rounds = _rounds(tokens)
    shards = min(SHARDS, -(-tokens // (rounds * SHARD_TOKENS * grown)) or 1)
    for k in range(rounds):
        part = texts.filter(F.col("round") == k)
        average(part.select(F.pmod(F.xxhash64(F.col("key"), F.lit(3)), F.lit(shards)).alias("shard"), "key", "ids"), RATE * (1 - 0.95 * k / rounds), None)


class _Speller:
    """What a worker needs: frequent words with their counts, and the vocabulary; token ids of words as they come."""

    def __init__(self, tokenizer: Subwords, keys: np.ndarray, counts: np.ndarray, vocab: Vocabulary, scale: float):
        self.tokenizer, self.vocab = tokenizer, vocab
        self.prior, self.unseen = _rounded(np.log10(counts + 0.5) - scale), _rounded(np.array([np.log10(0.5) - scale]))[0]
        self.index = HashIndex(keys)
        self.log_count = np.log10(counts + 0.5)
        self.first = np.full(len(keys), -1, dtype=np.int64)
        self.size = np.zeros(len(keys), dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0

    def _spell(self, data: bytes, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.tokenizer.many([data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """By row: words, those frequent, sum of their log counts, shares and extra costs of words, model ids; and (row, hash, count) of other words."""
        s, e, h, bounds = chunk_words(data, offsets)
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(bounds))
        at = self.index.find(h)
        common = at >= 0
        n_common = np.bincount(row[common], minlength=rows)
        base = np.bincount(row[common], weights=self.log_count[at[common]], minlength=rows)
        raw = data.tobytes().lower()
        new = np.flatnonzero(common)
        new = new[self.first[at[new]] < 0]
        if len(new):
            _, pick = np.unique(at[new], return_index=True)
            new = new[pick]
            size, ids = self._spell(raw, s[new], e[new])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.first[at[new]], self.size[at[new]] = self.used + np.cumsum(size) - size, size
            self.used += len(ids)
        rare = np.flatnonzero(~common)
        _, pick, back = np.unique(h[rare], return_index=True, return_inverse=True)
        size, ids = self._spell(raw, s[rare[pick]], e[rare[pick]])
        first = np.empty(len(h), dtype=np.int64)
        count = np.empty(len(h), dtype=np.int64)
        first[common], count[common] = self.first[at[common]], self.size[at[common]]
        first[rare], count[rare] = (self.used + np.cumsum(size) - size)[back], size[back]
        pool = np.concatenate([self.pool[: self.used], ids])
        tokens = pool[expand(first, count)[0]]
        edges = np.concatenate([[0], np.cumsum(count)])[bounds]
        spelt = self.vocab.of[tokens].astype(np.int16)
        places = np.cumsum(count) - count
        spelt[places] |= FIRST
        ids = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((edges * 2).astype(np.int32)), pa.py_buffer(spelt)])
        # of each word its share, and what its rare subwords cost on top
        prior = np.empty((len(h), 2), dtype=np.uint16)
        prior[:, 0] = self.unseen
        prior[common, 0] = self.prior[at[common]]
        prior[:, 1] = _rounded(np.add.reduceat(self.vocab.extra[tokens], places)) if len(h) else 0
        extra = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(prior.reshape(-1))])
        order = np.lexsort((h[rare], row[rare]))
        r, k = row[rare][order], h[rare][order]
        head = np.ones(len(r), dtype=bool)
        head[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
        starts = np.flatnonzero(head)
        return np.diff(bounds), n_common, base, extra, ids, r[starts], k[starts].view(np.int64), np.diff(np.append(starts, len(r)))


_FOUND = {
    "rid": pa.int64(), "n": pa.int64(), "common": pa.int64(), "h": pa.int64(), "base": pa.float64(), "extra": pa.binary(), "ids": pa.binary(),
    "doc_id": None, "held_out": pa.bool_()
}


def _batch(**columns) -> pa.RecordBatch:
    """A batch of these columns, null in all others."""
    n = len(columns["rid"])
    arrays = [(c if isinstance(c, pa.Array) else pa.array(c, _FOUND[k])) if (c := columns.get(k)) is not None else pa.nulls(n, _FOUND[k]) for k in _FOUND]
    return pa.record_batch(arrays, list(_FOUND))


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, frequent: int = FREQUENT,
    steps: int = STEPS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows that are not held out."""
    spark = docs.sparkSession
    bound_batches(spark)
    sc, scratch = spark.sparkContext, Scratch(docs.sparkSession, "lm_scoring")
    with open(tokenizer, "rb") as f:  # on the driver; executors get the bytes
        file = f.read()
    held, run = sc.broadcast(file), uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    train = rows.filter(~F.col("held_out"))

    counted = train.select("text").mapInArrow(_counter(run, held), "kind byte, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    counted = scratch.table(counted, "none")
    words = counted.filter("kind = 1").select("h", "n")
    facts = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    texts = counted.filter("kind = 3").agg(F.sum("n").alias("n")).first().n or 0
    total, distinct = (facts.tokens or 0) + texts, facts.distinct + (texts > 0)
    top = words.filter(F.col("n") >= least_count(words, "n", frequent)).toPandas().sort_values("h")
    keys, counts = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)

    subword = np.zeros(Subwords(file).size)
    for r in counted.filter("kind = 2").collect():
        subword[r.h] = r.n
    vocab = Vocabulary(subword, texts)
    scale = float(np.log10(total + 0.5 * (distinct + 1)))
    parts = sc.broadcast((keys, counts, vocab, scale))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        speller = _live(f"{run}:speller", lambda: _Speller(Subwords(held.value), *parts.value))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in chunks(batch.column(1)):
                n, common, base, extra, spelt, r, h, tf = speller(data, offsets)
                own = ids[first:last]
                yield _batch(
                    rid=own, n=n + 1, common=common, base=base, extra=extra, ids=spelt, doc_id=batch.column(2)[first:last],
                    held_out=batch.column(3)[first:last]
                )
                yield _batch(rid=own[r], n=tf, h=h, doc_id=pa.nulls(len(r), batch.column(2).type))

    # rows without h are texts, the others (round -1) are the words of a text that are not frequent; held-out texts have round -2
    kind = dict(rows.dtypes)["doc_id"]
    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    spelt = numbered.select("rid", "text", "doc_id", "held_out").mapInArrow(
        spell, f"rid long, n long, common long, h long, base double, extra binary, ids binary, doc_id {kind}, held_out boolean"
    )
    key, tokens = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "ids"), int(subword.sum())
    dealt = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(_rounds(tokens))).cast("int")
    found = scratch.table(spelt.withColumn("round", F.when(F.col("h").isNotNull(), -1).when(~F.col("held_out"), dealt).otherwise(-2)), by=["round"])
    model = Attention(vocab)
    if texts:
        _fit(model, found.filter("round >= 0").select("round", key.alias("key"), "ids"), tokens, steps)
    model.freeze()
    shared = sc.broadcast(model)
    end_prior = float(np.log10(texts + 0.5)) - scale

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        keep_freed()
        for batch in batches:
            tokens, bounds, starts = _tokens(batch.column(0))
            costs, words_of = _shorts(batch.column(batch.num_columns - 1), np.uint16)
            costs, words_of = costs.reshape(-1, 2), words_of // 2
            out, first = np.zeros(batch.num_rows), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SCORED, "right")) - 1)
                x, y, before, text = blocks_of(tokens[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                logs = shared.value.log_probs(x, y, before)[y >= 0].astype(np.float64) / np.log(10)
                mine, some = bounds[first : last + 1], slice(int(words_of[first]), int(words_of[last]))
                at = starts[some] - mine[0]
                # what rare subwords cost on top goes to their word's first one; ends lie between the texts
                logs[at + np.searchsorted(mine - mine[0], at, side="right") - 1] -= costs[some, 1] / STEP
                out[first:last] = mixed(logs, mine - mine[0], at, costs[some, 0] / -STEP, end_prior)
                first = last
            yield pa.record_batch([*batch.columns[1:-1], pa.array(out)], ["rid", "n", "common", "base", "doc_id", "held_out", "score"])
        give_back()

    rare = found.filter("round = -1").select("rid", "h", F.col("n").alias("tf")).join(words, "h", "left")
    rare = rare.groupBy("rid").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_base"),
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("rare_known")
    )
    known_end = 1 if texts else 0
    scored = found.filter("round <> -1").select("ids", "rid", "n", "common", "base", "doc_id", "held_out", "extra")
    out = scored.mapInArrow(score, f"rid long, n long, common long, base double, doc_id {kind}, held_out boolean, score double").join(rare, "rid", "left")
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("common") + F.coalesce("rare_known", F.lit(0)) + known_end).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + float(np.log10(texts + 0.5)) - F.col("n") * scale).alias("base_score"),
        "score",
    )
