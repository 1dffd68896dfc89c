"""What keeps op3's cost down gives the same results: words spelt in rows, words kept, tokens cut by round."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexaria.llm import attention, lm_scoring


class _Held:
    def __init__(self, value):
        self.value = value


def _file():
    with open(lm_scoring.TOKENIZER, "rb") as f:
        return f.read()


def test_words_spelt_in_rows_as_one_by_one(monkeypatch):
    subwords, r = lm_scoring.Subwords(_file()), random.Random(3)
    parts = ["a", "bc", "'s", "'", "17", " ", "　", "\x1f", "\x85", "é", "漢", "\U0001f642", "...", "the", "́", " "]
    for i in range(60):
        monkeypatch.setattr(lm_scoring, "ROW", r.choice([1, 3, 1000]))
        some = [p for p in parts if i % 2 or not p.isspace()]
        words = ["".join(r.choice(some) for _ in range(r.randrange(1, 6))).encode() for _ in range(r.randrange(40))]
        size, ids = subwords.many(words)
        assert size.tolist() == [len(subwords(w)) for w in words] and ids.tolist() == [k for w in words for k in subwords(w)]


def test_counting_calls_the_tokenizer_by_rows(monkeypatch):
    """3,000 different words in one call or two, where each word took a call of its own; a worker's kept words take none."""
    calls = []
    make = lm_scoring.Subwords

    class Counted(make):
        def __init__(self, file):
            super().__init__(file)
            own = self.encoding

            class Encoding:
                def encode_ordinary(self, text):
                    calls.append(len(text))
                    return own.encode_ordinary(text)

            self.encoding = Encoding()

    monkeypatch.setattr(lm_scoring, "Subwords", Counted)
    monkeypatch.setattr(lm_scoring, "_LIVE", {})
    words = [f"w{i * 7919 % 3001}x" for i in range(6000)]
    batch = pa.record_batch([pa.array([" ".join(words[:3000]), " ".join(words[3000:]).upper()])], ["text"])
    count = lm_scoring._counter("run", _Held(_file()))
    first = pa.Table.from_batches(list(count(iter([batch])))).to_pydict()
    assert len(calls) <= 2
    again = pa.Table.from_batches(list(count(iter([batch])))).to_pydict()
    assert again == first and len(calls) <= 3
    plain, want = make(_file()), {}
    for w in words:
        for k in plain(w.encode()):
            want[k] = want.get(k, 0) + 1
    assert {h: n for kind, h, n in zip(*(first[c] for c in ("kind", "h", "n")), strict=True) if kind == 2} == want


def test_kept_words_give_way(monkeypatch):
    monkeypatch.setattr(lm_scoring, "KEPT", 5)
    subwords, known, r = lm_scoring.Subwords(_file()), lm_scoring._Known(), np.random.default_rng(1)
    for _ in range(20):
        keys = np.unique(r.integers(0, 12, 6)).astype(np.uint64)
        n = r.integers(1, 4, len(keys))
        size, ids = known(keys, n, lambda some: subwords.many([f"word{k}ish".encode() for k in keys[some]]))
        want = [subwords(f"word{k}ish".encode()) for k in keys]
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x] and len(known.keys) <= 5


def test_tokens_are_cut_by_round(spark, monkeypatch):
    """The table of tokens has a folder for each round; with one for all, every round read every text and every rare word."""
    seen = []
    fit = lm_scoring._fit

    def watched(model, texts, tokens, steps):
        seen.append((tokens, [sorted(texts.filter(F.col("round") == k).inputFiles()) for k in range(lm_scoring._rounds(tokens))]))
        seen.append({r["round"] for r in texts.select("round").distinct().collect()})
        return fit(model, texts, tokens, steps)

    monkeypatch.setattr(lm_scoring, "_fit", watched)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 64)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    got = lm_scoring.score_texts(docs, F.col("doc_id") % 5 == 1, steps=3, frequent=10).collect()
    assert len(got) == 40 and all(np.isfinite(r.score) for r in got)
    assert seen[1] == set(range(lm_scoring.ROUNDS))
    assert all("round=" in f for files in seen[0][1] for f in files)


def test_steps_give_the_losses_of_plain_adam():
    counts = np.zeros(300)
    counts[:90] = np.arange(90, 0, -1)
    r = np.random.default_rng(4)
    x, y, before, _ = attention.blocks_of(r.integers(2, 90, 400), np.array([0, 150, 400]))
    model, plain = attention.Attention(attention.Vocabulary(counts, 10)), attention.Attention(attention.Vocabulary(counts, 10))
    picks = [r.integers(1, len(x), 8) for _ in range(5)]
    losses = model._descend(x, y, before, picks, [0.01] * 5)
    first, second = ({k: np.zeros_like(v) for k, v in plain.p.items()} for _ in range(2))
    for i, pick in enumerate(picks, 1):
        loss, grad = plain._step(np.concatenate([x[before[pick]], x[pick]], 1), y[pick])
        assert np.isclose(loss, losses[i - 1], rtol=1e-4)
        for k, g in grad.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            plain.p[k] = plain.p[k] - 0.01 * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
    assert np.allclose(model.weights(), plain.weights(), atol=2e-3)


def test_cheap_exponentials_are_near_and_shares_add_up_to_one(monkeypatch):
    """Training and scoring call numpy's exponential for no number in single precision; before, for all."""
    x = np.linspace(-79, 69, 100_000, dtype=np.float32)
    got = attention._exp(x.copy())
    assert np.abs(got / np.exp(x.astype(np.float64)) - 1).max() < 0.031 and (np.diff(got) >= 0).all()
    assert np.isfinite(attention._exp(np.array([-1e9, 1e9], dtype=np.float32))).all() and (attention._exp(np.array([-1e9], dtype=np.float32)) > 0).all()
    counts = np.zeros(300)
    counts[:90] = np.arange(90, 0, -1)
    vocabulary = attention.Vocabulary(counts, 10)
    model = attention.Attention(vocabulary)
    calls = []
    monkeypatch.setattr(attention.np, "exp", lambda *a, **k: calls.append(a))
    r = np.random.default_rng(0)
    model.train_once(r.integers(2, 90, 2000), np.array([0, 900, 2000]), 0.01, 16)
    model.freeze()
    x, y, before, _ = attention.blocks_of(r.integers(2, 90, 40), np.array([0, 40]))
    total = sum(np.float64(np.e) ** model.log_probs(x, np.where(y < 0, -1, v), before).astype(np.float64) for v in range(vocabulary.size))
    assert np.allclose(total[y >= 0], 1, atol=1e-3) and not calls


def test_steps_grow_with_the_text(monkeypatch):
    """Of more text, a round's average takes as many steps, of more blocks; every block is taken once. Before, steps stayed as small."""
    size = 8 * lm_scoring.ROUNDS * lm_scoring.SHARD_TOKENS
    assert [lm_scoring._growth(n) for n in (0, size - 1, size, 3 * size, 100 * size)] == [1, 1, 1, 3, lm_scoring.GROWN]
    counts = np.zeros(300)
    counts[:90] = np.arange(90, 0, -1)
    model, seen = attention.Attention(attention.Vocabulary(counts, 10)), []
    monkeypatch.setattr(model, "_descend", lambda x, y, before, picks, rates: seen.append(picks))
    tokens, bounds = np.random.default_rng(1).integers(2, 90, 9000), np.array([0, 9000])
    for grown in (1, 2):
        model.train_once(np.tile(tokens, grown), np.append(bounds, [] if grown == 1 else 18000).astype(np.int64), 0.01, 192 * grown)
    blocks = len(attention.blocks_of(tokens, bounds)[0]) - 1
    assert len(seen[0]) == len(seen[1])
    for picks, grown in zip(seen, (1, 2)):
        assert sorted(np.concatenate(picks).tolist()) == list(range(1, grown * blocks + 1))


def test_trainers_get_the_larger_steps(spark, monkeypatch):
    """The batch that shards are trained with, where the text is large for its settings."""
    got = []
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 8)
    make = lm_scoring._trainer
    monkeypatch.setattr(lm_scoring, "_trainer", lambda shared, rate, steps, batch: got.append(batch) or make(shared, rate, steps, batch))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    rows = lm_scoring.score_texts(docs, F.col("doc_id") % 5 == 1, steps=3, frequent=10).collect()
    assert len(rows) == 40 and all(np.isfinite(r.score) for r in rows)
    assert set(got) == {lm_scoring.BATCH * lm_scoring.GROWN}
