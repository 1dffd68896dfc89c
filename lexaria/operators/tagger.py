"""A linear-chain conditional random field: trained on partial sums, decoded by marginals.

A sequence is an array of arrays of feature numbers, one inner array for each place, and
an array of label numbers.  Each evaluation is one Spark job: tasks run forward and
backward sums in log space over batches of sequences, add up the gradient of the
features that they met, and Spark adds the tasks' sums by feature.  Only weights and the
summed gradient (bins x labels) are on the driver, where L-BFGS takes its steps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.sources.shared import Rounds

#: Places of the sequences that are worked on at a time.
PLACES = 1 << 14


def hashed_words(text: Column, bins: int) -> Column:
    """Numbers of the distinct lower-cased words of a text; a bias is number 0."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    return F.concat(F.array(F.lit(0)), F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(bins - 1)) + 1).cast("int")))


def word_features(words: list[str], bins: int) -> list[list[int]]:
    """Numbers of what a tagger of words looks at: the word, its ending, shape and length, and both neighbours."""
    import zlib

    low = ["", *(w.lower() for w in words), ""]
    out = []
    for i, word in enumerate(words, 1):
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:4])
        names = [f"w={low[i]}", f"e={low[i][-3:]}", f"s={shape}", f"n={min(len(word), 12)}", f"-={low[i - 1]}", f"+={low[i + 1]}", f"-+={low[i - 1]}|{low[i]}", f"+-={low[i]}|{low[i + 1]}"]
        out.append([0, *(zlib.crc32(n.encode()) % (bins - 1) + 1 for n in names)])
    return out


@dataclass
class Weights:
    """Scores of labels by feature, of a label after another, and of the first and the last label."""

    features: np.ndarray
    follow: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, bins: int, labels: int) -> Weights:
        cut = np.split(flat, np.cumsum([bins * labels, labels * labels, labels]))
        return cls(cut[0].reshape(bins, labels), cut[1].reshape(labels, labels), cut[2], cut[3])


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exponentials."""
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Lattice:
    """Scores, forward and backward sums of a batch of sequences, padded to the longest."""

    def __init__(self, w: Weights, flat: np.ndarray, places: np.ndarray, lengths: np.ndarray):
        """flat: feature numbers of all places in a row; places: how many each place has; lengths: places of each sequence (1 or more)."""
        self.w, self.flat, self.lengths = w, flat, lengths
        self.of_place = np.repeat(np.arange(len(places)), places)
        self.row, self.column = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])
        own = np.zeros((len(places), w.first.size))
        np.add.at(own, self.of_place, w.features[flat])
        n, steps = len(lengths), int(lengths.max())
        self.score = np.zeros((n, steps, w.first.size))
        self.score[self.row, self.column] = own
        self.inside = np.arange(steps)[None, :] < lengths[:, None]
        self.forward = self._forward()
        self.total = _sum(self.forward[np.arange(n), lengths - 1] + w.last, 1)
        self.backward = self._backward()

    def _forward(self) -> np.ndarray:
        out = np.empty_like(self.score)
        out[:, 0] = self.score[:, 0] + self.w.first
        for t in range(1, out.shape[1]):
            out[:, t] = _sum(out[:, t - 1, :, None] + self.w.follow, 1) + self.score[:, t]
        return out

    def _backward(self) -> np.ndarray:
        out = np.empty_like(self.score)
        out[:, -1] = self.w.last
        for t in range(out.shape[1] - 2, -1, -1):
            on = _sum(self.w.follow + (self.score[:, t + 1] + out[:, t + 1])[:, None, :], 2)
            out[:, t] = np.where((t == self.lengths - 1)[:, None], self.w.last, on)
        return out

    def marginals(self) -> np.ndarray:
        """Probability of each label at each place, places in a row."""
        return np.exp(self.forward + self.backward - self.total[:, None, None])[self.row, self.column]

    def pairs(self) -> np.ndarray:
        """Expected number of times that a label follows another."""
        both = self.forward[:, :-1, :, None] + self.w.follow + (self.score[:, 1:] + self.backward[:, 1:])[:, :, None, :] - self.total[:, None, None, None]
        return np.where(self.inside[:, 1:, None, None], np.exp(np.minimum(both, 0)), 0).sum((0, 1))

    def gradient(self, labels: np.ndarray, into: Weights) -> float:
        """Adds the gradient of the negative log likelihood to weights of zeros; returns that likelihood."""
        k = self.w.first.size
        begin = np.cumsum(self.lengths) - self.lengths
        end = begin + self.lengths - 1
        p = self.marginals()
        into.first += p[begin].sum(0) - np.bincount(labels[begin], minlength=k)
        into.last += p[end].sum(0) - np.bincount(labels[end], minlength=k)
        into.follow += self.pairs()
        start = np.ones(len(labels), dtype=bool)
        start[begin] = False
        np.subtract.at(into.follow, (labels[:-1][start[1:]], labels[1:][start[1:]]), 1)
        score = self.score[self.row, self.column][np.arange(len(labels)), labels].sum() + self.w.first[labels[begin]].sum() + self.w.last[labels[end]].sum()
        score += self.w.follow[labels[:-1][start[1:]], labels[1:][start[1:]]].sum()
        p[np.arange(len(labels)), labels] -= 1
        np.add.at(into.features, self.flat, p[self.of_place])
        return float(self.total.sum() - score)


def _pieces(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows of a batch in runs of about PLACES places: (rows, feature numbers, features of each place, places of each sequence, columns by place)."""
    outer, inner = batch["features"], batch["features"].flatten()
    lengths = np.diff(outer.offsets.to_numpy())
    numbers, places = inner.flatten().to_numpy(), np.diff(inner.offsets.to_numpy())
    others = [batch[n].flatten().to_numpy(zero_copy_only=False) for n in names]
    place_at, number_at = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(places)])
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(place_at, place_at[at] + PLACES, "right")) - 1)
        a, b = place_at[at], place_at[to]
        yield slice(at, to), numbers[number_at[a] : number_at[b]], places[a:b], lengths[at:to], [o[a:b] for o in others]
        at = to


class Tagger:
    """Weights of a trained field, and the labels it gives."""

    def __init__(self, flat: np.ndarray, bins: int, labels: list[str], losses: list[float]):
        self.flat, self.bins, self.labels, self.losses = flat, bins, labels, losses

    def marginals(self, sequences: DataFrame, keep: list[str]) -> DataFrame:
        """The keep columns, and marginals: for each place the probabilities of the labels; a sequence without places has an empty array."""
        sent = sequences.sparkSession.sparkContext.broadcast(self.flat)
        bins, k = self.bins, len(self.labels)
        types = dict(sequences.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = Weights.of(sent.value, bins, k)
            for batch in batches:
                parts = [Lattice(w, f, p, n).marginals() for _, f, p, n, _ in _with_places(batch)] or [np.zeros((0, k))]
                values = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parts).ravel()), k).cast(pa.list_(pa.float64()))
                offsets = np.concatenate([[0], np.cumsum(np.diff(batch["features"].offsets.to_numpy()))])
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], [*keep, "marginals"])

        return sequences.select(*keep, "features").mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["marginals array<array<double>>"]))


def _with_places(batch: pa.RecordBatch, *names: str):
    """Pieces of the sequences that have places."""
    some = pa.array(np.diff(batch["features"].offsets.to_numpy()) > 0)
    kept = batch.filter(some)
    return _pieces(kept, *names) if kept.num_rows else iter(())


def _evaluate(sequences: DataFrame, flat: np.ndarray, bins: int, k: int) -> tuple[float, np.ndarray]:
    """Negative log likelihood of all sequences and its gradient."""
    sent = sequences.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sums = Weights.of(sent.value, bins, k), np.zeros(len(flat) + k)
        into, loss = Weights.of(sums[: len(flat)], bins, k), 0.0
        for batch in batches:
            for _, features, places, lengths, (labels,) in _with_places(batch, "labels"):
                loss += Lattice(w, features, places, lengths).gradient(labels, into)
        sums[len(flat)] = loss
        rows = sums.reshape(-1, k)
        met = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *(pa.array(rows[met, i]) for i in range(k))], ["row", *(f"g{i}" for i in range(k))])

    parts = sequences.select("features", "labels").mapInArrow(run, "row int, " + ", ".join(f"g{i} double" for i in range(k)))
    total = parts.groupBy("row").agg(*(F.sum(f"g{i}").alias(f"g{i}") for i in range(k))).toArrow()  # bins and labels bound it
    sums = np.zeros((len(flat) // k + 1, k))
    if total.num_rows:
        sums[total["row"].to_numpy()] = np.stack([total[f"g{i}"].to_numpy() for i in range(k)], axis=1)
    sent.destroy()
    return float(sums[-1, 0]), sums[:-1].ravel()


def minimise(function: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8, enough: float = 1e-5) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with steps halved until they lower the value enough; the values on the way."""
    value, g = function(x)
    values, past = [value], deque(maxlen=memory)
    for _ in range(steps):
        q, weights = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            weights.append(a)
            q -= a * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            q /= max(1.0, float(np.abs(g).sum()))
        for (s, y), a in zip(past, reversed(weights), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        rate, slope = 1.0, float(g @ q)
        while rate > 1e-6:
            new = x - rate * q
            then, h = function(new)
            if then <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        if (new - x) @ (h - g) > 1e-12:
            past.append((new - x, h - g))
        fell, x, value, g = value - then, new, then, h
        values.append(value)
        if fell < enough * max(1.0, abs(value)):
            break
    return x, values


def train(sequences: DataFrame, labels: list[str], bins: int, penalty: float = 1.0, steps: int = 20) -> Tagger:
    """A field fitted on sequences (features array<array<int>>, labels array<int>).

    The penalty is on the sum of squared weights.  Sequences are written once, so
    that evaluations don't work out their features again; ``bins`` bounds what is broadcast and
    collected (eight bytes a bin and label).
    """
    k = len(labels)
    table = Rounds(sequences.sparkSession, "tagger").written(sequences.select("features", "labels"))

    def function(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = _evaluate(table, w, bins, k)
        return loss + penalty * float(w @ w) / 2, gradient + penalty * w

    flat, losses = minimise(function, np.zeros((bins + k + 2) * k), steps)
    return Tagger(flat, bins, labels, losses)


def marked_spans(begin: list[float], inside: list[float], threshold: float, least: int = 2) -> list[tuple[int, int]]:
    """Phrases of at least so many places: those whose probability of either label reaches the threshold are marked, and where beginning is the likelier one a phrase begins."""
    marked = [b + i >= threshold for b, i in zip(begin, inside, strict=True)]
    starts = [k for k, m in enumerate(marked) if m and (k == 0 or not marked[k - 1] or begin[k] >= inside[k])]
    ends = [next((j for j in range(a + 1, b) if not marked[j]), b) for a, b in zip(starts, [*starts, len(marked)][1:], strict=True)]
    return [(a, b) for a, b in zip(starts, ends, strict=True) if b - a >= least]
