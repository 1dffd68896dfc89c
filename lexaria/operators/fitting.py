"""Weights on a simplex, fitted on sufficient statistics: rows are read once, whatever the number of steps.

The statistics are means, variances and covariances of the features and the target, k
squared numbers a group by one aggregate.  The fit is projected gradient descent from
several starts (the centre, the corners and the middles of all edges), on the negative
correlation or on the mean squared error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def onto_simplex(v: np.ndarray) -> np.ndarray:
    """The point of the simplex that is nearest to v."""
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0)


class Moments:
    """Loss and gradient of a weighting from means, covariances of features, covariances with the target, and its mean and variance."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, with_target: np.ndarray, target_mean: float, target_var: float, objective: str):
        if objective not in ("corr", "mse"):
            raise ValueError(f"no objective {objective!r}")
        self.mean, self.cov, self.c, self.m, self.v, self.objective = mean, cov, with_target, target_mean, target_var, objective

    def correlation(self, w: np.ndarray) -> float:
        spread = float(w @ self.cov @ w) * self.v
        return float(w @ self.c) / spread**0.5 if spread > 0 else 0.0

    def loss(self, w: np.ndarray) -> float:
        if self.objective == "corr":
            return -self.correlation(w)
        return float(w @ self.cov @ w - 2 * w @ self.c + self.v + (w @ self.mean - self.m) ** 2)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        if self.objective == "mse":
            return 2 * (self.cov @ w - self.c + (w @ self.mean - self.m) * self.mean)
        inside = float(w @ self.cov @ w)
        if inside * self.v <= 0:
            return np.zeros_like(w)
        return -(self.c - (w @ self.c) / inside * (self.cov @ w)) / (inside * self.v) ** 0.5

    def descend(self, w: np.ndarray, steps: int = 2000, enough: float = 1e-12) -> np.ndarray:
        """Projected steps; each is halved until the loss falls, and the next one is tried twice as long."""
        rate = 1.0
        for _ in range(steps):
            g, now = self.gradient(w), self.loss(w)
            while rate > 1e-14:
                new = onto_simplex(w - rate * g)
                if self.loss(new) < now:
                    break
                rate /= 2
            else:
                break
            moved, w, rate = np.abs(new - w).max(), new, rate * 2
            if moved < enough:
                break
        return w


def starts(k: int) -> list[np.ndarray]:
    corners = list(np.eye(k))
    return [np.full(k, 1 / k), *corners, *((a + b) / 2 for a, b in combinations(corners, 2))]


def best_weights(moments: Moments) -> np.ndarray:
    """The weights of least loss that any start leads to; of equal ones the first start's."""
    return min((moments.descend(w) for w in starts(len(moments.c))), key=lambda w: round(moments.loss(w), 12))


def simplex_fit(rows: DataFrame, features: list[str], target: str, by: list[str], objective: str = "corr") -> DataFrame:
    """The by columns, n, weights (an array in the features' order), r: weights of 0 or more with sum 1 for each group.

    Rows with a null feature or target don't count; where the target or all features
    are constant, r is 0 and the weights are those of the first start.
    """
    k = len(features)
    x = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    whole = rows.dropna(subset=[*features, target])
    stats = [F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.array(*(F.avg(a) for a in x)).alias("mean")]
    stats.append(F.array(*(F.covar_pop(x[min(i, j)], x[max(i, j)]) for i in range(k) for j in range(k))).alias("cov"))
    stats.append(F.array(*(F.covar_pop(a, y) for a in x)).alias("c"))
    moments = whole.groupBy(*by).agg(*stats)
    types = dict(moments.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, r = [], []
            for row in batch.select(["m", "v", "mean", "cov", "c"]).to_pylist():
                one = Moments(np.array(row["mean"]), np.array(row["cov"]).reshape(k, k), np.array(row["c"]), row["m"], row["v"], objective)
                w = best_weights(one)
                weights.append(w.tolist())
                r.append(one.correlation(w))
            kept = [batch[c] for c in [*by, "n"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weights, pa.list_(pa.float64())), pa.array(r, pa.float64())], [*by, "n", "weights", "r"])

    return moments.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in [*by, "n"]] + ["weights array<double>", "r double"]))
