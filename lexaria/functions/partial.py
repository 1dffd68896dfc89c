"""User functions over groups of any size: aggregates by partial states, and table functions over partitions.

An aggregate is three functions: the state of some values (a few numbers), the
merger of states, and what a state says.  Tasks keep one state for each group that they meet,
so a group sends a state a task and not its values.  A table function sees a partition's
rows in Arrow batches and keeps what it needs (here the best candidates), twice: first by group
and a salt, so that the distinct words of a group that a third of all rows have are dealt to many tasks, then by group.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose states a task holds at a time; beyond that they are sent on and begun anew.
HELD = 1 << 16
#: Parts into which a group is dealt.
SALTS = 64


@dataclass(frozen=True)
class Partial:
    """state: values to a few numbers; merge: rows of states to one; finish: a state to the result."""

    state: Callable[[np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float]


def _runs(keys: list[tuple]) -> dict[tuple, list[int]]:
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        places.setdefault(key, []).append(i)
    return places


def partial_aggregate(rows: DataFrame, by: list[str], value: str, how: Partial, name: str = "value") -> DataFrame:
    """The by columns and the aggregate of a column's values (nulls don't count; a group without values is null)."""
    types = dict(rows.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)

    def out(held: dict[tuple, np.ndarray | None], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], schema.field(c).type) for i, c in enumerate(by)]
        states = pa.array([None if s is None else s.tolist() for s in held.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*columns, states], [*by, "state"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray | None] = {}
        for batch in batches:
            values = batch[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
            known = ~np.asarray(batch[value].is_null())
            for key, places in _runs(list(zip(*(batch[c].to_pylist() for c in by), strict=True))).items():
                at = np.array(places)[known[places]]
                new = how.state(values[at]) if len(at) else None
                old = held.get(key)
                held[key] = new if old is None else old if new is None else how.merge(np.stack([old, new]))
            if len(held) > HELD:
                yield out(held, batch.schema)
                held = {}
        if held:
            yield out(held, batch.schema)

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        given = [np.array(s) for s in table["state"].to_pylist() if s is not None]
        said = how.finish(how.merge(np.stack(given))) if given else None
        return pa.table([*(pa.array([k.as_py()], table.schema.field(c).type) for k, c in zip(key, by, strict=True)), pa.array([said], pa.float64())], [*by, name])

    sent = rows.select(*by, value).mapInArrow(states, f"{keys}, state array<double>")
    return sent.groupBy(*by).applyInArrow(whole, f"{keys}, `{name}` double")  # a state a task, of a few numbers


def best_candidates(rows: DataFrame, word: str, by: str, generate: Callable[[str], list[tuple[str, float]]], most: int) -> DataFrame:
    """The by column, candidate, score: of all candidates of a group's words, each once with its best score, the best ones (ties by name)."""
    kind = dict(rows.dtypes)[by]
    schema = f"`{by}` {kind}, candidate string, score double"

    class Best:
        """Keeps the best candidates of one partition."""

        def __init__(self):
            self.group, self.scores, self.made = None, {}, {}

        def eval(self, table: pa.RecordBatch):
            self.group = self.group if self.group is not None else table[by]
            if word in table.schema.names:
                new = []
                for w in table[word].to_pylist():
                    if w is not None:
                        if w not in self.made:
                            self.made[w] = list(generate(w))
                        new += self.made[w]
                if len(self.made) > HELD:
                    self.made = {}
            else:
                new = zip(table["candidate"].to_pylist(), table["score"].to_pylist(), strict=True)
            for c, s in new:
                if s > self.scores.get(c, -np.inf):
                    self.scores[c] = s
            if len(self.scores) > 2 * most:
                self.scores = dict(self.best())
            return iter(())

        def best(self):
            return heapq.nsmallest(most, self.scores.items(), key=lambda x: (-x[1], x[0]))

        def terminate(self):
            if self.group is not None and len(self.group) and self.scores:
                found = self.best()
                yield pa.table({by: pa.concat_arrays([self.group[:1]] * len(found)), "candidate": pa.array([c for c, _ in found]), "score": pa.array([s for _, s in found], pa.float64())})

    table = F.arrow_udtf(Best, returnType=schema)
    dealt = rows.select(by, word).distinct().withColumn("__salt", F.pmod(F.xxhash64(word), F.lit(SALTS)))
    first = table(dealt.asTable().partitionBy(by, "__salt"))
    return table(first.asTable().partitionBy(by))
