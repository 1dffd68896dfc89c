"""User functions by kind and name: what each kind takes and gives, and its form as a column or table function.

Kinds: system (text -> text), rewriter (text -> output, score, checks), stage (text ->
output, edits), veto (before, after -> turned down?), entailment (premise, hypothesis ->
probability or none), generator (word -> (candidate, score) rows), scorer (slot,
candidates -> a score each), aggregate (values of a group -> a number).  All but the
aggregate work on Arrow batches; a name that isn't registered is an error when the
query is built.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.functions.batches import arrow_type, rows_of
from lexaria.operators import stages

KINDS = ("system", "rewriter", "stage", "veto", "entailment", "generator", "scorer", "aggregate")
_HELD: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str, function: Callable) -> None:
    if kind not in _HELD:
        raise ValueError(f"no kind {kind!r}; there are {', '.join(KINDS)}")
    _HELD[kind][name] = function


def get(kind: str, name: str) -> Callable:
    if name not in _HELD[kind]:
        raise KeyError(f"no {kind} {name!r}; there are {sorted(_HELD[kind])}")
    return _HELD[kind][name]


def system(name: str, text: Column) -> Column:
    f = get("system", name)

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(batch, "string")(text)


def rewriter(name: str, text: Column) -> Column:
    """output, score, passed: where a check fails or nothing changes, the text stays."""
    f = get("rewriter", name)
    kind = arrow_type("struct<output:string,score:double,passed:boolean>")

    def one(t: str | None) -> dict | None:
        if t is None:
            return None
        said = f(t)
        passed = all(said.get("checks", {}).values())
        return {"output": said["output"] if passed else t, "score": said.get("score"), "passed": passed}

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], kind)

    return F.arrow_udf(batch, "struct<output:string,score:double,passed:boolean>")(text)


def stage(name: str, text: Column) -> Column:
    return stages.run(get("stage", name), text)


def _two(f: Callable, kind: pa.DataType) -> Callable:
    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return batch


def veto(name: str, before: Column, after: Column) -> Column:
    return F.arrow_udf(_two(get("veto", name), pa.bool_()), "boolean")(before, after)


def entailment(name: str, premise: Column, hypothesis: Column) -> Column:
    return F.arrow_udf(_two(get("entailment", name), pa.float64()), "double")(premise, hypothesis)


def generate(name: str, rows: DataFrame, word: str, keep: list[str]) -> DataFrame:
    """keep, candidate, score: a row for each candidate of a row's word."""
    f = get("generator", name)
    return rows_of(rows, lambda w: [] if w is None else list(f(w)), "candidate string, score double", keep, [word])


def scores(name: str, slot: Column, candidates: Column) -> Column:
    """A score for each candidate, all of a row at once."""
    f = get("scorer", name)

    def one(s: str | None, c: list | None) -> list | None:
        if s is None or c is None:
            return None
        out = list(map(float, f(s, c)))
        if len(out) != len(c):
            raise ValueError(f"{len(out)} scores for {len(c)} candidates")
        return out

    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return F.arrow_udf(batch, "array<double>")(slot, candidates)


def aggregate(name: str, value: Column) -> Column:
    """For bounded groups: a group's values meet in one task."""
    f = get("aggregate", name)

    def whole(values: pd.Series) -> float:
        return float(f(values.dropna().to_numpy()))

    return F.pandas_udf(whole, "double")(value)


def register_sql(spark: SparkSession, name: str) -> None:
    """A system under its name in SQL."""
    f = get("system", name)

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    spark.udf.register(name, F.arrow_udf(batch, "string"))


for _name, _stage in (
    ("identity", stages.identity), ("phrases", stages.phrases()), ("negation", stages.flatten_negation), ("clauses", stages.split_clauses),
    ("grammar", stages.mend_grammar)
):
    register("stage", _name, _stage)
    register("system", _name, lambda t, s=_stage: s(t)[0])
register("entailment", "overlap", stages.overlap_entailment)
register("veto", "window", stages.window_veto(stages.overlap_entailment, 0.5))
