"""Plain functions on values, applied to whole Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType, _parse_datatype_string


#: Bytes of a table for each part into which it is dealt, as Spark estimates them.
PART_BYTES = 1 << 20
#: Rows, about, of a part that a model's fit holds and goes through in one task.
FIT_ROWS = 1 << 18
#: Rows of a batch that are Python objects at a time.
SLICE = 256


def dealt(df: DataFrame) -> DataFrame:
    """A table dealt evenly to all cores, in parts that grow in number and not in size: a file's row group is one task, whatever the cores, and its rows may be a whole table's. What is shuffled is the table once, little beside the work on its texts."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if re.search(r"\bRepartition \d+, true", said := plan.toString()) and not re.search(r"\b(Join|Aggregate|Window)\b", said):
        return df  # it is dealt already
    size = int(str(plan.stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // PART_BYTES), 4096)))


def dealt_for_fit(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A table of about so many rows, by key in parts that grow in number and not in size, each in order: a fit keeps its rows and reads a part whole again in every step. Parts and order don't hang on files or cores, and neither does what a fit samples by part."""
    return df.repartition(max(1, -(-rows // FIT_ROWS)), key).sortWithinPartitions(key)


def slices(batch: pa.RecordBatch | pa.Array) -> Iterator:
    """A batch in slices of few rows."""
    return (batch.slice(at, SLICE) for at in range(0, len(batch), SLICE))


def arrow_type(ddl: str) -> pa.DataType:
    return to_arrow_type(_parse_datatype_string(ddl))


def column_of(function: Callable, ddl: str) -> Callable[..., Column]:
    """A column function of a plain one: a batch at a time, null where any argument is null."""
    kind = arrow_type(ddl)

    def batch(*columns: pa.Array) -> pa.Array:
        parts = (zip(*(c.to_pylist() for c in part), strict=True) for part in zip(*map(slices, columns), strict=True))
        made = [pa.array([None if any(v is None for v in row) else function(*row) for row in rows], kind) for rows in parts]
        return pa.concat_arrays(made) if made else pa.array([], kind)

    named = [
        lambda a: batch(a),
        lambda a, b: batch(a, b),
        lambda a, b, c: batch(a, b, c),
    ]

    def apply(*columns) -> Column:
        return F.arrow_udf(named[len(columns) - 1], ddl)(*columns)

    return apply


def rows_of(df: DataFrame, function: Callable[..., list[tuple] | tuple], ddl: str, keep: list[str], arguments: list[str]) -> DataFrame:
    """df's keep columns next to the rows (or the one row) that the function makes of the arguments, in one pass."""
    schema = _parse_datatype_string(ddl)
    assert isinstance(schema, StructType)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    names = keep + [f.name for f in schema.fields]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            values = zip(*(batch.column(len(keep) + i).to_pylist() for i in range(len(arguments))), strict=True)
            made, of = [], []
            for i, row in enumerate(values):
                out = function(*row)
                for one in out if isinstance(out, list) else [out]:
                    made.append(one)
                    of.append(i)
            place = pa.array(of, pa.int64())
            columns = list(zip(*made, strict=True)) if made else [[]] * len(kinds)
            yield pa.record_batch(
                [*(batch.column(i).take(place) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
            )

    rows = dealt(df.select(*keep, *(F.col(a).alias(f"__argument{i}") for i, a in enumerate(arguments))))
    out = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields])
    return rows.mapInArrow(run, out)


__all__ = ["DataType", "arrow_type", "column_of", "rows_of"]
