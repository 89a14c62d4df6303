"""Columns of any names: names that are free, references that are exact, batches whose columns go by place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` starts with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def named(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def constants(values, kind: str) -> str:
    """SQL of an array of constants, all of them in one string that is split once when the plan is optimised, so that
    neither the plan nor its text's parts grow with their number."""
    if not len(values):
        return f"CAST(array() AS ARRAY<{kind}>)"
    cells = ",".join(repr(float(v)) if kind == "DOUBLE" else str(int(v)) for v in values)
    return f"CAST(split('{cells}', ',') AS ARRAY<{kind}>)"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` that takes and gives columns by place, so that their names may have any characters."""

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f"_{k}" for k in range(batch.num_columns)])

    plain = df.toDF(*(f"_{k}" for k in range(len(df.columns))))
    schema = T.StructType([T.StructField(f"_{k}", f.dataType, f.nullable) for k, f in enumerate(fields)])
    return plain.mapInArrow(renamed, schema).toDF(*(f.name for f in fields))
