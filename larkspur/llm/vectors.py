"""Vectors of whole numbers for exact searches: preparation, statistics, blocks of queries, and the first of each group.

A component x becomes floor(256 * x). Inner products are exact: in doubles where the largest norm allows it, else in 64-bit
integers; vectors too long for these raise an error. A shorter vector counts as ending in zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import new_path, stored

SCALE = 256
#: Queries in a block, and bytes of query blocks that are broadcast at once; further blocks follow in further passes.
QUERIES, PASS_BYTES = 256, 64 << 20


def whole_numbers(vector: Column) -> Column:
    """The vector as whole numbers, null where it is null or has null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


@dataclass
class Shape:
    """What a set of vectors has in common: the sum of squares of each dimension, the largest component, the largest
    squared norm."""

    masses: np.ndarray
    top: float
    norm: float

    @cached_property
    def order(self) -> np.ndarray:
        """Dimensions by falling mass."""
        return np.argsort(-self.masses, kind="stable")

    @property
    def kind(self) -> str:
        """How components are stored."""
        return next(k for k in ("<i2", "<i4", "<i8") if self.top <= np.iinfo(k).max)

    @property
    def exact(self) -> type:
        """Numbers in which no sum of products is rounded."""
        return np.float64 if self.norm < 1 << 53 else np.int64

    @property
    def slack(self) -> float:
        """More than what rounding does to a bound of a score."""
        return 1 + 1e-9 * self.norm


def matrix(column: pa.Array, dims: int, kind: object = np.int64) -> np.ndarray:
    """A list column as a matrix, short rows filled up with zeros."""
    ends = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (ends == dims).all():
        return flat.reshape(len(ends), dims).astype(kind)
    out = np.zeros((len(ends), dims), kind)
    out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(n) for n in ends] or [ends])] = flat
    return out


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and which of them are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def measured(rows: DataFrame, vector: str = "v") -> Shape:
    """One pass over the vectors, of which each task sends a row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses, top, norm = np.zeros(0), 0.0, 0.0
        for batch in batches:
            dims = max(int(np.diff(batch.column(0).offsets.to_numpy()).max(initial=0)), len(masses))
            x = matrix(batch.column(0), dims, np.float64)
            masses = np.pad(masses, (0, dims - len(masses))) + (x * x).sum(axis=0)
            top, norm = max(top, float(np.abs(x).max(initial=0))), max(norm, float((x * x).sum(axis=1).max(initial=0)))
        n = len(masses)
        yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(masses), pa.array(np.full(n, top)), pa.array(np.full(n, norm))], ["dim", "mass", "top", "norm"])

    parts = rows.select(vector).mapInArrow(run, "dim int, mass double, top double, norm double")
    found = parts.groupBy("dim").agg(F.sum("mass").alias("mass"), F.max("top").alias("top"), F.max("norm").alias("norm")).collect()
    masses = np.zeros(len(found))
    for r in found:
        masses[r["dim"]] = r["mass"]
    shape = Shape(masses, max((r["top"] for r in found), default=0.0), max((r["norm"] for r in found), default=0.0))
    if shape.norm >= 2.0**63:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    return shape


def in_blocks(queries: DataFrame, columns: list[str], shape: Shape, per: int = QUERIES) -> tuple[DataFrame, int]:
    """A stored table with a row for each block of about ``per`` queries: ``block``, ``columns`` as arrays, ``vectors`` as
    bytes; and the number of blocks. A query's place in its block and the block's number name it."""
    count, dims, kind = max(1, -(-queries.count() // per)), len(shape.order), shape.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one block, which was dealt to this task
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = [pa.ListArray.from_arrays([0, whole.num_rows], whole.column(c)) for c in columns]
            vectors = matrix(whole.column("v"), dims)[:, shape.order].astype(kind).tobytes()
            yield pa.record_batch([whole.column("block")[:1], *lists, pa.array([vectors], pa.binary())], ["block", *columns, "vectors"])

    dealt = queries.repartition(count).select(F.spark_partition_id().alias("block"), *(F.col(c).cast("bigint").alias(c) for c in columns), "v")
    return stored(dealt.mapInArrow(run, ", ".join(["block int", *(f"{c} array<bigint>" for c in columns), "vectors binary"])), "blocks"), count


def in_passes(blocks: int, block_bytes: int, scan: Callable[[int, int], DataFrame]) -> DataFrame:
    """``scan(first, last)`` of all blocks: of so many at a time as a broadcast may hold. Several passes write to one
    table, one after the other."""
    per = max(1, PASS_BYTES // max(block_bytes, 1))
    if blocks <= per:
        return scan(0, blocks - 1)
    path = None
    for low in range(0, blocks, per):
        part = scan(low, min(low + per, blocks) - 1)
        path = path or new_path(part.sparkSession, "passes")
        part.write.mode("append").parquet(path)
    return part.sparkSession.read.schema(part.schema).parquet(path)


def first_of_groups(group: np.ndarray, score: np.ndarray, row: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Which entries are the ``k`` first of their groups, in order: by falling score, then by row, nulls last."""
    order = np.lexsort((row, null, -score, group))
    fresh = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order[place < k]
