"""Ranks and running sums over a whole table without a single task that sees all of it.

Rows are placed by range partitioning, or by arithmetic where their keys are hashes; sums run inside each part, and the totals
of the parts before are added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.columns import free, map_batches, named

#: Rows that one task may sort, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 1 << 16


def buckets_for(rows: int) -> int:
    """Buckets of about ``BUCKET_ROWS`` rows."""
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def running_sums(df: DataFrame, key: str, sums: dict[str, Column], ties: Sequence[str] = (), segment: str | None = None, part_rows: int | None = None) -> DataFrame:
    """``df`` with inclusive running sums in the order of ``key`` (then ``ties``), one column for each of ``sums``; inside each
    value of ``segment``, if given.

    Small frames take one window. Larger ones are range-partitioned by segment and key, so that a large segment is
    spread, sorted and summed part by part, which costs a row the same however many parts there are; the parts' totals (a row
    for each part and segment in it) are then summed in their order and added.
    """
    rows, part_rows = df.count(), part_rows or BUCKET_ROWS
    if rows <= part_rows:
        order = Window.partitionBy(*([segment] if segment else [])).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(order) for name, value in sums.items()})
    part, names = free(df, "_part"), list(sums)
    order = [*([segment] if segment else []), key, *ties]
    made = {name: value.alias(name) for name, value in sums.items()}
    wide = df.select(*(named(c) for c in df.columns if c not in made), *made.values())
    at, whole = wide.columns.index(segment) if segment else None, len(wide.columns) - len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, last = TaskContext.get().partitionId(), [0] * len(names), None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)  # where a segment begins
            if at is not None:
                column = batch.column(at).dictionary_encode()
                codes, seen = column.indices.fill_null(-1).to_numpy(zero_copy_only=False), column.dictionary.to_pylist()
                fresh[1:] = codes[1:] != codes[:-1]
                first, end = (None if c < 0 else seen[c] for c in (codes[0], codes[-1]))
                fresh[0], last = last is not None and last[0] != first, (end,)
            starts = np.flatnonzero(fresh)
            columns = []
            for k in range(len(names)):
                values = batch.column(whole + k).fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(values) + before[k]
                if len(starts):  # less what ran up before the row's segment began
                    total = total - np.concatenate([[total.dtype.type(0)], total[starts] - values[starts]])[np.cumsum(fresh)]
                before[k] = total[-1]
                columns.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*batch.columns[:whole], *columns, pa.array(np.full(batch.num_rows, number, np.int32))], names=[*batch.schema.names, part])

    dealt = wide.repartitionByRange(max(1, min(MOST_BUCKETS, -(-rows // part_rows))), *order).sortWithinPartitions(*order)
    placed = map_batches(dealt, run, [*wide.schema.fields, T.StructField(part, T.IntegerType())]).persist()
    ends = placed.groupBy(part, *([segment] if segment else [])).agg(*(F.max_by(n, F.struct(*order)).alias(n) for n in names))
    earlier = Window.partitionBy(*([segment] if segment else [])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = {n: free(df, f"_before{k}") for k, n in enumerate(names)}
    other, own = free(df, "_other"), free(df, "_own")
    totals = ends.select(F.col(part).alias(other), *([F.col(segment).alias(own)] if segment else []), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(offset[n]) for n in names))
    same = (F.col(part) == F.col(other)) & (F.col(segment).eqNullSafe(F.col(own)) if segment else F.lit(True))
    # parts are MOST_BUCKETS at most, and segments few
    return placed.join(F.broadcast(totals), same).select(*(named(c) for c in df.columns if c not in made), *((F.col(n) + F.col(offset[n])).alias(n) for n in names))


def hash_text(seed: object, turn: object, key: Column) -> Column:
    """The hexadecimal hash by which random choices are made: the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:{turn}:"), key.cast("string")))


def uniform(seed: object, turn: object, key: Column) -> Column:
    """A number in [0, 1) from the first 13 digits of the hash."""
    return F.conv(F.substring(hash_text(seed, turn, key), 1, 13), 16, 10).cast("double") / float(16**13)


def _share(hashed: Column) -> Column:
    """The first 32 bits of a hexadecimal hash."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")


def ranked(df: DataFrame, row_id: str, seed: object = 42, turn: object = 0, name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in the order of the hash of its identifier. Hashes are spread evenly, so
    that a row's part follows by arithmetic."""
    parts = buckets_for(df.count())
    hashed, part, own, before, at = (free(df, c) for c in ("_hash", "_part", "_own", "_before", "_at"))
    held = df.withColumn(hashed, hash_text(seed, turn, F.col(row_id)))
    held = held.withColumn(part, F.floor(_share(F.col(hashed)) / F.lit(16**8 / parts)).cast("int"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(hashed, row_id))
    sizes = held.groupBy(F.col(part).alias(own)).agg(F.count("*").alias(before))
    earlier = Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, MOST_BUCKETS at most
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    placed = held.withColumn(at, place).join(F.broadcast(sizes), F.col(part) == F.col(own))
    return placed.select(*(named(c) for c in df.columns if c != name), (F.col(at) + F.col(before)).alias(name))


def among_first(df: DataFrame, row_id: str, k: int, seed: object = 42, turn: object = 0, rows: int | None = None) -> Column:
    """Is a row among the ``k`` rows with the smallest hashes? Identifiers must be unique.

    Two aggregates find the ``k``-th hash: one counts buckets of hashes, one sorts the bucket in which it lies. The
    rows themselves are not moved.
    """
    rows = df.count() if rows is None else rows
    if k >= rows:
        return F.lit(True)
    parts = max(1, min(MOST_BUCKETS, rows // 1024))
    hashed = hash_text(seed, turn, F.col(row_id))
    place = F.floor(_share(hashed) / F.lit(16**8 / parts)).cast("int")
    before, edge = 0, 0
    for r in sorted(df.groupBy(place.alias("place")).count().collect(), key=lambda r: r["place"]):
        edge = r["place"]
        if before + r["count"] >= k:
            break
        before += r["count"]
    inside = df.where(place == edge).select(hashed.alias("hash"), F.col(row_id).alias("id")).orderBy("hash", "id").limit(max(k - before, 0))
    last = inside.agg(F.max(F.struct("hash", "id")).alias("last")).first()["last"]
    if last is None:
        return F.lit(False)
    return (hashed < last["hash"]) | ((hashed == last["hash"]) & (F.col(row_id) <= F.lit(last["id"])))
