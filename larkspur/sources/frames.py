"""Frames for training and scoring, made from tables, CSV files or thin air."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.binning import missing_to_null
from larkspur.operators.columns import named
from larkspur.operators.ordered import uniform


def inner_names(features: list[str]) -> list[str]:
    """Names by which scanned features never meet a column of the library's own, whatever they are called outside."""
    return [f"_f{k}" for k in range(len(features))]


def scan(df: DataFrame, row_id: str, features: list[str], target: str | list[str] | None = None, weight: str | None = None, names: list[str] | None = None) -> DataFrame:
    """``id``, the features as doubles (missing: null; called ``names``, or as they are), ``y`` (an array of doubles)
    and ``w``; nothing else is read."""
    missing = [c for c in [row_id, *features, *([target] if isinstance(target, str) else target or []), *([weight] if weight else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    columns = [named(row_id).alias("id"), *(missing_to_null(named(c)).alias(n) for c, n in zip(features, names or features, strict=True))]
    if target is not None:
        if isinstance(target, str) and dict(df.dtypes)[target].startswith("array"):
            y = F.transform(named(target), lambda v: v.cast("double"))
        else:
            y = F.array(*(named(c).cast("double") for c in ([target] if isinstance(target, str) else target)))
        columns += [y.alias("y"), (F.coalesce(named(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("w")]
    return df.select(*columns)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, **options)


def normal(seed: object, turn: object, key: Column) -> Column:
    """A standard normal number from two hashes of the key, the same whatever the partitioning."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed, f"{turn}:radius", key))) * F.cos(2 * math.pi * uniform(seed, f"{turn}:angle", key))


def make_regression(spark: SparkSession, rows: int | DataFrame, features: int, targets: int = 1, informative: int = 10, noise: float = 1.0, seed: int = 42) -> DataFrame:
    """``row_id, x0.., y0..``: normal features, targets that are linear in the first ``informative`` of them. ``rows``
    is their number, or a frame with the ``row_id`` to make them for."""
    row_id = F.col("row_id")
    keys = spark.range(rows).withColumnRenamed("id", "row_id") if isinstance(rows, int) else rows
    df = keys.select("row_id", *(normal(seed, f"x{k}", row_id).alias(f"x{k}") for k in range(features)))
    made = []
    for t in range(targets):
        total = F.lit(noise) * normal(seed, f"y{t}", row_id)
        for k in range(min(informative, features)):
            total = total + F.col(f"x{k}") * (((k * 37 + t * 101 + seed) % 97) + 1.0)
        made.append(total.alias(f"y{t}"))
    return df.select("*", *made)
