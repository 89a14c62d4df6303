"""Quantization of numeric features to small codes.

Borders of a feature ascend; a value's code is one more than the number of borders below it, and 0 if the value is
missing (null or NaN). So code c means that the value lies above border c - 1 and at most at border c. Borders are
found from counts of distinct values of all rows, which partial aggregation makes small before the shuffle. Only if a
``sample`` is asked for (boosters do), exactly ``sample`` rows are used where there are more, those with the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.columns import free, map_batches, named
from larkspur.operators.ordered import among_first, running_sums

#: The smallest finite double: minus infinity counts as this when borders are sought.
LOWEST = -1.7976931348623157e308
#: Borders of all features up to which codes are computed by SQL; beyond, by binary search on Arrow batches.
SQL_BORDERS = 64


def missing_to_null(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def sampled(df: DataFrame, row_id: str, sample: int | None, seed: object = 42) -> DataFrame:
    """Exactly ``sample`` rows, or all if it is None or there are no more; identifiers must be unique."""
    return df if sample is None else df.where(among_first(df, row_id, sample, seed, "bins"))


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """``feat, x, n``: the known values of each feature and how often they occur."""
    entries = F.array(*(F.struct(F.lit(k).alias("feat"), F.greatest(missing_to_null(named(c)), F.lit(LOWEST)).alias("x"), named(c).isNull().alias("gap")) for k, c in enumerate(features)))
    long = df.select(F.explode(entries).alias("e")).select("e.feat", "e.x", "e.gap")
    return long.where(~F.col("gap") & F.col("x").isNotNull()).groupBy("feat", "x").agg(F.count("*").alias("n"))


class Binner:
    """Base of the binners: ``fit`` finds borders, ``transform`` adds an array column of codes."""

    def __init__(self, sample: int | None = None, max_bin: int = 256, min_data_in_bin: int = 3, seed: int = 42):
        if not 1 < max_bin <= 256 or min_data_in_bin <= 0:
            raise ValueError("max_bin must lie between 2 and 256, min_data_in_bin above 0")
        self.sample, self.most, self.seed = sample, max_bin - 1, seed
        self.features: list[str] = []
        self.borders: list[np.ndarray] = []

    def chosen(self, counts: DataFrame, most: int) -> DataFrame:
        """``feat, border`` of the features with more distinct values than fit."""
        raise NotImplementedError

    def borders_frame(self, df: DataFrame, features: list[str]) -> DataFrame:
        """``feat, border``: few distinct values (the largest left out) are borders themselves."""
        return self._borders(value_counts(df, features))

    def _borders(self, counts: DataFrame) -> DataFrame:
        ends = counts.groupBy("feat").agg(F.count("*").alias("u"), F.max("x").alias("top"))
        known = counts.join(F.broadcast(ends), "feat")  # a row for each feature
        few = known.where((F.col("u") - 1 <= self.most - 1) & (F.col("x") < F.col("top"))).select("feat", F.col("x").alias("border"))
        return few.unionByName(self.chosen(known.where(F.col("u") - 1 > self.most - 1).select("feat", "x", "n"), self.most)).distinct()

    def fit(self, df: DataFrame, features: list[str], row_id: str) -> Binner:
        self.features = list(features)
        counts = value_counts(sampled(df.select(row_id, *map(named, features)), row_id, self.sample, self.seed), self.features).persist()
        rows = self._borders(counts).collect()
        counts.unpersist()
        found: list[list[float]] = [[] for _ in features]
        for r in rows:
            found[r["feat"]].append(r["border"])
        self.borders = [np.array(sorted(b), dtype=np.float64) for b in found]
        return self

    @property
    def max_bins(self) -> int:
        """Bins that the largest feature needs, the one for missing values included."""
        return max((len(b) for b in self.borders), default=0) + 2

    def get_borders(self) -> list[np.ndarray]:
        """Borders with the infinities at their ends."""
        return [np.concatenate([[-np.inf], b, [np.inf]]) for b in self.borders]

    def code(self, k: int) -> Column:
        x, borders = missing_to_null(named(self.features[k])), [float(b) for b in self.borders[k]]
        below = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b < x)) if borders else F.lit(0)
        return F.when(x.isNull(), 0).otherwise(below + 1).cast("smallint")

    def transform(self, df: DataFrame, name: str = "bins") -> DataFrame:
        if sum(map(len, self.borders)) <= SQL_BORDERS:
            return df.withColumn(name, F.array(*(self.code(k) for k in range(len(self.features)))))
        borders, features = self.borders, self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.empty((batch.num_rows, len(features)), np.int16)
                for k, c in enumerate(features):
                    x = batch.column(batch.num_columns - len(features) + k).to_numpy(zero_copy_only=False).astype(np.float64)
                    codes[:, k] = np.where(np.isnan(x), 0, np.searchsorted(borders[k], x, side="left") + 1)
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, len(features), dtype=np.int32), codes.ravel())
                keep = batch.num_columns - len(features)
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], lists], names=[*batch.schema.names[:keep], name])

        x = free(df, "_x")
        wide = df.select("*", *(missing_to_null(named(c)).alias(f"{x}{k}") for k, c in enumerate(features)))
        return map_batches(wide, run, [*df.schema.fields, T.StructField(name, T.ArrayType(T.ShortType()))])

    def fit_transform(self, df: DataFrame, features: list[str], row_id: str, name: str = "bins") -> DataFrame:
        return self.fit(df, features, row_id).transform(df, name)


def quantile_places(bins: int, n: int) -> list[int]:
    """The ranks (from 0) at which borders are read: whole parts of even steps over n."""
    return [int(v) for v in (np.linspace(0, 1, bins + 1) * n)[1:-1]]


def _quantiles(counts: DataFrame, bins: int) -> DataFrame:
    """A value is a border if one of the wanted ranks falls on its rows. The first rank from the value's first row on has
    a number that division gives, or one beside it where doubles round: only these three are looked at."""
    placed = running_sums(counts, "x", {"upto": F.col("n")}, segment="feat")
    ends = counts.groupBy("feat").agg(F.sum("n").alias("all"))
    first = (F.col("upto") - F.col("n")).cast("double") * bins / F.col("all")
    # linspace gives k * (1 / bins) in doubles; the same product is formed here
    numbers = F.transform(F.array(*(F.lit(d) for d in (-1.0, 0.0, 1.0))), lambda d: F.ceil(first) + d)
    hit = F.exists(numbers, lambda k: (k >= 1) & (k <= bins - 1) & F.floor(k * F.lit(1.0 / bins) * F.col("all")).between(F.col("upto") - F.col("n"), F.col("upto") - 1))
    return placed.join(F.broadcast(ends), "feat").where(hit).select("feat", F.col("x").alias("border"))


def _even(counts: DataFrame, bins: int) -> DataFrame:
    ends = counts.groupBy("feat").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    step = (F.col("high") - F.col("low")) / bins
    return ends.select("feat", F.explode(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: k * step + F.col("low"))).alias("border"))


class QuantileBinner(Binner):
    """Borders at even ranks of the values."""

    def chosen(self, counts, most):
        return _quantiles(counts, most)


class UniformBinner(Binner):
    """Borders at even steps between the smallest and the largest value."""

    def chosen(self, counts, most):
        return _even(counts, most)


class UniquantBinner(Binner):
    """Half of the bins at even steps, the rest at even ranks."""

    def chosen(self, counts, most):
        return _even(counts, most // 2).unionByName(_quantiles(counts, most - most // 2))


#: Names by which binners are asked for (fixed values).
BINNERS = {"Quantile": QuantileBinner, "Uniform": UniformBinner, "Uniquant": UniquantBinner}


def binner_from_name(kind, **options):
    """A binner by name, or the given object if it fits and transforms itself."""
    if isinstance(kind, str):
        if kind not in BINNERS:
            raise ValueError("Unknown quantizer")
        return BINNERS[kind](**options)
    return kind
