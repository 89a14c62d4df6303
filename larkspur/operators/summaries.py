"""Borders from mergeable quantile summaries of all rows, instead of exact ranks of a sample.

One aggregate keeps a summary of each feature (``percentile_approx``), which tasks merge: nothing is sorted and no
feature meets in one task. A border's rank is off by at most ``rows / accuracy``. Features with few distinct values are counted exactly,
as their counts are small.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.binning import BINNERS, LOWEST, QuantileBinner, missing_to_null, value_counts
from larkspur.operators.columns import named

#: Estimated distinct values up to which a feature's values are counted: as many times the borders.
COUNTED = 4


class SummaryBinner(QuantileBinner):
    """Borders at even ranks of all rows, each within ``1 / accuracy`` of its rank."""

    def __init__(self, sample: int | None = None, max_bin: int = 256, min_data_in_bin: int = 3, seed: int = 42, accuracy: int = 100_000):
        super().__init__(sample, max_bin, min_data_in_bin, seed)
        if accuracy < 1:
            raise ValueError("accuracy must be positive")
        self.accuracy = accuracy

    def summaries(self, df: DataFrame, features: list[str]) -> list[tuple[int, list[float]]]:
        """For each feature, the estimated number of distinct values and the values at even ranks."""
        shares = [k / self.most for k in range(1, self.most)]
        parts = []
        for c in features:
            known = missing_to_null(named(c))
            value = F.when(known.isNotNull(), F.greatest(known, F.lit(LOWEST)))
            parts += [F.approx_count_distinct(value), F.percentile_approx(value, shares, self.accuracy)]
        found = df.agg(*(p.alias(f"s{k}") for k, p in enumerate(parts))).first()
        return [(found[2 * k] or 0, list(found[2 * k + 1] or [])) for k in range(len(features))]

    def fit(self, df: DataFrame, features: list[str], row_id: str) -> SummaryBinner:
        """``row_id`` and the sample's size are not used: all rows count."""
        self.features = list(features)
        told = self.summaries(df, self.features)
        few = [k for k, (distinct, _) in enumerate(told) if distinct <= COUNTED * self.most]
        self.borders = [np.unique(np.array(values, dtype=np.float64)) for _, values in told]
        if few:
            exact: list[list[float]] = [[] for _ in few]
            for r in self.borders_frame(df, [self.features[k] for k in few]).collect():
                exact[r["feat"]].append(r["border"])
            for k, borders in zip(few, exact, strict=True):
                self.borders[k] = np.array(sorted(borders), dtype=np.float64)
        return self


BINNERS["Summary"] = SummaryBinner
