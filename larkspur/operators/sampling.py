"""Row and column samplers. All random choices come from hashes, so that runs agree whatever the partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordered import among_first, uniform


def exact_rows(df: DataFrame, row_id: str, k: int, seed: object = 42, turn: object = 0) -> DataFrame:
    """Exactly ``k`` rows without replacement; identifiers must be unique."""
    return df.where(among_first(df, row_id, k, seed, turn))


def _draws(seed: object, turn: object, n: int) -> np.ndarray:
    """n uniform numbers that depend on seed and turn alone."""
    return np.array([int(hashlib.md5(f"{seed}:{turn}:{k}".encode()).hexdigest()[:13], 16) / 16**13 for k in range(n)])


class RowSampler:
    """Every iteration, exactly ``max(1, int(n * rate))`` rows, marked in the column ``_in``; rate 1 takes all."""

    def __init__(self, rate: float = 1.0):
        self.rate = rate

    def mark(self, rows: DataFrame, row_id: str, n: int, seed: object, turn: int) -> DataFrame:
        if self.rate == 1:
            return rows.withColumn("_in", F.lit(True))
        return rows.withColumn("_in", among_first(rows, row_id, max(1, int(n * self.rate)), seed, f"rows{turn}", n))


def importance_of_rows(g: Column, h: Column, lam: Column | float, outputs: int, hessians: int) -> Column:
    """The regularised gradient norm by which rows are kept."""

    def squares(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)

    return F.sqrt(squares(g) + lam * squares(h) * (outputs / hessians))


class MVSSampler:
    """Rows kept with probability ``r / cut`` (at most 1), their gradients divided by it; ``cut`` is the one of an even
    grid from the least norm to ``grid_multiplier`` times it whose mean probability comes nearest ``sample``."""

    def __init__(self, sample: float = 0.1, lmbd: float | str = "auto", grid_search_steps: int = 100, grid_multiplier: float = 100):
        self.sample, self.lmbd, self.steps, self.multiplier = sample, lmbd, grid_search_steps, grid_multiplier

    def probabilities(self, rows: DataFrame, outputs: int, hessians: int) -> DataFrame:
        """``rows`` (with g, h) and ``prob``."""
        lam: float = 0.0
        if self.lmbd == "auto":
            sums = rows.agg(*(F.sum(F.get("g", F.lit(k))).alias(f"g{k}") for k in range(outputs)), *(F.sum(F.get("h", F.lit(k))).alias(f"h{k}") for k in range(hessians))).first()
            below = sum(sums[f"h{k}"] for k in range(hessians))
            lam = (sum(sums[f"g{k}"] for k in range(outputs)) / below) ** 2 if below else 0.0
        else:
            lam = float(self.lmbd)
        normed = rows.withColumn("_r", importance_of_rows(F.col("g"), F.col("h"), F.lit(lam), outputs, hessians))
        least = normed.agg(F.min("_r")).first()[0] or 0.0
        grid = [float(x) for x in np.linspace(least, least * self.multiplier, self.steps)]
        # one pass: the mean probability at every point of the grid
        means = normed.agg(*(F.avg(self._prob(x)).alias(f"m{k}") for k, x in enumerate(grid))).first()
        cut = grid[int(np.argmin([abs(m - self.sample) if m is not None else np.inf for m in means]))]
        return normed.withColumn("prob", self._prob(cut)).drop("_r")

    @staticmethod
    def _prob(cut: float) -> Column:
        return F.when(F.col("_r") >= cut, 1.0).otherwise(F.coalesce(F.try_divide(F.col("_r"), F.lit(cut)), F.lit(1.0)))

    def mark(self, rows: DataFrame, row_id: str, seed: object, turn: int, outputs: int, hessians: int) -> DataFrame:
        found = self.probabilities(rows, outputs, hessians)
        scaled = found.withColumn("g", F.transform("g", lambda v: v / F.col("prob")))
        return scaled.withColumn("_in", F.col("prob") >= uniform(seed, f"mvs{turn}", F.col(row_id))).drop("prob")


class ColumnSampler:
    """Every iteration, exactly ``max(1, int(n * rate))`` columns without replacement."""

    def __init__(self, rate: float = 1.0):
        self.rate = rate

    def choose(self, n: int, seed: object, turn: int, model) -> list[int]:
        if self.rate == 1:
            return list(range(n))
        return sorted(np.argsort(_draws(seed, f"columns{turn}", n), kind="stable")[: max(1, int(n * self.rate))].tolist())


class ColumnImportanceSampler:
    """Columns drawn with replacement in proportion to (or against) their importance; the last ``n_force`` always."""

    def __init__(self, rate: float = 0.5, smooth: float = 0.1, update_freq: int = 10, inverse: bool = False, n_force: int | None = None, imp_type: str = "split"):
        self.rate, self.smooth, self.update_freq, self.inverse = rate, smooth, update_freq, inverse
        self.n_force, self.imp_type, self.p = n_force, imp_type, None

    def shares(self, importance: np.ndarray) -> np.ndarray:
        p = importance + 1e-3
        if self.n_force:
            p = p[: -self.n_force]
        p = p / p.sum()
        if self.inverse and len(p) > 1:
            p = (1 - p) / (1 - p).sum()
        return self.smooth / len(p) + (1 - self.smooth) * p

    def choose(self, n: int, seed: object, turn: int, model) -> list[int]:
        if self.p is None or turn % self.update_freq == 0:
            self.p = self.shares(model.feature_importance(self.imp_type) if model.trees else np.zeros(n))
        free = len(self.p)
        drawn = np.searchsorted(np.cumsum(self.p), _draws(seed, f"columns{turn}", max(1, int(self.rate * free))), side="right")
        return sorted(set(np.minimum(drawn, free - 1).tolist()) | set(range(free, n)))
