"""Several outputs: which of them share a tree, and sketches of their gradients for the search of its structure."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.columns import constants
from larkspur.operators.sampling import _draws, exact_rows

LEAST_HESSIAN = 0.01
#: Outputs up to which products of gradients are sums of expressions; beyond, of matrix products on Arrow batches.
SQL_OUTPUTS = 8


def single_groups(outputs: int, seed: object = 42, turn: int = 0) -> list[list[int]]:
    """One tree for all outputs."""
    return [list(range(outputs))]


def one_vs_all_groups(outputs: int, seed: object = 42, turn: int = 0) -> list[list[int]]:
    """A tree for each output."""
    return [[k] for k in range(outputs)]


class RandomGroups:
    """Every iteration the outputs are shuffled and cut into ``ngroups`` groups of like size."""

    def __init__(self, ngroups: int = 2):
        self.ngroups = ngroups

    def __call__(self, outputs: int, seed: object = 42, turn: int = 0) -> list[list[int]]:
        order = np.argsort(_draws(seed, f"groups{turn}", outputs), kind="stable")
        return [part.tolist() for part in np.array_split(order, min(self.ngroups, outputs))]


#: Names by which splitters of outputs are asked for (fixed values).
SPLITTERS = {"Single": lambda: single_groups, "OneVsAll": lambda: one_vs_all_groups, "RandomGroups": RandomGroups}


def mean_squares(rows: DataFrame, outputs: int) -> np.ndarray:
    """The mean square of each output's gradient, in one pass without exploding rows."""
    return np.array(rows.agg(*(F.avg(F.pow(F.get("g", F.lit(k)), 2)).alias(f"s{k}") for k in range(outputs))).first(), dtype=float)


def gram(rows: DataFrame, outputs: int) -> np.ndarray:
    """Products of the gradient columns, summed over rows."""
    if outputs > SQL_OUTPUTS:
        return _gram_by_batch(rows, outputs)
    pairs = [(a, b) for a in range(outputs) for b in range(a, outputs)]
    sums = rows.agg(*(F.sum(F.get("g", F.lit(a)) * F.get("g", F.lit(b))).alias(f"p{a}_{b}") for a, b in pairs)).first()
    out = np.zeros((outputs, outputs))
    for (a, b), v in zip(pairs, sums, strict=True):
        out[a, b] = out[b, a] = v
    return out


def _gram_by_batch(rows: DataFrame, outputs: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((outputs, outputs))
        for batch in batches:
            g = batch.column(0).flatten().to_numpy().reshape(-1, outputs)
            total += g.T @ g
        a, b = np.divmod(np.arange(outputs * outputs), outputs)
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total.ravel())], ["a", "b", "v"])

    parts = rows.select("g").mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    out = np.zeros((outputs, outputs))
    for r in parts.collect():  # as many as pairs of outputs
        out[r["a"], r["b"]] = r["v"]
    return out


def gram_times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """What ``gram`` would give, times ``basis`` (outputs, k), without the products of pairs of outputs: a task sums
    one block of the basis' shape, and the blocks are added up by output."""
    outputs, k = basis.shape
    sums = [f"b{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((outputs, k))
        for batch in batches:
            g = batch.column(0).flatten().to_numpy().reshape(-1, outputs)
            total += g.T @ (g @ basis)
        yield pa.record_batch([pa.array(np.arange(outputs, dtype=np.int32)), *map(pa.array, total.T.copy())], ["out", *sums])

    schema = ", ".join(["out int", *(f"{c} double" for c in sums)])
    made = np.zeros((outputs, k))
    for r in rows.select("g").mapInArrow(run, schema).groupBy("out").agg(*(F.sum(c).alias(c) for c in sums)).collect():
        made[r["out"]] = r[1:]
    return made


class Sketch:
    """``apply`` gives the rows with fewer gradient columns, the number of these and of hessian columns."""

    def apply(self, rows: DataFrame, outputs: int, hessians: int, context: dict) -> tuple[DataFrame, int, int]:
        return rows, outputs, hessians

    @staticmethod
    def _picked(rows: DataFrame, which: list[int], hessians: int, scale: list[float] | None = None) -> tuple[DataFrame, int, int]:
        scale = scale or [1.0] * len(which)
        rows = rows.withColumn("g", F.array(*(F.get("g", F.lit(int(k))) * s for k, s in zip(which, scale, strict=True))))
        if hessians > 1:
            rows = rows.withColumn("h", F.array(*(F.get("h", F.lit(int(k))) for k in which)))
        return rows, len(which), len(which) if hessians > 1 else 1

    @staticmethod
    def _projected(rows: DataFrame, matrix: np.ndarray, hessians: int) -> tuple[DataFrame, int, int]:
        def dot(column: str, weights: np.ndarray):
            weighted = F.zip_with(column, F.expr(constants(weights, "DOUBLE")), lambda a, b: a * b)
            return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)

        k = matrix.shape[1]
        new_h = F.array(*(F.greatest(dot("h", matrix[:, j]), F.lit(LEAST_HESSIAN)) for j in range(k))) if hessians > 1 else F.col("h")
        return rows.withColumns({"g": F.array(*(dot("g", matrix[:, j]) for j in range(k))), "h": new_h}), k, k if hessians > 1 else 1


class TopOutputsSketch(Sketch):
    def __init__(self, topk: int = 1):
        self.k = topk

    def apply(self, rows, outputs, hessians, context):
        best = np.argsort(mean_squares(rows, outputs), kind="stable")[-self.k :]
        return self._picked(rows, best.tolist(), hessians)


class SVDSketch(Sketch):
    """Gradients on the leading right singular vectors, from the sums of their products, over ``sample`` rows at most.

    ``algorithm``: "jacobi" and "full" decompose the sums exactly; "randomized" turns a random basis towards the
    leading vectors in ``n_iter`` rounds. With more than ``wide`` outputs a round of it is a pass over the rows, whose memory
    is linear in outputs (``gram_times``); with fewer, one pass sums the products of all pairs.
    """

    def __init__(self, sample: int | None = None, n_components: int = 5, n_iter: int = 5, algorithm: str = "jacobi", wide: int = 256):
        if algorithm not in ("jacobi", "full", "randomized"):
            raise ValueError(f"unknown algorithm: {algorithm}")
        if sample is not None and (sample < 1 or sample != int(sample)):
            raise ValueError("sample is a number of rows")
        self.sample, self.k, self.rounds, self.algorithm, self.wide = sample, n_components, n_iter, algorithm, wide

    def leading(self, times: Callable[[np.ndarray], np.ndarray], outputs: int, seed: object, turn: object) -> np.ndarray:
        """The leading vectors of a symmetric matrix that is known by its products with a basis alone."""
        basis = projection(outputs, min(outputs, self.k + 5), True, seed, f"svd{turn}")
        for _ in range(self.rounds + 1):
            basis = np.linalg.qr(times(basis))[0]
        return basis @ np.linalg.eigh(basis.T @ times(basis))[1][:, ::-1][:, : self.k]

    def vectors(self, rows: DataFrame, outputs: int, seed: object, turn: object) -> np.ndarray:
        if self.algorithm == "randomized" and outputs > self.wide:
            held = rows.select("g").persist()
            found = self.leading(lambda basis: gram_times(held, basis), outputs, seed, turn)
            held.unpersist()
            return found
        products = gram(rows, outputs)
        if self.algorithm == "randomized":
            return self.leading(lambda basis: products @ basis, outputs, seed, turn)
        return np.linalg.eigh(products)[1][:, ::-1][:, : self.k]

    def apply(self, rows, outputs, hessians, context):
        part = rows
        if self.sample is not None and self.sample < context["n"]:
            part = exact_rows(rows, context["row_id"], int(self.sample), context["seed"], f"svd{context['turn']}")
        vectors = self.vectors(part, outputs, context["seed"], context["turn"])
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
        return self._projected(rows, vectors, hessians)


class RandomSamplingSketch(Sketch):
    """Columns drawn in proportion to their mean squares, scaled so that sums keep their expectation."""

    def __init__(self, n: int = 1, smooth: float = 0.1, replace: bool = True):
        self.n, self.smooth, self.replace = n, smooth, replace

    def shares(self, squares: np.ndarray) -> np.ndarray:
        p = squares + 1e-3
        p = p / p.sum()
        return self.smooth / len(p) + (1 - self.smooth) * p

    def apply(self, rows, outputs, hessians, context):
        p = self.shares(mean_squares(rows, outputs))
        if self.replace:
            draws = _draws(context["seed"], f"sketch{context['turn']}", self.n)
            which = np.minimum(np.searchsorted(np.cumsum(p), draws, side="right"), outputs - 1)
        else:
            draws = _draws(context["seed"], f"sketch{context['turn']}", outputs)
            which = np.argsort(np.log(np.maximum(draws, 1e-300)) / p)[::-1][: self.n]
        return self._picked(rows, which.tolist(), hessians, [float(1 / np.sqrt(self.n * p[k])) for k in which])


def projection(outputs: int, n: int, norm: bool, seed: object, turn: object) -> np.ndarray:
    """A Gaussian matrix (or one of signs), divided by the square root of 1 / n."""
    u = _draws(seed, f"projection{turn}", 2 * outputs * n)
    if norm:
        first, second = u[: outputs * n], u[outputs * n :]
        cells = np.sqrt(-2 * np.log(1 - first)) * np.cos(2 * np.pi * second)
    else:
        cells = np.where(u[: outputs * n] < 0.5, -1.0, 1.0)
    return cells.reshape(outputs, n) / np.sqrt(1 / n)


class RandomProjectionSketch(Sketch):
    def __init__(self, n: int = 1, norm: bool = True):
        self.n, self.norm = n, norm

    def apply(self, rows, outputs, hessians, context):
        return self._projected(rows, projection(outputs, self.n, self.norm, context["seed"], context["turn"]), hessians)


def filter_weights(rows: DataFrame, outputs: int, hessians: int, lam: float, leaves: list) -> np.ndarray:
    """For each output, the sum over leaves of the last trees of squared gradient sums over hessian sums."""
    total = np.zeros(outputs)
    for leaf in leaves or [None]:
        key = F.lit(0) if leaf is None else leaf
        sums = rows.groupBy(key.alias("leaf")).agg(*(F.sum(F.get("g", F.lit(k))).alias(f"g{k}") for k in range(outputs)), *(F.sum(F.get("h", F.lit(k))).alias(f"h{k}") for k in range(hessians)))
        parts = [F.sum(F.pow(f"g{k}", 2) / (F.col(f"h{k if hessians > 1 else 0}") + lam)).alias(f"w{k}") for k in range(outputs)]
        total += np.array(sums.agg(*parts).first(), dtype=float)
    return total


class FilterSketch(Sketch):
    """Columns weighed by what the leaves of the last ``ntrees`` trees make of their present gradients."""

    def __init__(self, k: int = 1, sample: bool = True, smooth: float = 0.1, ntrees: int = 1):
        self.k, self.sample, self.smooth, self.ntrees = k, sample, smooth, ntrees

    def shares(self, weights: np.ndarray) -> np.ndarray:
        if self.smooth >= 1:
            return np.full(len(weights), 1 / len(weights))
        p = weights / weights.sum() if weights.sum() else np.full(len(weights), 1 / len(weights))
        return self.smooth / len(p) + (1 - self.smooth) * p

    def apply(self, rows, outputs, hessians, context):
        if self.smooth >= 1:
            p = np.full(outputs, 1 / outputs)
        else:
            leaves = context["leaves"][-self.ntrees :] if self.ntrees else []
            if leaves:
                p = self.shares(filter_weights(rows, outputs, hessians, context["lam"], [c for tree in leaves for c in tree]))
            else:
                squares = mean_squares(rows, outputs)
                below = np.array(rows.agg(*(F.avg(F.get("h", F.lit(k))).alias(f"h{k}") for k in range(hessians))).first(), dtype=float)
                p = self.shares(squares / below)
        if self.sample:
            draws = _draws(context["seed"], f"filter{context['turn']}", self.k)
            which = np.minimum(np.searchsorted(np.cumsum(p), draws, side="right"), outputs - 1)
        else:
            which = np.argsort(p, kind="stable")[-self.k :]
        return self._picked(rows, which.tolist(), hessians)
