"""Losses over array columns: ``y`` holds a row's targets, ``p`` its raw margins, one element for each output.

A subclass of ``Loss`` needs ``grad_hess``; gradients have one element for each output, hessians as many or one that
all outputs share. All methods build column expressions, so that a loss runs inside whole-stage code.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of probabilities: of a sigmoid, and of a softmax for training and by default.
SIGMOID_CLIP, SOFTMAX_TRAIN_CLIP, SOFTMAX_CLIP = 1e-7, 1e-6, 1e-5


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once for a row, however often ``then`` uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(p: Column, limit: float = SOFTMAX_CLIP) -> Column:
    """Shares of the exponentials, the largest margin taken off first; clipped and not normalised again. Linear in classes."""

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        return once(total, lambda t: F.transform(e, lambda v: clip(v / t, limit, 1 - limit)))

    return once(p, lambda q: once(once(F.array_max(q), lambda top: F.transform(q, lambda v: F.exp(v - top))), shares))


class Loss:
    name = ""
    metric = "rmse"
    multiclass = False

    def grad_hess(self, y: Column, p: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def preprocess(self, y: Column) -> Column:
        return y

    def postprocess(self, p: Column) -> Column:
        return p

    def transformed(self, y: Column) -> Column:
        """What the base score is the mean of, for one target value."""
        return y

    def from_mean(self, mean: float) -> float:
        return mean

    def base_score(self, df: DataFrame, y: str, outputs: int) -> list[float]:
        """The starting margin of each output; sample weights do not enter."""
        means = df.agg(*(F.avg(self.transformed(F.get(y, F.lit(k)))).alias(f"m{k}") for k in range(outputs))).first()
        return [self.from_mean(float(m) if m is not None else 0.0) for m in means]

    def outputs(self, df: DataFrame, y: str, targets: int) -> int:
        return targets


class MSELoss(Loss):
    name, metric = "mse", "rmse"

    def grad_hess(self, y, p):
        return F.zip_with(p, y, lambda a, b: a - b), F.array(F.lit(1.0))


class MSLELoss(Loss):
    name, metric = "msle", "rmsle"

    def preprocess(self, y):
        fine = F.forall(y, lambda v: v >= 0)
        return F.when(fine, y).otherwise(F.raise_error(F.lit("targets of this loss must not be negative")).cast("array<double>"))

    def grad_hess(self, y, p):
        return F.zip_with(p, y, lambda a, b: a - F.log1p(b)), F.array(F.lit(1.0))

    def postprocess(self, p):
        return F.transform(p, F.expm1)

    def transformed(self, y):
        return F.log1p(y)


class BCELoss(Loss):
    name, metric = "bce", "bce"

    def _share(self, v: Column) -> Column:
        return clip(sigmoid(v), SIGMOID_CLIP, 1 - SIGMOID_CLIP)

    def grad_hess(self, y, p):
        return F.zip_with(p, y, lambda a, b: self._share(a) - b), F.transform(p, lambda a: self._share(a) * (1 - self._share(a)))

    def postprocess(self, p):
        return F.transform(p, self._share)

    def from_mean(self, mean):
        mean = min(max(mean, SIGMOID_CLIP), 1 - SIGMOID_CLIP)
        return math.log(mean / (1 - mean))


class MaskedBCELoss(BCELoss):
    """Targets may be missing (null or NaN): these add nothing to gradients, hessians and base scores."""

    name = "masked_bce"

    def preprocess(self, y):
        return F.transform(y, lambda v: F.when(F.isnan(v), None).otherwise(v))

    def grad_hess(self, y, p):
        g = F.zip_with(p, y, lambda a, b: F.coalesce(self._share(a) - b, F.lit(0.0)))
        return g, F.zip_with(p, y, lambda a, b: F.when(b.isNull(), 0.0).otherwise(self._share(a) * (1 - self._share(a))))


class CrossEntropyLoss(Loss):
    name, metric, multiclass = "crossentropy", "crossentropy", True

    def __init__(self, classes: int | None = None):
        self.classes = classes

    def grad_hess(self, y, p):
        q, label, k = softmax(p, SOFTMAX_TRAIN_CLIP), F.get(y, F.lit(0)).cast("int"), F.size(p)
        g = once(label, lambda c: F.transform(q, lambda v, i: v - F.when(i == c, 1.0).otherwise(0.0)))
        return g, once(k, lambda n: F.transform(q, lambda v: v * (1 - v) * n / (n - 1)))

    def preprocess(self, y):
        return F.transform(F.slice(y, 1, 1), lambda v: v.cast("int").cast("double"))

    def postprocess(self, p):
        return softmax(p)

    def outputs(self, df, y, targets):
        return self.classes or int(df.agg(F.max(F.get(y, F.lit(0)))).first()[0]) + 1

    def base_score(self, df, y, outputs):
        return [0.0] * outputs


#: Names by which losses are asked for (fixed values).
LOSSES = {
    "mse": MSELoss, "regression": MSELoss, "l2": MSELoss, "multitask": MSELoss, "msle": MSLELoss,
    "binary": BCELoss, "bce": BCELoss, "multilabel": BCELoss, "logloss": BCELoss,
    "multiclass": CrossEntropyLoss, "crossentropy": CrossEntropyLoss, "masked_bce": MaskedBCELoss,
}


def loss_from_name(loss: str | Loss) -> Loss:
    if isinstance(loss, Loss):
        return loss
    if loss not in LOSSES:
        raise ValueError(f"unknown loss: {loss}")
    return LOSSES[loss]()
