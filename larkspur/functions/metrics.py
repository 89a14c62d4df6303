"""Metrics as aggregates over ``y`` (targets), ``p`` (postprocessed predictions) and an optional weight ``w``.

``frame`` gives a one-row DataFrame with the column ``value``; ``evaluate`` its number. Arrays have an element for
each output; for multiclass metrics ``y`` holds the class number and ``p`` a share for each class.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordered import running_sums

LEAST = 1e-5


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


class Metric:
    name = ""
    larger_is_better = False

    def error(self, y: Column, p: Column) -> Column:
        """The error of one value."""
        raise NotImplementedError

    def finish(self, mean: Column) -> Column:
        return mean

    def frame(self, df: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
        """The mean over rows and outputs; with weights, each row's mean over outputs weighted."""
        row = _mean(F.zip_with(y, p, self.error))
        mean = F.avg(row) if w is None else F.try_divide(F.sum(row * F.col(w)), F.sum(w))
        return df.agg(self.finish(mean).alias("value"))

    def evaluate(self, df: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> float:
        value = self.frame(df, y, p, w).first()[0]
        return float("nan") if value is None else float(value)

    def compare(self, one: float, other: float) -> bool:
        """Is one better than the other?"""
        return (operator.gt if self.larger_is_better else operator.lt)(one, other)

    def argmax(self, values: list[float]) -> int:
        """The place of the first best value."""
        best = 0
        for k, v in enumerate(values):
            if self.compare(v, values[best]):
                best = k
        return best


class RMSE(Metric):
    name = "rmse"

    def error(self, y, p):
        return (y - p) * (y - p)

    def finish(self, mean):
        return F.sqrt(mean)


class RMSLE(RMSE):
    name = "rmsle"

    def error(self, y, p):
        return F.pow(F.log1p(y) - F.log1p(p), 2)


class BCE(Metric):
    name = "bce"

    def error(self, y, p):
        return -F.ln(y * p + (1 - p) * (1 - y))


class R2(Metric):
    """One less error over variance, averaged over outputs; with weights, the centre stays the unweighted mean."""

    name, larger_is_better = "r2", True

    def frame(self, df, y="y", p="p", w=None):
        long = _long(df, y, p, w)
        centred = long.join(F.broadcast(long.groupBy("out").agg(F.avg("y").alias("centre"))), "out")
        sums = centred.groupBy("out").agg(
            F.sum(F.col("w") * F.pow(F.col("y") - F.col("p"), 2)).alias("e"), F.sum(F.col("w") * F.pow(F.col("y") - F.col("centre"), 2)).alias("v")
        )
        return sums.agg(F.avg(1 - F.try_divide("e", "v")).alias("value"))


def _long(df: DataFrame, y: str, p: str, w: str | None) -> DataFrame:
    weight = F.lit(1.0) if w is None else F.col(w)
    rows = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("out", "v"), weight.alias("w"))
    return rows.select("out", F.col("v.y").alias("y"), F.col("v.p").alias("p"), "w")


class AUC(Metric):
    """For one output: the share of (positive, negative) pairs in order, ties counting half; 0.5 at one score or none."""

    name, larger_is_better = "auc", True

    def scores(self, df, y="y", p="p", w=None):
        """``score, n1, n0``: the weight of positives and negatives at each distinct score."""
        return _scores(_long(df.withColumn(y, F.slice(y, 1, 1)), y, p, w)).drop("out")

    def frame(self, df, y="y", p="p", w=None):
        first = df.select(F.slice(y, 1, 1).alias("y"), F.slice(p, 1, 1).alias("p"), *([w] if w else []))
        return _areas(_scores(_long(first, "y", "p", w))).agg(F.when(F.count("*") == 0, 0.5).otherwise(F.max("value")).alias("value"))


def _scores(long: DataFrame) -> DataFrame:
    """``out, score, n1, n0``: the weight of positives and negatives at each distinct score of an output."""
    return long.groupBy("out", F.col("p").alias("score")).agg(F.sum(F.col("w") * F.col("y")).alias("n1"), F.sum(F.col("w") * (1 - F.col("y"))).alias("n0"))


def _areas(scores: DataFrame) -> DataFrame:
    """``out, value`` of all outputs at once: one sort, one running sum, one aggregate."""
    run = running_sums(scores, "score", {"c0": F.col("n0")}, segment="out")
    area = F.try_divide(F.sum((F.col("c0") - F.col("n0") / 2) * F.col("n1")), F.sum("n0") * F.sum("n1"))
    return run.groupBy("out").agg(F.when(F.count("*") <= 1, 0.5).otherwise(area).alias("value"))


class MaskedAUC(AUC):
    """The mean over outputs of the AUC on rows whose target is known; all outputs are ranked by the same jobs."""

    name = "masked_auc"

    def frame(self, df, y="y", p="p", w=None):
        outputs = df.agg(F.max(F.size(y)).alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("out"))
        known = _long(df, y, p, w).where(F.col("y").isNotNull() & ~F.isnan("y"))
        areas = _areas(_scores(known)).withColumn("seen", F.lit(True))
        each = F.when(F.col("seen").isNull(), 0.5).otherwise(F.col("value"))  # no known target counts like one score
        return outputs.join(F.broadcast(areas), "out", "left").agg(F.avg(each).alias("value"))


class Thresholded(Metric):
    """Labels are ``p >= threshold``, or ``p >=`` the quantile ``q`` of each output (the value at rank ceil(q(n-1)))."""

    larger_is_better = True

    def __init__(self, threshold: float = 0.5, q: float | None = None):
        self.threshold, self.q = threshold, q

    def labelled(self, df: DataFrame, y: str, p: str, w: str | None) -> DataFrame:
        long = _long(df, y, p, w)
        if self.q is None:
            return long.withColumn("label", (F.col("p") >= self.threshold).cast("double"))
        counts = long.groupBy("out", "p").agg(F.count("*").alias("m"))
        run = running_sums(counts, "p", {"upto": F.col("m")}, segment="out")
        ends = counts.groupBy("out").agg(F.sum("m").alias("all"))
        wanted = F.ceil(F.lit(self.q) * (F.col("all") - 1)) + 1
        limits = run.join(F.broadcast(ends), "out").where(F.col("upto") >= wanted).groupBy("out").agg(F.min("p").alias("limit"))
        # a row for each output
        return long.join(F.broadcast(limits), "out").withColumn("label", (F.col("p") >= F.col("limit")).cast("double")).drop("limit")

    def stats(self, df: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
        """``out, tp, tot, totp, same, total``: weighted sums for each output."""
        w_, y_, label = F.col("w"), F.col("y"), F.col("label")
        return self.labelled(df, y, p, w).groupBy("out").agg(
            F.sum(w_ * y_ * label).alias("tp"), F.sum(w_ * y_).alias("tot"), F.sum(w_ * label).alias("totp"),
            F.sum(F.when(y_ == label, w_).otherwise(0.0)).alias("same"), F.sum(w_).alias("total"),
        )

    def of(self) -> Column:
        raise NotImplementedError

    def frame(self, df, y="y", p="p", w=None):
        return self.stats(df, y, p, w).agg(F.avg(self.of()).alias("value"))


class Accuracy(Thresholded):
    name = "accuracy"

    def of(self):
        return F.try_divide("same", "total")


class Precision(Thresholded):
    name = "precision"

    def of(self):
        return F.col("tp") / F.greatest("totp", F.lit(LEAST))


class Recall(Thresholded):
    name = "recall"

    def of(self):
        return F.col("tp") / F.greatest("tot", F.lit(LEAST))


class F1(Thresholded):
    name = "f1"

    def of(self):
        precision, recall = Precision.of(self), Recall.of(self)
        return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


class CrossEntropy(Metric):
    name = "crossentropy"

    def frame(self, df, y="y", p="p", w=None):
        row = -F.ln(F.get(p, F.get(y, F.lit(0)).cast("int")))
        mean = F.avg(row) if w is None else F.try_divide(F.sum(row * F.col(w)), F.sum(w))
        return df.agg(mean.alias("value"))


class MultiClass(Metric):
    """The predicted class is the first with the largest share. ``average``: macro or micro."""

    larger_is_better = True

    def __init__(self, average: str = "macro"):
        self.average = average

    def stats(self, df: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
        """``class, tp, tot, totp`` for every class of ``p``, those without rows included."""
        weight = F.lit(1.0) if w is None else F.col(w)
        rows = df.select(F.get(y, F.lit(0)).cast("int").alias("t"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("g"), weight.alias("w"), F.size(p).alias("k"))
        sides = rows.select("w", F.explode(F.array(
            F.struct(F.col("t").alias("class"), (F.col("t") == F.col("g")).cast("double").alias("hit"), F.lit(1.0).alias("true"), F.lit(0.0).alias("said")),
            F.struct(F.col("g").alias("class"), F.lit(0.0).alias("hit"), F.lit(0.0).alias("true"), F.lit(1.0).alias("said")),
        )).alias("s"))
        sums = sides.groupBy("s.class").agg(F.sum(F.col("w") * F.col("s.hit")).alias("tp"), F.sum(F.col("w") * F.col("s.true")).alias("tot"), F.sum(F.col("w") * F.col("s.said")).alias("totp"))
        classes = rows.agg(F.max("k").alias("k")).select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("class"))
        return classes.join(sums, "class", "left").na.fill(0.0)

    def _ratio(self, below: str) -> Column:
        if self.average == "micro":
            return F.sum("tp") / F.greatest(F.sum(below), F.lit(LEAST))
        return F.avg(F.col("tp") / F.greatest(below, F.lit(LEAST)))

    def of(self) -> Column:
        raise NotImplementedError

    def frame(self, df, y="y", p="p", w=None):
        return self.stats(df, y, p, w).agg(self.of().alias("value"))


class MultiAccuracy(MultiClass):
    name = "accuracy"

    def of(self):
        return F.try_divide(F.sum("tp"), F.sum("tot"))


class MultiPrecision(MultiClass):
    name = "precision"

    def of(self):
        return self._ratio("totp")


class MultiRecall(MultiClass):
    name = "recall"

    def of(self):
        return self._ratio("tot")


class MultiF1(MultiClass):
    """The harmonic mean of the averaged precision and recall."""

    name = "f1"

    def of(self):
        p, r = self._ratio("totp"), self._ratio("tot")
        return F.try_divide(2 * p * r, p + r)


#: Names by which metrics are asked for (fixed values).
METRICS = {
    "rmse": RMSE, "l2": RMSE, "r2": R2, "r2_score": R2, "rmsle": RMSLE, "bce": BCE, "logloss": BCE, "auc": AUC, "roc": AUC,
    "accuracy": Accuracy, "acc": Accuracy, "precision": Precision, "recall": Recall, "f1": F1, "f1_score": F1, "masked_auc": MaskedAUC,
}
MULTICLASS_METRICS = METRICS | {
    "accuracy": MultiAccuracy, "acc": MultiAccuracy, "precision": MultiPrecision, "recall": MultiRecall,
    "f1": MultiF1, "f1_score": MultiF1, "crossentropy": CrossEntropy,
}


def metric_from_name(metric: str | Metric, multiclass: bool = False) -> Metric:
    if isinstance(metric, Metric):
        return metric
    known = MULTICLASS_METRICS if multiclass else METRICS
    if metric not in known:
        raise ValueError(f"unknown metric: {metric}")
    return known[metric]()
