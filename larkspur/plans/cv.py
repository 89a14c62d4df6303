"""Cross-validation: folds, out-of-fold predictions, and the mean of the folds' models."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.binning import binner_from_name
from larkspur.operators.columns import free
from larkspur.operators.ordered import buckets_for, hash_text, ranked
from larkspur.plans.model import predict_all
from larkspur.sources.frames import inner_names, scan


def kfold(df: DataFrame, row_id: str, k: int, seed: object = 42) -> DataFrame:
    """``df`` with ``fold``: places in the order of the hash, modulo k."""
    return ranked(df, row_id, seed, "folds", "fold").withColumn("fold", ((F.col("fold") - 1) % k).cast("int"))


def stratified_kfold(df: DataFrame, row_id: str, label: str, k: int, seed: object = 42) -> DataFrame:
    """The same inside each class, whose rows are ranked in as many parts each as the table's rows need."""
    parts = buckets_for(df.count())
    held = df.withColumn("_hash", hash_text(seed, "folds", F.col(row_id)))
    held = held.withColumn("_part", (F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / (16**8 / parts)).cast("int"))
    sizes = held.groupBy(label, "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(label).alias("_label"), F.col("_part").alias("_p"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_hash", row_id)) - 1
    joined = held.withColumn("_place", place).join(offsets, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("fold", ((F.col("_place") + F.col("_before")) % k).cast("int")).select(*df.columns, "fold")


class CustomFolds:
    """Folds from a column; there are as many as its largest value says."""

    def __init__(self, column: str):
        self.column = column

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("fold", F.col(self.column).cast("int"))


def with_folds(df: DataFrame, row_id: str, cv: int | str | CustomFolds, stratify: str | None = None, seed: object = 42) -> DataFrame:
    if isinstance(cv, int):
        return stratified_kfold(df, row_id, stratify, cv, seed) if stratify else kfold(df, row_id, cv, seed)
    return (CustomFolds(cv) if isinstance(cv, str) else cv)(df)


def mean_of_arrays(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = F.zip_with(total, c, lambda a, b: a + b)
    return F.transform(total, lambda v: v / len(columns))


class CrossValidation:
    """Fits a copy of ``booster`` for each fold, the fold itself being its evaluation set. Borders are found once, on
    all rows."""

    def __init__(self, booster):
        self.booster = booster

    def _fits(self, df: DataFrame, features, target, row_id, weight, cv, stratify):
        inner = inner_names(features)
        folds = with_folds(df, row_id, cv, stratify, self.booster.seed).select(F.col(row_id).alias("id"), "fold")
        rows = scan(df, row_id, features, target, weight, inner).join(folds, "id").persist()
        options = {"sample": self.booster.quant_sample, "max_bin": self.booster.max_bin, "min_data_in_bin": self.booster.min_data_in_bin, "seed": self.booster.seed}
        binner = binner_from_name(self.booster.quantization, **options).fit(rows, inner, "id")
        self.folds = rows.agg(F.max("fold")).first()[0] + 1
        self.boosters = []
        for k in range(self.folds):
            booster = copy.copy(self.booster)
            booster.callbacks = copy.deepcopy(self.booster.callbacks)
            booster.fit_binned(rows.where(F.col("fold") != k).drop("fold"), [rows.where(F.col("fold") == k).drop("fold")], binner, features, weight is not None)
            self.boosters.append(booster)
        return rows, binner

    def fit_predict(self, df: DataFrame, features: list[str], target, row_id: str, weight: str | None = None, cv: int | str | CustomFolds = 5, stratify: str | None = None) -> DataFrame:
        """``id, fold, y, prediction``: every row predicted by the model that has not seen it."""
        rows, _ = self._fits(df, features, target, row_id, weight, cv, stratify)
        out = None
        for k, booster in enumerate(self.boosters):
            part = booster.model.on(inner_names(features)).predict(rows.where(F.col("fold") == k)).select("id", "fold", "y", "prediction")
            out = part if out is None else out.unionByName(part)
        rows.unpersist()  # what is returned reads the input once more
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """The mean of the folds' postprocessed predictions, all made in one pass."""
        models, held = [b.model for b in self.boosters], free(df, "_folds")
        scored = predict_all(models, df, held)
        each = [models[0].loss.postprocess(F.get(F.get(held, F.lit(0)), F.lit(k))) for k in range(len(models))]
        return scored.withColumn(name, mean_of_arrays(each)).drop(held)
