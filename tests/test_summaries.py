"""Borders from mergeable summaries: ranks within the stated error, few values exactly, models that use them."""

import numpy as np
import pytest

from larkspur.operators.binning import QuantileBinner, binner_from_name
from larkspur.operators.summaries import SummaryBinner
from larkspur.plans.booster import GradientBoosting


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=20_000), rng.integers(0, 9, 20_000).astype(float), rng.exponential(size=20_000).round(1), np.full(20_000, np.nan)], axis=1)
    x[rng.random(20_000) < 0.1, 0] = np.nan
    x[:3, 2] = -np.inf
    return x


@pytest.fixture(scope="module")
def df(spark, values):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(values)], "id bigint, `a b` double, b double, c double, d double").repartition(5).persist()


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_ranks_lie_within_the_stated_error(df, values, accuracy):
    binner = SummaryBinner(max_bin=64, accuracy=accuracy).fit(df, ["a b", "b", "c", "d"], "id")
    known = np.sort(values[:, 0][~np.isnan(values[:, 0])])
    wanted = np.arange(1, 63) / 63 * len(known)
    low, high = np.searchsorted(known, binner.borders[0], "left"), np.searchsorted(known, binner.borders[0], "right")
    if accuracy == 1000:  # finer than the steps: a border for each
        assert len(binner.borders[0]) == 62
    for a, z in zip(low, high, strict=True):
        assert np.min(np.maximum(np.maximum(a - wanted, wanted - z), 0)) <= len(known) / accuracy + 1
    assert binner.borders[1].tolist() == [float(v) for v in range(8)] and not len(binner.borders[3])
    exact = QuantileBinner(max_bin=64).fit(df, ["c"], "id")
    assert binner.borders[2].tolist() == exact.borders[0].tolist()


def test_by_name_in_a_fit_and_of_empty_frames(df):
    rows = df.select("id", "b", "c", (df.b * 2).alias("y"))
    fitted = GradientBoosting("mse", ntrees=2, max_depth=2, lr=1.0, lambda_l2=0, quantization="Summary", es=0, verbose=0).fit(rows, ["b", "c"], "y", "id")
    error = np.mean([(r.y - r.prediction[0]) ** 2 for r in fitted.predict(rows).collect()])
    assert error < 2
    none = binner_from_name("Summary").fit(df.where("id < 0"), ["b"], "id")
    assert not len(none.borders[0])
    with pytest.raises(ValueError):
        SummaryBinner(accuracy=0)
