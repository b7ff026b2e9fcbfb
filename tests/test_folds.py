"""All folds in one fit against single fits."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tidepanel.models import folds, scores, splits

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    weeks, names = 120, 12
    pdf = pd.DataFrame({"date": np.repeat([date(2020, 1, 3) + timedelta(weeks=w) for w in range(weeks)], names), "ticker": [f"T{i:02}" for i in range(names)] * weeks})
    x = rng.normal(size=(len(pdf), 2)) * [3, 0.1] + [10, -5]
    x[rng.random(len(pdf)) < 0.03, 0] = np.nan
    drift = np.repeat(np.linspace(-1, 2, weeks), names)
    pdf["a"], pdf["b"] = x[:, 0], x[:, 1]
    pdf["y"] = (rng.random(len(pdf)) < 1 / (1 + np.exp(-drift * (np.nan_to_num(x[:, 0], nan=10) - 10) / 3 - (x[:, 1] + 5) * 10 + 1))).astype(float)
    pdf.loc[rng.random(len(pdf)) < 0.05, "y"] = np.nan
    return spark.createDataFrame(pdf).replace(float("nan"), None).repartition(6)


def test_coefficients_equal_single_fits(spark, panel):
    spans = splits.folds_of(panel, min_train_weeks=40, test_weeks=13, step_weeks=26)
    model = folds.fit_fold_logits(panel, spans, COLS)
    assert model.fitted.all() and model.moved < 1e-10 and model.steps < 20
    got = model.score(panel).toPandas()
    for i, f in enumerate(spans):
        train = panel.where(panel["date"].between(f.train_start, f.train_end))
        single = scores.fit_logit(train, COLS)
        own = single.model.stages[-1]
        assert np.allclose(model.weights[i], own.coefficients.toArray(), atol=2e-5) and abs(model.constant[i] - own.intercept) < 2e-5
        want = single.score(panel.where(panel["date"].between(f.test_start, f.test_end))).toPandas()
        both = want.merge(got[got["fold"] == f.fold], on=["date", "ticker"])
        assert len(both) == len(want) and (both["score_x"].isna() == both["score_y"].isna()).all()
        assert np.nanmax(np.abs(both["score_x"] - both["score_y"])) < 1e-5


def test_one_job_a_step_whatever_the_folds(spark, panel):
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for step in (40, 5):
        spans = splits.folds_of(panel, min_train_weeks=40, test_weeks=13, step_weeks=step)
        spark.sparkContext.setJobGroup(f"folds-{step}", "")
        model = folds.fit_fold_logits(panel, spans, COLS)
        counts.append((len(spans), len(tracker.getJobIdsForGroup(f"folds-{step}")) - model.steps))
    spark.sparkContext.setJobGroup("", "")
    assert counts[1][0] > 4 * counts[0][0] and counts[0][1] == counts[1][1]


def test_folds_without_a_fit_and_broken_spans(spark, panel):
    spans = splits.folds_of(panel, min_train_weeks=40, test_weeks=13)
    ones = panel.withColumn("y", panel["y"] * 0 + 1)
    model = folds.fit_fold_logits(ones, spans, COLS)
    assert not model.fitted.any() and model.score(panel).count() == 0
    assert folds.fit_fold_logits(panel, [], COLS).folds == []
    with pytest.raises(ValueError, match="grow"):
        folds.fit_fold_logits(panel, [spans[1], spans[0]], COLS)
    constant = folds.fit_fold_logits(panel.withColumn("b", panel["b"] * 0), spans, COLS)
    assert np.allclose(constant.weights[:, 1], 0)
    assert folds.fit_fold_logits(panel, spans, COLS, steps=1).moved > 1e-3
