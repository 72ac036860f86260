"""What is summed up over participant partitions: whole metrics, intervals, and fits that never see a held-out row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recontact.functions import metrics as m, uncertainty as u
from recontact.plans import rolling_models
from recontact.policy import DAY


def test_partitions_are_summed_up_with_the_intervals_that_exclude_zero(spark):
    # only AP and a mean Brier score of one model were given; contrasts and intervals were missing.
    metrics = spark.createDataFrame(
        [(s, "unseen_both", "x", 7, ap, 0.5 + ap / 4, 0.2 + ap / 10, ap / 2, ap / 5) for s, ap in (("s1", 0.2), ("s2", 0.6), ("s3", 0.4))],
        "salt string, population string, model string, window_days int, average_precision double, roc_auc double, brier_score double, ndcg_at_5 double, precision_at_5 double")
    contrasts = spark.createDataFrame(
        [("s2", "unseen_both", "x - y", -0.2, -0.3, -0.1), ("s1", "unseen_both", "x - y", 0.1, 0.01, 0.2), ("s3", "unseen_both", "x - y", 0.0, -0.1, 0.1),
         ("s4", "unseen_both", "x - y", 0.3, None, None)], "salt string, population string, contrast string, delta double, low double, high double")
    got = {r.model or r.contrast: r for r in u.partition_summary(metrics, contrasts).collect()}
    x, both = got["x"], got["x - y"]
    assert [x.ap_mean, x.ap_min, x.ap_max, x.roc_auc_max, x.brier_min, x.brier_mean, x.brier_max] == pytest.approx([0.4, 0.2, 0.6, 0.65, 0.22, 0.24, 0.26])
    assert [x.ndcg_at_5_mean, x.precision_at_5_min, x.partitions] == pytest.approx([0.2, 0.04, 3])
    assert both.pooled_delta_ap_by_salt == [0.1, -0.2, 0.0, 0.3]
    assert (both.intervals_excluding_zero, both.intervals, both.partitions) == (2, 3, 4)


@pytest.mark.parametrize("label, p, fault", [(None, 0.5, "label"), (2, 0.5, "label"), (1, float("nan"), "score"), (0, 1.2, "score"), (1, None, "score")])
def test_metrics_refuse_rows_that_are_no_prediction(spark, label, p, fault):
    # such rows counted as negatives or moved the ranks.
    rows = spark.createDataFrame([("g", 1, 0.7, 0.5), ("g", 0, 0.2, 0.5), ("g", label, p, 0.5)], "g string, label int, p double, threshold double")
    assert m.binary_metrics(rows.limit(2), ["g"]).first().average_precision == 1.0
    with pytest.raises(Exception, match=f"rows refused: a {fault}"):
        m.binary_metrics(rows, ["g"]).collect()


def test_held_out_rows_are_tested_and_nothing_else(spark, monkeypatch):
    draw, rows = np.random.default_rng(6), []
    for day in range(12):
        for pair in range(24):
            x = float(draw.normal())
            rows.append((day * DAY, pair, pair + 1, 7, int(x + draw.normal() > 0), x, pair % 3 == 0))
    samples = spark.createDataFrame(rows, "timestamp long, user_min long, user_max long, window_days int, label int, x double, out boolean")
    folds = spark.createDataFrame([(t * DAY, 0, (t - 5) * DAY, [(t - k) * DAY for k in (4, 3, 2)]) for t in (10, 11)],
                                  "test_time long, train_first long, train_last long, validation array<long>")
    trained, fit = [], rolling_models.fit_model

    def watched(name, train, *rest):
        trained.extend(r.user_min for r in train.select("user_min").collect())
        return fit(name, train, *rest)

    monkeypatch.setattr(rolling_models, "fit_model", watched)
    found, states = rolling_models.rolling_trained(samples, folds, ("logistic_regression",), (7,), 1, None, ("x",), held="out")
    assert [(r.status, r.train_rows, r.validation_rows, r.test_rows) for r in states.orderBy("test_time").collect()] == [
        ("evaluated", 16 * 6, 16 * 3, 8), ("evaluated", 16 * 7, 16 * 3, 8)]
    assert trained and all(u % 3 for u in trained)
    assert sorted((r.test_time // DAY, r.user_min) for r in found.collect()) == [(t, u) for t in (10, 11) for u in range(0, 24, 3)]
    # Neither thresholds nor scores follow the labels and features of held-out rows of other days.
    moved = samples.withColumn("label", F.when(F.col("out") & (F.col("timestamp") < 10 * DAY), 1 - F.col("label")).otherwise(F.col("label")))
    moved = moved.withColumn("x", F.when(F.col("out") & (F.col("timestamp") < 10 * DAY), 1000.0).otherwise(F.col("x")))
    again, _ = rolling_models.rolling_trained(moved, folds, ("logistic_regression",), (7,), 1, None, ("x",), held="out")
    values = lambda f: [(r.test_time, r.user_min, pytest.approx(r.p), pytest.approx(r.threshold)) for r in f.orderBy("test_time", "user_min").collect()]
    assert [(r.test_time, r.user_min, r.p, r.threshold) for r in again.orderBy("test_time", "user_min").collect()] == values(found)
