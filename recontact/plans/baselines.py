"""Untrained probability rules: constant prior, historical frequency and a smoothed time rule.

Rates are counted per (snapshot, bucket) first. A fold trains on a beginning of the days, so its rates are
a running sum looked up at its last training day: neither rows nor days are repeated per fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recontact.functions.metrics import best_threshold
from recontact.functions.timemath import sums_until
from recontact.operators.pointintime import KEY
from recontact.operators.splits import evaluated_times
from recontact.policy import DAY, HOUR

BASELINES = ("constant", "historical_frequency", "time_rule")


def recency_bucket(age: Column) -> Column:
    """0..3 for at most 1, 3, 7 days and longer (right-closed); -1 when unknown."""
    return (F.when(age.isNull(), -1).when(age <= DAY, 0).when(age <= 3 * DAY, 1).when(age <= 7 * DAY, 2).otherwise(3))


def rule_key(frame: DataFrame, recency: str) -> DataFrame:
    hour = F.floor((F.col("timestamp") % DAY) / HOUR).cast("int")
    return frame.withColumn("hour", hour).withColumn("recency_bucket", recency_bucket(F.col(recency)))


def _daily(cohort: DataFrame, keys: list[str]) -> DataFrame:
    return cohort.groupBy("timestamp", *keys).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))


def score_baselines(cohort: DataFrame, folds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Long predictions of the test and validation rows of every fold.

    ``cohort``: KEY, window_days, label, probability, recency. ``folds``: test_time, train_last, validation (``splits.ready_folds``).
    The result has test_time, role, KEY, label, window_days, model and p.
    """
    if alpha < 0:
        raise ValueError("the smoothing constant cannot be negative")
    keyed = rule_key(cohort, "recency")
    cell = ["window_days", "hour", "recency_bucket"]
    used = keyed.join(evaluated_times(folds), "timestamp")
    asked = used.select("test_time", "train_last", *cell).distinct()
    fold = ["test_time", "window_days"]
    prior = (sums_until(_daily(keyed, ["window_days"]), asked.select("train_last", *fold).distinct(), ["window_days"], ("pos", "n"), "train_last")
             .where("n > 0").select(*fold, (F.col("pos") / F.col("n")).alias("prior")))
    cells = (sums_until(_daily(keyed, cell), asked, cell, ("pos", "n"), "train_last")
             .where("n > 0").select("test_time", *cell, F.col("pos").alias("cell_pos"), F.col("n").alias("cell_n")))
    rated = used.join(prior, fold).join(cells, ["test_time", *cell], "left")
    prior_value = F.col("prior")
    frequency = F.coalesce(F.least(F.greatest(F.col("probability"), F.lit(0.0)), F.lit(1.0)), prior_value)
    rule = F.coalesce((F.col("cell_pos") + alpha * prior_value) / (F.col("cell_n") + alpha), prior_value)
    models = F.array(*[F.struct(F.lit(name).alias("model"), value.alias("p")) for name, value in (
        ("constant", prior_value), ("historical_frequency", frequency), ("time_rule", rule))])
    return rated.select("test_time", "role", *KEY, "label", "window_days", F.inline(models))


def with_thresholds(scored: DataFrame) -> DataFrame:
    """Test rows with the threshold chosen on the same fold's validation rows."""
    keys = ["test_time", "window_days", "model"]
    chosen = best_threshold(scored.where("role = 'validation'"), keys)
    return scored.where("role = 'test'").drop("role").join(chosen, keys)  # folds x windows x models rows
