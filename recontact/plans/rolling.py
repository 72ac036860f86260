"""Tables over rolling test predictions: pooled and daily metrics, contrasts, day descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recontact.functions.metrics import average_precision, binary_metrics, ranking_metrics, spearman
from recontact.functions.uncertainty import contrast_deltas
from recontact.policy import DAY, Policy

KEYS = ["model", "window_days"]


def daily_ap(predictions: DataFrame) -> DataFrame:
    return average_precision(predictions, [*KEYS, "timestamp"])


def rolling_summary(predictions: DataFrame, policy: Policy) -> DataFrame:
    """Pooled metrics, mean daily AP, AP over prevalence and ranking metrics per model."""
    pooled = binary_metrics(predictions, KEYS).select(
        *KEYS, "rows", "positive_rate", "average_precision", "roc_auc", "brier_score", "log_loss")
    daily = daily_ap(predictions).groupBy(*KEYS).agg(
        F.avg("average_precision").alias("mean_daily_ap"), F.count("*").alias("test_days"))
    ranks = ranking_metrics(predictions, KEYS, policy.ranking_k)
    return (pooled.join(daily, KEYS).join(ranks, KEYS)
            .withColumn("ap_over_prevalence", F.col("average_precision") / F.nullif(F.col("positive_rate"), F.lit(0.0))))


def per_day_metrics(predictions: DataFrame) -> DataFrame:
    """Thresholds differ per fold, so thresholded metrics exist per day only."""
    return binary_metrics(predictions, [*KEYS, "timestamp"])


def model_contrast(predictions: DataFrame, contrasts) -> DataFrame:
    """Pooled AP difference and the number of days on which it is positive."""
    pooled = contrast_deltas(average_precision(predictions, KEYS), contrasts, [])
    daily = contrast_deltas(daily_ap(predictions), contrasts, ["timestamp"])
    days = daily.groupBy("contrast").agg(F.count_if(F.col("delta") > 0).alias("days_positive"), F.count("*").alias("test_days"))
    return pooled.withColumnRenamed("delta", "pooled_delta_ap").join(days, "contrast")


def model_comparison(parts: dict[str, DataFrame], baselines: tuple[str, ...]) -> DataFrame:
    """Metrics of several experiments in one table; absent columns are null."""
    result = None
    for name, frame in parts.items():
        tagged = frame.withColumn("experiment", F.lit(name)).withColumn(
            "kind", F.when(F.col("model").isin(*baselines), "baseline").otherwise("main"))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


DESCRIPTORS = ("rows", "positive_rate", "mean_pair_contact_days", "mean_recency_hours", "mean_participant_activity",
               "mean_min_scan_coverage", "share_contact_days_1")


def day_table(predictions: DataFrame, cohort: DataFrame) -> DataFrame:
    """Descriptors of each test day beside the AP and AP lift of every model.

    ``cohort``: the scored rows of one window, each pair once a day. A day is predicted for all of its rows, so
    the rows of the days that have predictions are those described, and no pair is looked up.
    """
    days = F.broadcast(predictions.select("timestamp").distinct())  # as many rows as test days
    rows = cohort.join(days, "timestamp", "left_semi")
    days = rows.groupBy("timestamp").agg(
        F.count("*").alias("rows"), F.avg(F.col("label").cast("double")).alias("positive_rate"),
        F.avg("pair_contact_days").alias("mean_pair_contact_days"), (F.avg("recency") / 3600).alias("mean_recency_hours"),
        F.avg((F.col("participant_a_activity") + F.col("participant_b_activity")) / 2).alias("mean_participant_activity"),
        F.avg(F.least("scan_coverage_a", "scan_coverage_b")).alias("mean_min_scan_coverage"),
        F.avg((F.col("pair_contact_days") == 1).cast("double")).alias("share_contact_days_1"))
    scores = daily_ap(predictions).select(*KEYS, "timestamp", "average_precision")
    return days.join(scores, "timestamp").withColumn("lift", F.col("average_precision") / F.nullif(F.col("positive_rate"), F.lit(0.0))).withColumn(
        "study_day", (F.floor(F.col("timestamp") / DAY) + 1))


def day_correlations(table: DataFrame) -> DataFrame:
    """Spearman rho of each descriptor with AP and lift over days, per model."""
    targets = F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).alias("y")) for t, c in (("ap", "average_precision"), ("lift", "lift"))])
    facts = F.array(*[F.struct(F.lit(d).alias("descriptor"), F.col(d).cast("double").alias("x")) for d in DESCRIPTORS])
    tall = table.select(*KEYS, F.inline(targets), facts.alias("facts")).select(*KEYS, "target", "y", F.inline("facts"))
    return spearman(tall, [*KEYS, "target", "descriptor"], "x", "y")
