"""Past-only prediction, then reveal: availability, deadlines, populations and scoped metrics.

The prediction side reads only rows before ``t``; outcomes are joined afterwards, so adding later
rows cannot change a score. Write the predictions out before revealing in a production run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recontact.functions.metrics import binary_metrics, exact_quantiles
from recontact.operators import pointintime as pit, splits
from recontact.operators.pointintime import KEY
from recontact.plans.study import Study
from recontact.policy import DAY
from recontact.session import staged



def contract(study: Study) -> DataFrame:
    """One row: label ends of training and validation and the information deadline."""
    plan = splits.split_plan(splits.time_counts(study.cohort), study.policy.fractions)
    last = lambda name: F.max(F.when(F.col("split") == name, F.col("timestamp") + DAY))
    ends = plan.agg(last("train").alias("training_labels_end"), last("validation").alias("validation_labels_end"))
    return ends.withColumn("information_deadline", F.greatest("training_labels_end", "validation_labels_end"))


def deadline_gate(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """Only snapshots after every label the model has used."""
    deadline = manifest.first().information_deadline
    return keys.where(F.col("timestamp") > F.lit(deadline).cast("long"))


def availability(bank: DataFrame) -> DataFrame:
    """A pair may be scored when both ends were scanned in every window."""
    least = F.min(F.least("scan_coverage_a", "scan_coverage_b"))
    gaps = F.count_if(F.col("scan_coverage_a").isNull() | F.col("scan_coverage_b").isNull())
    ok = F.coalesce((least > 0) & (gaps == 0), F.lit(False))
    one_day = lambda c: F.max(F.when(F.col("window_days") == 1, c))
    side_min = F.when(F.col("scan_coverage_a").isNotNull() & F.col("scan_coverage_b").isNotNull(), F.least("scan_coverage_a", "scan_coverage_b"))
    return bank.groupBy(*KEY).agg(
        ok.alias("prediction_available"), one_day(F.col("pair_contact_bins")).alias("past_contact_bins_1d"),
        one_day(F.col("pair_contact_count")).alias("past_contact_count_1d"), one_day(side_min).alias("past_scan_min_1d"),
        one_day(F.col("recency_seconds")).alias("past_recency_seconds_1d")).withColumn(
        "inference_reason", F.when(F.col("prediction_available"), "valid_pre_t_inputs").otherwise("missing_historical_scan_evidence"))


def audited_rows(study: Study, rows: DataFrame) -> DataFrame:
    """Rows of snapshots with a full history, after the deadline."""
    first, last = study.span.history_from(max(study.policy.windows)), study.span.last_snapshot
    whole = rows.where(F.col("timestamp").between(first * DAY + study.policy.offset, last * DAY + study.policy.offset))
    return deadline_gate(whole, contract(study))


def audited_keys(study: Study) -> DataFrame:
    """1-day candidates with a full history, at snapshots after the deadline, as (day, pair)."""
    gated = audited_rows(study, study.timed(study.recent_keys))
    return gated.select(((F.col("timestamp") - study.policy.offset) / DAY).cast("long").alias("day"), "user_min", "user_max")


def audit_bank(study: Study) -> DataFrame:
    """The past-only inputs, written before any outcome is read."""
    if not hasattr(study, "_audit_bank"):
        study._audit_bank = staged(study.bounded(audited_keys(study), neighbours=False), "audit-bank")
    return study._audit_bank


def audit_samples(study: Study) -> DataFrame:
    """Availability, revealed outcome and membership of the older cohort per audited key."""
    if hasattr(study, "_audit_samples"):
        return study._audit_samples
    bank = audit_bank(study)
    keys = bank.where("window_days = 1").select(((F.col("timestamp") - study.policy.offset) / DAY).cast("long").alias("day"), "user_min", "user_max")
    outcome = pit.reveal_outcomes(keys, study.contacts, study.seen, study.span)
    old = study.cohort.select(*KEY, F.lit(True).alias("in_old"))
    joined = availability(bank).join(outcome, KEY).join(old, KEY, "left")
    study._audit_samples = staged(joined.withColumn("in_old", F.coalesce("in_old", F.lit(False))), "audit-samples")
    return study._audit_samples


def audit_predictions(study: Study, threshold: float = 0.5) -> DataFrame:
    """Frequency scores per window for the available samples (null probability -> training prior)."""
    plan = splits.split_plan(splits.time_counts(study.cohort), study.policy.fractions).where("split = 'train'")
    prior = plan.agg((F.sum("positive") / F.sum(F.col("positive") + F.col("negative"))).alias("p")).scalar()
    scores = audit_bank(study).select(*KEY, "window_days", F.coalesce("historical_contact_probability", prior).alias("p"))
    return (audit_samples(study).where("prediction_available").join(scores, KEY)
            .withColumn("threshold", F.lit(threshold)).withColumn("label", F.col("label_24h").cast("int")))


def _population(rows: DataFrame, keys: list[str]) -> DataFrame:
    known, label = F.col("reliable_label"), F.col("label_24h")
    n = F.count("*")
    return rows.groupBy(*keys).agg(
        n.alias("rows"), F.count_if(label == 1).alias("positive"), F.count_if(label == 0).alias("negative"), F.count_if(~known).alias("unknown"),
        (F.count_if(~known) / n).alias("unknown_rate"), (F.count_if(known) / n).alias("known_label_rate"),
        F.avg(F.when(known, label.cast("double"))).alias("positive_rate_reliable_only"),
        (F.count_if(label == 1) / n).alias("observed_positive_fraction_all"),
        F.avg("past_contact_bins_1d").alias("past_contact_bins_mean"), F.avg("past_scan_min_1d").alias("past_scan_mean"))


def _populations() -> Column:
    return F.explode(F.array_compact(F.array(F.lit("all_asof"), F.when(F.col("in_old"), "old_cohort"), F.when(~F.col("in_old"), "added_asof"))))


def population_bias(samples: DataFrame) -> DataFrame:
    """Who has a known label: all candidates, the older cohort and the added ones."""
    rows = samples.withColumn("population", _populations())
    median = exact_quantiles(rows, ["population"], "past_contact_bins_1d", {"past_contact_bins_median": 0.5})
    return _population(rows, ["population"]).join(median, "population", "left")


def daily_funnel(samples: DataFrame) -> DataFrame:
    counts = samples.groupBy("timestamp").agg(
        F.count_if("prediction_available").alias("prediction_available"), F.count_if("strict_future_covered").alias("strict_future_covered"),
        F.count_if("in_old").alias("old_rows"), F.count_if(~F.col("in_old")).alias("added_rows"))
    return _population(samples, ["timestamp"]).join(counts, "timestamp")


def scoped(predictions: DataFrame) -> DataFrame:
    """One row per (prediction, scope) for the four overlapping evaluation scopes with a label."""
    known, old = F.col("reliable_label"), F.col("in_old")
    scopes = F.array_compact(F.array(
        F.when(known, "reliable_predicted"), F.when(F.col("strict_future_covered"), "strict_covered_predicted"),
        F.when(old, "old_overlap"), F.when(known & ~old, "added_reliable_predicted")))
    return predictions.withColumn("scope", F.explode(scopes)).where("label IS NOT NULL")


def scoped_metrics(predictions: DataFrame) -> DataFrame:
    rows = scoped(predictions)
    keys = ["scope", "window_days"]
    days = rows.select(*keys, "timestamp").distinct().groupBy(*keys).agg(F.count("*").alias("distinct_prediction_days"))
    metrics = binary_metrics(rows, keys).join(days, keys)
    one_class = (F.col("positive_rate") == 0) | (F.col("positive_rate") == 1)
    return metrics.withColumns({
        "ap_over_prevalence": F.col("average_precision") / F.nullif(F.col("positive_rate"), F.lit(0.0)),
        "status": F.when(one_class, "single_class_descriptive_only").otherwise("both_classes")})


def probability_quantiles(predictions: DataFrame) -> DataFrame:
    """Mean and five quantiles of p over all, reliable and unknown-label predictions."""
    known = F.col("reliable_label")
    rows = predictions.withColumn("population", F.explode(F.array_compact(F.array(
        F.lit("all_predicted"), F.when(known, "reliable_predicted"), F.when(~known, "unknown_predicted")))))
    keys = ["population", "window_days"]
    marks = exact_quantiles(rows, keys, "p", {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0})
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg("p").alias("mean_probability")).join(marks, keys)


def sensitivity_groups(rows: DataFrame, bins: str, coverage: str) -> DataFrame:
    """Each row three times: by 1-day contact bins, historical scan quality and study day."""
    n, scan = F.col(bins), F.col(coverage)
    frequency = F.when(n <= 1, "1").when(n <= 5, "2-5").otherwise(">5")
    quality = F.when(scan.isNull(), "unknown").when(scan < 0.5, "below0.5").when(scan < 0.75, "0.5-0.75").otherwise(">=0.75")
    day = (F.floor(F.col("timestamp") / DAY) + 1).cast("string")
    pick = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("group_name"))
    return rows.select("*", F.inline(F.array(pick("contact_frequency", frequency), pick("scan_quality", quality), pick("study_day", day))))


def sensitivity_table(rows: DataFrame, keys: list[str], bins: str, coverage: str) -> DataFrame:
    return binary_metrics(sensitivity_groups(rows, bins, coverage), [*keys, "dimension", "group_name"])
