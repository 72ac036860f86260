"""Canonical contacts, observation evidence, coverage and quality tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recontact.functions.timemath import Span, floor_div, study_day
from recontact.policy import DAY, Policy

PAIR = ["user_min", "user_max"]
CONTACT_COLUMNS = ["timestamp", *PAIR, "rssi", "class_min", "class_max"]


def _optional(frame: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in frame.columns else F.lit(None).cast(kind)


def canonical_contacts(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Undirected contacts: sentinels and self rows dropped, classes follow their ids."""
    swapped = F.col("user_a") > F.col("user_b")
    class_a, class_b = _optional(raw, "class_a", "string"), _optional(raw, "class_b", "string")
    return (raw.where("user_a >= 0 AND user_b >= 0 AND user_a <> user_b")
            .select(F.col("timestamp").cast("long").alias("timestamp"),
                    F.least("user_a", "user_b").alias("user_min"),
                    F.greatest("user_a", "user_b").alias("user_max"),
                    _optional(raw, "rssi", "double").alias("rssi"),
                    F.when(swapped, class_b).otherwise(class_a).alias("class_min"),
                    F.when(swapped, class_a).otherwise(class_b).alias("class_max"),
                    *keep))


def dedup_contacts(contacts: DataFrame) -> DataFrame:
    """Exact repeats once; another signal strength at the same second is another measurement."""
    return contacts.dropDuplicates([c for c in contacts.columns])


def observations(raw: DataFrame, policy: Policy) -> DataFrame:
    """A reporter's scan proves that it was observed in that bin; a detected device's id does not."""
    bin_start = lambda seconds: floor_div("timestamp", seconds) * seconds
    if policy.scan_coverage_available:
        return (raw.where("user_a >= 0")
                .select(bin_start(policy.bin_seconds).alias("timestamp"), F.col("user_a").alias("user_id"))
                .distinct().withColumn("scan_observed", F.lit(True)))
    valid = raw.where("user_a >= 0 AND user_b >= 0 AND user_a <> user_b")
    return (valid.select(bin_start(20).alias("timestamp"), F.explode(F.array("user_a", "user_b")).alias("user_id"))
            .distinct().withColumn("scan_observed", F.lit(None).cast("boolean")))


def relative_time(frame: DataFrame, column: str = "timestamp") -> DataFrame:
    """Shift to seconds since midnight of the first recorded day, keeping the source time."""
    origin = frame.agg((F.floor(F.min(column) / DAY) * DAY).cast("long").alias("origin")).scalar()
    return frame.withColumn("source_timestamp", F.col(column)).withColumn(column, F.col(column) - origin)


def participants(seen: DataFrame, contacts: DataFrame) -> DataFrame:
    ends = contacts.select(F.explode(F.array(*PAIR)).alias("user_id"))
    return seen.select("user_id").union(ends).distinct()


def daily_coverage(people: DataFrame, seen: DataFrame, span: Span, policy: Policy) -> DataFrame:
    """One row per participant and study day; a day without rows has zero bins."""
    first, last = span.scheduled
    spine = people.withColumn("study_day", F.explode(F.sequence(F.lit(first + 1).cast("long"), F.lit(last + 1).cast("long"))))
    bins = (seen.groupBy("user_id", study_day("timestamp").alias("study_day"))
            .agg(F.count("*").alias("recorded_bins")))
    dense = spine.join(bins, ["user_id", "study_day"], "left").withColumn(
        "recorded_bins", F.coalesce("recorded_bins", F.lit(0)).cast("long"))
    known = policy.scan_coverage_available
    return dense.select(
        "user_id", "study_day", "recorded_bins",
        F.lit(policy.expected_bins if known else None).cast("long").alias("expected_scan_bins"),
        (F.col("recorded_bins") / policy.expected_bins if known else F.lit(None)).cast("double").alias("scan_coverage"))


def quality_report(raw: DataFrame, contacts: DataFrame, seen: DataFrame, people: DataFrame) -> DataFrame:
    """One row of counts; the distinct counts come from tables that are already distinct."""
    valid = "user_a >= 0 AND user_b >= 0"
    scalar = lambda frame, value: frame.agg(value.alias("v")).scalar()
    rows = scalar(contacts, F.count("*"))
    report = raw.agg(
        F.count("*").alias("input_rows"),
        F.count_if(F.expr(f"NOT ({valid})")).alias("invalid_id_rows"),
        F.count_if(F.expr(f"{valid} AND user_a = user_b")).alias("self_contact_rows"),
        F.count_if(F.col("user_b") == -1).alias("empty_scan_rows"),
        F.count_if(F.col("user_b") == -2).alias("external_device_rows"),
        F.count_if(F.expr(f"{valid} AND user_a <> user_b")).alias("candidate_rows"),
        F.min("timestamp").alias("source_timestamp_min"), F.max("timestamp").alias("source_timestamp_max"),
        F.count_if(F.col("rssi").isNull()).alias("missing_rssi"),
        F.count_if(F.col("timestamp").isNull()).alias("missing_timestamp"))
    return report.select(
        "input_rows", "invalid_id_rows", "self_contact_rows", "empty_scan_rows", "external_device_rows",
        (F.col("candidate_rows") - rows).alias("duplicate_contact_rows"), rows.alias("contact_rows"),
        scalar(people, F.count("*")).alias("participants"),
        scalar(seen, F.count("*")).alias("observation_bins"),
        "source_timestamp_min", "source_timestamp_max",
        scalar(contacts, F.min("rssi")).alias("rssi_min"), scalar(contacts, F.max("rssi")).alias("rssi_max"),
        F.round(scalar(contacts, F.avg("rssi")), 6).alias("rssi_mean"), "missing_rssi", "missing_timestamp")


def daily_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy(study_day("timestamp").alias("study_day")).agg(F.count("*").alias("contact_rows"))


def duplicate_counts(contacts: DataFrame) -> DataFrame:
    """Catalogue policy: repeats stay in the data, only their number is reported."""
    keyed = contacts.groupBy("dataset_id", "timestamp", *PAIR).agg(F.count("*").alias("n"))
    return keyed.groupBy("dataset_id").agg(
        F.sum("n").alias("event_rows"), F.count("*").alias("unique_contact_records"),
        F.sum(F.col("n") - 1).alias("duplicate_canonical_records"))


def namespace_violations(contacts: DataFrame) -> DataFrame:
    """Rows that are not canonical pairs, and the number of namespaces they are mixed from."""
    bad = F.expr("user_min < 0 OR user_min >= user_max")
    return contacts.agg(F.count_distinct("dataset_id").alias("namespaces"),
                        F.coalesce(F.count_if(bad), F.lit(0)).alias("non_canonical_rows"))


def unique_contacts(contacts: DataFrame) -> DataFrame:
    """One row per source, second and pair. Refuses pairs that are not canonical."""
    checked = contacts.withColumn("user_min", F.when(
        F.expr("user_min < 0 OR user_min >= user_max"),
        F.raise_error(F.lit("contacts must be canonical undirected pairs")).cast("long")).otherwise(F.col("user_min")))
    return checked.select("dataset_id", "timestamp", *PAIR).distinct()


def rssi_anomalies(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.count_if(F.col("rssi") > 0).alias("positive_rssi_rows"),
                        F.count("*").alias("contact_rows"))
