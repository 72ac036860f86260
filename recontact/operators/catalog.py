"""Manifests, date capacity and eligibility of several contact sources side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recontact.functions.timemath import floor_div
from recontact.operators.clean import PAIR
from recontact.operators.pointintime import capacity
from recontact.operators.retrieval import source_times, source_windows
from recontact.policy import DAY, Policy



def catalog_scan(sources: dict[str, DataFrame]) -> DataFrame:
    """One namespaced contact table from several sources (timestamp, user_a, user_b each)."""
    result = None
    for name, frame in sources.items():
        part = frame.select(F.lit(name).alias("dataset_id"), "timestamp", "user_a", "user_b")
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("the catalogue has no sources")
    return result


def classify_rows(rows: DataFrame) -> DataFrame:
    """Numeric triplets as strings or numbers -> valid, invalid and self rows per source."""
    valid, self_row = row_tests()
    return rows.groupBy("dataset_id").agg(
        F.count("*").alias("raw_rows"), F.count_if(~valid).alias("invalid_rows"), F.count_if(valid & self_row).alias("self_contact_rows"),
        F.count_if(valid & ~self_row).alias("event_rows"))


def row_tests():
    """(valid, self) tests: finite, integral, non-negative time and ids."""
    numbers = [F.expr(f"try_cast({c} AS DOUBLE)") for c in ("timestamp", "user_a", "user_b")]
    valid = F.lit(True)
    for n in numbers:
        valid = valid & F.coalesce(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) & (n == F.rint(n)) & (n >= 0), F.lit(False))
    return valid, F.coalesce(numbers[1] == numbers[2], F.lit(False))


def catalog_contacts(rows: DataFrame) -> DataFrame:
    """Canonical contacts of the valid rows; repeats are kept."""
    valid, self_row = row_tests()
    whole = lambda c: F.expr(f"try_cast(try_cast({c} AS DOUBLE) AS BIGINT)")
    a, b = whole("user_a"), whole("user_b")
    return rows.where(valid & ~self_row).select(
        "dataset_id", whole("timestamp").alias("timestamp"), F.least(a, b).alias("user_min"), F.greatest(a, b).alias("user_max"))


def dataset_manifest(contacts: DataFrame) -> DataFrame:
    """Participants, pairs, records, first/last time, span and days without records per source."""
    pairs = contacts.groupBy("dataset_id", *PAIR).agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    totals = pairs.groupBy("dataset_id").agg(
        F.count("*").alias("valid_pairs"), F.sum("n").alias("event_rows"), F.min("lo").alias("first_timestamp"), F.max("hi").alias("last_timestamp"))
    people = (pairs.select("dataset_id", F.explode(F.array(*PAIR)).alias("user_id")).distinct()
              .groupBy("dataset_id").agg(F.count("*").alias("participants")))
    active = (contacts.select("dataset_id", floor_div("timestamp", DAY).alias("d")).distinct()
              .groupBy("dataset_id").agg(F.count("*").alias("active_days")))
    touched = floor_div("last_timestamp", DAY) - floor_div("first_timestamp", DAY) + 1
    return totals.join(people, "dataset_id").join(active, "dataset_id").select(
        "dataset_id", "participants", "valid_pairs", "event_rows", "first_timestamp", "last_timestamp",
        ((F.col("last_timestamp") - F.col("first_timestamp")) / DAY).alias("span_days"),
        (touched - F.col("active_days")).alias("days_without_contact_records"))


def dataset_days(contacts: DataFrame) -> DataFrame:
    """Records and participants per source and study day, empty days included."""
    d = floor_div("timestamp", DAY)
    records = contacts.groupBy("dataset_id", d.alias("d")).agg(F.count("*").alias("event_rows"))
    people = (contacts.select("dataset_id", d.alias("d"), F.explode(F.array(*PAIR)).alias("user_id")).distinct()
              .groupBy("dataset_id", "d").agg(F.count("*").alias("participants_with_contacts")))
    spine = (records.groupBy("dataset_id").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))
             .withColumn("d", F.explode(F.sequence("first_day", "last_day"))))
    dense = spine.join(records, ["dataset_id", "d"], "left").join(people, ["dataset_id", "d"], "left")
    return dense.select("dataset_id", (F.col("d") - F.col("first_day") + 1).alias("study_day"),
                        F.coalesce("event_rows", F.lit(0)).alias("event_rows"),
                        F.coalesce("participants_with_contacts", F.lit(0)).alias("participants_with_contacts"))


def calendar_capacity(unique: DataFrame, policy: Policy) -> DataFrame:
    """Complete snapshots and purged date capacity of every source and window, zero for sources too short for one."""
    line = ["dataset_id", "window_days"]
    times = source_times(unique, policy).select(*line, (F.col("day") * DAY + policy.offset).alias("timestamp"))
    counted = source_windows(unique, policy).join(capacity(times, line, policy.fractions), line, "left").na.fill(0)
    enough = F.least("train_times", "validation_times", "test_times") >= 2
    return counted.select(
        *line, F.col("complete_snapshots").alias("calendar_complete_snapshots"), "train_times", "validation_times", "test_times",
        F.when(enough, "date_capacity_only").otherwise("insufficient_days").alias("temporal_status"))


def eligibility(manifest: DataFrame, dates: DataFrame, support: DataFrame) -> DataFrame:
    """Status and blockers. ``support``: dataset_id, unit_verified, coverage_supported, coverage_checked."""
    seven = dates.where("window_days = 7").select("dataset_id", "calendar_complete_snapshots")
    rows = manifest.join(support, "dataset_id").join(seven, "dataset_id", "left")
    unit, checked, supported = F.col("unit_verified"), F.col("coverage_checked"), F.col("coverage_supported")
    short = (F.col("last_timestamp") - F.col("first_timestamp") < 8 * DAY) & ~supported
    status = (F.when(unit & short, "insufficient_history").when(checked & unit, "eligible_primary_24h").otherwise("exploratory_only"))
    blockers = F.array_compact(F.array(
        F.when(~checked, "missing verified scan support"),
        F.when(unit & (F.coalesce("calendar_complete_snapshots", F.lit(0)) < 6), "insufficient_days"),
        F.when(~unit, "time_unit_unverified")))
    return rows.select("dataset_id", status.alias("eligibility_status"), F.concat_ws("; ", blockers).alias("reason"))
