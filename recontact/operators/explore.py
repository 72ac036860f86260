"""Exploration tables: trends on dense spines, rankings, histograms, overview and case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recontact.functions.timemath import Span, floor_div, study_day
from recontact.operators.clean import PAIR
from recontact.operators.pointintime import KEY, day_range
from recontact.policy import DAY, HOUR



def scope(contacts: DataFrame, days: tuple[int, int] | None = None, users: tuple[int, ...] = (), pair: tuple[int, int] | None = None) -> DataFrame:
    """Day range, either-endpoint users and one pair, intersected; all reach the scan as filters."""
    rows = contacts
    if days:
        rows = rows.where((F.col("timestamp") >= (days[0] - 1) * DAY) & (F.col("timestamp") < days[1] * DAY))
    if users:
        rows = rows.where(F.col("user_min").isin(*users) | F.col("user_max").isin(*users))
    if pair:
        low, high = sorted(pair)
        rows = rows.where((F.col("user_min") == low) & (F.col("user_max") == high))
    return rows


def _dense(spine: DataFrame, counts: DataFrame, key: str, value: str) -> DataFrame:
    return spine.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0).cast("long")).alias(value))


def daily_trend(contacts: DataFrame, days: tuple[int, int]) -> DataFrame:
    spine = day_range(contacts.sparkSession, days[0], days[1]).withColumnRenamed("day", "study_day")
    return _dense(spine, contacts.groupBy(study_day("timestamp").alias("study_day")).agg(F.count("*").alias("contact_records")), "study_day", "contact_records")


def hourly_trend(contacts: DataFrame) -> DataFrame:
    spine = day_range(contacts.sparkSession, 0, 23).withColumnRenamed("day", "hour")
    hour = floor_div(F.col("timestamp") % DAY, HOUR)
    return _dense(spine, contacts.groupBy(hour.alias("hour")).agg(F.count("*").alias("contact_records")), "hour", "contact_records")


def pair_counts(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy(*PAIR).agg(F.count("*").alias("contact_records"))


def pair_frequency(contacts: DataFrame) -> DataFrame:
    """How many pairs have how many contact records."""
    return pair_counts(contacts).groupBy(F.col("contact_records").alias("frequency")).agg(F.count("*").alias("pairs"))


def activity_topn(contacts: DataFrame, n: int = 20) -> DataFrame:
    ends = contacts.select(F.explode(F.array(*PAIR)).alias("user_id"))
    return ends.groupBy("user_id").agg(F.count("*").alias("contact_records")).orderBy(F.col("contact_records").desc(), "user_id").limit(n)


def contact_matrix(contacts: DataFrame, n: int = 20) -> DataFrame:
    """Symmetric long-form counts among the n most active participants."""
    top = activity_topn(contacts, n).select("user_id")
    inside = pair_counts(contacts)
    for end in PAIR:
        inside = inside.join(F.broadcast(top.withColumnRenamed("user_id", end)), end, "left_semi")  # n rows
    cells = F.array(F.struct(F.col("user_min").alias("user_a"), F.col("user_max").alias("user_b")),
                    F.struct(F.col("user_max").alias("user_a"), F.col("user_min").alias("user_b")))
    return inside.select(F.inline(cells), "contact_records")


def rssi_histogram(contacts: DataFrame, selected: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width counts of the selection on the whole table's range; the last bin is closed."""
    ends = contacts.agg(F.min("rssi").alias("low"), F.max("rssi").alias("high")).first()
    low, high = (F.lit(v).cast("double") for v in ends)
    number = bins if ends.low is not None and ends.low < ends.high else 1
    width = (high - low) / bins
    place = F.least(F.floor((F.col("rssi") - low) / width), F.lit(bins - 1)) if number > 1 else F.lit(0)
    middle = low + (F.col("bin") + 0.5) * width if number > 1 else low
    counts = selected.where("rssi IS NOT NULL").groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("records"))
    spine = day_range(contacts.sparkSession, 0, number - 1).withColumnRenamed("day", "bin")
    return spine.join(counts, "bin", "left").select("bin", middle.alias("rssi"), F.coalesce("records", F.lit(0).cast("long")).alias("records"))


def coverage_trend(coverage: DataFrame) -> DataFrame:
    value = F.col("scan_coverage")
    return coverage.groupBy("study_day").agg(
        F.avg(value).alias("mean_scan_coverage"), F.count_if(value > 0).alias("with_scan"),
        F.count_if(value == 0).alias("without_scan"), F.count_if(value.isNull()).alias("unknown"))


def overview(contacts: DataFrame, people: DataFrame, labels: DataFrame, span: Span) -> DataFrame:
    first, last = span.scheduled
    known = F.col("eligible_for_evaluation") & F.col("label_24h").isNotNull()
    base = pair_counts(contacts).agg(F.count("*").alias("valid_pairs"), F.sum("contact_records").alias("contact_records"))
    rate = labels.agg(F.count_if(known).alias("eligible_samples"), F.count_if(known & (F.col("label_24h") == 1)).alias("positive_samples"))
    one = lambda frame, name: frame.select(name).scalar()
    eligible, positive = one(rate, "eligible_samples"), one(rate, "positive_samples")
    return base.select(
        people.agg(F.count("*").alias("n")).scalar().alias("participants"), "contact_records", "valid_pairs",
        F.lit(last - first + 1).cast("long").alias("observation_days"), eligible.alias("eligible_samples"),
        F.when(eligible > 0, positive / eligible).alias("positive_rate"))


def highlights(published: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """The largest published value per group and how many items share it (few rows per group)."""
    top = published.where(F.col(value).isNotNull()).withColumn("best", F.max(value).over(Window.partitionBy(group)))
    return top.where(F.col(value) == F.col("best")).groupBy(group).agg(
        F.min(item).alias("item"), F.max(value).alias("value"), F.count("*").alias("ties"))


def pair_cases(keys: DataFrame, bank: DataFrame, outcomes: DataFrame, window_days: int) -> DataFrame:
    """History count, recency, entropy of the historical probability and outcome per asked pair."""
    from recontact.functions.metrics import prediction_entropy
    p = F.col("historical_contact_probability")
    facts = bank.select(*KEY, F.col(f"contact_count_{window_days}d").cast("long").alias("historical_contact_count"),
                        F.col("time_since_last_contact").cast("long").alias("time_since_last_contact"),
                        p.alias("probability"), F.when(p.isNotNull(), prediction_entropy(p)).alias("prediction_entropy"))
    return keys.join(facts, KEY).join(outcomes, KEY)
