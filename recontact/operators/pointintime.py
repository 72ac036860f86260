"""Snapshots, candidates, three-valued labels and outcome reveal.

Every table is keyed by ``day``, the snapshot index, so history and horizon conditions are
equality keys (see ``functions.timemath``). Contacts are reduced to one row per pair and
snapshot day before anything is joined or spread over windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recontact.functions.timemath import Span, floor_div, history_day, horizon_day, snapshot_time
from recontact.operators.clean import PAIR
from recontact.policy import DAY, HOUR, Policy

KEY = ["timestamp", *PAIR]


def day_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, max(last + 1, first)).withColumnRenamed("id", "day")


def snapshots(spark: SparkSession, span: Span) -> DataFrame:
    """Every scheduled snapshot with its completeness."""
    first, last = span.scheduled
    days = day_range(spark, first, last).select(snapshot_time("day", span.policy).alias("timestamp"), "day")
    return days.select("timestamp", (F.col("day") + 1).alias("study_day"),
                       ((F.col("timestamp") >= span.start) & (F.col("timestamp") + DAY <= span.end)).alias("complete"))


def complete_times(spark: SparkSession, span: Span, windows: tuple[int, ...]) -> DataFrame:
    """Snapshots with a full history of each window and a full 24 h horizon."""
    days = day_range(spark, span.first_snapshot, span.last_snapshot)
    spread = days.withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows])))
    return (spread.where(F.col("day") * DAY + span.policy.offset - F.col("window_days") * DAY >= span.start)
            .select("window_days", snapshot_time("day", span.policy).alias("timestamp")))


def capacity(times: DataFrame, group: list[str], fractions: tuple[float, float, float]) -> DataFrame:
    """Purged train/validation/test snapshot counts of a timeline, per group."""
    order = Window.partitionBy(*group).orderBy("timestamp")
    whole = Window.partitionBy(*group)
    first_cut, second_cut = F.col("n") * F.lit(fractions[0]), F.col("n") * F.lit(fractions[0] + fractions[1])
    ranked = (times.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
              .withColumn("a", first_cut.cast("int")).withColumn("b", second_cut.cast("int")))
    cut = lambda index: F.max(F.when(F.col("i") == F.col(index), F.col("timestamp"))).over(whole)
    ranked = ranked.withColumn("cut_a", cut("a")).withColumn("cut_b", cut("b"))
    usable = (F.col("a") >= 1) & (F.col("b") > F.col("a")) & (F.col("b") < F.col("n"))
    ends = F.col("timestamp") + DAY
    return ranked.groupBy(*group).agg(
        F.count("*").alias("complete_snapshots"),
        F.count_if(usable & (F.col("i") < F.col("a")) & (ends < F.col("cut_a"))).alias("train_times"),
        F.count_if(usable & (F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")) & (ends < F.col("cut_b"))).alias("validation_times"),
        F.count_if(usable & (F.col("i") >= F.col("b"))).alias("test_times"))


def snapshot_capacity(spark: SparkSession, span: Span) -> DataFrame:
    """What 24, 6 and 1 hour schedules could offer, coverage ignored."""
    timelines = None
    for hours in (24, 6, 1):
        anchor = span.policy.offset if hours == 24 else 0
        step = hours * HOUR
        times = (spark.range(anchor, span.end + 1, step).withColumnRenamed("id", "timestamp")
                 .where((F.col("timestamp") >= span.start) & (F.col("timestamp") + DAY <= span.end))
                 .select(F.lit(hours).cast("long").alias("interval_hours"), "timestamp"))
        timelines = times if timelines is None else timelines.union(times)
    return capacity(timelines, ["interval_hours"], span.policy.fractions)


def pair_days(contacts: DataFrame, policy: Policy, extra: tuple[str, ...] = ()) -> DataFrame:
    """Contacts reduced to one row per pair and first snapshot day that sees them.

    ``on_day``/``on_next`` tell which of the two calendar days under the 24 h slot was touched.
    """
    slot_day = floor_div("timestamp", DAY)
    first_seen = contacts.withColumn("day", history_day("timestamp", policy))
    return first_seen.groupBy(*extra, *PAIR, "day").agg(
        F.count("*").alias("contacts"),
        F.count_distinct(floor_div("timestamp", policy.bin_seconds)).alias("bins"),
        F.sum("rssi").alias("rssi_sum"), F.count("rssi").alias("rssi_n"), F.max("rssi").alias("rssi_max"),
        F.max("timestamp").alias("last_contact"),
        F.max((slot_day == F.col("day") - 1).cast("int")).alias("on_day"),
        F.max((slot_day == F.col("day")).cast("int")).alias("on_next"))


def user_scans(seen: DataFrame, policy: Policy) -> DataFrame:
    """Observed bins per participant and first snapshot day that sees them."""
    return (seen.where(F.col("scan_observed"))
            .groupBy("user_id", history_day("timestamp", policy).alias("day"))
            .agg(F.count("*").alias("scans")))


def presence(pairs: DataFrame, windows: tuple[int, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """Each pair once per (window, snapshot day) whose history holds a contact.

    A pair-day covers the snapshots up to the next pair-day, so the rows come out distinct.
    """
    following = F.lead("day").over(Window.partitionBy(*extra, *PAIR).orderBy("day"))
    spread = (pairs.select(*extra, *PAIR, "day", following.alias("next_day"))
              .withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows]))))
    last = F.least(F.col("day") + F.col("window_days") - 1, F.coalesce(F.col("next_day") - 1, F.lit(2**40)))
    return spread.select(*extra, "window_days", F.explode(F.sequence("day", last)).alias("day"), *PAIR)


def nested_presence(pairs: DataFrame, windows: tuple[int, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """Each pair once per snapshot day whose longest history holds a contact; ``window_days`` is the shortest of the windows that does.

    Shorter histories lie inside longer ones, so every window's graph is the rows up to that window.
    """
    following = F.lead("day").over(Window.partitionBy(*extra, *PAIR).orderBy("day"))
    seen = pairs.select(*extra, *PAIR, F.col("day").alias("since"), following.alias("next_day"))
    last = F.least(F.col("since") + max(windows) - 1, F.coalesce(F.col("next_day") - 1, F.lit(2**40)))
    age = F.col("day") - F.col("since")
    shortest = F.coalesce(*[F.when(age < w, F.lit(w)) for w in sorted(windows)])
    return seen.select(*extra, *PAIR, "since", F.explode(F.sequence("since", last)).alias("day")).select(*extra, shortest.alias("window_days"), "day", *PAIR)


def in_span(frame: DataFrame, span: Span, history: int = 0) -> DataFrame:
    return frame.where(F.col("day").between(span.history_from(history), span.last_snapshot))


def known_pairs(pairs: DataFrame, span: Span, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every pair at every complete snapshot after its first contact."""
    first = pairs.groupBy(*extra, *PAIR).agg(F.greatest(F.min("day"), F.lit(span.first_snapshot)).alias("first_day"))
    return (first.where(F.col("first_day") <= span.last_snapshot)
            .select(*extra, F.explode(F.sequence("first_day", F.lit(span.last_snapshot).cast("long"))).alias("day"), *PAIR))


def candidates(pairs: DataFrame, span: Span, days: int = 1, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with a contact in ``[t-days, t)``. One day is exactly the pair-day table."""
    if days == 1:
        return in_span(pairs.select(*extra, "day", *PAIR), span)
    return in_span(presence(pairs, (days,), extra).drop("window_days"), span)


def future_positives(contacts: DataFrame, span: Span, extra: tuple[str, ...] = ()) -> DataFrame:
    return in_span(contacts.select(*extra, horizon_day("timestamp", span.policy).alias("day"), *PAIR).distinct(), span)


def future_coverage(seen: DataFrame, span: Span) -> DataFrame:
    """Observed bins per participant inside each complete 24 h horizon."""
    counted = (seen.where(F.col("scan_observed"))
               .groupBy("user_id", horizon_day("timestamp", span.policy).alias("day"))
               .agg(F.count("*").alias("bins"),
                    F.count_distinct(floor_div("timestamp", span.policy.bin_seconds)).alias("distinct_bins")))
    return in_span(counted, span).withColumn("coverage", F.col("bins") / span.policy.expected_bins)


def attach_users(keys: DataFrame, facts: DataFrame, columns: dict[str, tuple[str, str]], by: tuple[str, ...] = ("day",)) -> DataFrame:
    """Left join participant facts to both ends of a pair; ``columns`` maps fact -> (name_a, name_b).

    The two joins are keyed by (day, participant). A hub is split by adaptive skew handling
    (see ``session.SETTINGS``); small fact tables are broadcast by measured size.
    """
    result = keys
    for side, own in enumerate(PAIR):
        renamed = facts.select(*by, F.col("user_id").alias(own),
                               *[F.col(fact).alias(names[side]) for fact, names in columns.items()])
        result = result.join(renamed, [*by, own], "left")
    return result


def with_time(frame: DataFrame, policy: Policy) -> DataFrame:
    rest = [c for c in frame.columns if c not in ("day", *PAIR)]
    return frame.select(snapshot_time("day", policy).alias("timestamp"), *PAIR, *rest)


def label_evidence(keys: DataFrame, positives: DataFrame, coverage: DataFrame, policy: Policy) -> DataFrame:
    """Candidate keys with ``hit`` and the two future coverages (null when unknowable)."""
    joined = (keys.join(positives.withColumn("hit", F.lit(True)), ["day", *PAIR], "left")
              .withColumn("hit", F.coalesce("hit", F.lit(False))))
    names = {"coverage": ("scan_coverage_a", "scan_coverage_b")}
    if not policy.scan_coverage_available:
        unknown = F.lit(None).cast("double")
        return joined.withColumns({name: unknown for name in names["coverage"]})
    joined = attach_users(joined, coverage, names)
    return joined.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in names["coverage"]})


def _least_coverage() -> Column:
    """Null as soon as one side is null, unlike ``least``."""
    a, b = F.col("scan_coverage_a"), F.col("scan_coverage_b")
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def labels_24h(evidence: DataFrame, policy: Policy) -> DataFrame:
    """1 for a recorded contact, 0 for an observed absence, null otherwise."""
    eligible = F.coalesce(_least_coverage() >= policy.min_scan_coverage, F.lit(False))
    marked = evidence.withColumn("eligible_for_evaluation", eligible)
    ok = F.col("eligible_for_evaluation")
    return with_time(marked.withColumns({
        "label_24h": F.when(F.col("hit"), 1).when(ok, 0).cast("tinyint"),
        "exclusion_reason": F.when(ok, F.lit(None)).when(F.col("scan_coverage_a").isNull(), F.lit("scan_coverage_unknown"))
        .otherwise(F.lit("low_scan_coverage"))}), policy).select(
        *KEY, "label_24h", "scan_coverage_a", "scan_coverage_b", "eligible_for_evaluation", "exclusion_reason")


def label_funnel(labels: DataFrame) -> DataFrame:
    return labels.groupBy("timestamp").agg(
        F.count("*").alias("candidate_rows"), F.count_if("eligible_for_evaluation").alias("eligible_samples"),
        F.count_if(F.col("label_24h") == 1).alias("positive_labels"),
        F.count_if(F.col("label_24h") == 0).alias("negative_labels"),
        F.count_if(F.col("label_24h").isNull()).alias("unknown_labels"))


def reveal_outcomes(keys: DataFrame, contacts: DataFrame, seen: DataFrame, span: Span) -> DataFrame:
    """Contact, No Contact or Unknown with a reason; a contact counts even in a cut-off horizon."""
    policy = span.policy
    hits = contacts.select(horizon_day("timestamp", policy).alias("day"), *PAIR).distinct()
    bins = (seen.where(F.col("scan_observed")).groupBy("user_id", horizon_day("timestamp", policy).alias("day"))
            .agg(F.count_distinct(floor_div("timestamp", policy.bin_seconds)).alias("n"))
            .withColumn("coverage", F.col("n") / policy.expected_bins))
    rows = label_evidence(keys, hits, bins, policy)
    complete = F.col("day") * DAY + policy.offset + DAY <= span.end
    rows = rows.withColumn("strict_future_covered", F.coalesce(_least_coverage() >= policy.min_scan_coverage, F.lit(False)) & complete)
    covered = F.col("strict_future_covered")
    scan_reason = "low_scan_coverage" if policy.scan_coverage_available else "scan_coverage_unknown"
    rows = rows.withColumns({
        "label_24h": F.when(F.col("hit"), 1).when(covered, 0).cast("tinyint"),
        "outcome": F.when(F.col("hit"), F.lit("Contact")).when(covered, F.lit("No Contact")).otherwise(F.lit("Unknown")),
        "outcome_reason": F.when(F.col("hit"), F.lit("observed_positive_evidence"))
        .when(covered, F.lit("adequately_observed_no_contact"))
        .when(~complete, F.lit("future_window_incomplete")).otherwise(F.lit(scan_reason))})
    return with_time(rows, policy).select(
        *KEY, F.col("scan_coverage_a").alias("future_scan_coverage_a"), F.col("scan_coverage_b").alias("future_scan_coverage_b"),
        "strict_future_covered", "label_24h", "outcome", "outcome_reason",
        F.col("label_24h").isNotNull().alias("reliable_label"))


def backtest_outcomes(keys: DataFrame, contacts: DataFrame, seen: DataFrame, span: Span) -> DataFrame:
    """The older order of rules: a cut-off horizon is Unknown before any contact is looked at."""
    rows = reveal_outcomes(keys, contacts, seen, span)
    cut_off = F.col("timestamp") + DAY > span.end
    return rows.select(*KEY, F.when(cut_off, F.lit("Unknown")).otherwise(F.col("outcome")).alias("outcome"),
                       F.when(cut_off, F.lit("future_window_incomplete")).otherwise(F.col("outcome_reason")).alias("reason"))


def coverage_sensitivity(labels: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    enough = lambda value: F.coalesce(_least_coverage() >= value, F.lit(False))
    counts = labels.agg(F.array(*[F.struct(
        F.lit(float(value)).alias("threshold"), F.count_if(enough(value)).alias("samples"),
        F.count_if(enough(value) & (F.col("label_24h") == 1)).alias("positive"),
        F.count_if(enough(value) & (F.coalesce(F.col("label_24h"), F.lit(0)) != 1)).alias("negative")) for value in thresholds]).alias("rows"))
    return counts.select(F.inline("rows"))


def candidate_expansion(one_day: DataFrame, seven_day: DataFrame, labels: DataFrame) -> DataFrame:
    """Reach of the 1-day and 7-day candidate pools per snapshot, on the same labels."""
    known = F.col("eligible_for_evaluation") & F.col("label_24h").isNotNull()
    flagged = labels.join(seven_day, KEY).join(one_day.withColumn("recent", F.lit(True)), KEY, "left")
    short = F.coalesce("recent", F.lit(False))
    return flagged.groupBy("timestamp").agg(
        F.count_if(short).alias("candidates_1d"), F.count_if(short & known).alias("eligible_1d"),
        F.count_if(short & known & (F.col("label_24h") == 1)).alias("positive_1d"),
        F.count("*").alias("candidates_7d"), F.count_if(known).alias("eligible_7d"),
        F.count_if(known & (F.col("label_24h") == 1)).alias("positive_7d"),
        F.count_if(known & ~short).alias("extra_eligible_rows"))
