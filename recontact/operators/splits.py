"""Cohorts, purged chronological splits, walk-forward and rolling folds, participant holdout.

Splits are decided on the distinct snapshot times (one row per study day) and joined back to
the rows, so only day-sized tables are ever ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recontact.functions.timemath import Span, sums_until
from recontact.operators.integrity import contract_join
from recontact.operators.pointintime import KEY
from recontact.policy import DAY, Policy

SETS = ("train", "validation", "test", "purged")


def training_cohort(labels: DataFrame, bank: DataFrame) -> DataFrame:
    """Features of every usable label. A label without features and a repeated key fail the read; features without label are spare."""
    known = labels.where("eligible_for_evaluation AND label_24h IS NOT NULL").select(*KEY, "label_24h")
    return contract_join(known, bank.drop("label_24h"), KEY, spare_right=True)


def common_cohort(labels: DataFrame, candidates_1d: DataFrame, span: Span, dataset_id: str, history_days: int = 7) -> DataFrame:
    """Eligible 1-day candidates whose snapshot has a full 7-day history."""
    rows = (labels.where((F.col("timestamp") - history_days * DAY >= span.start) & (F.col("timestamp") + DAY <= span.end))
            .where("eligible_for_evaluation AND label_24h IS NOT NULL").join(candidates_1d, KEY, "left_semi"))
    return rows.select(F.lit(dataset_id).alias("dataset_id"), F.concat_ws("|", F.lit(dataset_id), *KEY).alias("sample_key"), *KEY,
                       "label_24h", F.col("scan_coverage_a").alias("future_scan_coverage_a"),
                       F.col("scan_coverage_b").alias("future_scan_coverage_b"))


def cohort_funnel(labels: DataFrame, candidates_1d: DataFrame, span: Span, history_days: int = 7) -> DataFrame:
    flagged = labels.join(candidates_1d.withColumn("recent", F.lit(True)), KEY, "left")
    whole = (F.col("timestamp") - history_days * DAY >= span.start) & (F.col("timestamp") + DAY <= span.end)
    recent = whole & F.coalesce("recent", F.lit(False))
    kept = recent & F.col("eligible_for_evaluation") & F.col("label_24h").isNotNull()
    return flagged.groupBy("timestamp").agg(
        F.count("*").alias("all_past_candidate_rows"), F.count_if(~whole).alias("excluded_incomplete_7d_span"),
        F.count_if(recent).alias("one_day_candidates"), F.count_if(whole & ~recent).alias("excluded_not_1d_candidate"),
        F.count_if(recent & ~kept).alias("excluded_coverage_or_unknown"), F.count_if(kept).alias("eligible_rows"),
        F.count_if(kept & (F.col("label_24h") == 1)).alias("positive"), F.count_if(kept & (F.col("label_24h") == 0)).alias("negative"))


def time_counts(rows: DataFrame) -> DataFrame:
    """Rows and classes per snapshot time; every split below is planned on this day-sized table."""
    return rows.groupBy("timestamp").agg(
        F.count("*").alias("rows"), F.count_if(F.col("label_24h") == 1).alias("positive"),
        F.count_if(F.col("label_24h") == 0).alias("negative"))


def split_cutoffs(times: DataFrame, fractions: tuple[float, float, float]) -> DataFrame:
    """One row: validation_start and test_start at truncated index positions."""
    order = Window.orderBy("timestamp")
    ranked = times.select("timestamp", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    first = (F.col("n") * F.lit(fractions[0])).cast("int")
    second = (F.col("n") * F.lit(fractions[0] + fractions[1])).cast("int")
    usable = (first >= 1) & (second > first) & (second < F.col("n"))
    return ranked.agg(F.max(F.when(usable & (F.col("i") == first), F.col("timestamp"))).alias("validation_start"),
                      F.max(F.when(usable & (F.col("i") == second), F.col("timestamp"))).alias("test_start"))


def split_plan(times: DataFrame, fractions: tuple[float, float, float]) -> DataFrame:
    """timestamp -> split (train, validation, test or purged); all purged without cutoffs.

    The two cutoffs are read once, so that every later plan carries them as constants.
    """
    cuts = split_cutoffs(times, fractions).first()
    start, test = (F.lit(c).cast("long") for c in (cuts.validation_start, cuts.test_start))
    t, end = F.col("timestamp"), F.col("timestamp") + DAY
    role = (F.when((t < start) & (end < start), "train").when((t >= start) & (t < test) & (end < test), "validation")
            .when(t >= test, "test").otherwise("purged"))
    return times.withColumn("split", role)


def assign_split(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan.select("timestamp", "split"), "timestamp")  # one row per study day


def chrono_split(rows: DataFrame, policy: Policy) -> DataFrame:
    return assign_split(rows, split_plan(time_counts(rows), policy.fractions))


def validation_plan(plan: DataFrame, fraction: float = 0.5) -> DataFrame:
    """timestamp -> calibration (early, purged) or tuning (later) inside the validation split."""
    order = Window.partitionBy("split").orderBy("timestamp")
    ranked = plan.where("split = 'validation'").select(
        "split", "timestamp", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("split")).alias("n"))
    at = (F.col("n") * F.lit(fraction)).cast("int")
    cut = F.max(F.when((F.col("i") == at) & (at >= 1), F.col("timestamp"))).over(Window.partitionBy("split"))
    marked = ranked.withColumn("cut", cut)
    return marked.select("timestamp", F.when(F.col("timestamp") + DAY < F.col("cut"), "calibration")
                         .when(F.col("timestamp") >= F.col("cut"), "tuning").otherwise("purged").alias("part"))


def _support(plan: DataFrame) -> DataFrame:
    """One row per set, those without any row included: a global aggregate, turned into rows."""
    part = lambda name, value: F.coalesce(F.sum(F.when(F.col("split") == name, value)), F.lit(0))
    sets = F.array(*[F.struct(
        F.lit(name).alias("split"), *[part(name, F.col(c)).alias(c) for c in ("rows", "positive", "negative")],
        part(name, F.lit(1)).alias("prediction_times")) for name in SETS])
    return plan.agg(sets.alias("sets")).select(F.inline("sets"))


def split_support(rows: DataFrame, policy: Policy) -> DataFrame:
    """Rows, classes and times of every set (zero where it has none) with the support gate of each."""
    sets = _support(split_plan(time_counts(rows), policy.fractions))
    gate = (F.col("prediction_times") >= policy.min_set_times) & (F.least("positive", "negative") >= policy.min_class_rows)
    return sets.withColumn("supported", gate)


def purged_by_day(rows: DataFrame, policy: Policy) -> DataFrame:
    return split_plan(time_counts(rows), policy.fractions).where("split = 'purged'").drop("split")


def feasibility(rows: DataFrame, policy: Policy) -> DataFrame:
    """The reasons, if any, why each set cannot carry an evaluation."""
    sets = split_support(rows, policy).where("split <> 'purged'")
    reasons = F.array_compact(F.array(
        F.when(F.col("prediction_times") < policy.min_set_times, "fewer than 2 prediction times"),
        F.when(F.least("positive", "negative") < policy.min_class_rows, "fewer than 20 samples in one class"),
        F.when((F.col("split") == "train") & (F.col("rows") < policy.min_train_rows), "fewer than 200 reliable samples")))
    return sets.select("split", "rows", F.concat_ws("; ", reasons).alias("reasons"), (F.size(reasons) == 0).alias("feasible"))


def forward_folds(rows: DataFrame, policy: Policy, start_days: tuple[int, ...], test_days: int = 2, min_train_days: int = 3) -> DataFrame:
    """Walk-forward folds from fixed first test study days: one row per fold."""
    times = time_counts(rows)
    starts = times.sparkSession.createDataFrame([(d, (d - 1) * DAY + policy.offset) for d in start_days], "study_day long, start long")
    return _fold_table(_walk_roles(starts, times, policy, test_days), ["study_day"], policy, min_train_days, test_days, "insufficient_days")


def _spread(folds: DataFrame, times: DataFrame, policy: Policy) -> DataFrame:
    """Fold starts beside every earlier or tested time. Both tables have one row per day."""
    listed = times.agg(F.array_sort(F.collect_list(F.struct("timestamp", "rows", "positive", "negative"))).alias("all_times"))
    return folds.withColumn("all_times", listed.scalar()).withColumn("item", F.explode("all_times")).select(*folds.columns, "item.*")


def _walk_roles(starts: DataFrame, times: DataFrame, policy: Policy, test_days: int) -> DataFrame:
    spread = _spread(starts, times, policy)
    t, start = F.col("timestamp"), F.col("start")
    recent = F.row_number().over(Window.partitionBy("study_day", "before").orderBy(t.desc()))
    marked = spread.withColumn("before", t + DAY < start).withColumn("recent", recent)
    val = F.col("before") & (F.col("recent") <= policy.validation_times)
    first_val = F.min(F.when(val, t)).over(Window.partitionBy("study_day"))
    role = (F.when(val, "validation").when((t >= start) & (t < start + test_days * DAY), "test")
            .when(t + DAY < F.col("first_val"), "train"))
    return marked.withColumn("first_val", first_val).withColumn("role", role)


def rolling_roles(times: DataFrame, policy: Policy) -> DataFrame:
    """test_time, timestamp, role: every time tested once, the last 3 purged earlier times
    validate, everything purged before those trains. Days squared rows, to look at: ``fold_spans`` says the same in one row a fold."""
    starts = times.select(F.col("timestamp").alias("test_time"))
    spread = _spread(starts, times, policy)
    t, test = F.col("timestamp"), F.col("test_time")
    marked = spread.withColumn("before", t + DAY < test)
    recent = F.row_number().over(Window.partitionBy("test_time", "before").orderBy(t.desc()))
    marked = marked.withColumn("recent", recent)
    val = F.col("before") & (F.col("recent") <= policy.validation_times)
    first_val = F.min(F.when(val, t)).over(Window.partitionBy("test_time"))
    role = F.when(val, "validation").when(t == test, "test").when(t + DAY < F.col("first_val"), "train")
    return marked.withColumn("first_val", first_val).withColumn("role", role).where("role IS NOT NULL").select(
        "test_time", "timestamp", "role", "rows", "positive", "negative")


def fold_spans(times: DataFrame, policy: Policy) -> DataFrame:
    """One row per time, tested by the fold it belongs to: times and classes of every role, the span that trains
    (train_first, train_last: every time between belongs to it) and the few times that validate (``validation``, an array).

    Everything purged before a time, and the purged times before its first validation time, are beginnings of the same order
    of times. So a fold is a running sum, looked up at two places: as many rows as times, not folds times days.
    """
    order = Window.orderBy("timestamp")
    earlier = order.rangeBetween(Window.unboundedPreceding, -DAY - 1)
    so_far = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name)
    before = F.struct(F.count("*").over(earlier).alias("times"), so_far("positive"), so_far("negative"),
                      F.min("timestamp").over(earlier).alias("first"), F.max("timestamp").over(earlier).alias("last"))
    placed = times.select("timestamp", "positive", "negative", F.row_number().over(order).alias("place"), before.alias("before"))
    few = Window.orderBy("place").rowsBetween(1 - policy.validation_times, Window.currentRow)
    recent = placed.select(F.col("place").alias("upto"), F.collect_list(F.struct("timestamp", "positive", "negative", "before")).over(few).alias("recent"))
    joined = placed.join(recent, F.col("before.times") == F.col("upto"), "left")
    validation = F.coalesce(F.col("recent"), F.expr("slice(array(struct(timestamp, positive, negative, before)), 1, 0)"))
    rows = joined.select("timestamp", "positive", "negative", validation.alias("held")).withColumn("train", F.try_element_at("held", F.lit(1))["before"])
    held = lambda name: F.aggregate("held", F.lit(0).cast("long"), lambda n, r: n + r[name])
    count = lambda name: F.coalesce(F.col(f"train.{name}"), F.lit(0).cast("long"))
    return rows.select(
        F.col("timestamp").alias("test_time"), count("times").alias("train_times"), F.size("held").cast("long").alias("validation_times"),
        F.lit(1).cast("long").alias("test_times"), count("positive").alias("train_positive"), count("negative").alias("train_negative"),
        held("positive").alias("validation_positive"), held("negative").alias("validation_negative"), F.col("positive").alias("test_positive"),
        F.col("negative").alias("test_negative"), F.col("train.first").alias("train_first"), F.col("train.last").alias("train_last"),
        F.col("held.timestamp").alias("validation"))


def _counts(keys: list[str], roles: DataFrame) -> DataFrame:
    part = lambda role, value: F.coalesce(F.sum(F.when(F.col("role") == role, value)), F.lit(0))
    names = ("train", "validation", "test")
    return roles.groupBy(*keys).agg(
        *[part(r, F.lit(1)).alias(f"{r}_times") for r in names],
        *[part(r, F.col(c)).alias(f"{r}_{c}") for r in names for c in ("positive", "negative")])


def _balanced(policy: Policy) -> Column:
    return F.least(*[F.col(f"{r}_{c}") for r in ("train", "validation", "test") for c in ("positive", "negative")]) >= policy.min_class_rows


def _fold_table(roles: DataFrame, keys: list[str], policy: Policy, min_train: int, test_times: int, failed: str) -> DataFrame:
    counts = _counts(keys, roles)
    ready = ((F.col("validation_times") == policy.validation_times) & (F.col("train_times") >= min_train)
             & (F.col("test_times") == test_times) & _balanced(policy))
    return counts.withColumn("status", F.when(ready, "ready").otherwise(failed))


SPANS = ("train_first", "train_last", "validation")


def _rated_folds(rows: DataFrame, policy: Policy) -> DataFrame:
    short = (F.col("validation_times") < policy.validation_times) | (F.col("train_times") < policy.min_train_times)
    status = F.when(short, "insufficient_history").when(_balanced(policy), "ready").otherwise("insufficient_class_rows")
    return fold_spans(time_counts(rows), policy).withColumn("status", status)


def rolling_folds(rows: DataFrame, policy: Policy) -> DataFrame:
    return _rated_folds(rows, policy).drop(*SPANS)


def ready_folds(rows: DataFrame, policy: Policy) -> DataFrame:
    """test_time, train_first, train_last, validation (array of times): the folds that may be evaluated, one row each."""
    return _rated_folds(rows, policy).where("status = 'ready'").select("test_time", *SPANS)


def evaluated_times(folds: DataFrame) -> DataFrame:
    """One row per fold and time that it validates or tests on: the folds' columns but ``validation``, timestamp and role."""
    item = lambda t, role: F.struct(t.alias("timestamp"), F.lit(role).alias("role"))
    items = F.concat(F.transform("validation", lambda t: item(t, "validation")), F.array(item(F.col("test_time"), "test")))
    return folds.withColumn("item", F.explode(items)).drop("validation").select("*", "item.*").drop("item")


def ready_roles(rows: DataFrame, policy: Policy) -> DataFrame:
    """test_time, timestamp, role of the folds that may be evaluated: the long form of ``ready_folds``, days squared rows."""
    roles = rolling_roles(time_counts(rows), policy).select("test_time", "timestamp", "role")
    return roles.join(rolling_folds(rows, policy).where("status = 'ready'").select("test_time"), "test_time", "left_semi")


# Leading part of the hashed text (fixed value).
GROUP_TAG = "T38"


def participant_group(user: Column, salt: Column, dataset_id: str, tag: str = GROUP_TAG) -> Column:
    """0 or 1 from the parity of a salted SHA-256 (the parity of its last hex digit)."""
    digest = F.sha2(F.concat_ws("|", F.lit(tag), salt, F.lit(dataset_id), user), 256)
    return (F.conv(F.substring(digest, 64, 1), 16, 10).cast("int") % 2)


def holdout_population(rows: DataFrame, salts: tuple[str, ...], dataset_id: str) -> DataFrame:
    spread = rows.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in salts])))
    a = participant_group(F.col("user_min"), F.col("salt"), dataset_id)
    b = participant_group(F.col("user_max"), F.col("salt"), dataset_id)
    return spread.withColumn("population", F.when((a == 0) & (b == 0), "train").when((a == 1) & (b == 1), "unseen_both").otherwise("unseen_one"))


def holdout_gate(rows: DataFrame, policy: Policy, salts: tuple[str, ...], dataset_id: str) -> DataFrame:
    """Class counts per salt, fold and set, and whether the fold may be evaluated."""
    counts = holdout_population(rows, salts, dataset_id).groupBy("salt", "timestamp", "population").agg(
        F.count("*").alias("rows"), F.count_if(F.col("label_24h") == 1).alias("positive"), F.count_if(F.col("label_24h") == 0).alias("negative"))
    sums = ("rows", "positive", "negative")
    folds = ready_folds(rows, policy)
    seen = F.col("population") == "train"
    asked = folds.select("test_time", "train_last", F.explode(F.array(*[F.lit(s) for s in salts])).alias("salt"))
    trained = sums_until(counts.where(seen), asked, ["salt"], sums, "train_last").where("rows > 0").select("salt", "test_time", F.lit("train").alias("set_name"), *sums)
    used = counts.join(evaluated_times(folds), "timestamp").withColumn("set_name", F.when(
        (F.col("role") == "validation") & seen, F.col("role")).when((F.col("role") == "test") & ~seen, F.col("population"))).where("set_name IS NOT NULL")
    sets = trained.unionByName(used.groupBy("salt", "test_time", "set_name").agg(*[F.sum(c).alias(c) for c in sums]))
    whole = Window.partitionBy("salt", "test_time")
    enough = (F.min(F.least("positive", "negative")).over(whole) >= policy.min_class_rows) & (F.count("*").over(whole) == 4)
    return sets.withColumn("status", F.when(enough, "evaluated").otherwise("insufficient_class_rows"))
