"""Small-count suppression and the published re-contact reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recontact.policy import DAY, Policy


def suppressed_histogram(bins: DataFrame, group: str, minimum: int) -> DataFrame:
    """All bins of a group are withheld when any non-empty one is too small."""
    smallest = F.min("count").over(Window.partitionBy(group))
    return bins.withColumn("status", F.when(smallest < minimum, "suppressed_small_groups").otherwise("aggregate")).withColumn(
        "bin", F.when(F.col("status") == "aggregate", F.col("bin"))).withColumn(
        "count", F.when(F.col("status") == "aggregate", F.col("count"))).distinct()


def suppress_cells(frame: DataFrame, columns: list[str], minimum: int) -> DataFrame:
    return frame.withColumns({c: F.when((F.col(c) == 0) | (F.col(c) >= minimum), F.col(c)) for c in columns})


def suppress_family(frame: DataFrame, counts: list[str], dependent: list[str], minimum: int) -> DataFrame:
    """One small count hides the whole family of counts and the ratios made from them."""
    small = F.exists(F.array(*[F.col(c).cast("long") for c in counts]), lambda n: (n > 0) & (n < minimum))
    marked = frame.withColumn("disclosure_status", F.when(small, "suppressed_small_counts_and_ratios").otherwise("aggregate_only"))
    shown = F.col("disclosure_status") == "aggregate_only"
    return marked.withColumns({c: F.when(shown, F.col(c)) for c in [*counts, *dependent]})


# Cell edges of the reference table (fixed values): recency [low, high) in days, frequency inclusive.
RECENCY = (("day", 0, 1), ("week", 1, 7), ("month", 7, 30))
FREQUENCY = (("zero", 0, 0), ("one_two", 1, 2), ("three_five", 3, 5), ("six_plus", 6, 14))


def reference_table(labels: DataFrame, bank: DataFrame, policy: Policy) -> DataFrame:
    """Re-contact rate by recency and contact days, hidden for small cells."""
    rows = (labels.where("eligible_for_evaluation AND label_24h IS NOT NULL")
            .join(bank.where("history_complete_14d = 1"), ["timestamp", "user_min", "user_max"]))
    age, days = F.col("time_since_last_contact"), F.col("unique_contact_days_14d")
    recency = F.coalesce(*[F.when((age >= low * DAY) & (age < high * DAY), name) for name, low, high in RECENCY])
    frequency = F.coalesce(*[F.when(days.between(low, high), name) for name, low, high in FREQUENCY])
    counted = rows.groupBy(recency.alias("recency"), frequency.alias("frequency")).agg(
        F.count("*").alias("n"), F.sum(F.col("label_24h").cast("long")).alias("positive"))
    spine = labels.sparkSession.createDataFrame([(r[0], f[0]) for r in RECENCY for f in FREQUENCY], "recency string, frequency string")
    cells = spine.join(counted, ["recency", "frequency"], "left")
    n, positive = F.coalesce("n", F.lit(0)), F.coalesce("positive", F.lit(0))
    shown = (n >= policy.reference_min_rows) & (F.least(positive, n - positive) >= policy.reference_min_class)
    return cells.select("recency", "frequency", F.when(shown, n).alias("samples"),
                        F.when(shown, F.round(positive / n, 3)).alias("recontact_rate"), (~shown).alias("suppressed"))


def reference_lookup(answers: DataFrame, table: DataFrame) -> DataFrame:
    found = answers.join(F.broadcast(table), ["recency", "frequency"], "left")  # twelve rows
    return found.withColumn("status", F.when(F.col("suppressed").isNull(), "unavailable")
                            .when(F.col("suppressed"), "suppressed").otherwise("ready")).drop("suppressed")
