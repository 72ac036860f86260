"""A fixed rule scorecard over a table of questionnaire answers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

# Answer points per scored factor (fixed values). An answer without points counts as unknown.
POINTS = {
    "frequency": {"zero": 0, "one_two": 35, "three_five": 70, "six_plus": 100},
    "distance": {"same_area": 100, "walkable": 75, "city_far": 30, "different_city": 0},
    "area": {"often": 100, "sometimes": 55, "rare": 0},
    "timing": {"often": 100, "sometimes": 55, "different": 0},
    "recency": {"day": 100, "week": 75, "month": 45, "older": 15, "never": 0},
}
# Level limits (fixed values).
MEDIUM_FROM, HIGH_FROM, MIN_KNOWN = 35, 70, 3


def _points(field: str) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(POINTS[field].items())])
    return F.element_at(table, F.col(field))


def _invalid(field: str) -> Column:
    allowed = [*POINTS[field], "unknown"]
    return F.col(field).isNotNull() & ~F.col(field).isin(*allowed)


def scorecard(answers: DataFrame) -> DataFrame:
    """Adds status, known factors, score (mean of known points, half up) and level."""
    known = F.array_compact(F.array(*[_points(f) for f in POINTS]))
    count = F.size(known)
    total = F.aggregate(known, F.lit(0), lambda a, b: a + b)
    invalid = F.lit(False)
    for field in POINTS:
        invalid = invalid | _invalid(field)
    invalid = invalid | (F.col("arrangement").isNotNull() & ~F.col("arrangement").isin("yes", "no", "unknown"))
    clash = F.coalesce((F.col("frequency").isin("one_two", "three_five", "six_plus") & F.col("recency").isin("older", "never"))
                       | ((F.col("frequency") == "zero") & F.col("recency").isin("day", "week", "month")), F.lit(False))
    status = (F.when(invalid, "invalid").when(F.coalesce(F.col("arrangement") == "yes", F.lit(False)), "out_of_scope")
              .when(F.coalesce(F.col("arrangement") != "no", F.lit(True)), "needs_confirmation")
              .when(F.col("relationship").isNull(), "invalid").when(clash, "inconsistent")
              .when(F.col("known_factors") < MIN_KNOWN, "insufficient").otherwise("ready"))
    rated = answers.withColumn("known_factors", count).withColumn("points", total).withColumn("status", status)
    score = F.when(F.col("status") == "ready", F.floor((2 * F.col("points") + F.col("known_factors")) / (2 * F.col("known_factors")))).cast("int")
    level = F.when(score < MEDIUM_FROM, "low").when(score < HIGH_FROM, "medium").when(score.isNotNull(), "high")
    return rated.withColumn("score", score).withColumn("level", F.when(score.isNotNull(), level)).drop("points")
