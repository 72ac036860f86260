"""Binary, ranking and calibration metrics as grouped aggregates.

All curve metrics start from ``score_steps``: rows are first counted per (group, score), then
running totals are taken in two levels (range of scores, then score inside the range), so one
large group is spread over many windows instead of one sort.
Rows need ``label`` (0/1) and ``p`` (0..1); ``keys`` are non-null grouping columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recontact.operators.integrity import refused
from recontact.session import staged

# Log-loss clips at the double machine epsilon (fixed value).
EPSILON = 2.220446049250313e-16


def dealt_by_value(counts: DataFrame, keys: list[str], value: str, descending: bool) -> DataFrame:
    """The rows in even ranges of (group, value), with the number of their range in ``part``.

    The ranges follow the rows and not the values, so scores that all lie close together spread like any others. The
    dealt rows are written: every later use sees the same ranges.
    """
    way = F.col(value).desc() if descending else F.col(value).asc()
    return staged(counts.repartitionByRange(*keys, way).withColumn("part", F.spark_partition_id()), "score-ranges")


def running_totals(counts: DataFrame, keys: list[str], value: str, sums: list[str], descending: bool = True) -> DataFrame:
    """Adds ``cum_x`` (inclusive, in value order) and ``all_x`` (group total) for every sum; values differ within a group.

    Running sums inside a range of values start at the totals of the group's earlier ranges.
    """
    dealt = dealt_by_value(counts, keys, value, descending)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = dealt.groupBy(*keys, "part").agg(*[F.sum(c).alias(f"part_{c}") for c in sums])
    offsets = totals.select(*keys, "part", *[e for c in sums for e in (
        F.coalesce(F.sum(f"part_{c}").over(earlier), F.lit(0)).alias(f"before_{c}"),
        F.sum(f"part_{c}").over(whole).alias(f"all_{c}"))])
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*keys, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(offsets, [*keys, "part"])
    return joined.select(*counts.columns, *[f"all_{c}" for c in sums], *[
        (F.col(f"before_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums])


def score_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))


def score_steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, n, pos, cum_n, cum_pos, all_n, all_pos with totals from the highest score down."""
    return running_totals(score_counts(rows, keys), keys, "p", ["n", "pos"])


def _ap_term() -> Column:
    return F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * F.col("cum_pos") / F.col("cum_n")


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    steps = score_steps(rows, keys)
    return steps.groupBy(*keys).agg(
        F.max("all_n").alias("rows"), F.max("all_pos").alias("positives"),
        F.when(F.max("all_pos") > 0, F.sum(_ap_term())).alias("average_precision"))


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null for one class."""
    return _rank_metrics(score_steps(rows, keys), keys).select(*keys, "rows", "roc_auc")


def _rank_metrics(steps: DataFrame, keys: list[str]) -> DataFrame:
    neg = F.col("n") - F.col("pos")
    all_neg = F.col("all_n") - F.col("all_pos")
    below = all_neg - (F.col("cum_n") - F.col("cum_pos"))
    return steps.groupBy(*keys).agg(
        F.max("all_n").alias("rows"),
        F.when(F.max("all_pos") > 0, F.sum(_ap_term())).alias("average_precision"),
        F.when((F.max("all_pos") > 0) & (F.max(all_neg) > 0),
               F.sum(F.col("pos") * (below + neg / 2)) / (F.max("all_pos") * F.max(all_neg))).alias("roc_auc"))


def _log_loss(label: Column, p: Column) -> Column:
    kept = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -F.when(label == 1, F.log(kept)).otherwise(F.log(1 - kept))


def _pointwise(threshold: str | None) -> list[Column]:
    label, p = F.col("label"), F.col("p")
    out = [F.count("*").alias("rows"), F.avg(label.cast("double")).alias("positive_rate"),
           F.avg((p - label) * (p - label)).alias("brier_score"), F.avg(_log_loss(label, p)).alias("log_loss")]
    if threshold:
        hit = p >= F.col(threshold)
        out += [F.count_if(hit & (label == 1)).alias("tp"), F.count_if(hit & (label == 0)).alias("fp"),
                F.count_if(~hit & (label == 0)).alias("tn"), F.count_if(~hit & (label == 1)).alias("fn")]
    return out


def _decided(counts: DataFrame) -> DataFrame:
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn),
        "accuracy": (tp + tn) / (tp + fp + tn + fn)})


def brier_logloss(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*_pointwise(None))


def threshold_metrics(rows: DataFrame, keys: list[str], threshold: str = "threshold") -> DataFrame:
    return _decided(rows.groupBy(*keys).agg(*_pointwise(threshold))).drop("positive_rate", "brier_score", "log_loss")


def binary_metrics(rows: DataFrame, keys: list[str], threshold: str = "threshold") -> DataFrame:
    """Every headline metric per group: one pointwise pass and one pass over score counts.

    A label that is not 0 or 1 and a score that is not in 0..1 fail the read: they would count as a class or shift the ranks.
    """
    label, p = F.col("label"), F.col("p")
    rows = refused(rows, {"a label that is not 0 or 1": F.coalesce(~label.isin(0, 1), F.lit(True)),
                          "a score outside 0..1": F.coalesce(F.isnan("p") | (p < 0) | (p > 1), F.lit(True))})
    points = _decided(rows.groupBy(*keys).agg(*_pointwise(threshold))).drop("tp", "fp", "tn", "fn")
    ranks = _rank_metrics(score_steps(rows, keys), keys).drop("rows")
    return points.join(ranks, keys).select(
        *keys, "rows", "positive_rate", "average_precision", "roc_auc", "brier_score", "log_loss",
        "precision", "recall", "f1", "accuracy")


def best_threshold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Highest F1; near-equal scores (1e-8 + 1e-5 of the best) go to the threshold nearest 0.5."""
    steps = score_steps(rows, keys).withColumn("f1", 2 * F.col("cum_pos") / (F.col("cum_n") + F.col("all_pos")))
    best = steps.groupBy(*keys).agg(F.max("f1").alias("best"), F.max("all_pos").alias("positives"))
    near = F.abs(F.col("f1") - F.col("best")) <= 1e-8 + 1e-5 * F.col("best")
    choice = F.min(F.struct(F.abs(F.col("p") - 0.5).alias("gap"), F.col("p").alias("p")))
    return (steps.join(best, keys).where(near).groupBy(*keys)
            .agg(F.when(F.max("positives") > 0, choice["p"]).otherwise(F.lit(0.5)).alias("threshold")))


def pr_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    return score_steps(rows, keys).select(*keys, F.col("p").alias("score"), (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
                                          F.when(F.col("all_pos") > 0, F.col("cum_pos") / F.col("all_pos")).alias("recall"))


def roc_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    steps = score_steps(rows, keys)
    negatives = F.col("all_n") - F.col("all_pos")
    return steps.where((F.col("all_pos") > 0) & (negatives > 0)).select(
        *keys, F.col("p").alias("score"), ((F.col("cum_n") - F.col("cum_pos")) / negatives).alias("fpr"),
        (F.col("cum_pos") / F.col("all_pos")).alias("tpr"))


def confusion(rows: DataFrame, keys: list[str], threshold: str = "threshold") -> DataFrame:
    return rows.groupBy(*keys, F.col("label").cast("int").alias("actual"),
                        (F.col("p") >= F.col(threshold)).cast("int").alias("predicted")).agg(F.count("*").alias("rows"))


def reliability(rows: DataFrame, keys: list[str], left_closed: bool = False) -> DataFrame:
    """Ten uniform bins; right-closed for the curve, left-closed for audits and ECE."""
    place = F.least(F.floor(F.col("p") * 10), F.lit(9)) if left_closed else F.greatest(F.ceil(F.col("p") * 10) - 1, F.lit(0))
    return rows.groupBy(*keys, place.cast("int").alias("bin")).agg(
        F.count("*").alias("rows"), F.avg("p").alias("mean_probability"),
        F.avg(F.col("label").cast("double")).alias("observed_fraction"))


def ece(rows: DataFrame, keys: list[str]) -> DataFrame:
    bins = reliability(rows, keys, left_closed=True)
    gap = F.abs(F.col("mean_probability") - F.col("observed_fraction"))
    return bins.groupBy(*keys).agg((F.sum(F.col("rows") * gap) / F.sum("rows")).alias("calibration_error_ece"), F.sum("rows").alias("rows"))


def error_counts(rows: DataFrame, keys: list[str], threshold: str = "threshold") -> DataFrame:
    hit, yes = F.col("p") >= F.col(threshold), F.col("label") == 1
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(hit & yes).alias("true_positive"), F.count_if(hit & ~yes).alias("false_positive"),
        F.count_if(~hit & ~yes).alias("true_negative"), F.count_if(~hit & yes).alias("false_negative"),
        F.count_if((F.col("p") >= 0.8) & ~yes).alias("high_confidence_false_positive"),
        F.count_if((F.col("p") <= 0.2) & yes).alias("high_confidence_false_negative"))


def error_rows(rows: DataFrame, threshold: str = "threshold") -> DataFrame:
    wrong = (F.col("p") >= F.col(threshold)) != (F.col("label") == 1)
    sure = ((F.col("p") >= 0.8) & (F.col("label") == 0)) | ((F.col("p") <= 0.2) & (F.col("label") == 1))
    return rows.where(wrong | sure).withColumn("high_confidence", sure)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles from running counts, without holding a group's values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    steps = running_totals(counts, keys, value, ["n"], descending=False)
    first = F.col("cum_n") - F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("cum_n")), F.col(value)))

    out = []
    for name, q in probabilities.items():
        place = (F.col("all_n") - 1) * F.lit(float(q))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(name))
    return steps.groupBy(*keys).agg(*out)


def weighted_medians(counts: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """Interpolated medians of ``value`` by each of several columns of whole counts, all from one pass of running sums; null without a count.

    ``counts``: one row per key and value.
    """
    steps = running_totals(counts, keys, value, weights, descending=False)

    def median(w: str) -> Column:
        place = (F.col(f"all_{w}") - 1) * F.lit(0.5)
        at = lambda rank: F.max(F.when((F.col(f"cum_{w}") - F.col(w) <= rank) & (rank < F.col(f"cum_{w}")), F.col(value)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return steps.groupBy(*keys).agg(*[median(w).alias(w) for w in weights])


def ranking_metrics(rows: DataFrame, keys: list[str], ks: tuple[int, ...]) -> DataFrame:
    """Mean Precision/Recall/NDCG@K over (timestamp, participant) groups with a positive.

    Every pair counts for both of its ends. The top K of a hub is found per partition before
    the exchange (window group limit), so no participant's full list meets in one task.
    """
    group = [*keys, "timestamp", "participant"]
    ends = F.array(F.struct(F.col("user_min").alias("participant"), F.col("user_max").alias("partner")),
                   F.struct(F.col("user_max").alias("participant"), F.col("user_min").alias("partner")))
    sides = rows.select(*keys, "timestamp", F.inline(ends), "label", "p")
    positives = sides.groupBy(*group).agg(F.sum(F.col("label").cast("long")).alias("positives"))
    order = Window.partitionBy(*group).orderBy(F.col("p").desc(), "partner")
    top = sides.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(ks))
    gain = F.col("label") / F.log2(F.col("rank") + 1)
    found = top.groupBy(*group).agg(*[e for k in ks for e in (
        F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias(f"hits_{k}"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}"))])

    def ideal(k: int) -> Column:
        ranks = F.sequence(F.lit(1), F.least(F.col("positives"), F.lit(k)).cast("int"))
        return F.aggregate(ranks, F.lit(0.0), lambda total, rank: total + 1 / F.log2(rank + 1))

    scored = positives.join(found, group)
    has = F.col("positives") > 0
    means = [e for k in ks for e in (
        F.avg(F.when(has, F.col(f"hits_{k}") / k)).alias(f"precision_at_{k}"),
        F.avg(F.when(has, F.col(f"hits_{k}") / F.col("positives"))).alias(f"recall_at_{k}"),
        F.avg(F.when(has, F.col(f"dcg_{k}") / ideal(k))).alias(f"ndcg_at_{k}"))]
    return scored.groupBy(*keys).agg(F.count_if(has).alias("groups"), F.count_if(~has).alias("groups_without_positive"), *means)


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks, per group."""
    def average_rank(column: str) -> Column:
        order = Window.partitionBy(*keys).orderBy(column)
        ties = Window.partitionBy(*keys, column)
        return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2

    ranked = rows.select(*keys, average_rank(x).alias("rank_x"), average_rank(y).alias("rank_y"))
    # Null for a constant column, where ``corr`` would divide by zero.
    spread = F.stddev_pop("rank_x") * F.stddev_pop("rank_y")
    return ranked.groupBy(*keys).agg(F.try_divide(F.covar_pop("rank_x", "rank_y"), spread).alias("spearman_rho"))


def prediction_entropy(p: Column) -> Column:
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(F.lit(0.0))
    return part(p) + part(1 - p)


def rounded(frame: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column, for comparison and publication."""
    doubles = [f.name for f in frame.schema.fields if f.dataType.simpleString() == "double" and f.name not in skip]
    return frame.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else frame
