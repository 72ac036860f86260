"""Average precision under day weights: bootstrap, leave-one-out, per-day and pooled at once.

Rows are never repeated per draw. Per score the counts of each day are kept as a vector, and a
draw is a weight per day, so a thousand draws are one matrix product over the score table.
Days are few (one per snapshot); rows stay distributed by score bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from recontact.functions.metrics import dealt_by_value, exact_quantiles
from recontact.policy import DAY, Policy

def snapshot_times(rows: DataFrame) -> list[int]:
    """The distinct snapshot times, one per study day."""
    return [r.timestamp for r in rows.select("timestamp").distinct().orderBy("timestamp").collect()]


def draw_weights(days: int, draws: int, seed: int) -> np.ndarray:
    """How often each day is drawn when days are resampled with replacement (days x draws)."""
    generator = np.random.default_rng(seed)
    picks = [generator.choice(days, size=days, replace=True) for _ in range(draws)]
    return np.stack([np.bincount(p, minlength=days) for p in picks], axis=1).astype(float)


#: Cells (scores times days) of the count matrices that a task holds at once.
CELLS = 2_000_000


def _listed(day_rows: DataFrame, keys: list[str], kind: int) -> DataFrame:
    """Counts per day as three arrays beside the key; at most one entry per day."""
    entries = F.array_sort(F.collect_list(F.when((F.col("n") > 0), F.struct("timestamp", "n", "pos")))).alias("e")
    made = day_rows.groupBy(*keys).agg(entries)
    return made.select(*keys, F.lit(kind).alias("kind"), F.col("e.timestamp").alias("days"), F.col("e.n").alias("n"), F.col("e.pos").alias("pos"))


def _earlier_days(dealt: DataFrame, keys: list[str], times: list[int]) -> DataFrame:
    """Per range of scores the counts of every day in the group's earlier ranges: ranges times days rows."""
    long = dealt.select(*keys, "part", F.inline(F.arrays_zip(F.col("days").alias("timestamp"), "n", "pos")))
    totals = long.groupBy(*keys, "part", "timestamp").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    spine = dealt.select(*keys, "part").distinct().withColumn("timestamp", F.explode(F.lit(times).cast("array<bigint>")))
    earlier = Window.partitionBy(*keys, "timestamp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c)
    return spine.join(totals, [*keys, "part", "timestamp"], "left").select(*keys, "part", "timestamp", summed("n"), summed("pos"))


def weighted_average_precision(rows: DataFrame, keys: list[str], times: list[int], weights: np.ndarray) -> DataFrame:
    """keys, draw, average_precision for every weight column; the plan is the same for any number of days.

    A score's counts per day are one vector. Vectors are added up in two levels: ranges of scores start at the day totals of the
    group's earlier ranges (ranges times days rows in Spark), and inside a range a task adds them up in score order, a block of rows at a
    time, multiplies with the weights and returns one partial sum per group and block.
    """
    daily = rows.groupBy(*keys, "p", "timestamp").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    dealt = dealt_by_value(_listed(daily, [*keys, "p"], 1), keys, "p", True)
    heads = _listed(_earlier_days(dealt, keys, times), [*keys, "part"], 0).withColumn("p", F.lit(None).cast(rows.schema["p"].dataType))
    ordered = (dealt.unionByName(heads).repartition(*keys, "part")
               .sortWithinPartitions(*keys, "part", "kind", F.col("p").desc()).select(*keys, "kind", "days", "n", "pos"))
    known, block = np.array(times, dtype=np.int64), max(1, CELLS // max(1, len(times)))

    def dense(part: pd.DataFrame, name: str) -> np.ndarray:
        lengths = part["days"].map(len).to_numpy()
        out = np.zeros((len(part), len(known)))
        if lengths.sum():
            day = np.searchsorted(known, np.concatenate(part["days"].to_numpy()))
            out[np.repeat(np.arange(len(part)), lengths), day] = np.concatenate(part[name].to_numpy())
        return out

    def partial(batches):
        shown_before = found_before = np.zeros(len(known))
        for batch in batches:
            edges = sorted({0, len(batch), *np.flatnonzero(batch["kind"].to_numpy() == 0).tolist()})
            for a, b in zip(edges[:-1], edges[1:]):
                if batch["kind"].iat[a] == 0:  # the totals that a range starts at
                    head = batch.iloc[a:a + 1]
                    shown_before, found_before, a = dense(head, "n")[0], dense(head, "pos")[0], a + 1
                for at in range(a, b, block):
                    part = batch.iloc[at:min(at + block, b)]
                    n, pos = dense(part, "n"), dense(part, "pos")
                    shown, found = shown_before + n.cumsum(axis=0), found_before + pos.cumsum(axis=0)
                    shown_before, found_before = shown[-1], found[-1]
                    drawn, seen = pos @ weights, shown @ weights
                    gain = np.divide(drawn * (found @ weights), seen, out=np.zeros_like(drawn), where=seen > 0).sum(axis=0)
                    yield pd.DataFrame({**{k: [part[k].iat[0]] for k in keys}, "gain": [gain.tolist()], "positives": [drawn.sum(axis=0).tolist()]})

    types = dict(rows.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["gain array<double>", "positives array<double>"])
    tall = ordered.mapInPandas(partial, schema).select(*keys, F.posexplode(F.arrays_zip("gain", "positives")).alias("draw", "part"))
    summed = tall.groupBy(*keys, "draw").agg(F.sum("part.gain").alias("gain"), F.sum("part.positives").alias("positives"))
    return summed.select(*keys, "draw", F.when(F.col("positives") > 0, F.col("gain") / F.col("positives")).alias("average_precision"))


def contrast_deltas(scores: DataFrame, contrasts, by: list[str], value: str = "average_precision") -> DataFrame:
    """First minus second model of each contrast; ``scores`` has model, window_days, by..., value."""
    listed = F.array(*[F.struct(
        F.lit(f"{aw}d {a} - {bw}d {b}").alias("contrast"), F.lit(a).alias("a"), F.lit(aw).alias("aw"),
        F.lit(b).alias("b"), F.lit(bw).alias("bw")) for a, aw, b, bw in contrasts])
    sides = scores.withColumn("c", F.explode(listed))
    is_a = (F.col("model") == F.col("c.a")) & (F.col("window_days") == F.col("c.aw"))
    is_b = (F.col("model") == F.col("c.b")) & (F.col("window_days") == F.col("c.bw"))
    return (sides.where(is_a | is_b).groupBy(F.col("c.contrast").alias("contrast"), *by)
            .agg((F.max(F.when(is_a, F.col(value))) - F.max(F.when(is_b, F.col(value)))).alias("delta")))


KEYS = ["model", "window_days"]


def paired_deltas(rows: DataFrame, contrasts) -> DataFrame:
    """Delta AP per day and with each day left out."""
    times = snapshot_times(rows)
    identity = np.eye(len(times))
    scored = weighted_average_precision(rows, KEYS, times, np.concatenate([identity, 1 - identity], axis=1))
    deltas = contrast_deltas(scored, contrasts, ["draw"])
    listed = F.lit(times).cast("array<bigint>")
    day = F.element_at(listed, (F.col("draw") % len(times) + 1).cast("int"))
    return deltas.select("contrast", (F.floor(day / DAY) + 1).alias("study_day"),
                         F.when(F.col("draw") < len(times), "only_this_day").otherwise("without_this_day").alias("kind"),
                         F.col("delta").alias("delta_ap"))


def block_bootstrap(rows: DataFrame, contrasts, policy: Policy) -> DataFrame:
    """95% interval of each pooled AP difference, days resampled together for all models."""
    times = snapshot_times(rows)
    empty = F.lit(None).cast("double")
    if len(times) < policy.bootstrap_min_days:
        listed = [(f"{aw}d {a} - {bw}d {b}",) for a, aw, b, bw in contrasts]
        return rows.sparkSession.createDataFrame(listed, "contrast string").select(
            "contrast", empty.alias("low"), empty.alias("high"), F.lit(len(times)).cast("long").alias("test_days"),
            F.lit("insufficient_days_for_ci").alias("status"))
    weights = draw_weights(len(times), policy.bootstrap_draws, policy.seed)
    scored = weighted_average_precision(rows, KEYS, times, weights)
    deltas = contrast_deltas(scored, contrasts, ["draw"]).where("delta IS NOT NULL")
    ends = exact_quantiles(deltas, ["contrast"], "delta", {"low": 0.025, "high": 0.975})
    return ends.select("contrast", "low", "high", F.lit(len(times)).cast("long").alias("test_days"),
                       F.lit("paired_day_block_bootstrap").alias("status"))


#: The metrics that are summed up across partitions, and what they are called there.
ACROSS = {"average_precision": "ap", "roc_auc": "roc_auc", "brier_score": "brier", "ndcg_at_5": "ndcg_at_5", "precision_at_5": "precision_at_5"}


def partition_summary(metrics: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Across participant partitions: mean, least and most of each metric per model; per contrast every partition's AP difference
    and the number of partitions whose interval excludes zero.

    ``metrics``: salt, population, model and the metrics. ``contrasts``: salt, population, contrast, delta, low, high (null without an interval).
    """
    spread = [f(column).alias(f"{name}_{kind}") for column, name in ACROSS.items() for kind, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    models = metrics.groupBy("population", "model").agg(*spread, F.count("*").alias("partitions"))
    deltas = F.array_sort(F.collect_list(F.struct("salt", "delta")))["delta"]
    found = contrasts.groupBy("population", "contrast").agg(
        deltas.alias("pooled_delta_ap_by_salt"), F.count("low").alias("intervals"),
        F.count_if((F.col("low") > 0) | (F.col("high") < 0)).alias("intervals_excluding_zero"), F.count("*").alias("partitions"))
    return models.unionByName(found, allowMissingColumns=True)
