"""Rolling predictions of trained learners: every fold, window and learner is a fit with a status of its own."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from recontact.functions.metrics import best_threshold, weighted_medians
from recontact.operators.features import BOUNDED_FEATURES
from recontact.operators.pointintime import KEY
from recontact.plans.models import PARAMETERS, POOL, Preparation, fit_model
from recontact.session import ensure_checkpoint_dir, record_stage, staged

#: Folds whose medians are found by one pass; each is a column of counts.
FOLDS_AT_ONCE = 16
STATUS = "test_time long, window_days int, model string, status string, train_rows long, validation_rows long, test_rows long, threshold double"
SCORED = "test_time long, timestamp long, user_min long, user_max long, label int, window_days int, model string, p double"
PREDICTION = f"{SCORED}, threshold double"


@dataclass(frozen=True)
class Fold:
    """A test time, and the first and last times of what trains and validates; roles are runs of days."""

    test_time: int
    train: tuple[int, int]
    validation: tuple[int, int]


def folds_of(roles: DataFrame) -> list[Fold]:
    """The folds of a fold table (``splits.ready_folds``) or of a role table (test_time, timestamp, role): two spans per fold, whatever the number of its days."""
    if "train_last" in roles.columns:
        ends = roles.select("test_time", "train_first", "train_last", F.array_min("validation").alias("a"), F.array_max("validation").alias("b"))
        return [Fold(r.test_time, (r.train_first, r.train_last), (r.a, r.b)) for r in ends.orderBy("test_time").collect()]
    spans = roles.groupBy("test_time", "role").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()
    by_fold: dict[int, dict] = {}
    for r in spans:
        by_fold.setdefault(r.test_time, {})[r.role] = (r.a, r.b)
    return [Fold(t, s["train"], s["validation"]) for t, s in sorted(by_fold.items()) if {"train", "validation", "test"} <= set(s)]


@dataclass(frozen=True)
class Days:
    """Per window and day: rows, rows of label 1, and rows without a value in each column. What a fold trains on is a sum of days."""

    found: dict[tuple[int, int], tuple]
    columns: tuple[str, ...]

    @classmethod
    def of(cls, rows: DataFrame, columns: tuple[str, ...]) -> "Days":
        daily = rows.groupBy("window_days", "timestamp").agg(
            F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == 1).alias("positive"),
            *[F.count_if(F.col(c).isNull()).alias(f"gaps_{i}") for i, c in enumerate(columns)])
        return cls({(r.window_days, r.timestamp): tuple(r)[2:] for r in daily.collect()}, columns)

    def between(self, window: int, first: int, last: int) -> tuple[int, int, dict[str, int]]:
        """(rows, classes, rows without a value per column) of a run of days."""
        own = [v for (w, t), v in self.found.items() if w == window and first <= t <= last]
        n, labelled, positive, *gaps = [sum(column) for column in zip(*own)] if own else [0] * (3 + len(self.columns))
        return n, (positive > 0) + (labelled > positive), dict(zip(self.columns, gaps))


def fold_medians(rows: DataFrame, folds: list[Fold], columns: tuple[str, ...]) -> dict[tuple[Fold, int], dict[str, float]]:
    """The training medians of every fold and window. Training spans overlap, so each value is counted once, by all folds that train on it.

    One pass for every FOLDS_AT_ONCE folds; no row is repeated per fold.
    """
    found: dict[tuple[Fold, int], dict[str, float]] = {}
    for start in range(0, len(folds), FOLDS_AT_ONCE):
        part = folds[start:start + FOLDS_AT_ONCE]
        weights = [f"n_{i}" for i in range(len(part))]
        tall = rows.select("window_days", "timestamp", F.inline(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))).where("value IS NOT NULL")
        counts = tall.groupBy("window_days", "name", "value").agg(*[
            F.count_if(F.col("timestamp").between(*fold.train)).alias(w) for fold, w in zip(part, weights)])
        for r in weighted_medians(counts, ["window_days", "name"], "value", weights).collect():
            for fold, w in zip(part, weights):
                if r[w] is not None:
                    found.setdefault((fold, r.window_days), {})[r["name"]] = r[w]
    return found


def _fit_one(rows: DataFrame, held: Column, days: Days, tested: Days, medians: dict, fold: Fold, window: int, name: str, seed: int, parameters: dict | None, folder: str) -> tuple:
    """The status of one fit; its scores of the validation and test days are a file of their own."""
    seen = [days.between(window, *fold.train), days.between(window, *fold.validation), tested.between(window, fold.test_time, fold.test_time)]
    state = lambda status: (fold.test_time, window, name, status, *[s[0] for s in seen])
    if seen[0][1] < 2:
        return state("one_class_train")
    if seen[1][1] < 2:
        # No threshold can be chosen; none is made up.
        return state("one_class_validation")
    n, classes, gaps = seen[0]
    if all(gaps[c] == n for c in days.columns):
        return state("no_usable_feature")
    own = rows.where(F.col("window_days") == window)
    preparation = Preparation.of(list(days.columns), medians.get((fold, window), {}), gaps, n, classes)
    model = fit_model(name, own.where(F.col("timestamp").between(*fold.train) & (held != F.lit("only tested"))), window, seed, parameters, days.columns, preparation)
    if isinstance(model.fitted, LogisticRegressionModel) and model.fitted.hasSummary \
            and model.fitted.summary.totalIterations >= {**PARAMETERS[name], **(parameters or {})}["max_iter"]:
        return state("not_settled")
    validates = F.col("timestamp").between(*fold.validation) & (held != F.lit("only tested"))
    scored = model.score(own.where(validates | ((F.col("timestamp") == fold.test_time) & (held != F.lit("never tested"))))).select(
        F.lit(fold.test_time).cast("long").alias("test_time"), *KEY, F.col("label").cast("int").alias("label"),
        F.col("window_days").cast("int").alias("window_days"), F.lit(name).alias("model"), "p")
    scored.write.parquet(f"{folder}/test_time={fold.test_time}/window={window}/learner={name}")
    return state("evaluated")


def rolling_trained(samples: DataFrame, roles: DataFrame, names: tuple[str, ...], windows: tuple[int, ...], seed: int, parameters: dict[str, dict] | None = None,
                    columns: tuple[str, ...] = BOUNDED_FEATURES, pool: int = POOL, held: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, statuses) of every learner over the test rows of all folds and windows.

    ``roles``: folds as rows with spans, or as rows with roles. ``samples``: KEY, window_days, label and the features; written once, by window and day, and read by every fit, at most ``pool`` at a time. A fit trains on
    its fold's training days, chooses its threshold on the same fold's validation days and scores the test day. Its scores are
    a file of their own, so a lost executor repeats one fit. What fits would each work out again (rows, classes, gaps, medians, thresholds)
    is worked out for all of them together. A fit that cannot be made or did not settle has a status row and no
    predictions: one_class_train, one_class_validation, no_usable_feature, not_settled.

    ``held``: a boolean column of rows that are held out: they are tested and nothing else, and the others are never tested.
    """
    spark = samples.sparkSession
    part = F.when(F.col(held), "only tested").otherwise("never tested") if held else F.lit("both")
    rows = staged(samples.select(*KEY, "window_days", "label", *columns, part.alias("held")).repartitionByRange("window_days", "timestamp")
                  .sortWithinPartitions("window_days", "timestamp"), "fold-samples")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/rolling-{uuid.uuid4().hex}"
    record_stage(folder)
    folds = folds_of(roles)
    part = F.col("held")
    own = rows.where(part != "only tested")
    days, medians = Days.of(own, columns), fold_medians(own, folds, columns)
    tested = Days.of(rows.where(part != "never tested"), columns) if held else days
    jobs = [(fold, window, name) for fold in folds for window in windows for name in names]
    with ThreadPoolExecutor(max_workers=pool) as workers:
        states = list(workers.map(lambda job: _fit_one(rows, part, days, tested, medians, *job, seed, (parameters or {}).get(job[2]), folder), jobs))
    made = [f"{folder}/test_time={s[0]}/window={s[1]}/learner={s[2]}" for s in states if s[3] == "evaluated"]
    if not made:
        return spark.createDataFrame([], PREDICTION), spark.createDataFrame([(*s, None) for s in states], STATUS)
    fits = ["test_time", "window_days", "model"]
    scored = spark.read.schema(SCORED).parquet(*made)
    chosen = best_threshold(scored.where(F.col("timestamp") < F.col("test_time")), fits).collect()
    thresholds = {tuple(r[c] for c in fits): float(r.threshold) for r in chosen}
    states = [(*s, thresholds.get(s[:3]) if s[3] == "evaluated" else None) for s in states]
    limits = spark.createDataFrame([(*s[:3], s[-1]) for s in states], "test_time long, window_days int, model string, threshold double")
    found = scored.where(F.col("timestamp") == F.col("test_time")).join(F.broadcast(limits), fits)  # one row per fit
    return found.select(*[f.strip().split(" ")[0] for f in PREDICTION.split(",")]), spark.createDataFrame(states, STATUS)
