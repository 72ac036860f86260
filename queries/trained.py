"""Queries with fitted models, with the settings of plans.models."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from queries.context import Context
from queries.spark_queries import SALTS, _cohort_events, query
from recontact.functions import hawkes, metrics as m, uncertainty
from recontact.functions.timemath import sums_until
from recontact.operators import features as fe, pointintime as pit, splits
from recontact.operators.pointintime import KEY
from recontact.plans import audit, kept_models, models, rolling, rolling_models, sealed
from recontact.plans.study import Study
from recontact.session import ensure_checkpoint_dir, staged

MODEL = ["model", "window_days"]


def recent_bank(c: Context) -> DataFrame:
    """The 1-day candidates' features, written once per session: sealed scores are rows of it, and samples made after it."""
    if not hasattr(c, "_recent_bank"):
        c._recent_bank = staged(c.bounded(c.recent_keys), "recent-bank")
    return c._recent_bank


def samples(c: Context) -> DataFrame:
    """Cohort rows per window with features, label and split, written once per session.

    Half of the days train, so that the validation days can be parted into calibration and tuning. The bank of all
    candidates is read if it is there; otherwise the features of the cohort's keys alone are worked out.
    """
    if not hasattr(c, "_samples"):
        plan = splits.split_plan(splits.time_counts(c.cohort), (0.5, 0.3, 0.2))
        part = splits.validation_plan(plan)
        bank = recent_bank(c) if hasattr(c, "_recent_bank") else c.bounded(c.cohort_keys)
        rows = (bank.join(c.cohort.select(*KEY, F.col("label_24h").cast("int").alias("label")), KEY)
                .join(plan.select("timestamp", "split"), "timestamp").join(part, "timestamp", "left"))
        c._samples = staged(rows, "samples")
    return c._samples


def _fit(c: Context, names, windows, columns=fe.BOUNDED_FEATURES, rows=None):
    """Models with the learners' own settings; those of the shared samples are fitted once per session."""
    if rows is not None:
        return models.train_windows(rows, names, windows, c.policy.seed, columns=columns)
    if not hasattr(c, "_models"):
        c._models = {}
    missing = [name for name in names if any((w, name) not in c._models for w in windows)]
    for model in models.train_windows(samples(c), tuple(missing), tuple(windows), c.policy.seed, columns=columns) if missing else []:
        c._models.setdefault((model.window_days, model.name), model)
    return [c._models[w, name] for w in windows for name in names]


def _test(c: Context) -> DataFrame:
    return samples(c).where("split = 'test'")


def _score(c: Context, name: str) -> DataFrame:
    return models.predictions(_fit(c, (name,), (7,)), _test(c), ("label",))


@query
def score_logistic(c: Context):
    return _score(c, "logistic_regression")


@query
def score_forest(c: Context):
    return _score(c, "random_forest")


@query
def score_gbt(c: Context):
    return _score(c, "boosted_trees")


@query
def train_windows(c: Context):
    fitted = _fit(c, ("logistic_regression", "boosted_trees"), c.policy.windows)
    return m.binary_metrics(models.predictions(fitted, _test(c), ("label",)), MODEL)


@query
def grid_search(c: Context):
    return models.grid_search(samples(c), "logistic_regression", 7, [{"reg": r} for r in (0.1, 1.0, 10.0)], c.policy.seed)


def _calibrated(c: Context) -> DataFrame:
    model = _fit(c, ("logistic_regression",), (7,))[0]
    early = model.score(samples(c).where("window_days = 7 AND part = 'calibration'")).select("label", "p")
    test = model.score(_test(c).where("window_days = 7")).select(*KEY, "label", "p")
    sigmoid = models.calibrate(test, early, "sigmoid").withColumn("method", F.lit("sigmoid"))
    isotonic = models.calibrate(test, early, "isotonic").withColumn("method", F.lit("isotonic"))
    return sigmoid.unionByName(isotonic)


@query
def calibrate(c: Context):
    return _calibrated(c).select(*KEY, "method", "label", "p", "q")


@query
def calibration_compare(c: Context):
    both = _calibrated(c).select("method", "label", F.inline(F.array(
        F.struct(F.lit("before").alias("stage"), F.col("p").alias("p")), F.struct(F.lit("after").alias("stage"), F.col("q").alias("p")))))
    keys = ["method", "stage"]
    return m.brier_logloss(both, keys).join(m.ece(both, keys).drop("rows"), keys)


def ablation_bank(c: Study) -> DataFrame:
    """The 14-day bank of the cohort's keys alone: the known pairs of every day are many times as many."""
    return fe.feature_bank(c.pairs, c.user_days, c.cohort_keys, c.span)


@query
def window_ablation(c: Context):
    """The 14-day bank of the cohort masked to each model window; communication features stay unavailable."""
    plan = splits.split_plan(splits.time_counts(c.cohort), c.policy.fractions)
    base = ablation_bank(c).join(c.cohort.select(*KEY, F.col("label_24h").cast("int").alias("label")), KEY).join(plan.select("timestamp", "split"), "timestamp")
    rows = None
    for w in c.policy.bank_windows:
        part = fe.feature_window_view(base, w).withColumn("window_days", F.lit(w))
        rows = part if rows is None else rows.unionByName(part)
    rows = staged(rows, "ablation")
    fitted = _fit(c, ("logistic_regression",), c.policy.bank_windows, fe.BANK_FEATURES, rows)
    scored = models.predictions(fitted, rows.where("split = 'validation'"), ("label",))
    measured = m.binary_metrics(scored, MODEL).withColumn("status", F.lit("available"))
    absent = c.spark.createDataFrame([("communications", 14, "not_available")], "model string, window_days int, status string")
    return measured.unionByName(absent, allowMissingColumns=True)


@query
def sensitivity(c: Context):
    model = _fit(c, ("logistic_regression",), (7,))[0]
    return models.sensitivity(model, _test(c).where("window_days = 7"))


@query
def feature_importance(c: Context):
    return models.importance_table(_fit(c, ("logistic_regression", "random_forest"), (7,)), c.spark)


def _sealed(c: Context) -> str:
    """Folder of the sealed scores of every available 1-day candidate after the information deadline, by each window's model."""
    if not hasattr(c, "_sealed"):
        bank = audit.audited_rows(c, recent_bank(c))  # first: the samples are then rows of it
        fitted = _fit(c, ("logistic_regression",), c.policy.windows)
        ready = audit.availability(bank).where("prediction_available").select(*KEY)
        deadline = kept_models.label_deadline(samples(c))
        scores = models.predictions(fitted, bank.join(ready, KEY, "left_semi").where(F.col("timestamp") >= deadline))
        ensure_checkpoint_dir(c.spark)
        folder = f"{c.spark.sparkContext.getCheckpointDir()}/sealed-{uuid.uuid4().hex}"
        sealed.seal(scores, folder, deadline, by=MODEL)
        c._sealed = folder
    return c._sealed


@query
def asof_scores(c: Context):
    """Scores as they were sealed, before any outcome was read."""
    return sealed.unsealed(c.spark, _sealed(c))[0]


@query
def revealed_scores(c: Context):
    """Sealed scores beside the outcomes that were revealed afterwards."""
    folder = _sealed(c)
    outcomes = pit.reveal_outcomes(c.reveal_keys, c.contacts, c.seen, c.span)
    return sealed.reveal(c.spark, folder, outcomes.select(*KEY, F.col("label_24h").cast("int").alias("label"), "outcome", "outcome_reason"))


def _hawkes(c: Context) -> DataFrame:
    if not hasattr(c, "_hawkes"):
        c._hawkes = staged(hawkes.hawkes_forecast(_cohort_events(c), c.policy, c.policy.half_life_hours), "hawkes")
    return c._hawkes


def _half_lives(c: Context) -> DataFrame:
    labels = c.cohort.select(*KEY, F.col("label_24h").cast("int").alias("label"))
    rows = _hawkes(c).join(labels, KEY).join(c.folds.select("test_time", F.explode("validation").alias("timestamp")), "timestamp")
    keys = ["test_time", "half_life_hours"]
    scored = m.average_precision(rows, keys).join(m.best_threshold(rows, keys), keys)
    order = Window.partitionBy("test_time").orderBy(F.col("average_precision").desc(), "half_life_hours")
    return (scored.withColumn("place", F.row_number().over(order)).where("place = 1")
            .select("test_time", "half_life_hours", "average_precision", "threshold"))


@query
def select_half_life(c: Context):
    """Per fold the half-life with the best validation AP (ties: the shorter), and its threshold."""
    return _half_lives(c)


@query
def score_gbt_hawkes(c: Context):
    """Boosted trees with the forecast of every half-life as further columns."""
    names = [f"hawkes_{i}" for i in range(len(c.policy.half_life_hours))]
    wide = _hawkes(c).groupBy(*KEY).agg(*[
        F.max(F.when(F.col("half_life_hours") == h, F.col("p"))).alias(n) for n, h in zip(names, c.policy.half_life_hours)])
    rows = staged(samples(c).where("window_days = 7").join(wide, KEY), "hawkes-samples")
    fitted = _fit(c, ("boosted_trees",), (7,), (*fe.BOUNDED_FEATURES, *names), rows)
    return models.predictions(fitted, rows.where("split = 'test'"), ("label",))


def _holdout(c: Context) -> DataFrame:
    """Train on pairs inside one half of the participants, test on pairs that touch the other."""
    rows = staged(splits.holdout_population(samples(c).where("window_days = 7"), SALTS, "scans"), "holdout")

    def part(salt: str) -> DataFrame:
        mine = rows.where(F.col("salt") == salt)
        model = _fit(c, ("logistic_regression",), (7,), rows=mine.where("population = 'train'"))
        return models.predictions(model, mine.where("split = 'test' AND population <> 'train'"), ("label", "population", "salt"))

    return reduce(DataFrame.unionByName, models.in_pool(part, SALTS))


@query
def holdout_scores(c: Context):
    return _holdout(c)


#: What the learner that has not seen the participants is compared with: the same learner over all participants, and two rules.
HELD = "logistic_regression_holdout"
HELD_CONTRASTS = tuple((HELD, 7, other, 7) for other in ("logistic_regression", "hawkes", "historical_frequency_holdout"))


def _hawkes_tests(c: Context) -> DataFrame:
    """Test forecasts of every fold at the half-life of its best validation AP."""
    best = F.broadcast(_half_lives(c).select(F.col("test_time").alias("timestamp"), "half_life_hours"))  # a row per fold
    return _hawkes(c).join(best, ["timestamp", "half_life_hours"]).select(*KEY, F.col("p").alias("hawkes"))


def _held_frequency(c: Context, folds: DataFrame) -> DataFrame:
    """Historical frequency; a pair without one has the rate of the training population at the fold's last training day."""
    rows = c.scored_cohort.where("window_days = 7").select(*KEY, "label", "probability")
    seen = splits.holdout_population(rows, SALTS, "scans").where("population = 'train'")
    daily = seen.groupBy("salt", "timestamp").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    prior = (sums_until(daily, folds.select("salt", "test_time", "train_last"), ["salt"], ("pos", "n"), "train_last").where("n > 0")
             .select("salt", F.col("test_time").alias("timestamp"), (F.col("pos") / F.col("n")).alias("prior")))
    known = F.least(F.greatest(F.col("probability"), F.lit(0.0)), F.lit(1.0))
    return rows.join(F.broadcast(prior), "timestamp").select("salt", *KEY, F.coalesce(known, "prior").alias("historical_frequency_holdout"))


def _holdout_study(c: Context) -> DataFrame:
    """Rolling test scores of pairs with participants that no fit of their partition has seen, beside those of the references.

    Per partition the folds with enough rows of both classes in every set train and choose thresholds on pairs of the one half and
    test the others. All models are compared on the same rows.
    """
    if not hasattr(c, "_holdout_rows"):
        own = samples(c).where("window_days = 7")
        gate = splits.holdout_gate(c.cohort, c.policy, SALTS, "scans").where("status = 'evaluated'").select("salt", "test_time").distinct()
        folds = staged(c.folds.join(gate, "test_time"), "holdout-folds")

        def partition(salt: str) -> DataFrame:
            rows = splits.holdout_population(own, (salt,), "scans").withColumn("held", F.col("population") != "train")
            mine = folds.where(F.col("salt") == salt).drop("salt")
            return splits.holdout_population(rolling_models.rolling_trained(
                rows, mine, ("logistic_regression",), (7,), c.policy.seed, held="held")[0], (salt,), "scans")

        held = reduce(DataFrame.unionByName, [partition(salt) for salt in SALTS])
        seen = _rolling(c)[0] if hasattr(c, "_rolling_trained") else rolling_models.rolling_trained(
            own, c.folds, ("logistic_regression",), (7,), c.policy.seed)[0]
        wide = (held.select("salt", "population", *KEY, "label", F.col("p").alias(HELD))
                .join(seen.where("window_days = 7").select(*KEY, F.col("p").alias("logistic_regression")), KEY)
                .join(_hawkes_tests(c), KEY).join(_held_frequency(c, folds), ["salt", *KEY]))
        models_ = F.array(*[F.struct(F.lit(name).alias("model"), F.col(name).alias("p")) for name in (HELD, *[other for _, _, other, _ in HELD_CONTRASTS])])
        c._holdout_rows = staged(wide.select("salt", "population", *KEY, "label", F.lit(7).alias("window_days"), F.inline(models_)), "holdout-study")
    return c._holdout_rows


@query
def partition_summary(c: Context):
    rows, cell = _holdout_study(c), ["salt", "population", "model", "window_days"]
    # Thresholds differ per fold, so no metric at a threshold is summed up.
    measured = m.binary_metrics(rows.withColumn("threshold", F.lit(None).cast("double")), cell).join(m.ranking_metrics(rows, cell, (5,)), cell)
    metrics = staged(measured.select(*cell, *uncertainty.ACROSS), "holdout-metrics")
    deltas = uncertainty.contrast_deltas(metrics, HELD_CONTRASTS, ["salt", "population"])

    def interval(key) -> DataFrame:
        own = rows.where((F.col("salt") == key.salt) & (F.col("population") == key.population))
        return staged(uncertainty.block_bootstrap(own, HELD_CONTRASTS, c.policy).select(
            F.lit(key.salt).alias("salt"), F.lit(key.population).alias("population"), "contrast", "low", "high"), "holdout-interval")

    made = models.in_pool(interval, metrics.select("salt", "population").distinct().collect())
    empty = c.spark.createDataFrame([], "salt string, population string, contrast string, low double, high double")
    intervals = reduce(DataFrame.unionByName, made, empty)
    return uncertainty.partition_summary(metrics, deltas.join(intervals, ["salt", "population", "contrast"], "left"))


def _rolling(c: Context) -> tuple[DataFrame, DataFrame]:
    """Every ready fold and window of the logistic learner; the tree learners run through the same call, at minutes a fold."""
    if not hasattr(c, "_rolling_trained"):
        c._rolling_trained = rolling_models.rolling_trained(samples(c), c.folds, ("logistic_regression",), tuple(c.policy.windows), c.policy.seed)
    return c._rolling_trained


@query
def rolling_trained(c: Context):
    return _rolling(c)[0]


@query
def rolling_fit_status(c: Context):
    return _rolling(c)[1]


@query
def rolling_trained_summary(c: Context):
    return rolling.rolling_summary(_rolling(c)[0].drop("test_time"), c.policy)


@query
def kept_model_scores(c: Context):
    """Test scores of a model that was saved with its contract, checked and loaded again; all lie after its information deadline."""
    model, = _fit(c, ("logistic_regression",), (7,))
    ensure_checkpoint_dir(c.spark)
    folder = f"{c.spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    kept_models.save(c.spark, model, samples(c), folder, fe.BOUNDED_FEATURES)
    again, terms = kept_models.load(c.spark, folder, 7, fe.BOUNDED_FEATURES)
    return kept_models.score_after_deadline(again, terms, _test(c)).select(*KEY, "window_days", "p", F.lit(again.threshold).alias("threshold"))
