"""Trained classifiers on bounded feature banks, with MLlib."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recontact.functions.metrics import best_threshold, binary_metrics, exact_quantiles
from recontact.operators.features import BOUNDED_FEATURES
from recontact.operators.pointintime import KEY
from recontact.plans import forests
from recontact.session import ensure_checkpoint_dir, record_stage, recorded_stages, remove_stages, staged

# Defaults of the compared learners (fixed values). Forests have no limit of depth; 30 is MLlib's own.
PARAMETERS = {
    "logistic_regression": {"max_iter": 1000},
    "random_forest": {"trees": 200, "min_leaf": 2, "depth": 30},
    "boosted_trees": {"trees": 200, "depth": 4, "rate": 0.05},
}

#: Training rows times trees that MLlib grows at once. There a tree grows with the rows and is held by the driver while it
#: grows, so a forest over more rows is grown by tasks (``forests``) or, over more cells than a task holds, by MLlib in groups of
#: trees. Either way it is kept in groups of so many rows times trees (of one tree at least), so that MLlib can load each. A group
#: at this bound has about 160,000 nodes on the given tables, which a driver heap of 750 MB holds.
ROWS_TIMES_TREES = 500_000

#: Fits that run at the same time; each is a series of Spark jobs of its own.
POOL = 4


@dataclass
class Preparation:
    """Columns kept from training, their medians and missing indicators; rows and classes of what was trained on."""

    columns: list[str]
    medians: dict[str, float]
    indicators: list[str]
    rows: int = 0
    classes: int = 0

    @classmethod
    def of(cls, columns: list[str], medians: dict[str, float], gaps: dict[str, int], rows: int, classes: int) -> "Preparation":
        kept = [c for c in columns if c in medians]
        return cls(kept, {c: medians[c] for c in kept}, [c for c in kept if gaps[c] > 0], rows, classes)

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> "Preparation":
        """Exact medians of all columns in one long-form pass; all-null columns are dropped."""
        tall = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))
        medians = {r["name"]: r["median"] for r in exact_quantiles(tall, ["name"], "value", {"median": 0.5}).collect()}
        gaps = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
        found = train.agg(F.struct(*gaps).alias("gaps"), F.count("*").alias("n"), F.count_if(F.col("label").isNotNull()).alias("labelled"),
                          F.min("label").alias("least"), F.max("label").alias("most")).first()
        classes = 0 if not found.labelled else 1 + (found.least != found.most)
        return cls.of(columns, medians, found.gaps.asDict(), found.n, classes)

    @property
    def names(self) -> list[str]:
        return [*self.columns, *[f"missing_{c}" for c in self.indicators]]

    def transform(self, frame: DataFrame) -> DataFrame:
        filled = {f"x_{c}": F.coalesce(F.col(c), F.lit(self.medians[c])) for c in self.columns}
        flags = {f"x_missing_{c}": F.col(c).isNull().cast("double") for c in self.indicators}
        ready = frame.withColumns({**filled, **flags})
        made = [*filled, *flags]
        return VectorAssembler(inputCols=made, outputCol="features").transform(ready).drop(*made)


@dataclass
class Model:
    name: str
    preparation: Preparation
    fitted: object
    window_days: int
    threshold: float = 0.5
    parameters: dict = field(default_factory=dict)

    def score(self, frame: DataFrame) -> DataFrame:
        if isinstance(self.fitted, GroupedForest):
            return self.fitted.score(self.preparation.transform(frame))
        scored = self.fitted.transform(self.preparation.transform(frame))
        return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def importance(self) -> list[tuple[str, float]]:
        values = getattr(self.fitted, "featureImportances", None)
        weights = values.toArray() if values is not None else abs(self.fitted.coefficients.toArray())
        return sorted(zip(self.preparation.names, map(float, weights)), key=lambda item: (-item[1], item[0]))


@dataclass
class GroupedForest:
    """A random forest whose groups of trees lie in the shared folder, each as MLlib saves a forest."""

    folders: list[str]
    trees: list[int]
    listed: DataFrame  # all trees as rows
    featureImportances: DenseVector

    @classmethod
    def of(cls, folders: list[str], trees: list[int], listed: DataFrame) -> "GroupedForest":
        return cls(folders, trees, listed, DenseVector(forests.importances(listed)))

    @classmethod
    def grow(cls, estimator: RandomForestClassifier, ready: DataFrame, group: int) -> "GroupedForest":
        """All trees grown by tasks that hold the rows."""
        trees = cls.parts(estimator.getNumTrees(), group)
        folders, listed = forests.grow(estimator, ready, trees)
        return cls.of(folders, trees, listed)

    @classmethod
    def fit(cls, estimator: RandomForestClassifier, ready: DataFrame, group: int) -> "GroupedForest":
        """Group by group by MLlib; the driver holds one group at a time."""
        spark = ready.sparkSession
        ensure_checkpoint_dir(spark)
        trees = cls.parts(estimator.getNumTrees(), group)
        folders = []
        for number, n in enumerate(trees):
            folder = f"{spark.sparkContext.getCheckpointDir()}/forest-{uuid.uuid4().hex}"
            record_stage(folder)
            # Groups need seeds of their own, or they would be the same trees again. A group of one tree would choose among
            # all columns at every node if it were not told that it is part of a forest.
            part = estimator.copy({estimator.numTrees: n, estimator.seed: estimator.getSeed() + number,
                                   estimator.featureSubsetStrategy: "sqrt" if len(trees) > 1 else "auto"}).fit(ready)
            part.write().save(folder)
            folders.append(folder)
            del part  # or the driver holds it while the next group grows
        return cls.of(folders, trees, forests.read(spark, folders, trees))

    @staticmethod
    def parts(whole: int, group: int) -> list[int]:
        return [min(group, whole - start) for start in range(0, whole, group)]

    def save(self, folder: str) -> None:
        for number, part in enumerate(self.folders):
            RandomForestClassificationModel.load(part).write().save(f"{folder}/group-{number}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, trees: list[int]) -> "GroupedForest":
        folders = [f"{folder}/group-{number}" for number in range(len(trees))]
        return cls.of(folders, trees, forests.read(spark, folders, trees))

    def score(self, ready: DataFrame) -> DataFrame:
        """The rows with ``p``, the mean of all trees; tasks hold a few trees and the rows that they vote on."""
        spark, rest = ready.sparkSession, [c for c in ready.columns if c != "features"]
        with recorded_stages() as written:
            rows = staged(ready.withColumn("row", F.monotonically_increasing_id()), "votes")  # written, or a later read would number them anew
            means = forests.scored(self.listed, sum(self.trees), rows)
            made = written[:]
            result = staged(rows.join(means, "row").select(*rest, "p"), "votes")
            remove_stages(spark, made)
        return result


def _estimator(name: str, parameters: dict, rows: int, seed: int):
    options = {**PARAMETERS[name], **parameters}
    if name == "logistic_regression":
        # regParam 1/rows is an L2 penalty of strength 1 on standardised columns.
        return LogisticRegression(labelCol="label", maxIter=options["max_iter"], regParam=options.get("reg", 1.0) / rows, standardization=True)
    if name == "random_forest":
        # Node ids are kept beside the rows; otherwise the driver sends all trees to every task of every level.
        return RandomForestClassifier(labelCol="label", numTrees=options["trees"], minInstancesPerNode=options["min_leaf"],
                                      maxDepth=options["depth"], seed=seed, cacheNodeIds=True)
    if name == "boosted_trees":
        return GBTClassifier(labelCol="label", maxIter=options["trees"], maxDepth=options["depth"], stepSize=options["rate"], seed=seed)
    raise ValueError(f"unknown model {name}")


def fit_model(name: str, train: DataFrame, window_days: int, seed: int, parameters: dict | None = None,
              columns: tuple[str, ...] = BOUNDED_FEATURES, preparation: Preparation | None = None) -> Model:
    """``preparation``: that of the same training rows and columns, where several models share it."""
    preparation = preparation or Preparation.fit(train, list(columns))
    if preparation.classes != 2:
        raise ValueError("training needs both classes")
    if not preparation.columns:
        raise ValueError("no usable feature in the training rows")
    ready = preparation.transform(train).select(F.col("label").cast("double").alias("label"), "features")
    estimator = _estimator(name, parameters or {}, preparation.rows, seed)
    group = max(1, ROWS_TIMES_TREES // preparation.rows)
    if name == "random_forest" and group < estimator.getNumTrees():
        held = preparation.rows * len(preparation.names) <= forests.TASK_CELLS
        grown = (GroupedForest.grow if held else GroupedForest.fit)(estimator, staged(ready, "forest-rows"), group)
        return Model(name, preparation, grown, window_days, parameters=parameters or {})
    return Model(name, preparation, estimator.fit(ready), window_days, parameters=parameters or {})


def in_pool(function, jobs) -> list:
    """The results in the order of the jobs, POOL at a time: a fit is a long series of small Spark jobs, which leaves most cores idle."""
    with ThreadPoolExecutor(max_workers=POOL) as workers:
        return list(workers.map(function, jobs))


def choose_threshold(model: Model, validation: DataFrame) -> Model:
    row = best_threshold(model.score(validation).select(F.lit(0).alias("g"), "label", "p"), ["g"]).first()
    model.threshold = float(row.threshold) if row else 0.5
    return model


def train_windows(samples: DataFrame, names: tuple[str, ...], windows: tuple[int, ...], seed: int, parameters: dict[str, dict] | None = None,
                  columns: tuple[str, ...] = BOUNDED_FEATURES) -> list[Model]:
    """One model per (window, name): fit on train, threshold on validation.

    ``samples``: KEY, window_days, split, label and the features; materialise it before calling.
    """
    def part(w: int, split: str) -> DataFrame:
        return samples.where(F.col("window_days") == w).where(F.col("split") == split)

    def fit(job: tuple) -> Model:
        w, name = job
        model = fit_model(name, part(w, "train"), w, seed, (parameters or {}).get(name), columns, prepared[w])
        return choose_threshold(model, part(w, "validation"))

    prepared = dict(zip(windows, in_pool(lambda w: Preparation.fit(part(w, "train"), list(columns)), windows)))
    jobs = [(w, name) for w in windows for name in names]
    # The driver holds a forest while it grows, so forests follow one another.
    forests = [job for job in jobs if job[1] == "random_forest"]
    others = [job for job in jobs if job not in forests]
    fitted = dict(zip(others, in_pool(fit, others))) | {job: fit(job) for job in forests}
    return [fitted[job] for job in jobs]


def predictions(models: list[Model], samples: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long predictions of all models over the rows of their own window."""
    result = None
    for model in models:
        part = model.score(samples.where(F.col("window_days") == model.window_days)).select(
            *KEY, *keep, "window_days", F.lit(model.name).alias("model"), "p", F.lit(model.threshold).alias("threshold"))
        result = part if result is None else result.unionByName(part)
    return result


def grid_search(samples: DataFrame, name: str, window_days: int, grid: list[dict], seed: int) -> DataFrame:
    """Validation metrics per parameter set; the best has the least log-loss."""
    if not 0 < len(grid) <= 32:
        raise ValueError("a grid has 1..32 parameter sets")
    rows = samples.where(F.col("window_days") == window_days)
    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")
    preparation = Preparation.fit(train, list(BOUNDED_FEATURES))

    def trial(job: tuple) -> DataFrame:
        number, options = job
        model = fit_model(name, train, window_days, seed, options, preparation=preparation)
        scored = staged(model.score(validation).select("label", "p"), "trial")
        chosen = best_threshold(scored.withColumn("g", F.lit(0)), ["g"]).first()
        return scored.select(F.lit(number).alias("trial"), F.lit(str(sorted(options.items()))).alias("parameters"),
                             "label", "p", F.lit(float(chosen.threshold) if chosen else 0.5).alias("threshold"))

    result = reduce(DataFrame.unionByName, in_pool(trial, enumerate(grid)))
    metrics = binary_metrics(result, ["trial", "parameters"])
    least = metrics.agg(F.min(F.struct("log_loss", "trial"))["trial"].alias("t")).scalar()
    return metrics.withColumn("selected", F.col("trial") == least)


def _log_odds(p: Column) -> Column:
    kept = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.log(kept / (1 - kept))


def calibrate(scored: DataFrame, calibration: DataFrame, method: str) -> DataFrame:
    """Adds calibrated ``q``; the calibrator sees early validation rows only (label, p)."""
    support = calibration.agg(F.count("*").alias("n"), F.count_distinct("label").alias("classes")).first()
    if support.classes != 2:
        raise ValueError("the calibration rows need both classes; use a longer validation period")
    if method == "isotonic":
        fitted = IsotonicRegression(labelCol="label", featuresCol="p").fit(calibration.select(F.col("label").cast("double").alias("label"), "p"))
        return fitted.setPredictionCol("q").transform(scored)
    if method != "sigmoid":
        raise ValueError("calibration is sigmoid or isotonic")
    assemble = VectorAssembler(inputCols=["log_odds"], outputCol="features")
    ready = assemble.transform(calibration.select(F.col("label").cast("double").alias("label"), _log_odds(F.col("p")).alias("log_odds")))
    fitted = LogisticRegression(regParam=1.0 / support.n, standardization=False).fit(ready)
    slope, offset = float(fitted.coefficients[0]), float(fitted.intercept)
    return scored.withColumn("q", 1 / (1 + F.exp(-(slope * _log_odds(F.col("p")) + offset))))


def sensitivity(model: Model, rows: DataFrame, top: int = 10) -> DataFrame:
    """Change of p when one feature is set to its training median, largest first per row."""
    from pyspark.sql import Window
    columns = model.preparation.columns
    base = model.score(rows).withColumn("base_p", F.col("p")).drop("p")
    spread = base.withColumn("replaced", F.explode(F.array(*[F.lit(c) for c in columns])))
    changed = spread.withColumns({c: F.when(F.col("replaced") == c, F.lit(model.preparation.medians[c])).otherwise(F.col(c)) for c in columns})
    scored = model.score(changed).select(*KEY, F.col("replaced").alias("feature"), (F.col("base_p") - F.col("p")).alias("contribution"))
    order = Window.partitionBy(*KEY).orderBy(F.abs("contribution").desc(), "feature")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def importance_table(models: list[Model], spark) -> DataFrame:
    rows = [(m.name, m.window_days, feature, value) for m in models for feature, value in m.importance()]
    return spark.createDataFrame(rows, "model string, window_days int, feature string, importance double")
