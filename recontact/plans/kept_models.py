"""Trained models kept with their contract: what they were fitted on, and a digest of the saved files."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.plans.models import GroupedForest, Model, Preparation
from recontact.policy import DAY

KINDS = {"logistic_regression": LogisticRegressionModel, "random_forest": RandomForestClassificationModel, "boosted_trees": GBTClassificationModel}


class ContractError(ValueError):
    """A saved model is not what its contract says, or is not fit for what is asked of it."""


def files_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the names and SHA-256 digests of the files below a folder, in the order of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", r"^.*/fitted/", "")
    listed = files.select(F.concat_ws(" ", name, F.sha2("content", 256)).alias("line"))
    return listed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest")).first().digest


def label_deadline(samples: DataFrame) -> int:
    """End of the last label horizon that training and validation have used."""
    last = samples.where(F.col("split").isin("train", "validation")).agg((F.max("timestamp") + DAY).alias("t")).first().t
    if last is None:
        raise ContractError("no training or validation row")
    return last


def save(spark: SparkSession, model: Model, samples: DataFrame, folder: str, columns: tuple[str, ...]) -> dict:
    """Write the fitted model and a contract table to a new folder; returns the contract.

    ``samples``: the rows that the model was fitted on, with their split: the information deadline comes from those rows, not from
    another split. The contract table is written last, so a folder without it is no model.
    """
    grouped = isinstance(model.fitted, GroupedForest)
    if grouped:
        model.fitted.save(f"{folder}/fitted")
    else:
        model.fitted.write().save(f"{folder}/fitted")
    terms = {
        "name": model.name, "window_days": model.window_days, "columns": list(columns), "threshold": model.threshold, "parameters": model.parameters,
        "kept_columns": model.preparation.columns, "medians": model.preparation.medians, "indicators": model.preparation.indicators,
        "information_deadline": label_deadline(samples), "digest": files_digest(spark, f"{folder}/fitted"),
        **({"trees": model.fitted.trees} if grouped else {})}
    text = json.dumps(terms, sort_keys=True)
    spark.createDataFrame([(text,)], "terms string").withColumn("terms_digest", F.sha2("terms", 256)).coalesce(1).write.parquet(f"{folder}/contract")
    return terms


def load(spark: SparkSession, folder: str, window_days: int, columns: tuple[str, ...]) -> tuple[Model, dict]:
    """The model and its contract; refused where a file or the contract has changed, or the window or columns are others."""
    row = spark.read.parquet(f"{folder}/contract").select("terms", (F.sha2("terms", 256) == F.col("terms_digest")).alias("whole")).first()
    if row is None or not row.whole:
        raise ContractError("the contract has been changed")
    terms = json.loads(row.terms)
    if terms["window_days"] != window_days:
        raise ContractError(f"the model was fitted on a window of {terms['window_days']} days")
    if terms["columns"] != list(columns):
        raise ContractError("the model was fitted on other columns")
    if files_digest(spark, f"{folder}/fitted") != terms["digest"]:
        raise ContractError("the saved model has been changed")
    preparation = Preparation(terms["kept_columns"], terms["medians"], terms["indicators"])
    fitted = GroupedForest.load(spark, f"{folder}/fitted", terms["trees"]) if "trees" in terms else KINDS[terms["name"]].load(f"{folder}/fitted")
    return Model(terms["name"], preparation, fitted, window_days, terms["threshold"], terms["parameters"]), terms


def score_after_deadline(model: Model, terms: dict, rows: DataFrame) -> DataFrame:
    """Scores of rows whose snapshot lies after every label that the model has used; an earlier row fails the read."""
    from recontact.operators.integrity import refused
    late = refused(rows, {"a snapshot before the information deadline": F.col("timestamp") < terms["information_deadline"]})
    return model.score(late.where(F.col("window_days") == model.window_days))
