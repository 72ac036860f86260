"""Scores sealed before their outcomes: written first, with a digest, and joined with outcomes only if nothing has changed since."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recontact.operators.integrity import refused
from recontact.operators.pointintime import KEY
from recontact.plans.kept_models import ContractError

#: Columns that only the reveal may add.
OUTCOMES = ("label", "label_24h", "outcome", "outcome_reason", "reliable_label", "strict_future_covered")


def rows_digest(rows: DataFrame) -> tuple[str, int]:
    """(SHA-256 hex, rows) of a table as a multiset: neither the order of rows, nor their files, nor the order of columns counts.

    Each row's SHA-256 is cut into eight words, each word is summed over all rows, and the sums and the count are hashed. So it is
    one partial aggregate of nine numbers at any size.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)]
    sums = rows.select(row.alias("h")).agg(F.count("*").alias("n"), *[F.coalesce(w, F.lit(0)).cast("string").alias(f"w{i}") for i, w in enumerate(words)])
    found = sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[f"w{i}" for i in range(8)]), 256).alias("digest")).first()
    return found.digest, found.n


def seal(scores: DataFrame, folder: str, deadline: int, model_digest: str = "", by: list[str] | None = None) -> dict:
    """Write scores to a new folder, then their seal; returns the seal's terms.

    ``scores``: KEY and whatever tells scores of one key apart (``by``, for instance window and model). Refused: columns of outcomes,
    snapshots before the information ``deadline``, null or repeated keys. The digest is taken from the written rows, and the seal is
    written last, so a folder without it holds no sealed scores.
    """
    keys = [*KEY, *(by or [])]
    if known := [c for c in scores.columns if c.lower() in OUTCOMES]:
        raise ContractError(f"scores already hold outcomes: {known}")
    spark = scores.sparkSession
    null_key = F.greatest(*[F.col(k).isNull() for k in keys])
    checked = refused(scores, {"a null key": null_key, "a snapshot before the information deadline": F.col("timestamp") < deadline})
    checked.write.parquet(f"{folder}/scores")
    written = spark.read.schema(scores.schema).parquet(f"{folder}/scores")
    if again := written.groupBy(*keys).count().where("count > 1").first():
        raise ContractError(f"a key is scored twice: {again}")
    digest, rows = rows_digest(written)
    ends = written.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    terms = {"digest": digest, "rows": rows, "schema": scores.schema.json(), "information_deadline": deadline, "first": ends.a, "last": ends.b, "model_digest": model_digest}
    text = json.dumps(terms, sort_keys=True)
    spark.createDataFrame([(text,)], "terms string").withColumn("terms_digest", F.sha2("terms", 256)).coalesce(1).write.parquet(f"{folder}/seal")
    return terms


def unsealed(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The sealed scores and the terms of the seal; refused where either has changed."""
    row = spark.read.parquet(f"{folder}/seal").select("terms", (F.sha2("terms", 256) == F.col("terms_digest")).alias("whole")).first()
    if row is None or not row.whole:
        raise ContractError("the seal has been changed")
    terms = json.loads(row.terms)
    from pyspark.sql.types import StructType
    scores = spark.read.schema(StructType.fromJson(json.loads(terms["schema"]))).parquet(f"{folder}/scores")
    if rows_digest(scores) != (terms["digest"], terms["rows"]):
        raise ContractError("the sealed scores have been changed")
    return scores, terms


def reveal(spark: SparkSession, folder: str, outcomes: DataFrame) -> DataFrame:
    """Sealed scores beside the outcome of their key; a key without outcome or with two of them fails the read.

    ``outcomes``: one row per KEY, also for keys that were not scored.
    """
    scores, _ = unsealed(spark, folder)
    if shared := [c for c in outcomes.columns if c in scores.columns and c not in KEY]:
        raise ContractError(f"both sides have the columns {shared}")
    counted = outcomes.withColumn("_outcomes", F.count("*").over(Window.partitionBy(*KEY)))
    joined = scores.join(counted, KEY, "left")
    return refused(joined, {"a score without an outcome": F.col("_outcomes").isNull(), "an outcome twice": F.col("_outcomes") > 1}).drop("_outcomes")
