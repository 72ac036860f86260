"""Writes that publish only complete tables, and the matching reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _publish(spark: SparkSession, made: str, path: str) -> None:
    """Put a complete table in its place; an earlier one is removed after that, and put back if the step fails."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    target, earlier = place(path), place(f"{made}-earlier")
    store = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    replaces = store.exists(target)
    if replaces and not store.rename(target, earlier):
        raise IOError(f"{path}: the earlier table cannot be set aside")
    if not store.rename(place(made), target):
        if replaces:
            store.rename(earlier, target)
        raise IOError(f"{path}: the new table cannot be published")
    if replaces:
        store.delete(earlier, True)


def write_contacts(frame: DataFrame, path: str, day_column: str = "study_day") -> int:
    """Parquet by study day, sorted inside files so that time filters skip row groups.

    The rows are counted, written beside the target, and counted again from there (an Observation would make fitted models of the
    session unserialisable); only
    a complete table takes the target's place, so readers never see part of one and a failure leaves the earlier table. Files follow
    the volume: large days are split and small ones kept together by the adaptive rebalance.
    """
    spark, made, expected = frame.sparkSession, f"{path.rstrip('/')}.made-{uuid.uuid4().hex}", frame.count()
    spread = spark.sql(f"SELECT /*+ REBALANCE(`{day_column}`) */ * FROM {{rows}}", rows=frame)
    spread.sortWithinPartitions(day_column, "timestamp").write.partitionBy(day_column).parquet(made)
    written = spark.read.schema(frame.schema).parquet(made).count()
    if written != expected:
        raise IOError(f"{path}: wrote {written} of {expected} rows")
    _publish(spark, made, path)
    return written


def read_declared(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read with the declared schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def history_frame(frame: DataFrame, columns: list[str], start: int, end: int) -> DataFrame:
    """Columns and rows of ``[start, end)``; both prunings reach the Parquet scan."""
    return frame.select(*columns).where((F.col("timestamp") >= start) & (F.col("timestamp") < end))


def export_table(frame: DataFrame, path: str, kind: str = "csv") -> None:
    """Aggregates for people: headed CSV or JSON lines."""
    if kind not in ("csv", "json"):
        raise ValueError("exports are csv or json")
    writer = frame.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)
