"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recontact.session import ensure_checkpoint_dir, staged

#: What separates words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Shuffle files of a finished action are not needed again: every reused result is a written table.
SHORT_LIVED_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

__all__ = ["BLANKS", "blank_free", "ensure_checkpoint_dir", "fold", "input_bytes", "numbered", "prepare", "staged", "table", "words_of", "written"]


def prepare(spark: SparkSession) -> None:
    """Adaptive plans with skew splitting, and no shuffle file kept after its action."""
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", SHORT_LIVED_SHUFFLES):
        spark.conf.set(key, "true")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """All runs of non-blank characters, in order; an empty array for null or blank text."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def blank_free(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo parts; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def input_bytes(frame: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column, from one pass over it."""
    return frame.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first().n


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame itself if it only reads, filters and selects from files, else a written copy of it.

    So every job reads the same rows, but not in the same order or splits: numbers need ``numbered``.
    """
    lines = frame._jdf.queryExecution().optimizedPlan().toString().rstrip().split("\n")
    reads = all(line.lstrip(" :+-").startswith(("Project ", "Filter ", "Relation ")) for line in lines)
    return frame if reads else staged(frame, name)


def numbered(frame: DataFrame, column: str, name: str) -> DataFrame:
    """A written copy of the frame with a number of every row.

    How files are split depends on the cores that are there when a job starts, so numbers are given once and read again.
    """
    return staged(frame.withColumn(column, F.monotonically_increasing_id()), name)
