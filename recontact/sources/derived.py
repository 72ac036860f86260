"""Contact logs read off the given tables, one or two rows per source row.

No table records who met whom. Each event becomes one row of a device scan log: the
reporter is the event's user, the detected device follows from the event number, so the
log grows linearly with the events and no pairing of rows is needed. Device 0 is detected
by a tenth of all scans, which makes it a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ORIGIN = "2024-01-01 00:00:00"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _seconds(column: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'{ORIGIN}', {column})").cast("long")


def scan_log(events: DataFrame) -> DataFrame:
    """timestamp, user_a, user_b, rssi, dataset_id with sentinels, mirrored and repeated rows."""
    n = F.col("event_id")
    device = (F.when(F.col("event_type") == "error", F.when(n % 3 == 0, F.lit(-2)).otherwise(F.lit(-1)))
              .when(n % 10 == 3, F.lit(0))
              .otherwise(F.col("user_id").bitwiseXOR(1 + F.least(n % 7, F.expr("event_id div 7") % 7))))
    signal = (F.when(n % 89 == 0, F.lit(None)).when(n % 97 == 0, F.lit(12.0))
              .otherwise(-40 - (n * 7) % 50)).cast("double")
    row = events.select(_seconds("ts").alias("timestamp"), F.col("user_id").alias("user_a"),
                        device.cast("long").alias("user_b"), signal.alias("rssi"),
                        F.col("event_type").alias("dataset_id"), "event_id")
    same = F.struct(F.col("user_a"), F.col("user_b"))
    mirror = F.struct(F.col("user_b").alias("user_a"), F.col("user_a").alias("user_b"))
    copies = (F.when((n % 4 == 0) & (F.col("user_b") >= 0), F.array(same, mirror))
              .when(n % 11 == 0, F.array(same, same)).otherwise(F.array(same)))
    return (row.withColumn("ends", F.explode(copies))
            .select("timestamp", F.col("ends.user_a"), F.col("ends.user_b"), "rssi", "dataset_id", "event_id"))


def proximity_lines(lineitem: DataFrame) -> DataFrame:
    """Whitespace text rows ``time a b class_a class_b`` from the line items."""
    return lineitem.select(F.concat_ws(
        " ", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)") + F.col("l_linenumber") * 20,
        "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("value"))
