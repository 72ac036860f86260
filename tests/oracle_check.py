"""Run registered queries beside their SQL on the same Parquet tables and compare all values.

    python tests/oracle_check.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _text(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NA or value is pd.NaT:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        number = float(value)
        return f"{number:.6f}".rstrip("0").rstrip(".") if number else "0"
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(frame.columns)
    return sorted(tuple(_text(v) for v in row) for row in frame[names].astype(object).itertuples(index=False, name=None))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty when both hold the same columns and rows."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    ours, theirs = rows_of(spark_frame), rows_of(sql_frame)
    if ours == theirs:
        return ""
    only = [r for r in ours if r not in set(theirs)][:2], [r for r in theirs if r not in set(ours)][:2]
    return f"rows {len(ours)} vs {len(theirs)}; columns {sorted(spark_frame.columns)}; spark only {only[0]}; sql only {only[1]}"


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "10g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles = database(folder), oracle_sql()
    bad = []
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ours = run(spark, folder).toPandas()
            took = time.time() - start
            problem = difference(ours, connection.execute(oracles[name]).fetchdf()) if name in oracles else ""
            kind = "sql" if name in oracles else "rows"
        except Exception as error:  # report every query, whatever breaks
            ours, took, kind, problem = pd.DataFrame(), time.time() - start, "error", f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'BAD ' if problem else 'ok  '} {name} {kind} rows={len(ours)} {took:.1f}s {problem}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
