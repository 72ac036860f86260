"""Sets, sources and score ranges that are easy to lose: none may vanish or land in one task."""

import pytest
from pyspark.sql import functions as F

from recontact.functions import metrics
from recontact.operators import catalog, retrieval, splits
from recontact.policy import DAY, Policy
from recontact.sources import sinks


def test_short_cohorts_keep_all_sets(spark):
    rows = spark.createDataFrame([(d * DAY, d % 2) for d in (8, 9) for _ in range(3)], "timestamp long, label_24h int")
    sets = {r.split: r for r in splits.split_support(rows, Policy()).collect()}
    assert set(sets) == set(splits.SETS) and sets["purged"].rows == 6
    assert [(sets[s].rows, sets[s].prediction_times, sets[s].supported) for s in splits.SETS[:3]] == [(0, 0, False)] * 3
    assert {(r.split, r.feasible) for r in splits.feasibility(rows, Policy()).collect()} == {(s, False) for s in splits.SETS[:3]}


def test_short_sources_have_zero_snapshots(spark):
    unique = spark.createDataFrame([("a|b", 100, 1, 2), ("a|b", 4000, 1, 3)], "dataset_id string, timestamp long, user_min long, user_max long")
    policy = Policy()
    got = catalog.calendar_capacity(unique, policy).collect()
    assert {(r.dataset_id, r.window_days, r.calendar_complete_snapshots, r.temporal_status) for r in got} == {("a|b", w, 0, "insufficient_days") for w in policy.windows}
    found = retrieval.retrieval_metrics(retrieval.retrieval_scores(unique, policy), unique, policy)
    got = retrieval.retrieval_feasibility(found, unique, policy).collect()
    assert {(r.dataset_id, r.window_days, r.complete_prediction_times, r.status) for r in got} == {("a|b", w, 0, "insufficient_history") for w in policy.windows}


def test_close_scores_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 5e-10).alias("p"), F.lit(1).cast("long").alias("n"))
        parts = [r["count"] for r in metrics.dealt_by_value(counts, ["g"], "p", True).groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(parts) == 20_000 and max(parts) < 10_000
    totals = metrics.running_totals(counts, ["g"], "p", ["n"], descending=False)
    assert totals.where("cum_n <> round(p / 5e-10) + 1 OR all_n <> 20000").count() == 0


def test_a_failed_write_keeps_the_earlier_table(spark, tmp_path):
    path = str(tmp_path / "contacts")
    frame = spark.createDataFrame([(5, 1, 2, 1), (6, 1, 3, 1)], "timestamp long, user_min long, user_max long, study_day int")
    assert sinks.write_contacts(frame, path) == 2
    broken = frame.withColumn("user_max", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_contacts(broken, path)
    assert spark.read.parquet(path).count() == 2
    assert sinks.write_contacts(frame.limit(1), path) == 1 and spark.read.parquet(path).count() == 1
