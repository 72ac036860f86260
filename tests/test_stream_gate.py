"""Changes of the freshness gate: files are micro-batches, times are event times."""

import pytest
from pyspark.sql import functions as F

from recontact.streaming import freshness

START = 1_600_000_000
PAIRS = [(1, 2), (1, 3), (2, 4), (7, 8)]


def run(spark, folder, batches, limit=600):
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(START + s, u, seen) for s, u, seen in rows], "s long, user_id long, scan_observed boolean")
        frame.select(F.timestamp_seconds("s").alias("event_time"), "user_id", "scan_observed").coalesce(1).write.mode("append").parquet(f"{folder}/in{i}")
    schema = "event_time timestamp, user_id long, scan_observed boolean"
    got, states = [], []
    pairs = spark.createDataFrame(PAIRS, "user_min long, user_max long")
    for i in range(len(batches)):  # one folder more at every start: the state comes from the checkpoint
        paths = f"{folder}/in[0-{i}]"
        changes = freshness.gate_changes(spark.readStream.schema(schema).parquet(paths), pairs, limit)
        query = (changes.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp")
                 .foreachBatch(lambda frame, _: got.extend((r.user_min, r.user_max, r.s - START, r.fresh) for r in frame.select(
                     "*", F.unix_seconds("changed_at").alias("s")).collect())).trigger(availableNow=True).start())
        query.awaitTermination(120)
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return got, states


def test_a_stale_participant_leaves_without_new_rows_and_state_shrinks(spark, tmp_path):
    got, states = run(spark, str(tmp_path), [
        [(0, 1, True), (100, 2, True), (90, 3, None), (50, 9, True)],  # 1-2 opens; 3 is not observed, 9 in no pair
        [(400, 1, True), (300, 1, True)],  # 1 is renewed: the gate now waits for 2, until 700
        [(5000, 9, True)],  # a stranger moves the watermark
    ])
    assert got == [(1, 2, 100, True), (1, 2, 700, False)]
    assert states[0] == 3 and states[-1] == 0


def test_an_open_gate_is_not_reported_again_and_reopens(spark, tmp_path):
    got, _ = run(spark, str(tmp_path), [
        [(0, 7, True), (10, 8, True)], [(200, 7, True), (210, 8, True)], [(3000, 9, True)], [(4000, 8, True), (4600, 7, True)], [(9000, 9, True)]])
    assert got == [(7, 8, 10, True), (7, 8, 800, False), (7, 8, 4600, True), (7, 8, 4600, False)]


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        freshness.gate_changes(None, None, 4000)
