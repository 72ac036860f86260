import pytest

from recontact.functions.timemath import sums_until
from recontact.operators import catalog, disclosure, graph, integrity, retrieval, splits
from recontact.policy import DAY, Policy
from recontact.sources import readers, sinks


def labels(spark, days, rows=6):
    data = [(d * DAY + 28800, a, a + 1, a % 2) for d in days for a in range(rows)]
    return spark.createDataFrame(data, "timestamp long, user_min long, user_max long, label_24h int")


def test_split_purges_rows_that_reach_the_next_set(spark):
    plan = {r.timestamp // DAY: r.split for r in splits.split_plan(splits.time_counts(labels(spark, range(10))), (0.6, 0.2, 0.2)).collect()}
    assert plan == {0: "train", 1: "train", 2: "train", 3: "train", 4: "train", 5: "purged", 6: "validation", 7: "purged", 8: "test", 9: "test"}


def test_rolling_folds_train_strictly_before_validation(spark):
    rows = labels(spark, range(12))
    policy = Policy(min_class_rows=3)
    for f in {r.test_time for r in splits.ready_roles(rows, policy).collect()}:
        times = {}
        for r in splits.ready_roles(rows, policy).where(f"test_time = {f}").collect():
            times.setdefault(r.role, []).append(r.timestamp)
        assert len(times["validation"]) == 3 and len(times["train"]) >= 4
        assert max(times["train"]) + DAY < min(times["validation"]) and max(times["validation"]) + DAY < f
    status = {r.test_time // DAY: r.status for r in splits.rolling_folds(rows, policy).collect()}
    assert status[4] == "insufficient_history" and status[11] == "ready"
    assert splits.rolling_folds(rows, Policy()).where("status = 'insufficient_class_rows'").count() > 0


@pytest.mark.parametrize("days", [(), (3,), tuple(range(12)), (0, 1, 2, 5, 6, 7, 11, 12, 13, 14, 20)])
def test_fold_spans_say_the_same_as_roles_in_one_row_a_fold(spark, days):
    policy = Policy(min_class_rows=1)
    rows = labels(spark, days)
    spans = {r.test_time: r for r in splits.fold_spans(splits.time_counts(rows), policy).collect()}
    assert sorted(spans) == [d * DAY + 28800 for d in days]
    long = {}
    for r in splits.rolling_roles(splits.time_counts(rows), policy).collect():
        long.setdefault((r.test_time, r.role), []).append(r)
    for t, s in spans.items():
        train, held = (sorted(long.get((t, role), []), key=lambda r: r.timestamp) for role in ("train", "validation"))
        assert (s.train_times, s.train_positive, s.train_negative) == tuple(map(sum, zip(*[(1, r.positive, r.negative) for r in train]))) if train else s.train_times == 0
        assert [r.timestamp for r in held] == s.validation and s.validation_positive == sum(r.positive for r in held)
        assert (s.train_first, s.train_last) == ((train[0].timestamp, train[-1].timestamp) if train else (None, None))
    ready = {f.test_time for f in splits.ready_folds(rows, policy).collect()}
    assert ready == {r.test_time for r in splits.ready_roles(rows, policy).select("test_time").distinct().collect()}


def test_sums_until_add_up_every_earlier_day_of_the_same_key(spark):
    daily = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("a", 30, 4), ("b", 20, 8)], "k string, timestamp long, n int")
    asked = spark.createDataFrame([("a", 1, 5), ("a", 2, 20), ("a", 3, 99), ("b", 4, 19), ("c", 5, 50), ("a", 3, 99)], "k string, id int, at long")
    got = sorted((r.k, r.id, r.at, r.n) for r in sums_until(daily, asked, ["k"], ("n",), "at").collect())
    assert got == [("a", 1, 5, 0), ("a", 2, 20, 3), ("a", 3, 99, 7), ("a", 3, 99, 7), ("b", 4, 19, 0), ("c", 5, 50, 0)]


def test_holdout_groups_follow_the_digest_parity(spark):
    import hashlib
    from pyspark.sql import functions as F
    people = spark.range(40).withColumnRenamed("id", "user_id")
    got = {r.user_id: r.side for r in people.select("user_id", splits.participant_group(F.col("user_id"), F.lit("s1"), "scans").alias("side")).collect()}
    assert got == {i: int(hashlib.sha256(f"T38|s1|scans|{i}".encode()).hexdigest(), 16) % 2 for i in range(40)}


def test_components_on_paths_cycles_and_a_hub(spark):
    edges = [("d", i, i + 1) for i in range(50)] + [("d", 100, k) for k in range(101, 140)] + [("e", 0, 1)]
    frame = spark.createDataFrame(edges, "dataset_id string, user_min long, user_max long")
    got = {r.dataset_id: (r.components, r.largest_component_nodes) for r in graph.component_sizes(graph.components(frame)).collect()}
    assert got == {"d": (2, 51), "e": (1, 2)}


def test_subgraph_keeps_the_focus_and_its_strongest_edge(spark):
    rows = [(0, a, b, 10, 5) for a in range(1, 6) for b in range(a + 1, 6)] + [(0, 1, 9, 1, 4)]
    edges = spark.createDataFrame(rows, "timestamp long, user_min long, user_max long, weight long, last_contact long")
    nodes, kept = graph.bounded_subgraph(edges, 9, max_nodes=4, max_edges=2)
    assert {r.user_id for r in nodes.collect()} == {1, 2, 3, 9}
    assert (1, 9) in {(r.user_min, r.user_max) for r in kept.collect()} and kept.count() == 2


def test_full_ranking_is_dense_and_ordered(spark):
    rows = [("s", 0, w, a, a + 1, float(a % 3), -float(a), 0.0) for w in (1, 3) for a in range(200)]
    scores = spark.createDataFrame(rows, "dataset_id string, timestamp long, window_days int, user_min long, user_max long, historical_frequency double, last_contact_recency double, common_neighbors double")
    got = retrieval.rank_scores(scores).where("window_days = 3 AND method = 'historical_frequency'").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 201))
    assert [(r.score, r.user_min) for r in got] == sorted(((r.score, r.user_min) for r in got), key=lambda x: (-x[0], x[1]))


def test_small_groups_are_withheld(spark):
    bins = spark.createDataFrame([("a", "0–5", 9), ("a", "6–20", 4), ("b", "0–5", 9)], "dataset_id string, bin string, count long")
    got = {(r.dataset_id, r.bin, r["count"], r.status) for r in disclosure.suppressed_histogram(bins, "dataset_id", 5).collect()}
    assert got == {("a", None, None, "suppressed_small_groups"), ("b", "0–5", 9, "aggregate")}
    family = spark.createDataFrame([(3, 10, 0.3), (0, 10, 0.0)], "hits long, total long, ratio double")
    hidden = disclosure.suppress_family(family, ["hits", "total"], ["ratio"], 5).collect()
    assert sorted((r.hits, r.ratio) for r in hidden if r.disclosure_status == "aggregate_only") == [(0, 0.0)]


def test_table_diff_tells_exact_from_close(spark):
    a = spark.createDataFrame([(1, 5, 1.0), (2, 6, None), (3, 7, 2.0)], "k int, n int, v double")
    b = spark.createDataFrame([(1, 5, 1.0 + 1e-14), (2, 6, None), (4, 7, 2.0)], "k int, n int, v double")
    got = {r.column_name: (r.compared, r.differences, r.one_sided_keys) for r in integrity.table_diff(a, b, ["k"], ["n"], ["v"]).collect()}
    assert got == {"n": (2, 0, 2), "v": (2, 0, 2)}


def test_must_match_refuses_a_missing_partner(spark):
    left, right = spark.range(3), spark.createDataFrame([(0, "a"), (1, "b")], "id long, name string")
    with pytest.raises(Exception, match="no matching key"):
        integrity.must_match(left, right, ["id"], "name").collect()


def test_readers_refuse_wrong_headers_and_bad_rows(spark, tmp_path):
    good = tmp_path / "calls.csv"
    good.write_text("# timestamp, caller,callee,duration\n10,1,2,-1\n20,3,4,60\n")
    rows = readers.cast_rows(readers.read_log(spark, str(good), "calls"), "calls").collect()
    assert [tuple(r) for r in rows] == [(10, 1, 2, -1), (20, 3, 4, 60)]
    bad = tmp_path / "bad.csv"
    bad.write_text("timestamp,user_a,user_c,rssi\n1,2,3,4\n")
    with pytest.raises(readers.SchemaError):
        readers.read_log(spark, str(bad), "bluetooth")
    late = tmp_path / "late.csv"
    late.write_text("timestamp,user_a,user_b,rssi\n1,2,3,4\n2,-7,3,4\n")
    with pytest.raises(Exception, match="user_a negative"):
        readers.cast_rows(readers.read_log(spark, str(late), "bluetooth"), "bluetooth").collect()
    wide = tmp_path / "wide.csv"
    wide.write_text("timestamp,user_a,user_b,rssi\n1,2,3,4\n1,2,3,4,5\n")
    with pytest.raises(Exception):
        readers.read_log(spark, str(wide), "bluetooth").collect()


def test_text_sources_and_probe(spark, tmp_path):
    path = tmp_path / "edges.dat"
    path.write_text("# a comment\n 7 100  9 \n8\t120 9\n")
    rows = readers.read_triplets(spark, str(path), ("user_a", "timestamp", "user_b")).collect()
    assert sorted(tuple(r) for r in rows) == [("100", "7", "9"), ("120", "8", "9")]
    assert readers.probe_source(spark, str(path))
    path.write_text("1 2\n")
    assert not readers.probe_source(spark, str(path))
    with pytest.raises(Exception, match="expected 3 fields"):
        readers.read_triplets(spark, str(path)).collect()


def test_datetimes_need_a_zone(spark):
    frame = spark.createDataFrame([("2024-07-01 12:00:00", "1", "2")], "when string, src string, dst string")
    mapping = {"when": "timestamp", "src": "user_a", "dst": "user_b"}
    assert readers.map_edges(frame, mapping, "datetime", "Europe/Berlin").first().timestamp == 1719828000
    with pytest.raises(readers.SchemaError):
        readers.map_edges(frame, mapping, "datetime")


def test_written_contacts_prune_days_and_columns(spark, tmp_path):
    frame = spark.createDataFrame([(d * DAY, 1, 2 + d, d + 1) for d in range(4)], "timestamp long, user_min long, user_max long, study_day int")
    path = str(tmp_path / "contacts")
    assert sinks.write_contacts(frame, path) == 4
    back = sinks.read_declared(spark, path, frame.schema)
    plan = sinks.history_frame(back, ["timestamp", "user_min"], DAY, 3 * DAY)
    assert plan.count() == 2
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in text and "user_max" not in text
    sinks.export_table(plan, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_catalogue_classifies_rows_and_blocks_unverified_units(spark):
    rows = spark.createDataFrame([("s", "1", "2", "3"), ("s", "x", "2", "3"), ("s", "1", "2", "2"), ("s", "1.5", "2", "3"), ("s", "1", "-2", "3")],
                                 "dataset_id string, timestamp string, user_a string, user_b string")
    got = catalog.classify_rows(rows).first()
    assert (got.raw_rows, got.invalid_rows, got.self_contact_rows, got.event_rows) == (5, 3, 1, 1)
    manifest = catalog.dataset_manifest(catalog.catalog_contacts(rows))
    support = spark.createDataFrame([("s", False, False, False)], "dataset_id string, unit_verified boolean, coverage_supported boolean, coverage_checked boolean")
    dates = spark.createDataFrame([], "dataset_id string, window_days int, calendar_complete_snapshots long")
    assert catalog.eligibility(manifest, dates, support).first().reason == "missing verified scan support; time_unit_unverified"
