"""What must not grow past the driver or one task, whatever the tables weigh as compressed files."""

import uuid
import weakref

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector

from helpers import scan_rows, study
from queries.trained import ablation_bank, recent_bank, samples
from recontact.operators import features as fe, retrieval
from recontact.plans import kept_models, models, rolling
from recontact.policy import DAY, Policy
from recontact.session import configure, ensure_checkpoint_dir, staged
from recontact.sources import readers


def test_window_graphs_are_not_broadcast_by_the_size_of_their_files(spark):
    # F1-F8: the files of a few contacts weigh next to nothing, the window graph made of them does not.
    rows = [("a", t * DAY // 4, u, u + 1 + t % 5) for u in range(40) for t in range(48)]
    unique = staged(spark.createDataFrame(rows, "dataset_id string, timestamp long, user_min long, user_max long").distinct(), "test-unique")
    plan = retrieval.retrieval_scores(unique, Policy())._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan
    assert int(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold").rstrip("b")) > 0


def test_a_line_is_split_once_and_each_number_read_once(spark):
    # the optimizer put the split and the casts in the place of every rule that reads them.
    lines = spark.range(5).selectExpr("concat_ws(' ', id * 20, id, id + 1, 'A', 'F') AS value")
    rows = readers.cast_rows(readers.parse_fields(lines, readers.SCHEMAS["proximity"]), "proximity")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert plan.count("as double)") == 3
    assert [tuple(r) for r in rows.orderBy("timestamp").collect()] == [(20 * i, i, i + 1, "A", "F") for i in range(5)]


def test_a_forest_over_many_rows_is_grown_in_groups_and_is_one_forest(spark, monkeypatch):
    # all trees were grown and held by the driver at once.
    rows = staged(spark.range(400).selectExpr("id AS timestamp", "id AS user_min", "id + 1 AS user_max", "7 AS window_days", "int(id % 5 < 2) AS label",
                                              "double(id % 5) AS a", "double(id % 7) AS b"), "test-forest")
    few = {"trees": 7, "depth": 4}
    monkeypatch.setattr(models, "ROWS_TIMES_TREES", 1200)
    model = models.fit_model("random_forest", rows, 7, 1, few, ("a", "b"))
    assert model.fitted.trees == [3, 3, 1]
    assert abs(sum(model.fitted.featureImportances) - 1) < 1e-9 and model.importance()[0][0] == "a"
    scored = model.score(rows)
    assert scored.columns == [*rows.columns, "p"] and scored.count() == 400
    # The mean of all trees, whichever group they are in.
    parts = [RandomForestClassificationModel.load(f) for f in model.fitted.folders]
    assert len({p.trees[0].toDebugString + str(p.uid) for p in parts}) == 3
    ready = model.preparation.transform(rows).where("timestamp = 3").first().features
    mean = sum(t.predictProbability(ready)[1] for p in parts for t in p.trees) / 7
    assert abs(scored.where("timestamp = 3").first().p - mean) < 1e-9
    assert all((r.p > 0.5) == (r.label == 1) for r in scored.collect())
    folder = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    kept_models.save(spark, model, rows.selectExpr("*", "'train' AS split"), folder, ("a", "b"))
    again, _ = kept_models.load(spark, folder, 7, ("a", "b"))
    assert again.importance() == model.importance()
    assert {(r.timestamp, r.p) for r in again.score(rows).collect()} == {(r.timestamp, r.p) for r in scored.collect()}


def test_the_driver_lets_go_of_a_group_before_the_next_one_grows(spark, monkeypatch):
    # a grown group stayed in the driver beside the next, and all trees went to every task of every level.
    rows = staged(spark.range(300).selectExpr("double(id % 5 < 2) AS label", "array(double(id % 5), double(id % 7)) AS x"), "test-groups")
    rows = rows.select("label", array_to_vector("x").alias("features"))
    grown, held, fit = [], [], RandomForestClassifier.fit

    def watched(self, frame):
        held.append(sum(g() is not None for g in grown))
        model = fit(self, frame)
        grown.append(weakref.ref(model))
        return model

    monkeypatch.setattr(RandomForestClassifier, "fit", watched)
    estimator = models._estimator("random_forest", {"trees": 6, "depth": 3}, 300, 1)
    assert models.GroupedForest.fit(estimator, rows, 2).trees == [2, 2, 2]
    assert held == [0, 0, 0] and estimator.getCacheNodeIds()
    # Seven of the forest's trees at the rows of events at 6 times sf0.1.
    assert models.ROWS_TIMES_TREES // 68_067 <= 7


def test_the_bounded_bank_is_not_broadcast_by_the_size_of_its_files(spark):
    # Every trained query starts from this bank; participant-days and window graphs were held by every task.
    s = study(spark, [*scan_rows((1, 2, 3, 4), 3, 3600), (DAY, 1, 2, -60.0), (DAY + 5, 2, 3, -60.0)])
    plan = s.bounded(s.recent_keys)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan


def test_the_window_graphs_are_one_and_their_paths_expanded_once(spark):
    # every window had edges, lists and paths of its own, although the shorter ones lie inside the longest.
    rows = [(t * DAY // 2 + 7 * u, u, v, -60.0) for t in range(30) for u in range(9) for v in range(u + 1, 9) if (t * 5 + u * 3 + v) % 11 == 0]
    s = study(spark, [*scan_rows(range(9), 15, 21_600), *rows])
    edges = fe.window_edges(s.pairs, s.span, (1, 3, 7))
    assert edges.count() == edges.select("day", "user_min", "user_max").distinct().count() > 0
    seen = {(r.day, r.user_min, r.user_max) for r in s.pairs.collect()}
    wanted = {}
    for w in (1, 3, 7):
        for day, a, b in {(r.day, r.user_min, r.user_max) for r in s.recent_keys.collect()}:
            graph = {(x, y) for d, x, y in seen if day - w < d <= day}
            around = lambda u: {y if x == u else x for x, y in graph if u in (x, y)}
            wanted[day * DAY + 8 * 3600, a, b, w] = float(len((around(a) & around(b)) - {a, b}))
    got = {(r.timestamp, r.user_min, r.user_max, r.window_days): r.common_neighbors for r in s.bounded(s.recent_keys).collect()}
    assert got == wanted and max(got.values()) > 1


def test_a_day_is_described_by_the_rows_that_were_scored(spark):
    # the features of all candidates were worked out once more and looked up by pair.
    cohort = spark.createDataFrame(
        [(t, u, u + 1, u % 2, 7, 3600.0 * u, float(1 + u % 3), 2.0, 4.0, 0.5, 0.25 * u) for t in (1, 2, 3) for u in range(4)],
        "timestamp long, user_min long, user_max long, label int, window_days int, recency double, pair_contact_days double, "
        "participant_a_activity double, participant_b_activity double, scan_coverage_a double, scan_coverage_b double")
    predictions = cohort.where("timestamp < 3").selectExpr("timestamp", "label", "window_days", "'m' AS model", "user_min / 4D AS p")
    table = rolling.day_table(predictions, cohort)
    rows = sorted(tuple(r[c] for c in ("timestamp", *rolling.DESCRIPTORS)) for r in table.collect())
    assert rows == [(t, 4, 0.5, 1.75, 1.5, 3.0, 0.3125, 0.5) for t in (1, 2)]


def test_the_ablation_works_out_the_bank_of_the_cohort_alone(spark):
    # the bank of all known pairs of every day was shuffled, and all but the cohort's rows dropped afterwards.
    rows = [(t * DAY // 2 + 7 * u, u, v, -60.0) for t in range(30) for u in range(6) for v in range(u + 1, 6) if (t * 5 + u * 3 + v) % 7 == 0]
    s = study(spark, [*scan_rows(range(6), 15), *rows])
    keys = ["timestamp", "user_min", "user_max"]
    own = ablation_bank(s)
    assert own.count() == s.cohort.count() > 0
    wanted = s.bank.join(s.cohort.select(*keys), keys).select(*own.columns)
    assert wanted.count() == own.count() and wanted.exceptAll(own).isEmpty()


def test_joined_partitions_stay_small_whatever_they_weigh_compressed(spark):
    # Spark's own 64 MB of compressed days and pairs are gigabytes in one task's memory.
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    other = spark.newSession()
    configure(other)
    assert [other.conf.get(k) for k in keys] == [f"{8 << 20}b", f"{32 << 20}b"]
    other.conf.set(keys[0], "2m")
    configure(other)
    assert other.conf.get(keys[0]) == "2m"


def cohort_study(spark, monkeypatch):
    """A study whose cohort is a part of its candidates, and the numbers of keys that its banks are asked for."""
    rows = [(t * DAY // 2 + 7 * u, u, v, -60.0) for t in range(30) for u in range(6) for v in range(u + 1, 6) if (t * 5 + u * 3 + v) % 7 == 0]
    s = study(spark, [*scan_rows(range(6), 15), *rows])
    asked, bounded = [], s.bounded
    monkeypatch.setattr(s, "bounded", lambda keys, *a, **k: asked.append(keys.count()) or bounded(keys, *a, **k))
    assert s.recent_keys.count() > s.cohort.count() > 0
    return s, asked


def test_samples_are_worked_out_for_the_cohort_alone(spark, monkeypatch):
    # The bank of all candidates of every day was worked out, and all but the cohort's rows dropped afterwards.
    s, asked = cohort_study(spark, monkeypatch)
    own = samples(s)
    assert asked == [s.cohort.count()] and own.count() == 3 * asked[0]
    del s._samples
    recent_bank(s)
    read = samples(s)
    assert asked[1:] == [s.recent_keys.count()] and read.count() == own.count() and read.exceptAll(own).isEmpty()


def test_scored_rows_are_worked_out_for_the_cohort_alone(spark, monkeypatch):
    # as the samples, the inputs of the untrained rules were worked out for all candidates.
    s, asked = cohort_study(spark, monkeypatch)
    assert s.scored_cohort.count() == 3 * s.cohort.count() and asked == [s.cohort.count()]
