import numpy as np
import pytest
from pyspark.sql import functions as F

from recontact.operators import integrity, splits
from recontact.plans import kept_models, models, rolling_models
from recontact.policy import DAY
from recontact.sources import readers

COLUMNS = ("pair_contact_bins", "recency_seconds")


def table(spark, rows, name):
    return spark.createDataFrame(rows, f"id int, {name} string")


def test_contract_join_returns_the_rows(spark):
    left, right = table(spark, [(1, "a"), (2, "b")], "x"), table(spark, [(2, "d"), (1, "c"), (3, "e")], "y")
    assert sorted(map(tuple, integrity.contract_join(left, right, ["id"], spare_right=True).collect())) == [(1, "a", "c"), (2, "b", "d")]


@pytest.mark.parametrize("left, right", [
    ([(1, "a"), (2, "b")], [(1, "c")]), ([(1, "a")], [(1, "c"), (2, "d")]), ([(1, "a"), (1, "b")], [(1, "c")]), ([(1, "a")], [(1, "c"), (1, "c")]),
    ([(None, "a"), (1, "b")], [(1, "c")])])
def test_contract_join_refuses_whatever_is_read(spark, left, right):
    joined = integrity.contract_join(table(spark, left, "x"), table(spark, right, "y"), ["id"])
    for read in (lambda: joined.collect(), lambda: joined.select("x").collect(), lambda: joined.select("id").collect(), lambda: joined.count()):
        with pytest.raises(Exception, match="rows refused"):
            read()


def test_must_match_is_not_pruned(spark):
    joined = integrity.must_match(table(spark, [(1, "a"), (2, "b")], "x"), table(spark, [(1, "c")], "y"), ["id"], "y")
    for read in (lambda: joined.select("x").collect(), lambda: joined.count()):
        with pytest.raises(Exception, match="no matching key"):
            read()


def test_training_cohort_refuses_a_label_without_features(spark):
    labels = spark.createDataFrame([(10, 1, 2, True, 1), (10, 1, 3, True, 0), (10, 1, 4, False, None)],
                                   "timestamp long, user_min long, user_max long, eligible_for_evaluation boolean, label_24h int")
    bank = spark.createDataFrame([(10, 1, 2, 0.5), (10, 1, 3, 0.1), (10, 8, 9, 0.7)], "timestamp long, user_min long, user_max long, f double")
    assert splits.training_cohort(labels, bank).count() == 2
    for broken in (bank.where("user_max <> 3"), bank.unionByName(bank.where("user_max = 2"))):
        with pytest.raises(Exception, match="rows refused"):
            splits.training_cohort(labels, broken).select("f").collect()


def test_mapped_edges_refuse_files_with_another_header_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,src,dst\n1,20,30\n")
    mapping = {"time": "timestamp", "src": "user_a", "dst": "user_b"}
    assert [tuple(r) for r in readers.read_mapped_edges(spark, str(tmp_path), mapping).collect()] == [("1", "20", "30")]
    (tmp_path / "b.csv").write_text("src,time,dst\n20,2,30\n")
    with pytest.raises(Exception):
        readers.read_mapped_edges(spark, str(tmp_path), mapping).collect()


@pytest.fixture(scope="module")
def samples(spark):
    """Sixteen days of pairs; contact is likelier for pairs seen often, by a logistic rule; day 12 holds one class."""
    draw = np.random.default_rng(41)
    rows = []
    for day in range(16):
        for i in range(40):
            seen, age = float(draw.poisson(3)), None if draw.random() < 0.1 else float(draw.exponential(50_000))
            chance = 1 / (1 + np.exp(2.5 - seen + (age or 0) / 40_000))
            rows += [(day * DAY, i, 1000 + i, w, 0 if day == 12 else int(draw.random() < chance), seen / w, age) for w in (1, 3)]
    return spark.createDataFrame(rows, "timestamp long, user_min long, user_max long, window_days int, label int, pair_contact_bins double, recency_seconds double")


def roles_for(spark, tests):
    rows = [(t * DAY, d * DAY, role) for t in tests for role, days in (("test", [t]), ("validation", [t - 4, t - 3, t - 2]), ("train", range(t - 5))) for d in days]
    return spark.createDataFrame(rows, "test_time long, timestamp long, role string")


def test_rolling_predictions_of_all_learners(spark, samples):
    small = {"random_forest": {"trees": 5, "depth": 4}, "boosted_trees": {"trees": 3, "depth": 2}}
    names = ("logistic_regression", "random_forest", "boosted_trees")
    found, states = rolling_models.rolling_trained(samples, roles_for(spark, (10, 15)), names, (1, 3), 5, small, COLUMNS)
    assert {(s.test_time // DAY, s.window_days, s.model, s.status) for s in states.collect()} == {(t, w, n, "evaluated") for t in (10, 15) for w in (1, 3) for n in names}
    rows = found.collect()
    assert len(rows) == 2 * 2 * 3 * 40 and all(0 <= r.p <= 1 and r.timestamp == r.test_time for r in rows)
    # One fit made by hand gives the same predictions.
    one = samples.where("window_days = 3")
    model = models.choose_threshold(models.fit_model("logistic_regression", one.where(F.col("timestamp") < 10 * DAY), 3, 5, None, COLUMNS),
                                    one.where(F.col("timestamp").between(11 * DAY, 13 * DAY)))
    by_hand = {r.user_min: r.p for r in model.score(one.where(F.col("timestamp") == 15 * DAY)).collect()}
    mine = {r.user_min: (r.p, r.threshold) for r in rows if r.test_time == 15 * DAY and r.window_days == 3 and r.model == "logistic_regression"}
    assert all(abs(mine[k][0] - by_hand[k]) < 1e-6 for k in by_hand) and abs(next(iter(mine.values()))[1] - model.threshold) < 1e-6


def test_fits_that_cannot_be_made_have_a_status(spark, samples):
    flat = samples.withColumn("label", F.when(F.col("timestamp") < 6 * DAY, 0).when(F.col("timestamp") >= 12 * DAY, 0).otherwise(F.col("label")))
    found, states = rolling_models.rolling_trained(flat, roles_for(spark, (10, 15)).where("NOT (test_time = 1296000 AND role = 'validation' AND timestamp < 1036800)"),
                                                   ("logistic_regression",), (1,), 5, None, COLUMNS)
    assert {(s.test_time // DAY, s.status, s.threshold) for s in states.collect()} == {(10, "one_class_train", None), (15, "one_class_validation", None)}
    assert found.collect() == []
    _, states = rolling_models.rolling_trained(samples, roles_for(spark, (10,)), ("logistic_regression",), (1,), 5, {"logistic_regression": {"max_iter": 1}}, COLUMNS)
    assert [s.status for s in states.collect()] == ["not_settled"]


@pytest.mark.parametrize("name, parameters", [("logistic_regression", {}), ("random_forest", {"trees": 3, "depth": 3}), ("boosted_trees", {"trees": 2, "depth": 2})])
def test_a_kept_model_scores_alike_and_is_refused_when_changed(spark, samples, tmp_path, name, parameters):
    rows = samples.where("window_days = 1").withColumn("split", F.when(F.col("timestamp") < 9 * DAY, "train").when(F.col("timestamp") < 12 * DAY, "validation").otherwise("test"))
    model = models.choose_threshold(models.fit_model(name, rows.where("split = 'train'"), 1, 5, parameters, COLUMNS), rows.where("split = 'validation'"))
    folder = str(tmp_path / "kept")
    terms = kept_models.save(spark, model, rows, folder, COLUMNS)
    assert terms["information_deadline"] == 12 * DAY
    again, read = kept_models.load(spark.newSession(), folder, 1, COLUMNS)
    test = rows.where("split = 'test'")
    scores = lambda m: sorted((r.timestamp, r.user_min, r.p) for r in m.score(test).collect())
    assert scores(again) == scores(model) and again.threshold == model.threshold and read == terms
    assert kept_models.score_after_deadline(again, read, test).count() == test.count()
    with pytest.raises(Exception, match="information deadline"):
        kept_models.score_after_deadline(again, read, rows).count()
    with pytest.raises(kept_models.ContractError):
        kept_models.load(spark, folder, 3, COLUMNS)
    with pytest.raises(kept_models.ContractError):
        kept_models.load(spark, folder, 1, COLUMNS[::-1])
    part = next((tmp_path / "kept" / "fitted" / "metadata").glob("part-*"))
    part.with_name(f".{part.name}.crc").unlink()
    part.write_bytes(part.read_bytes() + b" ")
    with pytest.raises(kept_models.ContractError, match="changed"):
        kept_models.load(spark, folder, 1, COLUMNS)


def test_folds_share_one_pass_of_statistics(spark, samples, monkeypatch):
    # Every fit had a pass of its own over its training days for medians, classes and thresholds.
    folds = rolling_models.folds_of(roles_for(spark, (9, 10, 15)))
    found = rolling_models.fold_medians(samples, folds, COLUMNS)
    days = rolling_models.Days.of(samples, COLUMNS)
    for fold in folds:
        for w in (1, 3):
            own = models.Preparation.fit(samples.where(F.col("window_days") == w).where(F.col("timestamp").between(*fold.train)), list(COLUMNS))
            n, classes, gaps = days.between(w, *fold.train)
            assert models.Preparation.of(list(COLUMNS), found[fold, w], gaps, n, classes) == own
    monkeypatch.setattr(models.Preparation, "fit", None)
    _, states = rolling_models.rolling_trained(samples, roles_for(spark, (10, 15)), ("logistic_regression",), (1, 3), 5, None, COLUMNS)
    assert [s.status for s in states.collect()] == ["evaluated"] * 4
