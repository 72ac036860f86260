"""Forests that tasks grow: MLlib's trees, without MLlib's jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from recontact.plans import forests, models
from recontact.session import staged


def table(spark, n=600):
    draw = np.random.default_rng(4)
    x = np.column_stack([draw.normal(size=n), draw.integers(0, 6, n), draw.exponential(size=n).round(2)])
    label = (x[:, 0] + 0.3 * x[:, 1] + draw.normal(size=n) > 1).astype(int)
    rows = [(i, i, i + 1, 7, int(y), *map(float, v)) for i, (y, v) in enumerate(zip(label, x))]
    return staged(spark.createDataFrame(rows, "timestamp long, user_min long, user_max long, window_days int, label int, a double, b double, c double"), "test-table")


@pytest.fixture
def many(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_TIMES_TREES", 1200)
    return table(spark)


def test_a_tree_without_bag_is_the_one_that_mllib_grows(spark):
    # the same thresholds, gains, leaves and merged leaves, over columns with more and fewer values than bins.
    rows = table(spark).select(F.col("label").cast("double").alias("label"), array_to_vector(F.array("a", "b", "c")).alias("features"))
    estimator = RandomForestClassifier(numTrees=1, bootstrap=False, maxDepth=7, minInstancesPerNode=2, seed=3)
    folders, _ = forests.grow(estimator, rows, [1])
    ours, theirs = RandomForestClassificationModel.load(folders[0]), estimator.fit(rows)
    lines = lambda m: m.toDebugString.split("\n")[1:]  # noqa: E731  (the first has the uid)
    assert lines(ours) == lines(theirs) and len(lines(ours)) > 30
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)
    assert ours.extractParamMap()[ours.getParam("maxDepth")] == 7 and ours.numClasses == 2


def test_many_rows_are_grown_by_tasks_and_not_level_by_level(many, monkeypatch):
    # 200 trees over 68,067 rows took 667 s in 29 groups, one after another, each level of each a job.
    first = models.fit_model("random_forest", many, 7, 1, {"trees": 20, "depth": 6}, ("a", "b", "c"))
    monkeypatch.setattr(forests, "TASK_CELLS", 0)
    slow = models.fit_model("random_forest", many, 7, 1, {"trees": 20, "depth": 6}, ("a", "b", "c"))
    monkeypatch.undo()
    monkeypatch.setattr(models, "ROWS_TIMES_TREES", 1200)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a: pytest.fail("grown by MLlib"))
    fast = models.fit_model("random_forest", many, 7, 1, {"trees": 20, "depth": 6}, ("a", "b", "c"))
    assert fast.fitted.trees == slow.fitted.trees == [2] * 10
    assert fast.fitted.featureImportances == first.fitted.featureImportances  # the seed says what is grown
    other = models.fit_model("random_forest", many.repartition(5, "a"), 7, 1, {"trees": 20, "depth": 6}, ("a", "b", "c"))
    assert fast.importance() == other.importance()  # however the rows lie
    # Two forests of the same kind agree but for their draws.
    assert fast.fitted.featureImportances.toArray() == pytest.approx(slow.fitted.featureImportances.toArray(), abs=0.08)
    p, q = ([r.p for r in m.score(many).orderBy("timestamp").collect()] for m in (fast, slow))
    assert np.corrcoef(p, q)[0, 1] > 0.97 and abs(np.mean(p) - np.mean(q)) < 0.02 and len(set(p)) > 100


def test_scores_keep_repeated_rows_and_their_columns(many, monkeypatch):
    model = models.fit_model("random_forest", many, 7, 1, {"trees": 5, "depth": 4}, ("a", "b", "c"))
    monkeypatch.setattr(forests, "SCORED_AT_ONCE", 100)
    twice = many.unionByName(many)
    found = model.score(twice)
    assert found.columns == [*many.columns, "p"] and found.count() == 1200
    assert found.distinct().count() == 600 and found.drop("p").exceptAll(twice).isEmpty()
    assert model.score(many.where("a > 100")).count() == 0


def test_large_nodes_are_split_in_parts_with_the_same_tree(monkeypatch):
    draw = np.random.default_rng(1)
    cells = np.column_stack([draw.integers(0, 8, (500, 3)), draw.integers(0, 2, 500)]).astype(np.uint8)
    splits = [np.arange(7.0)] * 3
    whole = forests.grow_tree(cells, splits, 2, 9, 3, np.random.default_rng(0), bag=False)
    monkeypatch.setattr(forests, "ROWS_AT_ONCE", 20)
    parts = forests.grow_tree(cells, splits, 2, 9, 3, np.random.default_rng(0), bag=False)

    def walk(tree, at=0):
        return tuple(round(float(tree[c][at]), 9) for c in ("c0", "c1", "gain", "feature")) + (
            (walk(tree, tree["leftChild"][at]), walk(tree, tree["rightChild"][at])) if tree["leftChild"][at] >= 0 else ())

    assert walk(whole) == walk(parts) and len(whole["c0"]) > 50
    leaf = whole["leftChild"] < 0
    assert ((whole["c0"] + whole["c1"])[leaf] >= 2).all() and (whole["c0"] + whole["c1"])[leaf].sum() == 500
