import math
import random

import numpy as np
import pytest
from recontact.functions import metrics as m, uncertainty as u
from recontact.policy import DAY, Policy


def average_precision(pairs):
    total = sum(y for y, _ in pairs)
    result = seen = hits = 0
    for score in sorted({p for _, p in pairs}, reverse=True):
        now = [y for y, p in pairs if p == score]
        seen, hits = seen + len(now), hits + sum(now)
        result += sum(now) / total * hits / seen
    return result


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(d * DAY, a, b, int(rng.random() < 0.4), round(rng.random(), 2), model, 7)
            for d in range(9) for a in range(6) for b in range(a + 1, 7) for model in ("x", "y")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "timestamp long, user_min long, user_max long, label int, p double, model string, window_days int").withColumn(
        "threshold", F.lit(0.5))


def test_ap_and_auc_match_their_definitions(frame, rows):
    pairs = [(r[3], r[4]) for r in rows if r[5] == "x"]
    got = m.binary_metrics(frame, ["model", "window_days"]).where("model = 'x'").first()
    assert got.average_precision == pytest.approx(average_precision(pairs))
    ranks = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in pairs if y for z, b in pairs if not z]
    assert got.roc_auc == pytest.approx(sum(ranks) / len(ranks))
    assert got.brier_score == pytest.approx(sum((p - y) ** 2 for y, p in pairs) / len(pairs))


def test_one_class_groups_have_no_auc(spark):
    frame = spark.createDataFrame([("g", 0, 0.3), ("g", 0, 0.7), ("h", 1, 0.0)], "g string, label int, p double")
    got = {r.g: r for r in m.roc_auc(frame, ["g"]).join(m.average_precision(frame, ["g"]).drop("rows"), "g").collect()}
    assert got["g"].roc_auc is None and got["g"].average_precision is None and got["h"].average_precision == 1.0
    loss = {r.g: r.log_loss for r in m.brier_logloss(frame, ["g"]).collect()}
    assert loss["h"] == pytest.approx(-math.log(m.EPSILON))


def test_threshold_ties_go_to_the_score_nearest_a_half(spark):
    frame = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.6), ("g", 0, 0.55), ("g", 1, 0.4), ("n", 0, 0.2)], "g string, label int, p double")
    got = {r.g: r.threshold for r in m.best_threshold(frame, ["g"]).collect()}
    assert got == {"g": 0.4, "n": 0.5}


def test_quantiles_interpolate_like_numpy(spark):
    rng = random.Random(1)
    values = [rng.choice([1.0, 2.0, 2.0, 5.5, -3.0, 9.25]) for _ in range(101)]
    frame = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = m.exact_quantiles(frame, ["g"], "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}).first()
    assert [got.a, got.b, got.c, got.d, got.e] == pytest.approx(list(np.quantile(values, [0, 0.1, 0.5, 0.93, 1])))


def test_bins_close_on_different_sides(spark):
    frame = spark.createDataFrame([("g", 1, 0.1), ("g", 0, 0.0), ("g", 1, 1.0)], "g string, label int, p double")
    assert sorted(r.bin for r in m.reliability(frame, ["g"]).collect()) == [0, 9]
    assert sorted(r.bin for r in m.reliability(frame, ["g"], left_closed=True).collect()) == [0, 1, 9]


def test_ranking_by_hand(spark):
    rows = [(0, 1, 2, 1, 0.9), (0, 1, 3, 0, 0.8), (0, 1, 4, 1, 0.7), (0, 2, 3, 0, 0.1)]
    got = m.ranking_metrics(spark.createDataFrame([("g", *r) for r in rows], "g string, timestamp long, user_min long, user_max long, label int, p double"),
                            ["g"], (2,)).first()
    # Participants 1 (hit, miss), 2 (hit, miss) and 4 (hit) have a positive; 3 has none.
    assert (got.groups, got.groups_without_positive) == (3, 1)
    assert got.precision_at_2 == pytest.approx(0.5) and got.recall_at_2 == pytest.approx((0.5 + 1 + 1) / 3)
    assert got.ndcg_at_2 == pytest.approx((1 / (1 + 1 / math.log2(3)) + 1 + 1) / 3)


def test_weighted_ap_equals_repeating_the_days(frame, rows):
    times = u.snapshot_times(frame)
    weights = u.draw_weights(len(times), 5, 42)
    got = {(r.model, r.draw): r.average_precision for r in u.weighted_average_precision(frame, ["model", "window_days"], times, weights).collect()}
    for draw in range(5):
        repeated = [(r[3], r[4]) for r in rows if r[5] == "y" for _ in range(int(weights[times.index(r[0]), draw]))]
        assert got[("y", draw)] == pytest.approx(average_precision(repeated))


def test_bootstrap_interval_holds_the_pooled_delta_and_needs_days(frame):
    contrasts = (("x", 7, "y", 7),)
    ci = u.block_bootstrap(frame, contrasts, Policy(bootstrap_draws=200)).first()
    assert ci.status == "paired_day_block_bootstrap" and ci.low < ci.high
    few = u.block_bootstrap(frame.where(f"timestamp < {3 * DAY}"), contrasts, Policy()).first()
    assert few.low is None and few.status == "insufficient_days_for_ci"


def test_weighted_curves_have_one_plan_for_any_number_of_days(spark, monkeypatch):
    draw = np.random.default_rng(6)
    monkeypatch.setattr(u, "CELLS", 40)
    shapes = []
    for days in (3, 60):
        rows = [(("x", "y")[i % 2], int(draw.integers(days)) * DAY, int(draw.random() < 0.4), float(draw.integers(9)) / 8) for i in range(400)]
        made = spark.createDataFrame(rows, "model string, timestamp long, label int, p double")
        times = u.snapshot_times(made)
        weights = u.draw_weights(len(times), 4, 2)
        result = u.weighted_average_precision(made, ["model"], times, weights)
        plan = result._jdf.queryExecution().analyzed().toString().strip().split("\n")
        shapes.append((len(plan), len(result.columns)))
        found = {(r.model, r.draw): r.average_precision for r in result.collect()}
        for model in "xy":
            for k in range(4):
                # Rows repeated as often as their day is drawn.
                drawn = [(p, label) for m, t, label, p in rows if m == model for _ in range(int(weights[times.index(t), k]))]
                positives, total = sum(label for _, label in drawn), 0.0
                for p in {p for p, _ in drawn}:
                    above = [label for q, label in drawn if q >= p]
                    total += sum(label for q, label in drawn if q == p) / positives * sum(above) / len(above)
                assert found[model, k] == pytest.approx(total)
    assert shapes[0] == shapes[1]
