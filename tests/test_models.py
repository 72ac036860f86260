import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import T, scan_rows, study
from recontact.functions import hawkes
from recontact.operators.features import BOUNDED_FEATURES
from recontact.plans import models
from recontact.policy import DAY
from recontact.streaming import freshness


def simulate(rng, mu, alpha, beta, end):
    events, s = [], 0.0
    while True:
        rate = mu + alpha * beta * sum(np.exp(-beta * (s - t)) for t in events)
        s += rng.exponential(1 / rate)
        if s >= end:
            return np.array(events)
        if rng.random() * rate <= mu + alpha * beta * sum(np.exp(-beta * (s - t)) for t in events):
            events.append(s)


def grid_likelihood(events, end, beta):
    excite = beta * np.array([np.exp(-beta * (t - events[events < t])).sum() for t in events])
    loss = (1 - np.exp(-beta * (end - events))).sum()
    return lambda mu, alpha: np.log(mu + alpha * excite).sum() - mu * end - alpha * loss


def test_fit_reaches_the_likelihood_maximum():
    rng = np.random.default_rng(5)
    for beta in (hawkes.decay_rate(0.5), hawkes.decay_rate(8)):
        events = simulate(rng, 0.1, 0.5, beta, 168.0)
        times = events[None, :]
        mu, alpha = hawkes.fit_rows(times, np.ones_like(times, dtype=bool), 168.0, beta)
        value = grid_likelihood(events, 168.0, beta)
        best = max(value(m, a) for m in np.linspace(1e-6, 0.6, 120) for a in np.linspace(0, 0.99, 100))
        assert value(mu[0], alpha[0]) >= best - 1e-6


def test_residuals_tell_a_maximum_from_other_points():
    rng = np.random.default_rng(8)
    for beta in (hawkes.decay_rate(0.5), hawkes.decay_rate(8)):
        times = np.sort(rng.uniform(0, 168, (6, 30)))
        live = np.ones_like(times, dtype=bool)
        mu, alpha = hawkes.fit_rows(times, live, 168.0, beta)
        assert (hawkes.residuals(times, live, 168.0, beta, mu, alpha) < hawkes.SETTLED).all()
        assert (hawkes.residuals(times, live, 168.0, beta, mu * 1.01, alpha) > hawkes.SETTLED).all()
        few = hawkes.fit_rows(times, live, 168.0, beta, rounds=0)
        assert (hawkes.residuals(times, live, 168.0, beta, *few) > hawkes.SETTLED).all()


def test_padding_and_order_do_not_change_a_forecast():
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.uniform(0, 168, n)) for n in (1, 40, 3, 7)]
    together = hawkes.forecast_rows(lists, 168.0, hawkes.decay_rate(2))
    alone = [hawkes.forecast_rows([e], 168.0, hawkes.decay_rate(2))[0] for e in lists]
    assert together == pytest.approx(alone, abs=1e-7) and ((together > 0) & (together < 1)).all()


def test_short_half_lives_stay_finite():
    events = np.sort(np.random.default_rng(1).uniform(0, 168, 300))
    assert np.isfinite(hawkes.forecast_rows([events], 168.0, hawkes.decay_rate(5 / 60))).all()


def test_excitation_fold_equals_the_double_sum(spark):
    rows = [(T - x, 1, 2, float(-x % 40)) for x in (10, 400, 4000, 90000, 90000, 300000)]
    s = study(spark, [*rows, *scan_rows((1, 2), 10, 3600)])
    events = hawkes.pair_events(s.contacts, s.policy).where("day = 8")
    got = hawkes.hawkes_excitation(events, s.policy, (2.0,)).first()
    times = sorted({r[0] for r in rows})
    beta = np.log(2) / 2.0
    total = sum(np.exp(-beta * (a - b) / 3600) for a in times for b in times if b < a)
    assert got.events == 5 and got.excitation_sum == pytest.approx(total)


@pytest.fixture(scope="module")
def samples(spark):
    """Pairs with a lasting tie strength; contact follows it by a logistic rule, and the first feature is a noisy count of it."""
    draw = np.random.default_rng(23)
    tie = draw.gamma(1.5, 1.0, size=30)
    rows = []
    for d in range(12):
        split = "train" if d < 7 else "validation" if d < 9 else "test"
        for a, strength in enumerate(tie):
            label = int(draw.random() < 1 / (1 + np.exp(14.0 - 6.0 * strength)))
            rows.append((d * DAY, a, a + 1, 7, split, label, float(draw.poisson(12 * strength)) / 12, *map(float, draw.normal(size=len(BOUNDED_FEATURES) - 2))))
    frame = spark.createDataFrame(rows, "timestamp long, user_min long, user_max long, window_days int, split string, label int, " + ", ".join(f"{n} double" for n in BOUNDED_FEATURES[1:]))
    return frame.withColumn("pair_contact_count", F.lit(None).cast("double")).withColumn(
        "rssi_mean", F.when(F.col("user_min") % 5 != 0, F.col("rssi_mean"))).cache()


def test_learners_beat_prevalence_and_drop_empty_columns(samples):
    from recontact.functions.metrics import binary_metrics
    fitted = models.train_windows(samples, ("logistic_regression", "boosted_trees"), (7,), 42, {"boosted_trees": {"trees": 5}})
    assert "pair_contact_count" not in fitted[0].preparation.columns and fitted[0].preparation.indicators == ["rssi_mean"]
    scored = models.predictions(fitted, samples.where("split = 'test'"), ("label",))
    for r in binary_metrics(scored, ["model"]).collect():
        assert r.average_precision > 2 * r.positive_rate
    assert fitted[0].importance()[0][0] == "pair_contact_bins"
    top = models.sensitivity(fitted[0], samples.where("split = 'test'"), 1).groupBy("feature").count().orderBy(F.col("count").desc()).first()
    assert top.feature == "pair_contact_bins"


def test_medians_are_exact(samples):
    preparation = models.Preparation.fit(samples, ["rssi_max", "rssi_mean"])
    values = [r.rssi_max for r in samples.select("rssi_max").collect()]
    assert preparation.medians["rssi_max"] == pytest.approx(np.median(values))


def test_calibration_is_monotone_and_needs_both_classes(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(size=400)
    frame = spark.createDataFrame([(int(rng.random() < x ** 2), float(x)) for x in p], "label int, p double")
    share = frame.agg(F.avg("label")).first()[0]
    for method in ("sigmoid", "isotonic"):
        out = sorted((r.p, r.q) for r in models.calibrate(frame, frame, method).collect())
        assert all(b[1] >= a[1] - 1e-9 for a, b in zip(out, out[1:])) and abs(np.mean([q for _, q in out]) - share) < 0.01
    with pytest.raises(ValueError):
        models.calibrate(frame, frame.where("label = 1"), "sigmoid")


def test_stream_gate_keeps_pairs_with_two_fresh_ends(spark, tmp_path):
    now = 1_700_000_000
    observed = spark.createDataFrame([(now - 60, 1, True), (now - 30, 2, True), (now - 5000, 3, True), (now - 10, 4, None)], "s long, user_id long, scan_observed boolean")
    observed.select(F.timestamp_seconds("s").alias("event_time"), "user_id", "scan_observed").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_time timestamp, user_id long, scan_observed boolean").parquet(str(tmp_path / "in"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "user_min long, user_max long")
    got = []
    gate = freshness.start_gate(stream, pairs, lambda frame, _: got.extend((r.user_min, r.user_max) for r in frame.collect()), str(tmp_path / "cp"),
                                now=lambda: F.timestamp_seconds(F.lit(now)))
    gate.awaitTermination(120)
    assert got == [(1, 2)]
    with pytest.raises(ValueError):
        freshness.check_age(4000)


def test_fits_run_side_by_side_and_share_their_preparation(samples, monkeypatch):
    # fits followed one another, and each worked out the same medians again.
    prepared, together, fit = [], threading.Barrier(2), models.fit_model
    monkeypatch.setattr(models.Preparation, "fit", lambda *a, own=models.Preparation.fit: prepared.append(1) or own(*a))

    def beside(*args, **named):
        together.wait(60)
        return fit(*args, **named)

    monkeypatch.setattr(models, "fit_model", beside)
    models.train_windows(samples, ("logistic_regression", "boosted_trees"), (7,), 42, {"boosted_trees": {"trees": 2}})
    found = models.grid_search(samples, "logistic_regression", 7, [{"reg": 0.1}, {"reg": 10.0}], 42).collect()
    assert len(prepared) == 2 and sorted(r.trial for r in found) == [0, 1] and sum(r.selected for r in found) == 1


def test_recorded_stages_are_those_of_their_thread():
    # Fits side by side: a thread that removes what it has recorded must not remove another one's stage.
    from recontact.session import record_stage, recorded_stages
    with recorded_stages() as mine:
        other = threading.Thread(target=record_stage, args=("elsewhere",))
        other.start()
        other.join()
        record_stage("here")
    assert mine == ["here"]
