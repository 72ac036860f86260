import random

from helpers import T, at, scan_rows, study
from pyspark.sql import functions as F
from recontact.operators import features as fe
from recontact.policy import DAY, Policy

ROWS = [(T - 250, 5, 97, -80.0), (T - 200, 97, 5, -60.0), (T - 150, 5, 222, -50.0), (T - 100, 222, 97, -70.0)]


def test_hand_computed_pair(spark):
    s = study(spark, [*ROWS, *scan_rows((5, 97, 222), 11)])
    row = at(s.bounded(s.recent_keys, (1,)), T, *fe.BOUNDED_FEATURES)[(5, 97)]
    values = dict(zip(fe.BOUNDED_FEATURES, row))
    assert values["pair_contact_count"] == 2 and values["pair_contact_bins"] == 1 and values["pair_contact_days"] == 1
    assert values["recency_seconds"] == 200 and values["rssi_mean"] == -70 and values["rssi_max"] == -60
    assert values["common_neighbors"] == 1 and values["network_degree_a"] == 2 and values["participant_a_activity"] == 3
    assert values["scan_coverage_a"] == 1.0 and values["historical_contact_probability"] == 1.0 and values["observed_history_days"] == 1


def test_later_rows_change_nothing_at_t(spark):
    base = [*ROWS, *scan_rows((5, 97, 222), 11)]
    more = [(T, 5, 97, -1.0), (T + 1, 5, 222, -1.0), (T + 2, 97, 500, -1.0)]
    before, after = study(spark, base), study(spark, [*base, *more])
    assert at(before.bounded(before.recent_keys), T, "window_days", *fe.BOUNDED_FEATURES) == at(after.bounded(after.recent_keys), T, "window_days", *fe.BOUNDED_FEATURES)
    assert at(before.bank, T, *fe.BANK_FEATURES) == at(after.bank, T, *fe.BANK_FEATURES)


def brute(rows, scans, t, pair, w, threshold):
    a, b = pair
    near = [(ts, x, y) for ts, x, y in rows if t - w * DAY <= ts < t]
    own = [ts for ts, x, y in near if (x, y) == pair]
    friends = lambda u: {y if x == u else x for _, x, y in near if u in (x, y)}
    bucket = lambda u: {k for k in range(w) if len({ts // 300 for ts in scans.get(u, ()) if t - (k + 1) * DAY <= ts < t - k * DAY}) >= threshold}
    observed = bucket(a) & bucket(b)
    hit = {(t - 1 - ts) // DAY for ts in own}
    return (len(own), len({ts // 300 for ts in own}), len({ts // DAY for ts in own}), len(friends(a)), len(friends(b)),
            len(friends(a) & friends(b)), len(observed), len(hit & observed) / len(observed) if observed else None)


def test_sliding_frames_equal_brute_force_on_a_random_log_with_a_hub(spark):
    rng = random.Random(7)
    raw = []
    for _ in range(1500):
        a = 0 if rng.random() < 0.35 else rng.randrange(1, 15)
        b = rng.randrange(1, 15)
        if a != b:
            raw.append((rng.randrange(0, 12 * DAY), a, b, float(-rng.randrange(40, 90))))
    s = study(spark, raw, min_scan_coverage=2 / 288)
    rows = {(ts, min(a, b), max(a, b), r) for ts, a, b, r in raw}
    plain = [(ts, a, b) for ts, a, b, _ in rows]
    scans = {}
    for ts, a, _, _ in raw:
        scans.setdefault(a, set()).add(ts // 300 * 300)
    names = ("pair_contact_count", "pair_contact_bins", "pair_contact_days", "network_degree_a", "network_degree_b", "common_neighbors",
             "observed_history_days", "historical_contact_probability")
    got = s.bounded(s.recent_keys).where(F.col("timestamp").isin(T, T + DAY)).collect()
    assert got
    for r in got:
        assert tuple(r[n] for n in names) == brute(plain, scans, r.timestamp, (r.user_min, r.user_max), r.window_days, 2)


def test_window_view_hides_longer_spans(spark):
    s = study(spark, [(T - 2 * DAY, 5, 97, -60.0), *scan_rows((5, 97), 11)])
    view = at(fe.feature_window_view(s.bank, 1), T, "contact_count_1d", "contact_count_3d", "rssi_mean_7d", "historical_contact_probability",
              "common_neighbors_historical", "time_since_last_contact", "prediction_hour")
    assert view[(5, 97)] == (0.0, None, None, None, None, None, 8.0)


def test_weekday_needs_a_documented_origin(spark):
    keys = spark.createDataFrame([(5 * DAY,)], "timestamp long")
    assert fe.time_context(keys, Policy()).first().relative_weekday is None
    row = fe.time_context(keys, Policy(weekday_origin=0)).first()
    assert (row.relative_weekday, row.is_relative_weekend) == (5.0, 1.0)
