"""Independent SQL for every query with an exact answer."""

from __future__ import annotations

from queries.ctes import sql
from recontact.functions.scorecard import POINTS

ORACLES: dict[str, str] = {}
K = "t AS timestamp, a AS user_min, b AS user_max"
R = lambda expression, name=None: f"round(CAST({expression} AS DOUBLE), 6) AS {name or expression}"
I = lambda expression, name: f"CAST({expression} AS BIGINT) AS {name}"


def add(name: str, body: str, **own: str) -> None:
    ORACLES[name] = sql(body, **own)


# ---- sources
add("read_scan_log", "SELECT ts AS timestamp, user_a, user_b, coalesce(rssi, -99.0) AS rssi FROM raw_log")
add("read_call_log", """SELECT CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01') AS BIGINT) AS timestamp, o_custkey AS user_a,
    o_orderkey % 1500 AS user_b, o_orderkey % 600 - 1 AS duration FROM orders""")
add("read_proximity_log", "SELECT ts AS timestamp, user_a, user_b, class_a, class_b FROM prox")
add("read_triplets", "SELECT CAST(epoch(l_shipdate) AS BIGINT) AS timestamp, l_partkey AS user_a, l_suppkey AS user_b FROM lineitem WHERE l_linenumber <> 7")
add("read_mapped_edges", """SELECT CAST(epoch(o_orderdate) AS BIGINT) - 7200 AS timestamp, CAST(o_custkey AS VARCHAR) AS user_a,
    CAST(o_orderkey AS VARCHAR) AS user_b FROM orders""")
FAULTY = """SELECT event_id, dataset_id, rssi, event_id % 101 = 0 AS bad_time, event_id % 101 <> 0 AND event_id % 103 = 0 AS neg_time,
    event_id % 107 = 0 AS frac_a, event_id % 107 <> 0 AND event_id % 109 = 0 AS neg_a, user_a, CASE WHEN event_id % 113 = 0 THEN -3 ELSE user_b END AS user_b FROM raw_log"""
add("validate_rows", """SELECT reason, count(*) AS rows, min(event_id) AS first_row FROM (SELECT event_id, CASE
    WHEN bad_time THEN 'timestamp not a finite number' WHEN frac_a THEN 'user_a not an integer' WHEN rssi IS NULL THEN 'rssi not a finite number'
    WHEN neg_time THEN 'timestamp negative' WHEN neg_a OR user_a < 0 THEN 'user_a negative' WHEN user_b < -2 THEN 'user_b below its minimum' END AS reason
    FROM faulty) WHERE reason IS NOT NULL GROUP BY reason""", faulty=FAULTY)
add("classify_rows", """SELECT dataset_id, count(*) AS raw_rows, count(*) FILTER (bad) AS invalid_rows, count(*) FILTER (NOT bad AND user_a = user_b) AS self_contact_rows,
    count(*) FILTER (NOT bad AND user_a <> user_b) AS event_rows
    FROM (SELECT *, bad_time OR neg_time OR frac_a OR neg_a OR user_a < 0 OR user_b < 0 AS bad FROM faulty) GROUP BY dataset_id""", faulty=FAULTY)
add("source_profile", """SELECT count(*) AS rows, min(ts) AS timestamp_min, max(ts) AS timestamp_max, count(*) FILTER (user_b = -1) AS empty_scans,
    count(*) FILTER (user_b = -2) AS external_scans, count(*) FILTER (user_a = user_b) AS self_contacts, min(rssi) AS rssi_min, max(rssi) AS rssi_max FROM raw_log""")
add("probe_source", "SELECT least(count(*), 20) AS lines, least(count(*), 20) AS matching FROM lineitem WHERE l_linenumber <> 7")

# ---- cleaning
add("canonical_contacts", "SELECT ts AS timestamp, a AS user_min, b AS user_max, rssi FROM canon")
add("classed_contacts", """SELECT DISTINCT ts AS timestamp, least(user_a, user_b) AS user_min, greatest(user_a, user_b) AS user_max,
    CASE WHEN user_a > user_b THEN class_b ELSE class_a END AS class_min, CASE WHEN user_a > user_b THEN class_a ELSE class_b END AS class_max
    FROM prox WHERE user_a <> user_b""")
add("dedup_contacts", "SELECT ts AS timestamp, a AS user_min, b AS user_max, rssi FROM con")
add("observations", "SELECT ts AS timestamp, u AS user_id, true AS scan_observed FROM obs")
add("contact_only_observations", """SELECT DISTINCT (ts // 20) * 20 AS timestamp, u AS user_id, true AS unknown
    FROM (SELECT ts, user_a AS u FROM prox WHERE user_a <> user_b UNION ALL SELECT ts, user_b FROM prox WHERE user_a <> user_b)""")
add("relative_time", """SELECT ts - (SELECT min(ts) // 86400 * 86400 FROM prox) AS timestamp, ts AS source_timestamp, user_a, user_b FROM prox""")
add("participants", "SELECT u AS user_id FROM people")
COVER = """SELECT p.u, s.d + 1 AS study_day, count(o.ts) AS n FROM people p CROSS JOIN sched s LEFT JOIN obs o ON o.u = p.u AND o.ts // 86400 = s.d GROUP BY p.u, s.d"""
add("daily_coverage", f"SELECT u AS user_id, study_day, n AS recorded_bins, CAST(288 AS BIGINT) AS expected_scan_bins, {R('n / 288.0', 'scan_coverage')} FROM cover", cover=COVER)
QUALITY = """SELECT count(*) AS input_rows, count(*) FILTER (user_a < 0 OR user_b < 0) AS invalid_id_rows,
    count(*) FILTER (user_a >= 0 AND user_b >= 0 AND user_a = user_b) AS self_contact_rows, count(*) FILTER (user_b = -1) AS empty_scan_rows,
    count(*) FILTER (user_b = -2) AS external_device_rows, (SELECT count(*) FROM canon) - (SELECT count(*) FROM con) AS duplicate_contact_rows,
    (SELECT count(*) FROM con) AS contact_rows, (SELECT count(*) FROM people) AS participants, (SELECT count(*) FROM obs) AS observation_bins,
    min(ts) AS source_timestamp_min, max(ts) AS source_timestamp_max, (SELECT min(rssi) FROM con) AS rssi_min, (SELECT max(rssi) FROM con) AS rssi_max,
    (SELECT round(avg(rssi), 6) FROM con) AS rssi_mean, count(*) FILTER (rssi IS NULL) AS missing_rssi, count(*) FILTER (ts IS NULL) AS missing_timestamp FROM raw_log"""
add("quality_report", QUALITY)
add("daily_contacts", "SELECT ts // 86400 + 1 AS study_day, count(*) AS contact_rows FROM con GROUP BY 1")
add("duplicate_counts", """SELECT dataset_id, count(*) AS event_rows, count(DISTINCT (ts, a, b)) AS unique_contact_records,
    count(*) - count(DISTINCT (ts, a, b)) AS duplicate_canonical_records FROM canon GROUP BY 1""")
add("unique_contacts", "SELECT ds AS dataset_id, ts AS timestamp, a AS user_min, b AS user_max FROM uniq")
add("namespace_violations", "SELECT count(DISTINCT dataset_id) AS namespaces, count(*) FILTER (a < 0 OR a >= b) AS non_canonical_rows FROM canon")
add("rssi_anomalies", "SELECT count(*) FILTER (rssi > 0) AS positive_rssi_rows, count(*) AS contact_rows FROM con")

# ---- snapshots, candidates, labels
add("snapshots", "SELECT t AS timestamp, d + 1 AS study_day, t >= lo AND t + 86400 <= hi AS complete FROM sched, span")
add("complete_times", "SELECT w AS window_days, t AS timestamp FROM snap CROSS JOIN wins, span WHERE t - w * 86400 >= lo")
add("snapshot_capacity", """SELECT h AS interval_hours, count(*) AS complete_snapshots, count(*) FILTER (i < f AND t + 86400 < tf) AS train_times,
    count(*) FILTER (i >= f AND i < s AND t + 86400 < ts) AS validation_times, count(*) FILTER (i >= s) AS test_times
    FROM (SELECT *, max(t) FILTER (i = f) OVER (PARTITION BY h) AS tf, max(t) FILTER (i = s) OVER (PARTITION BY h) AS ts FROM
     (SELECT *, CAST(trunc(m * 0.6::DOUBLE) AS BIGINT) AS f, CAST(trunc(m * 0.8::DOUBLE) AS BIGINT) AS s FROM
      (SELECT h, t, row_number() OVER (PARTITION BY h ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY h) AS m
       FROM (SELECT CAST(h AS BIGINT) AS h, unnest(range(CASE WHEN h = 24 THEN 28800 ELSE 0 END, (SELECT hi + 1 FROM span), h * 3600)) AS t FROM (SELECT unnest([24, 6, 1]) AS h)), span
       WHERE t >= lo AND t + 86400 <= hi))) GROUP BY h""")
add("known_pairs", f"SELECT {K} FROM known")
add("candidates_1d", f"SELECT {K} FROM cand1")
add("candidates_7d", f"SELECT {K} FROM cand7")
add("future_positives", f"SELECT {K} FROM pos")
add("future_coverage", f"SELECT t AS timestamp, u AS user_id, n AS bins, {R('n / 288.0', 'coverage')} FROM fcov")
add("labels_24h", f"""SELECT {K}, y AS label_24h, {R('ca', 'scan_coverage_a')}, {R('cb', 'scan_coverage_b')}, ok AS eligible_for_evaluation,
    CASE WHEN NOT ok THEN 'low_scan_coverage' END AS exclusion_reason FROM lab""")
add("label_funnel", """SELECT t AS timestamp, count(*) AS candidate_rows, count(*) FILTER (ok) AS eligible_samples, count(*) FILTER (y = 1) AS positive_labels,
    count(*) FILTER (y = 0) AS negative_labels, count(*) FILTER (y IS NULL) AS unknown_labels FROM lab GROUP BY t""")
add("reveal_outcomes", f"""SELECT {K}, {R('na / 288.0', 'future_scan_coverage_a')}, {R('nb / 288.0', 'future_scan_coverage_b')},
    complete AND least(na, nb) >= 2 AS strict_future_covered, CASE WHEN hit THEN 1 WHEN complete AND least(na, nb) >= 2 THEN 0 END AS label_24h,
    CASE WHEN hit THEN 'Contact' WHEN complete AND least(na, nb) >= 2 THEN 'No Contact' ELSE 'Unknown' END AS outcome,
    CASE WHEN hit THEN 'observed_positive_evidence' WHEN complete AND least(na, nb) >= 2 THEN 'adequately_observed_no_contact'
         WHEN NOT complete THEN 'future_window_incomplete' ELSE 'low_scan_coverage' END AS outcome_reason,
    hit OR (complete AND least(na, nb) >= 2) AS reliable_label FROM rev""")
add("backtest_outcomes", f"""SELECT {K}, CASE WHEN NOT complete THEN 'Unknown' WHEN hit THEN 'Contact' WHEN least(na, nb) >= 2 THEN 'No Contact' ELSE 'Unknown' END AS outcome,
    CASE WHEN NOT complete THEN 'future_window_incomplete' WHEN hit THEN 'observed_positive_evidence' WHEN least(na, nb) >= 2 THEN 'adequately_observed_no_contact'
         ELSE 'low_scan_coverage' END AS reason FROM rev""")
add("coverage_sensitivity", """SELECT round(m / 288.0, 6) AS threshold, count(*) FILTER (least(ca, cb) >= m / 288.0) AS samples,
    count(*) FILTER (least(ca, cb) >= m / 288.0 AND y = 1) AS positive, count(*) FILTER (least(ca, cb) >= m / 288.0 AND coalesce(y, 0) <> 1) AS negative
    FROM lab CROSS JOIN (SELECT unnest([1, 2, 4]) AS m) GROUP BY m""")
add("candidate_expansion", """SELECT l.t AS timestamp, count(*) FILTER (s.t IS NOT NULL) AS candidates_1d, count(*) FILTER (s.t IS NOT NULL AND ok) AS eligible_1d,
    count(*) FILTER (s.t IS NOT NULL AND ok AND y = 1) AS positive_1d, count(*) AS candidates_7d, count(*) FILTER (ok) AS eligible_7d,
    count(*) FILTER (ok AND y = 1) AS positive_7d, count(*) FILTER (ok AND s.t IS NULL) AS extra_eligible_rows
    FROM lab l JOIN cand7 c ON c.t = l.t AND c.a = l.a AND c.b = l.b LEFT JOIN cand1 s ON s.t = l.t AND s.a = l.a AND s.b = l.b GROUP BY l.t""")

# ---- features
PIV = lambda value, name, ws: ", ".join(f"max({value}) FILTER (w = {w}) AS {name}_{w}d" for w in ws)
add("contact_counts", f"SELECT {K}, {PIV('n', 'contact_count', (1, 3, 7, 14))} FROM hist_known GROUP BY t, a, b")
add("contact_bins", f"SELECT {K}, {PIV('bins', 'contact_bins', (1, 7))} FROM hist_known GROUP BY t, a, b")
add("contact_days", f"SELECT {K}, {PIV('days', 'contact_days', (1, 3, 7, 14))} FROM hist_known GROUP BY t, a, b")
add("asof_last_contact", f"SELECT {K}, t - last AS time_since_last_contact FROM ever")
add("recency", f"SELECT {K}, {PIV('t - last', 'recency', (1, 3, 7))} FROM hist_known GROUP BY t, a, b")
add("rssi_stats", f"SELECT {K}, {R('rmean', 'rssi_mean_7d')}, {R('rmax', 'rssi_max_7d')} FROM hist_known WHERE w = 7")
US = "t AS timestamp, u AS user_id"
ZERO = lambda value, name: ", ".join(f"coalesce(max({value}) FILTER (w = {w}), 0) AS {name}_{w}d" for w in (1, 3, 7))
add("activity", f"SELECT {US}, {ZERO('act', 'activity')} FROM ustat GROUP BY t, u")
add("degree", f"SELECT {US}, {ZERO('deg', 'degree')} FROM ustat GROUP BY t, u")
add("common_neighbours", f"SELECT {K}, w AS window_days, cn AS common_neighbors FROM cn_cand")
COV = ", ".join(f"round(coalesce(max(n) FILTER (w = {w}), 0) / ({w} * 288.0), 6) AS coverage_{w}d" for w in (1, 3, 7))
add("history_coverage", f"SELECT {US}, {COV} FROM uscan GROUP BY t, u")
add("contact_probability", f"SELECT {K}, w AS window_days, CASE WHEN seen > 0 THEN round(hits / CAST(seen AS DOUBLE), 6) END AS historical_contact_probability FROM prob_cand")
add("observed_days", f"SELECT {K}, w AS window_days, CAST(seen AS DOUBLE) AS observed_history_days FROM prob_cand")
add("time_context", f"""SELECT {K}, CAST(t // 86400 AS DOUBLE) AS prediction_day_index, CAST(t % 86400 // 3600 AS DOUBLE) AS prediction_hour,
    CAST(t // 86400 % 7 AS DOUBLE) AS relative_weekday, CASE WHEN t // 86400 % 7 >= 5 THEN 1.0 ELSE 0.0 END AS is_relative_weekend FROM cand1""")
FULL = ", ".join(f"CAST(CAST(t - {w} * 86400 >= lo AS INT) AS DOUBLE) AS history_complete_{w}d" for w in (1, 3, 7, 14))
add("history_complete", f"SELECT {K}, {FULL} FROM cand1, span")
D = lambda value, name: f"CAST({value} AS DOUBLE) AS {name}"


def _bank(days: int | None) -> str:
    cut = lambda span, value, name: D(value if days is None or span <= days else "NULL", name)
    rounded = lambda span, value, name: R(value if days is None or span <= days else "NULL", name)
    age = "age" if days is None else f"CASE WHEN age <= {days} * 86400 THEN age END"
    full = ", ".join(cut(w, f"CAST(t - {w} * 86400 >= lo AS INT)", f"history_complete_{w}d") for w in (1, 3, 7, 14))
    return f"""SELECT {K}, {cut(1, 'n1', 'contact_count_1d')}, {cut(3, 'n3', 'contact_count_3d')}, {cut(7, 'n7', 'contact_count_7d')}, {cut(14, 'n14', 'contact_count_14d')},
    {cut(1, 'bins1', 'contact_bins_1d')}, {cut(7, 'bins7', 'contact_bins_7d')}, {D(age, 'time_since_last_contact')}, {cut(7, 'days7', 'unique_contact_days_7d')},
    {cut(14, 'days14', 'unique_contact_days_14d')}, {rounded(14, 'prob', 'historical_contact_probability')}, {rounded(7, 'rmean', 'rssi_mean_7d')},
    {rounded(7, 'rmax', 'rssi_max_7d')}, CAST(NULL AS DOUBLE) AS sms_count_7d, CAST(NULL AS DOUBLE) AS call_count_7d, {D('t // 86400', 'prediction_day_index')},
    {D('t % 86400 // 3600', 'prediction_hour')}, CAST(NULL AS DOUBLE) AS relative_weekday, CAST(NULL AS DOUBLE) AS is_relative_weekend,
    {cut(7, 'acta', 'participant_a_activity_7d')}, {cut(7, 'actb', 'participant_b_activity_7d')}, {cut(7, 'cn', 'common_neighbors_historical')},
    {cut(7, 'dega', 'historical_network_degree_a')}, {cut(7, 'degb', 'historical_network_degree_b')}, {rounded(7, 'ca', 'scan_coverage_a')},
    {rounded(7, 'cb', 'scan_coverage_b')}, {full} FROM bank14"""


add("feature_bank_14d", _bank(None))
add("feature_window_view", _bank(7))
add("feature_bank_bounded", f"""SELECT {K}, w AS window_days, {D('n', 'pair_contact_count')}, {D('bins', 'pair_contact_bins')}, {D('days', 'pair_contact_days')},
    {D('recency', 'recency_seconds')}, {R('rmean', 'rssi_mean')}, {R('rmax', 'rssi_max')}, {D('acta', 'participant_a_activity')}, {D('actb', 'participant_b_activity')},
    {D('cn', 'common_neighbors')}, {D('dega', 'network_degree_a')}, {D('degb', 'network_degree_b')}, {R('ca', 'scan_coverage_a')}, {R('cb', 'scan_coverage_b')},
    {R('prob', 'historical_contact_probability')}, {D('seen', 'observed_history_days')} FROM bank1""")
add("pair_trend", """SELECT k.t AS timestamp, k.a AS user_min, k.b AS user_max, k.d AS study_day, count(c.ts) AS contact_records
    FROM (SELECT t, a, b, unnest(range(greatest(t - 7 * 86400, 0) // 86400 + 1, (t - 1) // 86400 + 2)) AS d FROM cand1) k
    LEFT JOIN con c ON c.a = k.a AND c.b = k.b AND c.ts >= k.t - 7 * 86400 AND c.ts < k.t AND c.ts // 86400 + 1 = k.d GROUP BY k.t, k.a, k.b, k.d""")

# ---- integrity
add("one_to_one_join", """SELECT CASE WHEN c.t IS NULL THEN 'right_only' WHEN p.t IS NULL THEN 'left_only' ELSE 'both' END AS provenance, count(*) AS keys,
    CAST(0 AS BIGINT) AS repeated_keys FROM cand7 c FULL JOIN pos p ON p.t = c.t AND p.a = c.a AND p.b = c.b GROUP BY 1""")
add("missing_scores", f"SELECT {K} FROM (SELECT t, a, b FROM pos EXCEPT SELECT t, a, b FROM cand1)")
add("semi_filter", f"SELECT {K} FROM (SELECT t, a, b FROM pos INTERSECT SELECT t, a, b FROM cand1)")
add("pool_sets", """SELECT coalesce(s.ds, f.ds) AS dataset_id, CASE WHEN f.ds IS NULL THEN 'candidate_only' WHEN s.ds IS NULL THEN 'positive_only' ELSE 'both' END AS part, count(*) AS pairs
    FROM (SELECT * FROM uscore WHERE w = 1) s FULL JOIN (SELECT f.* FROM ufut f SEMI JOIN (SELECT ds, t FROM utime WHERE w = 1) k ON k.ds = f.ds AND k.t = f.t) f
    ON f.ds = s.ds AND f.t = s.t AND f.a = s.a AND f.b = s.b GROUP BY 1, 2""")
add("key_violations", """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
    CAST(coalesce(sum(n) FILTER (a >= b), 0) AS BIGINT) AS non_canonical_pairs, CAST(0 AS BIGINT) AS bad_labels FROM (SELECT t, a, b, count(*) AS n FROM
    (SELECT t, a, CASE WHEN b = 7 THEN a ELSE b END AS b FROM (SELECT * FROM lab UNION ALL SELECT * FROM lab WHERE a = 0)) GROUP BY t, a, b)""")
add("cohort_reconcile", """SELECT (SELECT count(*) FROM cand1) AS samples, count(*) AS old_rows, count(c.t) AS matched, count(*) - count(c.t) AS old_missing_in_new, CAST(0 AS BIGINT) AS label_conflicts
    FROM cohort o LEFT JOIN cand1 c ON c.t = o.t AND c.a = o.a AND c.b = o.b""")
DIFF = """SELECT x.k1 IS NOT NULL AND y.k1 IS NOT NULL AS m, x.lines AS l1, y.lines AS l2, x.q AS q1, y.q AS q2 FROM (SELECT * FROM li WHERE k1 % 50 <> 0) x
    FULL JOIN (SELECT k1, k2, CASE WHEN k2 % 17 = 0 THEN lines + 1 ELSE lines END AS lines, CASE WHEN k1 % 13 = 0 THEN q + 1e-3 ELSE q END AS q FROM li WHERE k2 % 50 <> 0) y
    ON y.k1 = x.k1 AND y.k2 = x.k2"""
add("table_diff", """SELECT c AS column_name, count(*) FILTER (m) AS compared, count(*) FILTER (m AND CASE c WHEN 'lines' THEN l1 <> l2 WHEN 'quantity' THEN abs(q1 - q2) > 1e-6 ELSE false END) AS differences,
    count(*) FILTER (NOT m) AS one_sided_keys FROM diff CROSS JOIN (SELECT unnest(['lines', 'quantity', 'discount']) AS c) GROUP BY c""",
    li="SELECT l_orderkey AS k1, l_partkey AS k2, sum(l_linenumber) AS lines, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2", diff=DIFF)
add("identity_checks", """SELECT rule, (SELECT count(*) FROM uagg) AS checked, CAST(0 AS BIGINT) AS failed
    FROM (SELECT unnest(['candidates_partition', 'positives_partition', 'hits_bounded', 'capture_ratio', 'reach_ratio']) AS rule)""")

# ---- splits
KL = "l.t AS timestamp, l.a AS user_min, l.b AS user_max"
add("training_cohort", f"""SELECT {KL}, l.y AS label_24h, CAST(b.n7 AS DOUBLE) AS contact_count_7d, {R('b.prob', 'historical_contact_probability')}
    FROM lab l JOIN bank14 b ON b.t = l.t AND b.a = l.a AND b.b = l.b WHERE l.ok AND l.y IS NOT NULL""")
add("chrono_split", "SELECT c.t AS timestamp, c.a AS user_min, c.b AS user_max, p.split FROM cohort c JOIN plan p ON p.t = c.t")
add("validation_partition", """SELECT t AS timestamp, CASE WHEN t + 86400 < cut THEN 'calibration' WHEN t >= cut THEN 'tuning' ELSE 'purged' END AS part
    FROM (SELECT t, max(t) FILTER (i = m // 2 AND m // 2 >= 1) OVER () AS cut FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS m FROM plan WHERE split = 'validation'))""")
add("common_cohort", f"""SELECT 'scans' AS dataset_id, 'scans|' || t || '|' || a || '|' || b AS sample_key, {K}, y AS label_24h,
    {R('ca', 'future_scan_coverage_a')}, {R('cb', 'future_scan_coverage_b')} FROM cohort""")
add("cohort_funnel", """SELECT l.t AS timestamp, count(*) AS all_past_candidate_rows, count(*) FILTER (NOT w) AS excluded_incomplete_7d_span, count(*) FILTER (w AND r) AS one_day_candidates,
    count(*) FILTER (w AND NOT r) AS excluded_not_1d_candidate, count(*) FILTER (w AND r AND NOT ok) AS excluded_coverage_or_unknown, count(*) FILTER (w AND r AND ok) AS eligible_rows,
    count(*) FILTER (w AND r AND ok AND y = 1) AS positive, count(*) FILTER (w AND r AND ok AND y = 0) AS negative
    FROM (SELECT l.*, l.t - 7 * 86400 >= lo AS w, c.t IS NOT NULL AS r FROM lab l LEFT JOIN cand1 c ON c.t = l.t AND c.a = l.a AND c.b = l.b, span) l GROUP BY l.t""")
SUPPORT = """SELECT s.split, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS rows, CAST(coalesce(sum(g.p), 0) AS BIGINT) AS positive, CAST(coalesce(sum(g.q), 0) AS BIGINT) AS negative,
    count(g.t) AS prediction_times FROM (SELECT unnest(['train', 'validation', 'test', 'purged']) AS split) s LEFT JOIN plan g ON g.split = s.split GROUP BY s.split"""
add("split_support", "SELECT *, prediction_times >= 2 AND least(positive, negative) >= 5 AS supported FROM support", support=SUPPORT)
add("purged_by_day", "SELECT t AS timestamp, n AS rows, p AS positive, q AS negative FROM plan WHERE split = 'purged'")
add("feasibility", """SELECT split, rows, concat_ws('; ', CASE WHEN prediction_times < 2 THEN 'fewer than 2 prediction times' END,
    CASE WHEN least(positive, negative) < 5 THEN 'fewer than 20 samples in one class' END, CASE WHEN split = 'train' AND rows < 200 THEN 'fewer than 200 reliable samples' END) AS reasons,
    NOT (prediction_times < 2 OR least(positive, negative) < 5 OR (split = 'train' AND rows < 200)) AS feasible FROM support WHERE split <> 'purged'""", support=SUPPORT)
FOLD_COLUMNS = """CAST({r}_p AS BIGINT) AS {r}_positive, CAST({r}_q AS BIGINT) AS {r}_negative"""
FC = ", ".join(FOLD_COLUMNS.format(r=r) for r in ("train", "validation", "test"))
add("rolling_folds", f"SELECT f AS test_time, train_times, validation_times, test_times, {FC}, status FROM fold_status")
WALK = """SELECT s.d, g.t, g.p, g.q, CASE WHEN g.r <= 3 AND g.t + 86400 < s.start THEN 'validation' WHEN g.t >= s.start AND g.t < s.start + 2 * 86400 THEN 'test' END AS role
    FROM (SELECT CAST(d AS BIGINT) AS d, (d - 1) * 86400 + 28800 AS start FROM (SELECT unnest([10, 16, 19, 22]) AS d)) s
    JOIN (SELECT s2.d AS d2, c.*, row_number() OVER (PARTITION BY s2.d, c.t + 86400 < (s2.d - 1) * 86400 + 28800 ORDER BY c.t DESC) AS r FROM tc c CROSS JOIN (SELECT unnest([10, 16, 19, 22]) AS d) s2) g ON g.d2 = s.d"""
WALK2 = "SELECT d, t, p, q, coalesce(role, CASE WHEN t + 86400 < min(t) FILTER (role = 'validation') OVER (PARTITION BY d) THEN 'train' END) AS role FROM walk"
_part = lambda r: f"count(*) FILTER (role = '{r}') AS {r}_times, CAST(coalesce(sum(p) FILTER (role = '{r}'), 0) AS BIGINT) AS {r}_positive, CAST(coalesce(sum(q) FILTER (role = '{r}'), 0) AS BIGINT) AS {r}_negative"
add("forward_folds", """SELECT *, CASE WHEN validation_times = 3 AND train_times >= 3 AND test_times = 2 AND least(train_positive, train_negative, validation_positive, validation_negative, test_positive, test_negative) >= 5
    THEN 'ready' ELSE 'insufficient_days' END AS status FROM (SELECT d AS study_day, """ + ", ".join(_part(r) for r in ("train", "validation", "test")) + " FROM walk2 GROUP BY d)", walk=WALK, walk2=WALK2)
GROUP = lambda user, salt: f"instr('13579bdf', right(sha256('T38|' || {salt} || '|scans|' || {user}), 1)) > 0"
SALT = "(SELECT unnest(['s1', 's2', 's3', 's4', 's5']) AS salt)"
add("participant_groups", f"SELECT salt, u AS user_id, CAST({GROUP('u', 'salt')} AS INT) AS side FROM people CROSS JOIN {SALT}")
add("holdout_gate", """SELECT salt, f AS test_time, set_name, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positive, CAST(sum(q) AS BIGINT) AS negative,
    CASE WHEN min(least(sum(p), sum(q))) OVER (PARTITION BY salt, f) >= 5 AND count(*) OVER (PARTITION BY salt, f) = 4 THEN 'evaluated' ELSE 'insufficient_class_rows' END AS status
    FROM (SELECT h.*, r.f, CASE WHEN role <> 'test' AND pop = 'train' THEN role WHEN role = 'test' AND pop <> 'train' THEN pop END AS set_name FROM held h JOIN role r ON r.t = h.t)
    WHERE set_name IS NOT NULL GROUP BY salt, f, set_name""",
    held=f"""SELECT salt, t, CASE WHEN NOT ga AND NOT gb THEN 'train' WHEN ga AND gb THEN 'unseen_both' ELSE 'unseen_one' END AS pop, count(*) AS n, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q
    FROM (SELECT salt, t, y, {GROUP('a', 'salt')} AS ga, {GROUP('b', 'salt')} AS gb FROM cohort CROSS JOIN {SALT}) GROUP BY 1, 2, 3""")

# ---- graphs
add("historical_edges", f"SELECT {K}, wt AS weight, last AS last_contact FROM edge7")
add("historical_nodes", "SELECT t AS timestamp, u AS user_id, CAST(act AS BIGINT) AS activity, deg AS historical_degree, last AS last_contact FROM node7")
add("network_density", """SELECT e.t AS timestamp, n AS nodes, e.c AS edges, round(CASE WHEN n > 1 THEN 2.0 * e.c / (n * (n - 1)) ELSE 0 END, 6) AS density
    FROM (SELECT t, count(*) AS c FROM edge3 GROUP BY t) e JOIN (SELECT t, count(DISTINCT u) AS n FROM (SELECT t, a AS u FROM edge3 UNION ALL SELECT t, b FROM edge3) GROUP BY t) n ON n.t = e.t""")
add("source_densities", """SELECT e.ds AS dataset_id, e.t AS timestamp, e.w AS window_days, n AS nodes, e.c AS edges, round(CASE WHEN n > 1 THEN 2.0 * e.c / (n * (n - 1)) ELSE 0 END, 6) AS density
    FROM (SELECT ds, w, t, count(*) AS c FROM uhist GROUP BY 1, 2, 3) e JOIN (SELECT ds, w, t, count(DISTINCT u) AS n FROM uadj GROUP BY 1, 2, 3) n ON n.ds = e.ds AND n.w = e.w AND n.t = e.t""")
add("bounded_subgraph_nodes", "SELECT t AS timestamp, u AS user_id, CAST(act AS BIGINT) AS activity, deg AS historical_degree, last AS last_contact FROM pick7")
add("bounded_subgraph_edges", f"""SELECT {K}, wt AS weight, last AS last_contact FROM (SELECT *, min(r) FILTER (foc) OVER (PARTITION BY t) AS ff,
    CASE WHEN foc THEN row_number() OVER (PARTITION BY t, foc ORDER BY wt DESC, CASE WHEN a = 5 THEN b ELSE a END) END AS fr FROM in7)
    WHERE r < 20 OR (r = 20 AND coalesce(ff <= 20, true)) OR (coalesce(ff > 20, false) AND coalesce(fr = 1, false))""")
add("network_summary", f"""SELECT e.ds AS dataset_id, n AS nodes, m AS edges, CAST(recs AS BIGINT) AS unique_contact_records, {R('CASE WHEN n > 1 THEN 2.0 * m / (n * (n - 1)) ELSE 0 END', 'density')}, {R('2.0 * m / n', 'mean_degree')}
    FROM (SELECT ds, count(*) AS m, sum(n) AS recs FROM edges GROUP BY ds) e JOIN (SELECT ds, count(*) AS n FROM udeg GROUP BY ds) d ON d.ds = e.ds""")
ORACLES["components"] = sql("""SELECT ds AS dataset_id, count(*) AS components, max(n) AS largest_component_nodes FROM (SELECT ds, c, count(*) AS n FROM
    (SELECT ds, u, min(v) AS c FROM reach GROUP BY ds, u) GROUP BY ds, c) GROUP BY ds""", recursive=True,
    lnk="SELECT ds, a AS u, b AS v FROM edges UNION SELECT ds, b, a FROM edges",
    reach="SELECT ds, u, u AS v FROM udeg UNION SELECT r.ds, r.u, l.v FROM reach r JOIN lnk l ON l.ds = r.ds AND l.u = r.v")
add("degree_histogram", "SELECT ds AS dataset_id, bin, c AS count FROM deg_hist")
add("pair_histogram", "SELECT ds AS dataset_id, CASE WHEN n <= 5 THEN '1–5' WHEN n <= 20 THEN '6–20' WHEN n <= 100 THEN '21–100' ELSE '>100' END AS bin, count(*) AS count FROM edges GROUP BY 1, 2")
add("daily_repeat_pairs", f"SELECT ds AS dataset_id, study_day, {I('records', 'records')}, active AS active_pairs, repeated AS previous_day_repeated_pairs FROM drep")
add("repeated_pairs", "SELECT ds AS dataset_id, count(*) FILTER (n >= 2) AS pairs_active_on_multiple_days FROM (SELECT ds, a, b, count(*) AS n FROM dpair GROUP BY 1, 2, 3) GROUP BY ds")

# ---- retrieval
UK = "ds AS dataset_id, t AS timestamp, w AS window_days"
add("retrieval_scores", f"SELECT {UK}, a AS user_min, b AS user_max, {R('fr', 'historical_frequency')}, re AS last_contact_recency, cn AS common_neighbors FROM uscore")
add("rank_scores", f"SELECT {UK}, method, a AS user_min, b AS user_max, {R('score', 'score')}, r AS rank FROM urank")
add("retrieval_metrics", f"""SELECT {UK}, method, k, n AS candidate_count, total AS future_observed_positive_pairs, pool AS future_positive_pairs_in_candidate_pool, hits AS observed_positive_hits_at_k,
    least(k, n) AS actual_k, total - pool AS future_positive_pairs_outside_candidate_pool, n - pool AS unknown_candidate_count, CASE WHEN pool > 0 THEN round(hits / CAST(pool AS DOUBLE), 6) END AS observed_positive_capture_at_k,
    CASE WHEN total > 0 THEN round(hits / CAST(total AS DOUBLE), 6) END AS observed_positive_capture_all_at_k, CASE WHEN total > 0 THEN round(pool / CAST(total AS DOUBLE), 6) END AS candidate_reach_of_observed_positives,
    CASE WHEN n = 0 THEN 'no_candidates' WHEN total = 0 THEN 'no_future_observed_positives' WHEN pool = 0 THEN 'no_positive_in_candidate_pool' ELSE 'observed_positive_retrieval' END AS status FROM umet""")
SMALL = " OR ".join(f"({c} > 0 AND {c} < 60)" for c in ("n", "total", "pool", "outside", "hits", "unknown"))


def _aggregate(hide: bool) -> str:
    shown = lambda value: f"CASE WHEN NOT ({SMALL}) THEN {value} END" if hide else value
    counts = {"n": "candidate_count", "total": "future_observed_positive_pairs", "pool": "future_positive_pairs_in_candidate_pool",
              "outside": "future_positive_pairs_outside_candidate_pool", "hits": "observed_positive_hits_at_k", "unknown": "unknown_candidate_count", "actual": "actual_k"}
    ratios = {"observed_positive_capture_at_k": ("hits", "pool"), "observed_positive_capture_all_at_k": ("hits", "total"), "candidate_reach_of_observed_positives": ("pool", "total")}
    parts = [I(shown(c), n) for c, n in counts.items()] + [R(shown(f"CASE WHEN {d} > 0 THEN {x} / CAST({d} AS DOUBLE) END"), n) for n, (x, d) in ratios.items()]
    status = f", CASE WHEN {SMALL} THEN 'suppressed_small_counts_and_ratios' ELSE 'aggregate_only' END AS disclosure_status" if hide else ""
    return f"""SELECT ds AS dataset_id, scope, w AS window_days, method, k, {", ".join(parts)}, times AS eligible_prediction_times, nonempty AS nonempty_candidate_times, withpool AS times_with_positive_pool,
    CASE WHEN withpool < 3 THEN 'descriptive_only_insufficient_times' ELSE 'descriptive_only' END AS evidence_status{status} FROM uagg"""


add("retrieval_aggregate", _aggregate(False))
add("suppressed_retrieval", _aggregate(True))
add("retrieval_feasibility", """SELECT s.ds AS dataset_id, s.w AS window_days, count(m.t) AS complete_prediction_times, count(*) FILTER (m.n > 0) AS nonempty_candidate_times, count(*) FILTER (m.pool > 0) AS positive_pool_times,
    CASE WHEN count(*) FILTER (m.pool > 0) >= 3 THEN 'positive_retrieval_ready' ELSE 'insufficient_history' END AS status
    FROM (SELECT * FROM (SELECT DISTINCT ds FROM uniq) CROSS JOIN wins) s LEFT JOIN (SELECT * FROM umet WHERE method = 'historical_frequency' AND k = 5) m ON m.ds = s.ds AND m.w = s.w
    GROUP BY s.ds, s.w""")

# ---- scores and metrics
MW = "model, w AS window_days"
for name, model in (("score_constant", "constant"), ("score_frequency", "historical_frequency"), ("score_time_rule", "time_rule")):
    add(name, f"SELECT {K}, y AS label, w AS window_days, {R('p')}, {R('threshold')} FROM pred WHERE model = '{model}'")
ENT = "(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END)"
add("prediction_entropy", f"SELECT {K}, {MW}, {R(ENT, 'prediction_entropy')} FROM pred")
add("average_precision", f"SELECT {MW}, CAST(max(nall) AS BIGINT) AS rows, CAST(max(pall) AS BIGINT) AS positives, {R('CASE WHEN max(pall) > 0 THEN sum(pos / CAST(pall AS DOUBLE) * tp / np) END', 'average_precision')} FROM step GROUP BY model, w")
AUC = "CASE WHEN max(pall) > 0 AND max(nall - pall) > 0 THEN sum(pos * (nall - pall - (np - tp) + (n - pos) / 2.0)) / (CAST(max(pall) AS DOUBLE) * max(nall - pall)) END"
AP = "CASE WHEN max(pall) > 0 THEN sum(pos / CAST(pall AS DOUBLE) * tp / np) END"
add("roc_auc", f"SELECT {MW}, CAST(max(nall) AS BIGINT) AS rows, {R(AUC, 'roc_auc')} FROM step GROUP BY model, w")
CLIP = "least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
LOSS = f"avg(-CASE WHEN y = 1 THEN ln({CLIP}) ELSE ln(1 - {CLIP}) END)"
POINT = f"count(*) AS rows, {R('avg(CAST(y AS DOUBLE))', 'positive_rate')}, {R('avg((p - y) * (p - y))', 'brier_score')}, {R(LOSS, 'log_loss')}"
add("brier_logloss", f"SELECT {MW}, {POINT} FROM pred GROUP BY model, w")
TP, FP, TN, FN = ("count(*) FILTER (p >= threshold AND y = 1)", "count(*) FILTER (p >= threshold AND y = 0)", "count(*) FILTER (p < threshold AND y = 0)", "count(*) FILTER (p < threshold AND y = 1)")
SHARE = lambda top, bottom: f"CASE WHEN {bottom} > 0 THEN ({top}) / CAST({bottom} AS DOUBLE) ELSE 0 END"
DECIDED = f"""{R(SHARE(TP, f'({TP} + {FP})'), 'precision')}, {R(SHARE(TP, f'({TP} + {FN})'), 'recall')}, {R(SHARE(f'2 * {TP}', f'(2 * {TP} + {FP} + {FN})'), 'f1')},
    {R(f'({TP} + {TN}) / CAST(count(*) AS DOUBLE)', 'accuracy')}"""
add("threshold_metrics", f"SELECT {MW}, count(*) AS rows, {TP} AS tp, {FP} AS fp, {TN} AS tn, {FN} AS fn, {DECIDED} FROM pred GROUP BY model, w")
add("best_threshold", f"""SELECT {MW}, {R('CASE WHEN max(pall) > 0 THEN arg_min(p, (abs(p - 0.5), p)) ELSE 0.5 END', 'threshold')} FROM
    (SELECT *, 2.0 * tp / (np + pall) AS f1, max(2.0 * tp / (np + pall)) OVER (PARTITION BY model, w) AS best FROM step) WHERE abs(f1 - best) <= 1e-8 + 1e-5 * best GROUP BY model, w""")
add("pr_curve", f"SELECT {MW}, {R('p', 'score')}, {R('tp / CAST(np AS DOUBLE)', 'precision')}, {R('tp / CAST(pall AS DOUBLE)', 'recall')} FROM step")
add("roc_curve", f"SELECT {MW}, {R('p', 'score')}, {R('(np - tp) / CAST(nall - pall AS DOUBLE)', 'fpr')}, {R('tp / CAST(pall AS DOUBLE)', 'tpr')} FROM step WHERE pall > 0 AND nall > pall")
add("confusion", f"SELECT {MW}, y AS actual, CAST(p >= threshold AS INT) AS predicted, count(*) AS rows FROM pred GROUP BY model, w, y, p >= threshold")
add("reliability", f"""SELECT {MW}, CAST(greatest(ceil(p * 10) - 1, 0) AS INT) AS bin, count(*) AS rows, {R('avg(p)', 'mean_probability')}, {R('avg(CAST(y AS DOUBLE))', 'observed_fraction')}
    FROM pred GROUP BY model, w, greatest(ceil(p * 10) - 1, 0)""")
BIN9 = "SELECT model, w, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS oy FROM pred GROUP BY 1, 2, 3"
add("ece", f"SELECT {MW}, {R('sum(n * abs(mp - oy)) / sum(n)', 'calibration_error_ece')}, CAST(sum(n) AS BIGINT) AS rows FROM bin9 GROUP BY model, w", bin9=BIN9)
add("error_counts", f"""SELECT {MW}, count(*) AS rows, {TP} AS true_positive, {FP} AS false_positive, {TN} AS true_negative, {FN} AS false_negative,
    count(*) FILTER (p >= 0.8 AND y = 0) AS high_confidence_false_positive, count(*) FILTER (p <= 0.2 AND y = 1) AS high_confidence_false_negative FROM pred GROUP BY model, w""")
add("error_rows", f"""SELECT {K}, {MW}, y AS label, {R('p')}, {R('threshold')}, (p >= 0.8 AND y = 0) OR (p <= 0.2 AND y = 1) AS high_confidence FROM pred
    WHERE (p >= threshold) <> (y = 1) OR (p >= 0.8 AND y = 0) OR (p <= 0.2 AND y = 1)""")
SIDE = "SELECT model, w, t, a AS u, b AS v, y, p FROM pred UNION ALL SELECT model, w, t, b, a, y, p FROM pred"
RANKED = "SELECT *, row_number() OVER (PARTITION BY model, w, t, u ORDER BY p DESC, v) AS r, sum(y) OVER (PARTITION BY model, w, t, u) AS np FROM side"
_hit = lambda k: f"coalesce(sum(y) FILTER (r <= {k}), 0) AS h{k}, coalesce(sum(y / log2(r + 1)) FILTER (r <= {k}), 0) AS d{k}, (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 11)) AS i) WHERE i <= least(max(np), {k})) AS i{k}"
RGROUP = f"SELECT model, w, t, u, max(np) AS np, {_hit(5)}, {_hit(10)} FROM ranked GROUP BY model, w, t, u"
_mean = lambda k: ", ".join((R(f"avg(h{k} / {k}.0) FILTER (np > 0)", f"precision_at_{k}"), R(f"avg(h{k} / CAST(np AS DOUBLE)) FILTER (np > 0)", f"recall_at_{k}"), R(f"avg(d{k} / i{k}) FILTER (np > 0)", f"ndcg_at_{k}")))
RMEANS = f"count(*) FILTER (np > 0) AS groups, count(*) FILTER (np = 0) AS groups_without_positive, {_mean(5)}, {_mean(10)}"
add("ranking_metrics", f"SELECT {MW}, {RMEANS} FROM rgroup GROUP BY model, w", side=SIDE, ranked=RANKED, rgroup=RGROUP)


def _binary(rows: str, keys: str, names: str, joined: str, extra: str = "", tail: str = "") -> tuple[str, dict[str, str]]:
    """Pointwise and curve metrics of a row set grouped by ``keys``."""
    steps = f"""SELECT {keys}, p, sum(y) AS pos, count(*) AS n, sum(sum(y)) OVER g AS tp, sum(count(*)) OVER g AS np, sum(sum(y)) OVER z AS pall, sum(count(*)) OVER z AS nall
        FROM {rows} GROUP BY {keys}, p WINDOW g AS (PARTITION BY {keys} ORDER BY p DESC), z AS (PARTITION BY {keys})"""
    curve = f"SELECT {keys}, {R(AP, 'average_precision')}, {R(AUC, 'roc_auc')} FROM bsteps GROUP BY {keys}"
    point = f"SELECT {keys}, {POINT}, {DECIDED} FROM {rows} GROUP BY {keys}"
    body = f"""SELECT {names}, rows, positive_rate, average_precision, roc_auc, brier_score, log_loss, precision, recall, f1, accuracy{extra}
        FROM bpoint x JOIN bcurve z USING ({joined}) {tail}"""
    return body, {"bsteps": steps, "bcurve": curve, "bpoint": point}


def add_binary(name: str, rows: str, keys: str, names: str, joined: str | None = None, extra: str = "", tail: str = "", **own: str) -> None:
    body, parts = _binary(rows, keys, names, joined or keys, extra, tail)
    add(name, body, **own, **parts)


FG = """SELECT p.*, CASE WHEN h.n <= 1 THEN '0–1' WHEN h.n <= 5 THEN '2–5' WHEN h.n <= 20 THEN '6–20' ELSE '>20' END AS g FROM pred p JOIN hist_cand h ON h.t = p.t AND h.a = p.a AND h.b = p.b AND h.w = 7"""
add_binary("frequency_groups", "fgrp", "model, w, g", f"{MW}, g AS history_group", fgrp=FG)
SG = """SELECT p.*, d.dim, CASE d.dim WHEN 'contact_frequency' THEN CASE WHEN h.bins <= 1 THEN '1' WHEN h.bins <= 5 THEN '2-5' ELSE '>5' END
    WHEN 'scan_quality' THEN CASE WHEN least(coalesce(x.n, 0), coalesce(y.n, 0)) / 288.0 < 0.5 THEN 'below0.5' WHEN least(coalesce(x.n, 0), coalesce(y.n, 0)) / 288.0 < 0.75 THEN '0.5-0.75' ELSE '>=0.75' END
    ELSE CAST(p.t // 86400 + 1 AS VARCHAR) END AS g FROM pred p JOIN hist_cand h ON h.t = p.t AND h.a = p.a AND h.b = p.b AND h.w = 1
    LEFT JOIN uscan x ON x.t = p.t AND x.w = 1 AND x.u = p.a LEFT JOIN uscan y ON y.t = p.t AND y.w = 1 AND y.u = p.b
    CROSS JOIN (SELECT unnest(['contact_frequency', 'scan_quality', 'study_day']) AS dim) d"""
add_binary("sensitivity_table", "sgrp", "model, w, dim, g", f"{MW}, dim AS dimension, g AS group_name", sgrp=SG)
add_binary("per_day_metrics", "pred", "model, w, t", f"{MW}, t AS timestamp")
add("rolling_summary", f"""SELECT {MW}, rows, positive_rate, average_precision, roc_auc, brier_score, log_loss, {R('mean_daily_ap')}, test_days, groups, groups_without_positive,
    precision_at_5, recall_at_5, ndcg_at_5, precision_at_10, recall_at_10, ndcg_at_10, {R('raw_ap / raw_rate', 'ap_over_prevalence')}
    FROM (SELECT model, w, {POINT}, avg(CAST(y AS DOUBLE)) AS raw_rate FROM pred GROUP BY model, w)
    JOIN (SELECT model, w, {R(AP, 'average_precision')}, {AP} AS raw_ap, {R(AUC, 'roc_auc')} FROM step GROUP BY model, w) USING (model, w)
    JOIN (SELECT model, w, avg(ap) AS mean_daily_ap, count(*) AS test_days FROM day_ap GROUP BY model, w) USING (model, w)
    JOIN (SELECT model, w, {RMEANS} FROM rgroup GROUP BY model, w) USING (model, w)""", side=SIDE, ranked=RANKED, rgroup=RGROUP)
CNAME = "am_aw"
LABEL = "aw || 'd ' || am || ' - ' || bw || 'd ' || bm"
add("model_contrast", f"""SELECT {LABEL} AS contrast, {R('x.ap - y.ap', 'pooled_delta_ap')}, d.days_positive, d.test_days FROM contrasts JOIN pooled_ap x ON x.model = am AND x.w = aw JOIN pooled_ap y ON y.model = bm AND y.w = bw
    JOIN (SELECT am AS m1, aw AS w1, bm AS m2, bw AS w2, count(*) FILTER (x.ap - y.ap > 0) AS days_positive, count(*) AS test_days FROM contrasts JOIN day_ap x ON x.model = am AND x.w = aw
          JOIN day_ap y ON y.model = bm AND y.w = bw AND y.t = x.t GROUP BY 1, 2, 3, 4) d ON m1 = am AND w1 = aw AND m2 = bm AND w2 = bw""")
LOO = """SELECT model, w, out, sum(pos / CAST(pall AS DOUBLE) * tp / np) AS ap FROM (SELECT model, w, out, p, sum(y) AS pos, sum(sum(y)) OVER g AS tp, sum(count(*)) OVER g AS np, sum(sum(y)) OVER z AS pall
    FROM pred JOIN (SELECT DISTINCT t AS out FROM pred) o ON o.out <> pred.t GROUP BY model, w, out, p WINDOW g AS (PARTITION BY model, w, out ORDER BY p DESC), z AS (PARTITION BY model, w, out)) GROUP BY model, w, out"""
add("paired_deltas", f"""SELECT {LABEL} AS contrast, x.t // 86400 + 1 AS study_day, 'only_this_day' AS kind, {R('x.ap - y.ap', 'delta_ap')} FROM contrasts JOIN day_ap x ON x.model = am AND x.w = aw JOIN day_ap y ON y.model = bm AND y.w = bw AND y.t = x.t
    UNION ALL SELECT {LABEL}, x.out // 86400 + 1, 'without_this_day', {R('x.ap - y.ap', 'delta_ap')} FROM contrasts JOIN loo x ON x.model = am AND x.w = aw JOIN loo y ON y.model = bm AND y.w = bw AND y.out = x.out""", loo=LOO)
add_binary("model_comparison", "pred", "model, w", f"'rolling' AS experiment, CASE WHEN model IN ('constant', 'historical_frequency', 'time_rule') THEN 'baseline' ELSE 'main' END AS kind, {MW}")
ORACLES["model_comparison"] += f""" UNION ALL SELECT 'documents', 'main', 'toxicity', 0, count(*), {R('avg(CAST(y AS DOUBLE))', 'x1')}, NULL, NULL, {R('avg((p - y) * (p - y))', 'x2')}, {R(LOSS, 'x3')}, NULL, NULL, NULL, NULL
    FROM (SELECT toxic AS y, 1 - quality * CAST(0.9 AS DOUBLE) AS p FROM labels)"""
DAYROW = """SELECT d.t, count(*) AS rows, avg(CAST(d.y AS DOUBLE)) AS rate, avg(h.days) AS mdays, avg(h.t - h.last) / 3600 AS mrec, avg((x.act + y.act) / 2.0) AS mact,
    avg(least(coalesce(sa.n, 0), coalesce(sb.n, 0)) / (7 * 288.0)) AS mcov, avg(CAST(CAST(h.days = 1 AS INT) AS DOUBLE)) AS share
    FROM (SELECT DISTINCT t, a, b, y FROM pred) d JOIN hist_cand h ON h.t = d.t AND h.a = d.a AND h.b = d.b AND h.w = 7 JOIN ustat x ON x.t = d.t AND x.w = 7 AND x.u = d.a JOIN ustat y ON y.t = d.t AND y.w = 7 AND y.u = d.b
    LEFT JOIN uscan sa ON sa.t = d.t AND sa.w = 7 AND sa.u = d.a LEFT JOIN uscan sb ON sb.t = d.t AND sb.w = 7 AND sb.u = d.b GROUP BY d.t"""
add("day_table", f"""SELECT r.t AS timestamp, rows, {R('rate', 'positive_rate')}, {R('mdays', 'mean_pair_contact_days')}, {R('mrec', 'mean_recency_hours')}, {R('mact', 'mean_participant_activity')},
    {R('mcov', 'mean_min_scan_coverage')}, {R('share', 'share_contact_days_1')}, {MW}, {R('ap', 'average_precision')}, {R('ap / rate', 'lift')}, r.t // 86400 + 1 AS study_day FROM dayrow r JOIN day_ap s ON s.t = r.t""", dayrow=DAYROW)
TALL = """SELECT model, w, target, name, x, y FROM (SELECT s.model, s.w, r.rows, round(rate, 6) AS rate, round(mdays, 6) AS mdays, round(mrec, 6) AS mrec, round(mact, 6) AS mact, round(mcov, 6) AS mcov, round(share, 6) AS share,
    round(s.ap, 6) AS ap, round(s.ap / rate, 6) AS lift FROM dayrow r JOIN day_ap s ON s.t = r.t WHERE s.model <> 'constant'),
    LATERAL (SELECT unnest(['rows', 'positive_rate', 'mean_pair_contact_days', 'mean_recency_hours', 'mean_participant_activity', 'mean_min_scan_coverage', 'share_contact_days_1']) AS name,
                    unnest([CAST(rows AS DOUBLE), rate, mdays, mrec, mact, mcov, share]) AS x), LATERAL (SELECT unnest(['ap', 'lift']) AS target, unnest([ap, lift]) AS y)"""
add("spearman", f"""SELECT {MW}, target, name AS descriptor, {R('corr(rx, ry)', 'spearman_rho')} FROM (SELECT *, rank() OVER (PARTITION BY model, w, target, name ORDER BY x) + (count(*) OVER (PARTITION BY model, w, target, name, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY model, w, target, name ORDER BY y) + (count(*) OVER (PARTITION BY model, w, target, name, y) - 1) / 2.0 AS ry FROM tall) GROUP BY model, w, target, name""", dayrow=DAYROW, tall=TALL)
IMP = """SELECT 'rssi_mean' AS feature, h.rmean AS v FROM trainrow h UNION ALL SELECT 'historical_contact_probability', prob FROM trainrow UNION ALL SELECT 'recency_seconds', recency FROM trainrow UNION ALL SELECT 'observed_history_days', seen FROM trainrow"""
add("impute_features", f"""SELECT feature, count(*) AS rows, count(*) FILTER (v IS NULL) AS missing, {R('avg(v)', 'mean')}, {R('stddev_pop(v)', 'deviation')}, {R('quantile_cont(v, 0.5)', 'median')} FROM imp GROUP BY feature""",
    trainrow="""SELECT h.rmean, h.t - h.last AS recency, CASE WHEN p.seen > 0 THEN p.hits / CAST(p.seen AS DOUBLE) END AS prob, p.seen FROM cohort c JOIN plan s ON s.t = c.t AND s.split = 'train' JOIN hist_cand h ON h.t = c.t AND h.a = c.a AND h.b = c.b AND h.w = 7
    JOIN prob_cand p ON p.t = c.t AND p.a = c.a AND p.b = c.b AND p.w = 7""", imp=IMP)

# ---- scorecard
_case = lambda f: f"CASE {f} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in POINTS[f].items()) + " END"
_bad = lambda f: f"({f} IS NOT NULL AND {f} NOT IN ({', '.join(repr(x) for x in [*POINTS[f], 'unknown'])}))"
ANSWERS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 19 <> 0 THEN c_mktsegment END AS relationship, ['same_area', 'walkable', 'city_far', 'different_city', 'unknown', NULL][c_nationkey % 6 + 1] AS distance,
    ['zero', 'one_two', 'three_five', 'six_plus', 'unknown', NULL][c_custkey % 6 + 1] AS frequency, ['day', 'week', 'month', 'older', 'never', 'unknown', NULL][(c_custkey + c_nationkey) % 7 + 1] AS recency,
    ['often', 'sometimes', 'rare', 'unknown', NULL][(c_custkey // 3) % 5 + 1] AS area, ['often', 'sometimes', 'different', 'unknown', 'weekly', NULL][(c_custkey // 5) % 6 + 1] AS timing,
    ['no', 'no', 'no', 'no', 'yes', 'unknown', NULL][(c_custkey // 2) % 7 + 1] AS arrangement FROM customer"""
RATED = f"""SELECT *, {' + '.join(f'CAST(({_case(f)}) IS NOT NULL AS INT)' for f in POINTS)} AS known, {' + '.join(f'coalesce({_case(f)}, 0)' for f in POINTS)} AS points FROM answers"""
STATUS = f"""SELECT *, CASE WHEN {' OR '.join(_bad(f) for f in POINTS)} THEN 'invalid' WHEN arrangement = 'yes' THEN 'out_of_scope' WHEN coalesce(arrangement <> 'no', true) THEN 'needs_confirmation'
    WHEN relationship IS NULL THEN 'invalid' WHEN coalesce((frequency IN ('one_two', 'three_five', 'six_plus') AND recency IN ('older', 'never')) OR (frequency = 'zero' AND recency IN ('day', 'week', 'month')), false) THEN 'inconsistent'
    WHEN known < 3 THEN 'insufficient' ELSE 'ready' END AS status FROM rated"""
add("scorecard", """SELECT id, status, known AS known_factors, CASE WHEN status = 'ready' THEN CAST((2 * points + known) // (2 * known) AS INT) END AS score,
    CASE WHEN status = 'ready' THEN CASE WHEN (2 * points + known) // (2 * known) < 35 THEN 'low' WHEN (2 * points + known) // (2 * known) < 70 THEN 'medium' ELSE 'high' END END AS level FROM stated""", answers=ANSWERS, rated=RATED, stated=STATUS)

# ---- audit
add("deadline_gate", f"SELECT {K} FROM cand1, deadline WHERE t > v")
add("asof_available", f"""SELECT {K}, ok AS prediction_available, CAST(bins1 AS DOUBLE) AS past_contact_bins_1d, CAST(n1 AS DOUBLE) AS past_contact_count_1d, {R('scan1', 'past_scan_min_1d')}, CAST(rec1 AS DOUBLE) AS past_recency_seconds_1d,
    CASE WHEN ok THEN 'valid_pre_t_inputs' ELSE 'missing_historical_scan_evidence' END AS inference_reason FROM avail""")
POPULATION = f"""count(*) AS rows, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative, count(*) FILTER (NOT known) AS unknown, {R('count(*) FILTER (NOT known) / CAST(count(*) AS DOUBLE)', 'unknown_rate')},
    {R('count(*) FILTER (known) / CAST(count(*) AS DOUBLE)', 'known_label_rate')}, {R('avg(CAST(y AS DOUBLE))', 'positive_rate_reliable_only')}, {R('count(*) FILTER (y = 1) / CAST(count(*) AS DOUBLE)', 'observed_positive_fraction_all')},
    {R('avg(bins1)', 'past_contact_bins_mean')}, {R('avg(scan1)', 'past_scan_mean')}"""
add("population_bias", f"""SELECT pop AS population, {POPULATION}, {R('quantile_cont(CAST(bins1 AS DOUBLE), 0.5)', 'past_contact_bins_median')} FROM
    (SELECT *, 'all_asof' AS pop FROM asample UNION ALL SELECT *, CASE WHEN old THEN 'old_cohort' ELSE 'added_asof' END FROM asample) GROUP BY pop""")
add("daily_funnel", f"""SELECT t AS timestamp, {POPULATION}, count(*) FILTER (ok) AS prediction_available, count(*) FILTER (covered) AS strict_future_covered, count(*) FILTER (old) AS old_rows,
    count(*) FILTER (NOT old) AS added_rows FROM asample GROUP BY t""")
SCOPED = """SELECT *, CAST(0.5 AS DOUBLE) AS threshold FROM (SELECT *, 'reliable_predicted' AS scope FROM apred WHERE known UNION ALL SELECT *, 'strict_covered_predicted' FROM apred WHERE covered
    UNION ALL SELECT *, 'old_overlap' FROM apred WHERE old UNION ALL SELECT *, 'added_reliable_predicted' FROM apred WHERE known AND NOT old) WHERE y IS NOT NULL"""
add_binary("scoped_metrics", "sc", "scope, w", "scope, w AS window_days", "scope, w",
           extra=", days AS distinct_prediction_days, round(raw_ap / raw_rate, 6) AS ap_over_prevalence, CASE WHEN positive_rate IN (0, 1) THEN 'single_class_descriptive_only' ELSE 'both_classes' END AS status",
           tail=f"JOIN (SELECT scope, w, count(DISTINCT t) AS days, avg(CAST(y AS DOUBLE)) AS raw_rate FROM sc GROUP BY scope, w) USING (scope, w) JOIN (SELECT scope, w, {AP} AS raw_ap FROM bsteps GROUP BY scope, w) USING (scope, w)", sc=SCOPED)
add("probability_quantiles", f"""SELECT pop AS population, w AS window_days, count(*) AS rows, {R('avg(p)', 'mean_probability')}, {", ".join(R(f'quantile_cont(p, {q / 100})', f'q{q}') for q in (0, 10, 50, 90, 100))}
    FROM (SELECT *, 'all_predicted' AS pop FROM apred UNION ALL SELECT *, CASE WHEN known THEN 'reliable_predicted' ELSE 'unknown_predicted' END FROM apred) GROUP BY pop, w""")
add("freshness_gate", """SELECT k.t AS timestamp, k.a AS user_min, k.b AS user_max, k.t - x.last AS age_a, k.t - y.last AS age_b, coalesce(k.t - x.last <= 3600, false) AND coalesce(k.t - y.last <= 3600, false) AS fresh
    FROM cand1 k LEFT JOIN lastobs x ON x.t = k.t AND x.u = k.a LEFT JOIN lastobs y ON y.t = k.t AND y.u = k.b""", lastobs="SELECT t, u, max(ts) AS last FROM snap JOIN obs ON ts >= t - 86400 AND ts < t GROUP BY t, u")

# ---- exploration, disclosure, catalogue
add("daily_trend", "SELECT s.d + 1 AS study_day, count(c.ts) AS contact_records FROM sched s LEFT JOIN con c ON c.ts // 86400 = s.d AND (c.a IN (0, 3) OR c.b IN (0, 3)) GROUP BY s.d")
add("hourly_trend", "SELECT h AS hour, count(ts) AS contact_records FROM (SELECT unnest(range(0, 24)) AS h) LEFT JOIN con ON ts % 86400 // 3600 = h GROUP BY h")
add("pair_frequency", "SELECT n AS frequency, count(*) AS pairs FROM (SELECT a, b, count(*) AS n FROM con GROUP BY a, b) GROUP BY n")
TOP = "SELECT u, count(*) AS n FROM ends GROUP BY u ORDER BY n DESC, u LIMIT 20"
add("activity_topn", "SELECT u AS user_id, n AS contact_records FROM top20", top20=TOP)
add("contact_matrix", "SELECT e.u AS user_a, e.v AS user_b, count(*) AS contact_records FROM ends e JOIN top20 x ON x.u = e.u JOIN top20 y ON y.u = e.v GROUP BY e.u, e.v", top20=TOP)
add("rssi_histogram", """SELECT i AS bin, round(lo + (i + 0.5) * ((hi - lo) / 30), 6) AS rssi, count(c.ts) AS records FROM (SELECT min(rssi) AS lo, max(rssi) AS hi FROM con) CROSS JOIN (SELECT unnest(range(0, 30)) AS i)
    LEFT JOIN con c ON c.ts < 14 * 86400 AND c.rssi IS NOT NULL AND least(floor((c.rssi - lo) / ((hi - lo) / 30)), 29) = i GROUP BY i, lo, hi""")
add("coverage_trend", f"SELECT study_day, {R('avg(n / 288.0)', 'mean_scan_coverage')}, count(*) FILTER (n > 0) AS with_scan, count(*) FILTER (n = 0) AS without_scan, CAST(0 AS BIGINT) AS unknown FROM cover GROUP BY study_day", cover=COVER)
add("overview", f"""SELECT (SELECT count(*) FROM people) AS participants, (SELECT count(*) FROM con) AS contact_records, (SELECT count(DISTINCT (a, b)) FROM con) AS valid_pairs, (SELECT count(*) FROM sched) AS observation_days,
    count(*) FILTER (ok) AS eligible_samples, {R('count(*) FILTER (ok AND y = 1) / CAST(count(*) FILTER (ok) AS DOUBLE)', 'positive_rate')} FROM lab""")
add("highlights", """SELECT ds AS dataset_id, min(study_day) AS item, CAST(max(records) AS BIGINT) AS value, count(*) AS ties FROM (SELECT *, max(records) FILTER (records = 0 OR records >= 5) OVER (PARTITION BY ds) AS best FROM drep)
    WHERE records = best GROUP BY ds""")
add("pair_cases", f"""SELECT c.t AS timestamp, c.a AS user_min, c.b AS user_max, b.n7 AS historical_contact_count, b.age AS time_since_last_contact, {R('b.prob', 'probability')},
    {R("CASE WHEN b.prob IS NOT NULL THEN CASE WHEN b.prob > 0 THEN -b.prob * log2(b.prob) ELSE 0 END + CASE WHEN b.prob < 1 THEN -(1 - b.prob) * log2(1 - b.prob) ELSE 0 END END", 'prediction_entropy')},
    CASE WHEN l.y = 1 THEN 'Contact' WHEN l.ok THEN 'No Contact' ELSE 'Unknown' END AS outcome,
    CASE WHEN l.y = 1 THEN 'observed_positive_evidence' WHEN l.ok THEN 'adequately_observed_no_contact' ELSE 'low_scan_coverage' END AS reason
    FROM cand1 c JOIN bank14 b ON b.t = c.t AND b.a = c.a AND b.b = c.b JOIN lab l ON l.t = c.t AND l.a = c.a AND l.b = c.b""")
add("suppressed_histogram", """SELECT DISTINCT ds AS dataset_id, CASE WHEN least_c >= 5 THEN bin END AS bin, CASE WHEN least_c >= 5 THEN c END AS count, CASE WHEN least_c < 5 THEN 'suppressed_small_groups' ELSE 'aggregate' END AS status
    FROM (SELECT *, min(c) OVER (PARTITION BY ds) AS least_c FROM deg_hist)""")
_sup = lambda c, n: f"CASE WHEN {c} = 0 OR {c} >= 5 THEN CAST({c} AS BIGINT) END AS {n}"
add("suppressed_days", f"SELECT ds AS dataset_id, study_day, {_sup('records', 'records')}, {_sup('active', 'active_pairs')}, {_sup('repeated', 'previous_day_repeated_pairs')} FROM drep")
REF = """SELECT r, f, count(l.t) AS n, coalesce(sum(l.y), 0) AS p FROM (SELECT * FROM (VALUES ('day', 0, 1), ('week', 1, 7), ('month', 7, 30)) x(r, r1, r2) CROSS JOIN (VALUES ('zero', 0, 0), ('one_two', 1, 2), ('three_five', 3, 5), ('six_plus', 6, 14)) y(f, f1, f2)) z
    LEFT JOIN (SELECT l.t, l.y, b.age, b.days14 FROM lab l JOIN bank14 b ON b.t = l.t AND b.a = l.a AND b.b = l.b WHERE l.ok AND l.y IS NOT NULL AND l.t - 14 * 86400 >= b.lo) l
    ON l.age >= r1 * 86400 AND l.age < r2 * 86400 AND l.days14 BETWEEN f1 AND f2 GROUP BY r, f"""
REFT = "SELECT r AS recency, f AS frequency, CASE WHEN s THEN n END AS samples, CASE WHEN s THEN round(p / CAST(n AS DOUBLE), 3) END AS recontact_rate, NOT s AS suppressed FROM (SELECT *, n >= 200 AND least(p, n - p) >= 20 AS s FROM refc)"
add("reference_table", "SELECT * FROM reft", refc=REF, reft=REFT)
add("reference_lookup", """SELECT id, q.recency, q.frequency, samples, recontact_rate, CASE WHEN suppressed IS NULL THEN 'unavailable' WHEN suppressed THEN 'suppressed' ELSE 'ready' END AS status
    FROM (SELECT c_custkey AS id, ['day', 'week', 'month', 'older'][c_custkey % 4 + 1] AS recency, ['zero', 'one_two', 'three_five', 'six_plus', 'unknown'][(c_custkey // 4) % 5 + 1] AS frequency FROM customer) q
    LEFT JOIN reft ON reft.recency = q.recency AND reft.frequency = q.frequency""", refc=REF, reft=REFT)
add("catalog_scan", """SELECT ds AS dataset_id, count(*) AS raw_rows, count(*) FILTER (ts < 0 OR user_a < 0 OR user_b < 0) AS invalid_rows, count(*) FILTER (ts >= 0 AND user_a >= 0 AND user_b >= 0 AND user_a = user_b) AS self_contact_rows,
    count(*) FILTER (ts >= 0 AND user_a >= 0 AND user_b >= 0 AND user_a <> user_b) AS event_rows FROM cat GROUP BY ds""")
add("dataset_manifest", f"""SELECT m.ds AS dataset_id, p.n AS participants, pairs AS valid_pairs, rows AS event_rows, lo AS first_timestamp, hi AS last_timestamp, {R('(hi - lo) / 86400.0', 'span_days')},
    hi // 86400 - lo // 86400 + 1 - days AS days_without_contact_records FROM cman m JOIN (SELECT ds, count(DISTINCT u) AS n FROM (SELECT ds, a AS u FROM ccon UNION ALL SELECT ds, b FROM ccon) GROUP BY ds) p ON p.ds = m.ds""")
add("dataset_days", """SELECT s.ds AS dataset_id, s.d - s.f + 1 AS study_day, coalesce(r.n, 0) AS event_rows, coalesce(u.n, 0) AS participants_with_contacts
    FROM (SELECT ds, lo // 86400 AS f, unnest(range(lo // 86400, hi // 86400 + 1)) AS d FROM cman) s LEFT JOIN (SELECT ds, ts // 86400 AS d, count(*) AS n FROM ccon GROUP BY 1, 2) r ON r.ds = s.ds AND r.d = s.d
    LEFT JOIN (SELECT ds, d, count(DISTINCT u) AS n FROM (SELECT ds, ts // 86400 AS d, a AS u FROM ccon UNION ALL SELECT ds, ts // 86400, b FROM ccon) GROUP BY 1, 2) u ON u.ds = s.ds AND u.d = s.d""")
add("calendar_capacity", """SELECT ds AS dataset_id, w AS window_days, n AS calendar_complete_snapshots, tr AS train_times, va AS validation_times, te AS test_times,
    CASE WHEN least(tr, va, te) >= 2 THEN 'date_capacity_only' ELSE 'insufficient_days' END AS temporal_status
    FROM (SELECT s.ds, s.w, coalesce(n, 0) AS n, coalesce(tr, 0) AS tr, coalesce(va, 0) AS va, coalesce(te, 0) AS te FROM (SELECT ds, w FROM cman CROSS JOIN wins) s
          LEFT JOIN ccap c ON c.ds = s.ds AND c.w = s.w)""")
add("eligibility", """SELECT m.ds AS dataset_id, CASE WHEN unit AND hi - lo < 8 * 86400 AND NOT sup THEN 'insufficient_history' WHEN chk AND unit THEN 'eligible_primary_24h' ELSE 'exploratory_only' END AS eligibility_status,
    concat_ws('; ', CASE WHEN NOT chk THEN 'missing verified scan support' END, CASE WHEN unit AND coalesce(c.n, 0) < 6 THEN 'insufficient_days' END, CASE WHEN NOT unit THEN 'time_unit_unverified' END) AS reason
    FROM cman m JOIN (VALUES ('scans', true, true, true), ('shipments', true, false, false), ('orders', false, false, false)) s(ds, unit, sup, chk) ON s.ds = m.ds LEFT JOIN ccap c ON c.ds = m.ds AND c.w = 7""")
ALONG = " UNION ALL ".join(f"SELECT '{n}' AS measure, {n} AS value FROM quality" for n in (
    "input_rows", "invalid_id_rows", "self_contact_rows", "empty_scan_rows", "external_device_rows", "duplicate_contact_rows", "contact_rows", "participants"))
add("diagnosis", f"""{ALONG} UNION ALL SELECT 'candidate_rows', count(*) FROM lab UNION ALL SELECT 'positive_labels', count(*) FILTER (y = 1) FROM lab UNION ALL SELECT 'negative_labels', count(*) FILTER (y = 0) FROM lab
    UNION ALL SELECT 'unknown_labels', count(*) FILTER (y IS NULL) FROM lab UNION ALL SELECT 'eligible_samples', count(*) FILTER (ok) FROM lab
    UNION ALL SELECT 'split_' || split, CAST(sum(n) AS BIGINT) FROM plan GROUP BY split""", quality=QUALITY)
add("hawkes_excitation", f"""SELECT k.t AS timestamp, k.a AS user_min, k.b AS user_max, h AS half_life_hours, max(e.n) AS events, {R('coalesce(sum(exp(-ln(2.0) / h * (x.ts - y.ts) / 3600.0)) FILTER (x.ts = e.last), 0)', 'last_excitation')},
    {R('coalesce(sum(exp(-ln(2.0) / h * (x.ts - y.ts) / 3600.0)), 0)', 'excitation_sum')}
    FROM cohort k CROSS JOIN (SELECT unnest([0.5, 2.0, 8.0, 24.0]) AS h) JOIN (SELECT t, a, b, count(*) AS n, max(ts) AS last FROM evt GROUP BY t, a, b) e ON e.t = k.t AND e.a = k.a AND e.b = k.b
    JOIN evt x ON x.t = k.t AND x.a = k.a AND x.b = k.b LEFT JOIN evt y ON y.t = x.t AND y.a = x.a AND y.b = x.b AND y.ts < x.ts GROUP BY k.t, k.a, k.b, h""",
    evt="SELECT DISTINCT c.t, c.a, c.b, n.ts FROM cohort c JOIN con n ON n.a = c.a AND n.b = c.b AND n.ts >= c.t - 7 * 86400 AND n.ts < c.t")
