"""SQL building blocks, written straight from the definitions (range joins, no fan-out keys).

``sql(body)`` prepends exactly the blocks a query mentions, with their own requirements.
"""

from __future__ import annotations

import re

CTES = {
    # -- the derived scan log --
    "scan_row": """SELECT event_id, event_type AS dataset_id,
        CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS ts, user_id AS user_a,
        CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN -2 ELSE -1 END
             WHEN event_id % 10 = 3 THEN 0
             ELSE xor(user_id, 1 + least(event_id % 7, (event_id // 7) % 7)) END AS user_b,
        CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 12.0
             ELSE CAST(-40 - (event_id * 7) % 50 AS DOUBLE) END AS rssi FROM events""",
    "raw_log": """SELECT event_id, dataset_id, ts, user_a, user_b, rssi FROM scan_row
        UNION ALL SELECT event_id, dataset_id, ts, user_b, user_a, rssi FROM scan_row WHERE event_id % 4 = 0 AND user_b >= 0
        UNION ALL SELECT event_id, dataset_id, ts, user_a, user_b, rssi FROM scan_row
            WHERE event_id % 11 = 0 AND NOT (event_id % 4 = 0 AND user_b >= 0)""",
    "canon": """SELECT dataset_id, ts, least(user_a, user_b) AS a, greatest(user_a, user_b) AS b, rssi FROM raw_log
        WHERE user_a >= 0 AND user_b >= 0 AND user_a <> user_b""",
    "con": "SELECT DISTINCT ts, a, b, rssi FROM canon",
    "uniq": "SELECT DISTINCT dataset_id AS ds, ts, a, b FROM canon",
    "obs": "SELECT DISTINCT (ts // 300) * 300 AS ts, user_a AS u FROM raw_log WHERE user_a >= 0",
    "people": "SELECT u FROM obs UNION SELECT a FROM con UNION SELECT b FROM con",
    "span": "SELECT min(ts) AS lo, max(ts) AS hi FROM raw_log",
    "prox": """SELECT CAST(epoch(l_shipdate) AS BIGINT) + l_linenumber * 20 AS ts, l_partkey AS user_a, l_suppkey AS user_b,
        l_returnflag AS class_a, l_linestatus AS class_b FROM lineitem""",
    # -- time --
    "sched": """SELECT d, d * 86400 + 28800 AS t FROM (SELECT unnest(range((SELECT lo // 86400 FROM span), (SELECT hi // 86400 + 1 FROM span))) AS d)""",
    "snap": "SELECT d, t FROM sched, span WHERE t >= lo AND t + 86400 <= hi",
    "wins": "SELECT unnest([1, 3, 7]) AS w",
    # -- candidates and labels --
    "cand1": "SELECT DISTINCT t, a, b FROM snap JOIN con ON ts >= t - 86400 AND ts < t",
    "cand7": "SELECT DISTINCT t, a, b FROM snap JOIN con ON ts >= t - 7 * 86400 AND ts < t",
    "known": "SELECT DISTINCT t, a, b FROM snap JOIN con ON ts < t",
    "pos": "SELECT DISTINCT t, a, b FROM snap JOIN con ON ts > t AND ts <= t + 86400",
    "fcov": "SELECT t, u, count(*) AS n FROM snap JOIN obs ON ts > t AND ts <= t + 86400 GROUP BY t, u",
    "lab": """SELECT k.t, k.a, k.b, coalesce(x.n, 0) / 288.0 AS ca, coalesce(y.n, 0) / 288.0 AS cb,
        least(coalesce(x.n, 0), coalesce(y.n, 0)) >= 2 AS ok,
        CASE WHEN p.t IS NOT NULL THEN 1 WHEN least(coalesce(x.n, 0), coalesce(y.n, 0)) >= 2 THEN 0 END AS y
        FROM known k LEFT JOIN pos p ON p.t = k.t AND p.a = k.a AND p.b = k.b
        LEFT JOIN fcov x ON x.t = k.t AND x.u = k.a LEFT JOIN fcov y ON y.t = k.t AND y.u = k.b""",
    "cohort": """SELECT l.t, l.a, l.b, l.y, l.ca, l.cb FROM lab l JOIN cand1 c ON c.t = l.t AND c.a = l.a AND c.b = l.b, span
        WHERE l.ok AND l.y IS NOT NULL AND l.t - 7 * 86400 >= lo""",
    "rev_key": "SELECT DISTINCT s.t, c.a, c.b FROM (SELECT (d + 1) * 86400 + 28800 AS t FROM sched UNION SELECT t FROM sched) s JOIN con c ON c.ts >= s.t - 86400 AND c.ts < s.t, span WHERE s.t >= lo",
    "rev": """SELECT k.t, k.a, k.b, count(h.ts) > 0 AS hit, k.t + 86400 <= max(hi) AS complete,
        (SELECT count(DISTINCT o.ts // 300) FROM obs o WHERE o.u = k.a AND o.ts > k.t AND o.ts <= k.t + 86400) AS na,
        (SELECT count(DISTINCT o.ts // 300) FROM obs o WHERE o.u = k.b AND o.ts > k.t AND o.ts <= k.t + 86400) AS nb
        FROM rev_key k LEFT JOIN con h ON h.a = k.a AND h.b = k.b AND h.ts > k.t AND h.ts <= k.t + 86400, span GROUP BY k.t, k.a, k.b""",
    # -- history --
    "hist_known": """SELECT k.t, k.a, k.b, w.w, count(c.ts) AS n, count(DISTINCT c.ts // 300) AS bins, count(DISTINCT c.ts // 86400) AS days,
        max(c.ts) AS last, avg(c.rssi) AS rmean, max(c.rssi) AS rmax
        FROM known k CROSS JOIN (SELECT unnest([1, 3, 7, 14]) AS w) w
        LEFT JOIN con c ON c.a = k.a AND c.b = k.b AND c.ts >= k.t - w.w * 86400 AND c.ts < k.t GROUP BY k.t, k.a, k.b, w.w""",
    "ever": "SELECT k.t, k.a, k.b, max(c.ts) AS last FROM known k JOIN con c ON c.a = k.a AND c.b = k.b AND c.ts < k.t GROUP BY k.t, k.a, k.b",
    "hist_cand": """SELECT k.t, k.a, k.b, w.w, count(*) AS n, count(DISTINCT c.ts // 300) AS bins, count(DISTINCT c.ts // 86400) AS days,
        max(c.ts) AS last, avg(c.rssi) AS rmean, max(c.rssi) AS rmax FROM cand1 k CROSS JOIN wins w
        JOIN con c ON c.a = k.a AND c.b = k.b AND c.ts >= k.t - w.w * 86400 AND c.ts < k.t GROUP BY k.t, k.a, k.b, w.w""",
    "ends": "SELECT ts, a AS u, b AS v FROM con UNION ALL SELECT ts, b, a FROM con",
    "ustat": """SELECT t, w, u, count(*) AS act, count(DISTINCT v) AS deg FROM snap CROSS JOIN wins JOIN ends ON ts >= t - w * 86400 AND ts < t GROUP BY t, w, u""",
    "adj": "SELECT DISTINCT t, w, u, v FROM snap CROSS JOIN wins JOIN ends ON ts >= t - w * 86400 AND ts < t",
    "uscan": "SELECT t, w, u, count(*) AS n FROM snap CROSS JOIN wins JOIN obs ON ts >= t - w * 86400 AND ts < t GROUP BY t, w, u",
    "ubk": "SELECT t, u, (t - 1 - ts) // 86400 AS k, count(*) AS n FROM snap JOIN obs ON ts >= t - 14 * 86400 AND ts < t GROUP BY t, u, k",
    "cn_cand": """SELECT k.t, k.a, k.b, x.w, count(*) AS cn FROM cand1 k JOIN adj x ON x.t = k.t AND x.u = k.a
        JOIN adj y ON y.t = k.t AND y.w = x.w AND y.u = k.b AND y.v = x.v GROUP BY k.t, k.a, k.b, x.w""",
    "cn_known": """SELECT k.t, k.a, k.b, count(*) AS cn FROM known k JOIN adj x ON x.t = k.t AND x.w = 7 AND x.u = k.a
        JOIN adj y ON y.t = k.t AND y.w = 7 AND y.u = k.b AND y.v = x.v GROUP BY k.t, k.a, k.b""",
    "seen_known": """SELECT k.t, k.a, k.b, x.k FROM known k JOIN ubk x ON x.t = k.t AND x.u = k.a AND x.n >= 2
        JOIN ubk y ON y.t = k.t AND y.u = k.b AND y.k = x.k AND y.n >= 2""",
    "hit_known": "SELECT DISTINCT k.t, k.a, k.b, (k.t - 1 - c.ts) // 86400 AS k FROM known k JOIN con c ON c.a = k.a AND c.b = k.b AND c.ts >= k.t - 14 * 86400 AND c.ts < k.t",
    "prob_cand": """SELECT c.t, c.a, c.b, w.w, count(s.k) AS seen, count(h.k) AS hits FROM cand1 c CROSS JOIN wins w
        LEFT JOIN seen_known s ON s.t = c.t AND s.a = c.a AND s.b = c.b AND s.k < w.w
        LEFT JOIN hit_known h ON h.t = s.t AND h.a = s.a AND h.b = s.b AND h.k = s.k GROUP BY c.t, c.a, c.b, w.w""",
    "prob14": """SELECT s.t, s.a, s.b, count(*) AS seen, count(h.k) AS hits FROM seen_known s
        LEFT JOIN hit_known h ON h.t = s.t AND h.a = s.a AND h.b = s.b AND h.k = s.k GROUP BY s.t, s.a, s.b""",
    "bank1": """SELECT h.t, h.a, h.b, h.w, h.n, h.bins, h.days, h.t - h.last AS recency, h.rmean, h.rmax, x.act AS acta, y.act AS actb,
        coalesce(cn.cn, 0) AS cn, x.deg AS dega, y.deg AS degb, coalesce(sa.n, 0) / (h.w * 288.0) AS ca, coalesce(sb.n, 0) / (h.w * 288.0) AS cb,
        CASE WHEN p.seen > 0 THEN p.hits / CAST(p.seen AS DOUBLE) END AS prob, p.seen
        FROM hist_cand h JOIN ustat x ON x.t = h.t AND x.w = h.w AND x.u = h.a JOIN ustat y ON y.t = h.t AND y.w = h.w AND y.u = h.b
        LEFT JOIN cn_cand cn ON cn.t = h.t AND cn.a = h.a AND cn.b = h.b AND cn.w = h.w
        LEFT JOIN uscan sa ON sa.t = h.t AND sa.w = h.w AND sa.u = h.a LEFT JOIN uscan sb ON sb.t = h.t AND sb.w = h.w AND sb.u = h.b
        JOIN prob_cand p ON p.t = h.t AND p.a = h.a AND p.b = h.b AND p.w = h.w""",
    "u7": "SELECT t, u, act, deg FROM ustat WHERE w = 7",
    "s7": "SELECT t, u, n FROM uscan WHERE w = 7",
    "bank14": """SELECT k.t, k.a, k.b, h1.n AS n1, h3.n AS n3, h7.n AS n7, h14.n AS n14, h1.bins AS bins1, h7.bins AS bins7, k.t - e.last AS age,
        h7.days AS days7, h14.days AS days14, CASE WHEN p.seen > 0 THEN p.hits / CAST(p.seen AS DOUBLE) END AS prob, h7.rmean, h7.rmax,
        coalesce(ua.act, 0) AS acta, coalesce(ub.act, 0) AS actb, coalesce(cn.cn, 0) AS cn, coalesce(ua.deg, 0) AS dega, coalesce(ub.deg, 0) AS degb,
        coalesce(sa.n, 0) / (7 * 288.0) AS ca, coalesce(sb.n, 0) / (7 * 288.0) AS cb, lo
        FROM known k JOIN hist_known h1 ON h1.t = k.t AND h1.a = k.a AND h1.b = k.b AND h1.w = 1
        JOIN hist_known h3 ON h3.t = k.t AND h3.a = k.a AND h3.b = k.b AND h3.w = 3 JOIN hist_known h7 ON h7.t = k.t AND h7.a = k.a AND h7.b = k.b AND h7.w = 7
        JOIN hist_known h14 ON h14.t = k.t AND h14.a = k.a AND h14.b = k.b AND h14.w = 14 JOIN ever e ON e.t = k.t AND e.a = k.a AND e.b = k.b
        LEFT JOIN prob14 p ON p.t = k.t AND p.a = k.a AND p.b = k.b LEFT JOIN u7 ua ON ua.t = k.t AND ua.u = k.a LEFT JOIN u7 ub ON ub.t = k.t AND ub.u = k.b
        LEFT JOIN cn_known cn ON cn.t = k.t AND cn.a = k.a AND cn.b = k.b LEFT JOIN s7 sa ON sa.t = k.t AND sa.u = k.a
        LEFT JOIN s7 sb ON sb.t = k.t AND sb.u = k.b, span""",
    # -- splits and folds --
    "tc": "SELECT t, count(*) AS n, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS m FROM cohort GROUP BY t",
    "cuts": """SELECT max(t) FILTER (i = CAST(trunc(m * 0.6::DOUBLE) AS BIGINT)) AS v, max(t) FILTER (i = CAST(trunc(m * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT)) AS s FROM tc
        WHERE trunc(m * 0.6::DOUBLE) >= 1 AND trunc(m * (0.6::DOUBLE + 0.2::DOUBLE)) > trunc(m * 0.6::DOUBLE) AND trunc(m * (0.6::DOUBLE + 0.2::DOUBLE)) < m""",
    "plan": """SELECT t, n, p, q, CASE WHEN t + 86400 < v THEN 'train' WHEN t >= v AND t + 86400 < s THEN 'validation' WHEN t >= s THEN 'test' ELSE 'purged' END AS split
        FROM tc, cuts""",
    "vals": "SELECT f.t AS f, g.t AS t, row_number() OVER (PARTITION BY f.t ORDER BY g.t DESC) AS r FROM tc f JOIN tc g ON g.t + 86400 < f.t",
    "fold_role": """SELECT f, t, 'validation' AS role FROM vals WHERE r <= 3 UNION ALL SELECT t, t, 'test' FROM tc
        UNION ALL SELECT v.f, g.t, 'train' FROM (SELECT f, min(t) AS first FROM vals WHERE r <= 3 GROUP BY f) v JOIN tc g ON g.t + 86400 < v.first""",
    "fold": """SELECT f, count(*) FILTER (role = 'train') AS train_times, count(*) FILTER (role = 'validation') AS validation_times, count(*) FILTER (role = 'test') AS test_times,
        coalesce(sum(p) FILTER (role = 'train'), 0) AS train_p, coalesce(sum(q) FILTER (role = 'train'), 0) AS train_q,
        coalesce(sum(p) FILTER (role = 'validation'), 0) AS validation_p, coalesce(sum(q) FILTER (role = 'validation'), 0) AS validation_q,
        coalesce(sum(p) FILTER (role = 'test'), 0) AS test_p, coalesce(sum(q) FILTER (role = 'test'), 0) AS test_q FROM fold_role JOIN tc USING (t) GROUP BY f""",
    "fold_status": """SELECT *, CASE WHEN validation_times < 3 OR train_times < 4 THEN 'insufficient_history'
        WHEN least(train_p, train_q, validation_p, validation_q, test_p, test_q) >= 5 THEN 'ready' ELSE 'insufficient_class_rows' END AS status FROM fold""",
    "role": "SELECT r.f, r.t, r.role FROM fold_role r JOIN fold_status s ON s.f = r.f AND s.status = 'ready'",
    # -- untrained scores --
    "facts": """SELECT c.t, c.a, c.b, c.y, h.w, h.t - h.last AS recency, CASE WHEN p.seen > 0 THEN p.hits / CAST(p.seen AS DOUBLE) END AS prob,
        CASE WHEN h.t - h.last <= 86400 THEN 0 WHEN h.t - h.last <= 3 * 86400 THEN 1 WHEN h.t - h.last <= 7 * 86400 THEN 2 ELSE 3 END AS rb
        FROM cohort c JOIN hist_cand h ON h.t = c.t AND h.a = c.a AND h.b = c.b JOIN prob_cand p ON p.t = h.t AND p.a = h.a AND p.b = h.b AND p.w = h.w""",
    "prior": "SELECT r.f, x.w, sum(y) / CAST(count(*) AS DOUBLE) AS prior FROM role r JOIN facts x ON x.t = r.t WHERE r.role = 'train' GROUP BY r.f, x.w",
    "cell": "SELECT r.f, x.w, x.rb, sum(y) AS cp, count(*) AS cn FROM role r JOIN facts x ON x.t = r.t WHERE r.role = 'train' GROUP BY r.f, x.w, x.rb",
    "scored": """SELECT r.f, r.role, x.t, x.a, x.b, x.y, x.w, m.model,
        CASE m.model WHEN 'constant' THEN prior WHEN 'historical_frequency' THEN coalesce(least(greatest(prob, 0.0), 1.0), prior)
             ELSE coalesce((CAST(cp AS DOUBLE) + prior) / (CAST(cn AS DOUBLE) + 1.0), prior) END AS p
        FROM role r JOIN facts x ON x.t = r.t JOIN prior q ON q.f = r.f AND q.w = x.w LEFT JOIN cell c ON c.f = r.f AND c.w = x.w AND c.rb = x.rb
        CROSS JOIN (SELECT unnest(['constant', 'historical_frequency', 'time_rule']) AS model) m WHERE r.role <> 'train'""",
    "vstep": """SELECT f, w, model, p, sum(sum(y)) OVER g AS tp, sum(count(*)) OVER g AS np, sum(sum(y)) OVER (PARTITION BY f, w, model) AS pall
        FROM scored WHERE role = 'validation' GROUP BY f, w, model, p WINDOW g AS (PARTITION BY f, w, model ORDER BY p DESC)""",
    "vf": "SELECT f, w, model, p, pall, 2.0 * tp / (np + pall) AS f1 FROM vstep",
    "thr": """SELECT f, w, model, CASE WHEN max(pall) > 0 THEN arg_min(p, (abs(p - 0.5), p)) ELSE 0.5 END AS threshold
        FROM (SELECT *, max(f1) OVER (PARTITION BY f, w, model) AS best FROM vf) WHERE abs(f1 - best) <= 1e-8 + 1e-5 * best GROUP BY f, w, model""",
    "pred": "SELECT s.t, s.a, s.b, s.y, s.w, s.model, s.p, h.threshold FROM scored s JOIN thr h ON h.f = s.f AND h.w = s.w AND h.model = s.model WHERE s.role = 'test'",
    "step": """SELECT model, w, p, sum(y) AS pos, count(*) AS n, sum(sum(y)) OVER g AS tp, sum(count(*)) OVER g AS np,
        sum(sum(y)) OVER z AS pall, sum(count(*)) OVER z AS nall FROM pred GROUP BY model, w, p
        WINDOW g AS (PARTITION BY model, w ORDER BY p DESC), z AS (PARTITION BY model, w)""",
    "dstep": """SELECT model, w, t, p, sum(y) AS pos, count(*) AS n, sum(sum(y)) OVER g AS tp, sum(count(*)) OVER g AS np,
        sum(sum(y)) OVER z AS pall, sum(count(*)) OVER z AS nall FROM pred GROUP BY model, w, t, p
        WINDOW g AS (PARTITION BY model, w, t ORDER BY p DESC), z AS (PARTITION BY model, w, t)""",
    "pooled_ap": "SELECT model, w, sum(pos / CAST(pall AS DOUBLE) * tp / np) AS ap FROM step WHERE pall > 0 GROUP BY model, w",
    "day_ap": "SELECT model, w, t, sum(pos / CAST(pall AS DOUBLE) * tp / np) AS ap FROM dstep WHERE pall > 0 GROUP BY model, w, t",
    "contrasts": """SELECT * FROM (VALUES ('time_rule', 7, 'time_rule', 1), ('historical_frequency', 7, 'historical_frequency', 1),
        ('time_rule', 7, 'historical_frequency', 7)) v(am, aw, bm, bw)""",
    # -- several sources --
    "uspan": """SELECT ds, min(ts) AS lo, max(ts) AS hi FROM uniq GROUP BY ds""",
    "utime": """SELECT ds, w, d * 86400 + 28800 AS t FROM uspan CROSS JOIN wins CROSS JOIN (SELECT unnest(range(-2, 60)) AS d)
        WHERE d * 86400 + 28800 - w * 86400 >= lo AND d * 86400 + 28800 + 86400 <= hi""",
    "uhist": "SELECT k.ds, k.w, k.t, a, b, count(*) AS n, max(ts) AS last FROM utime k JOIN uniq u ON u.ds = k.ds AND ts >= t - w * 86400 AND ts < t GROUP BY k.ds, k.w, k.t, a, b",
    "uadj": "SELECT ds, w, t, a AS u, b AS v FROM uhist UNION ALL SELECT ds, w, t, b, a FROM uhist",
    "ucn": "SELECT h.ds, h.w, h.t, h.a, h.b, count(*) AS cn FROM uhist h JOIN uadj x ON x.ds = h.ds AND x.w = h.w AND x.t = h.t AND x.u = h.a JOIN uadj y ON y.ds = h.ds AND y.w = h.w AND y.t = h.t AND y.u = h.b AND y.v = x.v GROUP BY h.ds, h.w, h.t, h.a, h.b",
    "uscore": """SELECT h.ds, h.w, h.t, h.a, h.b, h.n / CAST(h.w AS DOUBLE) AS fr, CAST(h.last - h.t AS DOUBLE) AS re, CAST(coalesce(c.cn, 0) AS DOUBLE) AS cn
        FROM uhist h LEFT JOIN ucn c ON c.ds = h.ds AND c.w = h.w AND c.t = h.t AND c.a = h.a AND c.b = h.b WHERE h.last >= h.t - 86400""",
    "umeth": """SELECT ds, w, t, a, b, 'historical_frequency' AS method, fr AS score FROM uscore UNION ALL SELECT ds, w, t, a, b, 'last_contact_recency', re FROM uscore
        UNION ALL SELECT ds, w, t, a, b, 'common_neighbors', cn FROM uscore""",
    "urank": "SELECT *, row_number() OVER (PARTITION BY ds, w, t, method ORDER BY score DESC, a, b) AS r FROM umeth",
    "ufut": "SELECT DISTINCT k.ds, k.t, a, b FROM (SELECT DISTINCT ds, t FROM utime) k JOIN uniq u ON u.ds = k.ds AND ts > t AND ts <= t + 86400",
    "upool": "SELECT s.ds, s.w, s.t, count(*) AS n, count(f.a) AS pool FROM uscore s LEFT JOIN ufut f ON f.ds = s.ds AND f.t = s.t AND f.a = s.a AND f.b = s.b GROUP BY s.ds, s.w, s.t",
    "uhit": """SELECT k.ds, k.w, k.t, m.method, j.k, count(f.a) AS hits FROM utime k CROSS JOIN (SELECT unnest(['historical_frequency', 'last_contact_recency', 'common_neighbors']) AS method) m
        CROSS JOIN (SELECT unnest([5, 10, 20]) AS k) j LEFT JOIN urank r ON r.ds = k.ds AND r.w = k.w AND r.t = k.t AND r.method = m.method AND r.r <= j.k
        LEFT JOIN ufut f ON f.ds = r.ds AND f.t = r.t AND f.a = r.a AND f.b = r.b GROUP BY k.ds, k.w, k.t, m.method, j.k""",
    "umet": """SELECT h.ds, h.t, h.w, h.method, h.k, coalesce(p.n, 0) AS n, coalesce(f.c, 0) AS total, coalesce(p.pool, 0) AS pool, h.hits
        FROM uhit h LEFT JOIN upool p ON p.ds = h.ds AND p.w = h.w AND p.t = h.t LEFT JOIN (SELECT ds, t, count(*) AS c FROM ufut GROUP BY ds, t) f ON f.ds = h.ds AND f.t = h.t""",
    "uagg": """SELECT ds, scope, w, method, k, sum(n) AS n, sum(total) AS total, sum(pool) AS pool, sum(total - pool) AS outside, sum(hits) AS hits, sum(n - pool) AS unknown,
        sum(least(k, n)) AS actual, count(*) AS times, count(*) FILTER (n > 0) AS nonempty, count(*) FILTER (pool > 0) AS withpool
        FROM (SELECT *, 'per_window' AS scope FROM umet UNION ALL SELECT m.*, 'common_7d' FROM umet m SEMI JOIN (SELECT ds, t FROM utime WHERE w = 7) c ON c.ds = m.ds AND c.t = m.t)
        GROUP BY ds, scope, w, method, k""",
    "edges": "SELECT ds, a, b, count(*) AS n FROM uniq GROUP BY ds, a, b",
    "udeg": "SELECT ds, u, count(*) AS deg FROM (SELECT ds, a AS u FROM edges UNION ALL SELECT ds, b FROM edges) GROUP BY ds, u",
    "deg_hist": "SELECT ds, CASE WHEN deg <= 5 THEN '0–5' WHEN deg <= 20 THEN '6–20' WHEN deg <= 50 THEN '21–50' ELSE '>50' END AS bin, count(*) AS c FROM udeg GROUP BY 1, 2",
    "dpair": "SELECT ds, ts // 86400 AS d, a, b, count(*) AS n FROM uniq GROUP BY 1, 2, 3, 4",
    "drep": """SELECT s.ds, s.d - s.f + 1 AS study_day, coalesce(sum(p.n), 0) AS records, count(p.a) AS active, count(q.a) AS repeated
        FROM (SELECT ds, min(d) AS f, unnest(range(min(d), max(d) + 1)) AS d FROM dpair GROUP BY ds) s LEFT JOIN dpair p ON p.ds = s.ds AND p.d = s.d
        LEFT JOIN dpair q ON q.ds = p.ds AND q.d = p.d - 1 AND q.a = p.a AND q.b = p.b GROUP BY s.ds, s.d, s.f""",
    # -- 7-day graph --
    "edge7": "SELECT t, a, b, count(*) AS wt, max(ts) AS last FROM snap JOIN con ON ts >= t - 7 * 86400 AND ts < t GROUP BY t, a, b",
    "edge3": "SELECT DISTINCT t, a, b FROM snap JOIN con ON ts >= t - 3 * 86400 AND ts < t",
    "node7": "SELECT t, u, sum(wt) AS act, count(*) AS deg, max(last) AS last FROM (SELECT t, a AS u, wt, last FROM edge7 UNION ALL SELECT t, b, wt, last FROM edge7) GROUP BY t, u",
    "strong": "SELECT t, arg_min(v, (-wt, v)) AS s FROM (SELECT t, b AS v, wt FROM edge7 WHERE a = 5 UNION ALL SELECT t, a, wt FROM edge7 WHERE b = 5) GROUP BY t",
    "pick7": """SELECT t, u, act, deg, last FROM (SELECT n.*, row_number() OVER (PARTITION BY n.t ORDER BY (n.u = 5 OR n.u = coalesce(s.s, -9)) DESC, n.act DESC, n.u) AS r
        FROM node7 n LEFT JOIN strong s ON s.t = n.t) WHERE r <= 12""",
    "in7": "SELECT e.*, (a = 5 OR b = 5) AS foc, row_number() OVER (PARTITION BY e.t ORDER BY wt DESC, a, b) AS r FROM edge7 e JOIN pick7 x ON x.t = e.t AND x.u = e.a JOIN pick7 y ON y.t = e.t AND y.u = e.b",
    # -- audit --
    "deadline": "SELECT max(t) + 86400 AS v FROM plan WHERE split IN ('train', 'validation')",
    "akey": "SELECT c.t, c.a, c.b FROM cand1 c, deadline, span WHERE c.t > v AND c.t - 7 * 86400 >= lo",
    "afact": """SELECT k.t, k.a, k.b, h.w, h.n, h.bins, h.t - h.last AS recency, coalesce(sa.n, 0) / (h.w * 288.0) AS ca, coalesce(sb.n, 0) / (h.w * 288.0) AS cb,
        CASE WHEN p.seen > 0 THEN p.hits / CAST(p.seen AS DOUBLE) END AS prob FROM akey k JOIN hist_cand h ON h.t = k.t AND h.a = k.a AND h.b = k.b
        LEFT JOIN uscan sa ON sa.t = h.t AND sa.w = h.w AND sa.u = h.a LEFT JOIN uscan sb ON sb.t = h.t AND sb.w = h.w AND sb.u = h.b
        JOIN prob_cand p ON p.t = h.t AND p.a = h.a AND p.b = h.b AND p.w = h.w""",
    "avail": """SELECT t, a, b, min(least(ca, cb)) > 0 AS ok, max(bins) FILTER (w = 1) AS bins1, max(n) FILTER (w = 1) AS n1,
        max(least(ca, cb)) FILTER (w = 1) AS scan1, max(recency) FILTER (w = 1) AS rec1 FROM afact GROUP BY t, a, b""",
    "asample": """SELECT v.t, v.a, v.b, v.ok, v.bins1, v.scan1, l.y, l.ok AS covered, l.y IS NOT NULL AS known, c.t IS NOT NULL AS old
        FROM avail v JOIN lab l ON l.t = v.t AND l.a = v.a AND l.b = v.b LEFT JOIN cohort c ON c.t = v.t AND c.a = v.a AND c.b = v.b""",
    "apred": """SELECT s.*, f.w, coalesce(f.prob, (SELECT avg(CAST(c.y AS DOUBLE)) FROM cohort c JOIN plan p ON p.t = c.t AND p.split = 'train')) AS p
        FROM asample s JOIN afact f ON f.t = s.t AND f.a = s.a AND f.b = s.b WHERE s.ok""",
    # -- catalogue --
    "cat": """SELECT 'scans' AS ds, ts, user_a, user_b FROM raw_log
        UNION ALL SELECT 'shipments', CAST(epoch(l_shipdate) - epoch(TIMESTAMP '1995-01-01') AS BIGINT) + l_linenumber * 20, l_partkey, l_suppkey FROM lineitem
        UNION ALL SELECT 'orders', CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01') AS BIGINT), o_custkey, o_orderkey % 1500 FROM orders""",
    "ccon": "SELECT ds, ts, least(user_a, user_b) AS a, greatest(user_a, user_b) AS b FROM cat WHERE ts >= 0 AND user_a >= 0 AND user_b >= 0 AND user_a <> user_b",
    "ctime": """SELECT ds, w, t, row_number() OVER (PARTITION BY ds, w ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY ds, w) AS m
        FROM (SELECT ds, min(ts) AS lo, max(ts) AS hi, unnest(range(min(ts) // 86400, max(ts) // 86400 + 1)) * 86400 + 28800 AS t FROM ccon GROUP BY ds) CROSS JOIN wins
        WHERE t - w * 86400 >= lo AND t + 86400 <= hi""",
    "ccap": """SELECT ds, w, count(*) AS n, count(*) FILTER (i < f AND t + 86400 < tf) AS tr, count(*) FILTER (i >= f AND i < s AND t + 86400 < ts) AS va, count(*) FILTER (i >= s) AS te
        FROM (SELECT *, max(t) FILTER (i = f) OVER (PARTITION BY ds, w) AS tf, max(t) FILTER (i = s) OVER (PARTITION BY ds, w) AS ts
              FROM (SELECT *, CAST(trunc(m * 0.6::DOUBLE) AS BIGINT) AS f, CAST(trunc(m * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT) AS s FROM ctime)) GROUP BY ds, w""",
    "cman": """SELECT ds, count(*) AS rows, min(ts) AS lo, max(ts) AS hi, count(DISTINCT (a, b)) AS pairs, count(DISTINCT ts // 86400) AS days FROM ccon GROUP BY ds""",
}



def _needs(text: str, found: dict[str, None]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
            _needs(CTES[name], found)
            found[name] = None


def sql(body: str, recursive: bool = False, **own: str) -> str:
    """``WITH <needed blocks>, <own blocks> body``."""
    found: dict[str, None] = {}
    for text in (*own.values(), body):
        _needs(text, found)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in found] + [f"{n} AS ({t})" for n, t in own.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body
