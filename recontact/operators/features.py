"""Strictly historical features over ``[t-w, t)``.

Partial sums per (pair, day) and (participant, day) are combined by sliding RANGE frames over
the snapshot day, so a w-day history costs no row blow-up: each partition holds at most one row
per snapshot of one pair or one participant. Which of the last 14 daily buckets were touched or
observed is kept as a 16-bit mask (bit ``day % 16``), so the contact probability is two bit
counts. Only common neighbours need the window graph itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recontact.functions.timemath import Span, floor_div
from recontact.operators.clean import PAIR
from recontact.operators.pointintime import KEY, attach_users, nested_presence
from recontact.policy import DAY, HOUR, Policy

# Names and order of the published feature columns.
BOUNDED_FEATURES = (
    "pair_contact_count", "pair_contact_bins", "pair_contact_days", "recency_seconds", "rssi_mean", "rssi_max",
    "participant_a_activity", "participant_b_activity", "common_neighbors", "network_degree_a", "network_degree_b",
    "scan_coverage_a", "scan_coverage_b", "historical_contact_probability", "observed_history_days")

# Names and order of the bank's columns, each with the days of history it needs (0: none of its own).
BANK_SPANS = {
    "contact_count_1d": 1, "contact_count_3d": 3, "contact_count_7d": 7, "contact_count_14d": 14, "contact_bins_1d": 1, "contact_bins_7d": 7,
    "time_since_last_contact": 0, "unique_contact_days_7d": 7, "unique_contact_days_14d": 14, "historical_contact_probability": 14,
    "rssi_mean_7d": 7, "rssi_max_7d": 7, "sms_count_7d": 7, "call_count_7d": 7, "prediction_day_index": 0, "prediction_hour": 0,
    "relative_weekday": 0, "is_relative_weekend": 0, "participant_a_activity_7d": 7, "participant_b_activity_7d": 7,
    "common_neighbors_historical": 7, "historical_network_degree_a": 7, "historical_network_degree_b": 7, "scan_coverage_a": 7,
    "scan_coverage_b": 7, "history_complete_1d": 1, "history_complete_3d": 3, "history_complete_7d": 7, "history_complete_14d": 14}
BANK_FEATURES = tuple(BANK_SPANS)
MODEL_WINDOWS = (1, 3, 7, 14)


def _union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def _over(keys: str, days: int | None) -> str:
    """A sliding frame of ``days`` snapshots up to the current one; None reaches back to the first."""
    start = "UNBOUNDED" if days is None else str(days - 1)
    return f"OVER (PARTITION BY {keys} ORDER BY day RANGE BETWEEN {start} PRECEDING AND CURRENT ROW)"


def _day_bit(flag: str) -> str:
    return f"CASE WHEN {flag} THEN shiftleft(1L, int(pmod(day, 16))) ELSE 0L END"


def _record(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in values.items()) + ")"


def user_history(pairs: DataFrame, scans: DataFrame, span: Span, windows: tuple[int, ...]) -> DataFrame:
    """activity_w, degree_w, scans_w and seen_w per participant and snapshot day (dense).

    Degrees are running sums of edge arrivals and departures, so no window graph is built.
    """
    policy = span.policy
    edges = pairs.selectExpr(*PAIR, "day", "contacts", f"lead(day) OVER (PARTITION BY {', '.join(PAIR)} ORDER BY day) AS next_day")
    arrives = _record({"day": "day", "activity": "contacts", **{f"edge_{v}": "1L" for v in windows}})
    leaves = [_record({"day": f"least(day + {w}, coalesce(next_day, 1L << 40))", "activity": "0L",
                       **{f"edge_{v}": "-1L" if v == w else "0L" for v in windows}}) for w in windows]
    moves = (edges.withColumn("user_id", F.explode(F.array(*PAIR)))
             .selectExpr("user_id", f"inline(array({', '.join([arrives, *leaves])}))"))
    people = pairs.select(F.explode(F.array(*PAIR)).alias("user_id")).union(scans.select("user_id")).distinct()
    spine = people.selectExpr("user_id", f"explode(sequence({span.first_snapshot}L, {span.last_snapshot}L)) AS day")
    names = ["activity", "scans", *[f"edge_{w}" for w in windows]]
    facts = _union_all([moves, scans, spine]).groupBy("user_id", "day").agg(*[F.expr(f"coalesce(sum({n}), 0L) AS {n}") for n in names])
    enough = f"scans / {policy.expected_bins} >= {policy.min_scan_coverage!r}D"
    columns = []
    for w in windows:
        frame = _over("user_id", w)
        columns += [f"sum(activity) {frame} AS activity_{w}", f"sum(scans) {frame} AS scans_{w}", f"bit_or({_day_bit(enough)}) {frame} AS seen_{w}",
                    f"sum(edge_{w}) {_over('user_id', None)} AS degree_{w}"]
    dense = facts.selectExpr("user_id", "day", *columns)
    return dense.where(F.col("day").between(span.first_snapshot, span.last_snapshot))


def pair_history(pairs: DataFrame, keys: DataFrame, windows: tuple[int, ...], counted: DataFrame | None = None) -> DataFrame:
    """count/bins/days/rssi/last/touched-mask per window for the given (pair, day) keys.

    ``counted``: further numbers of some of the keys, which are merged by the same exchange.
    """
    further = [] if counted is None else [c for c in counted.columns if c not in ("day", *PAIR)]
    group = ", ".join(PAIR)
    facts = pairs.select(*PAIR, "day", "contacts", "bins", "rssi_sum", "rssi_n", "rssi_max", "last_contact", "on_day", "on_next")
    asked = keys.select(*PAIR, "day").withColumn("asked", F.lit(1))
    # One exchange by pair serves the merge and every window below.
    merged = _union_all([facts, asked, *([] if counted is None else [counted])]).repartition(*PAIR).groupBy(*PAIR, "day").agg(*[
        F.expr(f"max({c}) AS {c}") for c in ("asked", "contacts", "bins", "rssi_sum", "rssi_n", "rssi_max", "last_contact", "on_day", "on_next", *further)])
    # The late calendar day of yesterday's slot is the early calendar day of today's slot.
    before = f"OVER (PARTITION BY {group} ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    marked = merged.selectExpr("*", "coalesce(on_day + on_next, 0) AS touched", f"coalesce(on_day * max(on_next) {before}, 0) AS overlap")
    columns = []
    for w in windows:
        frame = _over(group, w)
        total = lambda name: f"coalesce(sum({name}) {frame}, 0L)"
        shared = f"coalesce(sum(overlap) {_over(group, w - 1)}, 0L)" if w > 1 else "0L"
        columns += [f"{total('contacts')} AS contacts_{w}", f"{total('bins')} AS bins_{w}", f"{total('touched')} - {shared} AS days_{w}",
                    f"sum(rssi_sum) {frame} AS rssi_sum_{w}", f"{total('rssi_n')} AS rssi_n_{w}", f"max(rssi_max) {frame} AS rssi_max_{w}",
                    f"max(last_contact) {frame} AS last_{w}", f"bit_or({_day_bit('contacts IS NOT NULL')}) {frame} AS mask_{w}"]
    ever = f"max(last_contact) {_over(group, None)} AS last_ever"
    return marked.selectExpr(*PAIR, "day", "asked", *further, ever, *columns).where("asked = 1").drop("asked")


def window_edges(pairs: DataFrame, span: Span, windows: tuple[int, ...]) -> DataFrame:
    """The nested window graphs: each edge of the widest one once per day, with the shortest window that holds it."""
    return nested_presence(pairs, windows).where(F.col("day").between(span.first_snapshot, span.last_snapshot))


def common_neighbours(keys: DataFrame, edges: DataFrame, people: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Shared neighbours of each key in each window graph that has any, one row per (key, window_days)."""
    counted = ", ".join(_record({"window_days": str(w), "common_neighbors": f"common_{w}"}) for w in windows)
    wide = neighbour_counts(keys, edges, people, windows)
    return wide.selectExpr("day", *PAIR, f"inline(array({counted}))").where("common_neighbors > 0").select("window_days", "day", *PAIR, "common_neighbors")


def neighbour_counts(keys: DataFrame, edges: DataFrame, people: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """common_w of each key: expand the end with fewer neighbours in the widest window graph, once for all windows.

    The neighbours of the smaller end are looked up in the edge table of the other end by an
    exact key. The work is the sum of the smaller degrees; a hub's list is only read where its
    partner is a hub as well.
    """
    degrees = people.selectExpr("day", "user_id", f"degree_{max(windows)} AS degree").where("degree > 0")
    return expand_smaller_end(keys.select("day", *PAIR), edges, degrees, ["day"], windows)


def expand_smaller_end(asked: DataFrame, edges: DataFrame, degrees: DataFrame, by: list[str], windows: tuple[int, ...]) -> DataFrame:
    """common_w per asked pair. A path lies in the graphs that hold both of its edges: in those from the longer of their windows on."""
    ends = attach_users(asked, degrees, {"degree": ("degree_a", "degree_b")}, tuple(by)).where("degree_a > 0 AND degree_b > 0")
    smaller_a = "degree_a < degree_b OR (degree_a = degree_b AND user_min < user_max)"
    sided = ends.selectExpr(*by, *PAIR, f"if({smaller_a}, user_min, user_max) AS expand", f"if({smaller_a}, user_max, user_min) AS probe")
    lists = edges.selectExpr(*by, "window_days AS opens",
                             "inline(array(named_struct('expand', user_min, 'third', user_max), named_struct('expand', user_max, 'third', user_min)))")
    paths = sided.join(lists, [*by, "expand"]).where("third <> probe")
    closing = edges.selectExpr(*by, "user_min AS low", "user_max AS high", "window_days AS closes")
    closed = (paths.selectExpr(*by, *PAIR, "opens", "least(probe, third) AS low", "greatest(probe, third) AS high")
              .join(closing, [*by, "low", "high"]))
    return closed.groupBy(*by, *PAIR).agg(*[F.count_if(F.greatest("opens", "closes") <= w).alias(f"common_{w}") for w in windows])


def _probability(mask: str, seen_a: str, seen_b: str) -> tuple[str, str]:
    observed = f"(coalesce({seen_a}, 0L) & coalesce({seen_b}, 0L))"
    return f"CASE WHEN {observed} > 0 THEN bit_count({observed} & {mask}) / bit_count({observed}) END", f"bit_count({observed})"


def _mean(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {total} / {n} END"


def bounded_bank(pairs: DataFrame, people: DataFrame, keys: DataFrame, span: Span, windows: tuple[int, ...], neighbours: bool = True) -> DataFrame:
    """The 15 features of every key for each window, one row per (key, window_days).

    ``people`` is ``user_history`` for at least these windows.
    """
    policy = span.policy
    known = policy.scan_coverage_available
    shared = neighbour_counts(keys, window_edges(pairs, span, windows), people, windows) if neighbours else None
    wide = attach_users(pair_history(pairs, keys, windows, shared), people, {
        f"{fact}_{w}": (f"{fact}_a_{w}", f"{fact}_b_{w}") for w in windows for fact in ("activity", "degree", "scans", "seen")})
    t = f"(day * {DAY} + {policy.offset})"
    rows = []
    for w in windows:
        probability, observed = _probability(f"mask_{w}", f"seen_a_{w}", f"seen_b_{w}")
        values = {"pair_contact_count": f"contacts_{w}", "pair_contact_bins": f"bins_{w}", "pair_contact_days": f"days_{w}",
                  "recency_seconds": f"{t} - last_{w}", "rssi_mean": _mean(f"rssi_sum_{w}", f"rssi_n_{w}"), "rssi_max": f"rssi_max_{w}"}
        for side in ("a", "b"):
            values[f"participant_{side}_activity"] = f"coalesce(activity_{side}_{w}, 0L)"
            values[f"network_degree_{side}"] = f"coalesce(degree_{side}_{w}, 0L)"
            values[f"scan_coverage_{side}"] = f"coalesce(scans_{side}_{w}, 0L) / {w * policy.expected_bins}" if known else "NULL"
        values["historical_contact_probability"] = probability if known else "NULL"
        values["observed_history_days"] = observed if known else "NULL"
        values["common_neighbors"] = f"coalesce(common_{w}, 0L)" if neighbours else "NULL"
        rows.append(_record({"window_days": str(w), **{name: f"double({value})" for name, value in values.items()}}))
    tall = wide.selectExpr("day", *PAIR, f"inline(array({', '.join(rows)}))")
    return tall.selectExpr(f"{t} AS timestamp", *PAIR, "window_days", *BOUNDED_FEATURES)


def time_context(keys: DataFrame, policy: Policy) -> DataFrame:
    """Day index and hour; weekday only when the origin's weekday is documented."""
    weekday = (F.lit(None).cast("double") if policy.weekday_origin is None
               else ((policy.weekday_origin + floor_div("timestamp", DAY)) % 7).cast("double"))
    return keys.withColumns({
        "prediction_day_index": floor_div("timestamp", DAY).cast("double"),
        "prediction_hour": F.floor((F.col("timestamp") % DAY) / HOUR).cast("double"),
        "relative_weekday": weekday,
        "is_relative_weekend": F.when(weekday.isNotNull(), (weekday >= 5).cast("double"))})


def history_complete(keys: DataFrame, span: Span, windows: tuple[int, ...]) -> DataFrame:
    return keys.withColumns({f"history_complete_{w}d": (F.col("timestamp") - w * DAY >= span.start).cast("double") for w in windows})


def feature_bank(pairs: DataFrame, people: DataFrame, keys: DataFrame, span: Span) -> DataFrame:
    """The 29-feature, 14-day bank for known-pair keys; unavailable measurements stay null."""
    policy = span.policy
    known = policy.scan_coverage_available
    facts = {"activity_7": ("activity_a", "activity_b"), "degree_7": ("degree_a", "degree_b"),
             "scans_7": ("scans_a", "scans_b"), "seen_14": ("seen_a", "seen_b")}
    shared = neighbour_counts(keys, window_edges(pairs, span, (7,)), people, (7,))
    wide = attach_users(pair_history(pairs, keys, policy.bank_windows, shared), people, facts)
    t = f"(day * {DAY} + {policy.offset})"
    values = {
        **{f"contact_count_{w}d": f"contacts_{w}" for w in policy.bank_windows}, "contact_bins_1d": "bins_1", "contact_bins_7d": "bins_7",
        "time_since_last_contact": f"{t} - last_ever", "unique_contact_days_7d": "days_7", "unique_contact_days_14d": "days_14",
        "historical_contact_probability": _probability("mask_14", "seen_a", "seen_b")[0] if known else "NULL",
        "rssi_mean_7d": _mean("rssi_sum_7", "rssi_n_7"), "rssi_max_7d": "rssi_max_7",
        # Message and call logs carry no arrival times, so their counts stay unknown.
        "sms_count_7d": "NULL", "call_count_7d": "NULL",
        "participant_a_activity_7d": "coalesce(activity_a, 0L)", "participant_b_activity_7d": "coalesce(activity_b, 0L)",
        "common_neighbors_historical": "coalesce(common_7, 0L)",
        "historical_network_degree_a": "coalesce(degree_a, 0L)", "historical_network_degree_b": "coalesce(degree_b, 0L)",
        **{f"scan_coverage_{side}": f"coalesce(scans_{side}, 0L) / {7 * policy.expected_bins}" if known else "NULL" for side in ("a", "b")}}
    rows = wide.selectExpr(f"{t} AS timestamp", *PAIR, *[f"double({value}) AS {name}" for name, value in values.items()])
    return history_complete(time_context(rows, policy), span, policy.bank_windows).select(*KEY, *BANK_FEATURES)


def feature_window_view(bank: DataFrame, days: int | None) -> DataFrame:
    """The bank as a model with a history of ``days`` sees it: one projection that leaves out of each row what is older.

    Columns that need a longer history are null; the last contact is known if it lies inside the window. None: all.
    """
    if days is not None and days not in MODEL_WINDOWS:
        raise ValueError(f"a model window is one of {MODEL_WINDOWS} days")
    seen = []
    for name in bank.columns:
        value = F.col(name)
        if days is not None and BANK_SPANS.get(name, 0) > days:
            value = F.lit(None).cast("double")
        elif days is not None and name == "time_since_last_contact":
            value = F.when(value <= days * DAY, value)
        seen.append(value.alias(name))
    return bank.select(*seen)


def pair_trend(keys: DataFrame, contacts: DataFrame, policy: Policy, window_days: int) -> DataFrame:
    """Contacts of a pair per calendar study day of its window, empty days included."""
    t = F.col("timestamp")
    spine = (keys.select(*KEY, history_bounds(t, window_days, policy))
             .select(*KEY, F.explode("days").alias("study_day")))
    daily = (contacts.select(floor_div("timestamp", DAY).alias("d"), *PAIR, "timestamp")
             .select((F.col("d") + 1).alias("study_day"), *PAIR,
                     (F.col("timestamp") - F.col("d") * DAY < policy.offset).alias("early"))
             .groupBy("study_day", *PAIR).agg(F.count_if("early").alias("early"), F.count_if(~F.col("early")).alias("late")))
    # The first calendar day counts only its part after the window start, the last only its part before t.
    first = F.col("study_day") == floor_div(t - window_days * DAY, DAY) + 1
    last = F.col("study_day") == floor_div(t, DAY) + 1
    records = F.when(first, F.col("late")).when(last, F.col("early")).otherwise(F.col("early") + F.col("late"))
    return spine.join(daily, ["study_day", *PAIR], "left").select(
        *KEY, "study_day", F.coalesce(records, F.lit(0)).alias("contact_records"))


def history_bounds(t: Column, window_days: int, policy: Policy) -> Column:
    start = F.greatest(t - window_days * DAY, F.lit(0))
    return F.sequence(floor_div(start, DAY) + 1, floor_div(F.greatest(t - 1, F.lit(0)), DAY) + 1).alias("days")
