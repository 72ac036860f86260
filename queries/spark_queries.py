"""One registered query per operator. Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from queries.context import Context, context
from recontact.functions import hawkes, metrics as m, scorecard as card, uncertainty
from recontact.functions.timemath import snapshot_time
from recontact.operators import (catalog, clean, disclosure, explore, features as fe, graph, integrity, pointintime as pit,
                                 retrieval, splits)
from recontact.operators.pointintime import KEY
from recontact.plans import audit, baselines, rolling
from recontact.session import staged
from recontact.sources import derived, readers
from recontact.streaming import freshness

PAIR = ["user_min", "user_max"]
MODEL = ["model", "window_days"]
QUERIES: dict[str, Callable] = {}


def query(function=None, *, name: str | None = None):
    """Register a function of a Context; doubles are rounded to 6 digits at the edge."""
    def register(f):
        def run(spark, folder: str) -> DataFrame:
            return m.rounded(f(context(spark, folder)))
        QUERIES[name or f.__name__] = run
        return f
    return register(function) if function else register


# ---- sources ---------------------------------------------------------------------------------

@query
def read_scan_log(c: Context):
    text = c.raw.select(F.coalesce(F.col("rssi"), F.lit(-99.0)).cast("string").alias(" rssi"), F.col("user_b").cast("string").alias("user_b"),
                        F.col("timestamp").cast("string").alias("# timestamp "), F.col("user_a").cast("string").alias("user_a"))
    return readers.cast_rows(readers.normalize_header(text, "bluetooth"), "bluetooth")


@query
def read_call_log(c: Context):
    text = c.table("orders").select(
        F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1992-01-01 00:00:00', o_orderdate) AS STRING)").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("caller"), (F.col("o_orderkey") % 1500).cast("string").alias("callee"),
        (F.col("o_orderkey") % 600 - 1).cast("string").alias("duration"))
    return readers.cast_rows(readers.normalize_header(text, "calls"), "calls")


@query
def read_proximity_log(c: Context):
    lines = derived.proximity_lines(c.table("lineitem"))
    return readers.cast_rows(readers.parse_fields(lines, readers.SCHEMAS["proximity"]), "proximity")


def _triplet_lines(c: Context):
    line = F.concat_ws("\t", "l_partkey", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)"), "l_suppkey")
    return c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                      F.when(F.col("l_linenumber") == 7, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))


@query
def read_triplets(c: Context):
    rows = readers.triplets(_triplet_lines(c).select("value"), ("user_a", "timestamp", "user_b"))
    return rows.select(*[F.col(x).cast("long").alias(x) for x in rows.columns])


@query
def read_mapped_edges(c: Context):
    text = c.table("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("when"),
                                    F.col("o_custkey").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst"))
    return readers.map_edges(text, {"when": "timestamp", "src": "user_a", "dst": "user_b"}, "datetime", "+02:00")


def _faulty(c: Context):
    n = F.col("event_id")
    return c.raw.select(
        "event_id", F.when(n % 101 == 0, "noon").when(n % 103 == 0, "-5").otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        F.when(n % 107 == 0, "1.5").when(n % 109 == 0, "-4").otherwise(F.col("user_a").cast("string")).alias("user_a"),
        F.when(n % 113 == 0, "-3").otherwise(F.col("user_b").cast("string")).alias("user_b"), F.col("rssi").cast("string").alias("rssi"))


@query
def validate_rows(c: Context):
    return readers.validate_rows(_faulty(c), "bluetooth", "event_id")


@query
def classify_rows(c: Context):
    return catalog.classify_rows(_faulty(c).join(c.raw.select("event_id", "dataset_id").distinct(), "event_id"))


@query
def source_profile(c: Context):
    return readers.source_profile(c.raw)


@query
def probe_source(c: Context):
    lines = _triplet_lines(c).withColumn("at", F.format_string("%015d-%02d-%010d-%010d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return readers.probe(lines, "at")


# ---- cleaning --------------------------------------------------------------------------------

@query
def canonical_contacts(c: Context):
    return c.canonical.select("timestamp", *PAIR, "rssi")


@query
def classed_contacts(c: Context):
    rows = readers.cast_rows(readers.parse_fields(derived.proximity_lines(c.table("lineitem")), readers.SCHEMAS["proximity"]), "proximity")
    return clean.dedup_contacts(clean.canonical_contacts(rows)).drop("rssi")


@query
def dedup_contacts(c: Context):
    return c.contacts.select("timestamp", *PAIR, "rssi")


@query
def observations(c: Context):
    return c.seen


@query
def contact_only_observations(c: Context):
    rows = readers.cast_rows(readers.parse_fields(derived.proximity_lines(c.table("lineitem")), readers.SCHEMAS["proximity"]), "proximity")
    blind = type(c.policy)(scan_coverage_available=False)
    return clean.observations(rows, blind).select("timestamp", "user_id", F.col("scan_observed").isNull().alias("unknown"))


@query
def relative_time(c: Context):
    rows = readers.cast_rows(readers.parse_fields(derived.proximity_lines(c.table("lineitem")), readers.SCHEMAS["proximity"]), "proximity")
    return clean.relative_time(rows).select("timestamp", "source_timestamp", "user_a", "user_b")


@query
def participants(c: Context):
    return c.people


@query
def daily_coverage(c: Context):
    return c.coverage


@query
def quality_report(c: Context):
    return clean.quality_report(c.raw, c.contacts, c.seen, c.people)


@query
def daily_contacts(c: Context):
    return clean.daily_contacts(c.contacts)


@query
def duplicate_counts(c: Context):
    return clean.duplicate_counts(c.catalog)


@query
def unique_contacts(c: Context):
    return c.unique


@query
def namespace_violations(c: Context):
    return clean.namespace_violations(c.catalog)


@query
def rssi_anomalies(c: Context):
    return clean.rssi_anomalies(c.contacts)


# ---- snapshots, candidates, labels -------------------------------------------------------------

def _label_int(frame: DataFrame) -> DataFrame:
    return frame.withColumn("label_24h", F.col("label_24h").cast("int"))


@query
def snapshots(c: Context):
    return pit.snapshots(c.spark, c.span)


@query
def complete_times(c: Context):
    return pit.complete_times(c.spark, c.span, c.policy.windows)


@query
def snapshot_capacity(c: Context):
    return pit.snapshot_capacity(c.spark, c.span)


@query
def known_pairs(c: Context):
    return c.timed(c.known_keys)


@query
def candidates_1d(c: Context):
    return c.timed(c.recent_keys)


@query
def candidates_7d(c: Context):
    return c.timed(pit.candidates(c.pairs, c.span, 7))


@query
def future_positives(c: Context):
    return c.timed(c.positives)


@query
def future_coverage(c: Context):
    return c.future_coverage.select(snapshot_time("day", c.policy).alias("timestamp"), "user_id", "bins", "coverage")


@query
def labels_24h(c: Context):
    return _label_int(c.labels)


@query
def label_funnel(c: Context):
    return pit.label_funnel(c.labels)


@query
def reveal_outcomes(c: Context):
    return _label_int(pit.reveal_outcomes(c.reveal_keys, c.contacts, c.seen, c.span))


@query
def backtest_outcomes(c: Context):
    return pit.backtest_outcomes(c.reveal_keys, c.contacts, c.seen, c.span)


@query
def coverage_sensitivity(c: Context):
    return pit.coverage_sensitivity(c.labels, (1 / 288, 2 / 288, 4 / 288))


@query
def candidate_expansion(c: Context):
    return pit.candidate_expansion(c.timed(c.recent_keys), c.timed(pit.candidates(c.pairs, c.span, 7)), c.labels)


# ---- history features --------------------------------------------------------------------------

def _history(c: Context, windows=(1, 3, 7, 14)):
    return c.timed(fe.pair_history(c.pairs, c.known_keys, windows))


@query
def contact_counts(c: Context):
    return _history(c).select(*KEY, *[F.col(f"contacts_{w}").alias(f"contact_count_{w}d") for w in (1, 3, 7, 14)])


@query
def contact_bins(c: Context):
    return _history(c).select(*KEY, *[F.col(f"bins_{w}").alias(f"contact_bins_{w}d") for w in (1, 7)])


@query
def contact_days(c: Context):
    return _history(c).select(*KEY, *[F.col(f"days_{w}").cast("long").alias(f"contact_days_{w}d") for w in (1, 3, 7, 14)])


@query
def asof_last_contact(c: Context):
    return _history(c).select(*KEY, (F.col("timestamp") - F.col("last_ever")).alias("time_since_last_contact"))


@query
def recency(c: Context):
    return _history(c).select(*KEY, *[(F.col("timestamp") - F.col(f"last_{w}")).alias(f"recency_{w}d") for w in (1, 3, 7)])


@query
def rssi_stats(c: Context):
    mean = F.when(F.col("rssi_n_7") > 0, F.col("rssi_sum_7") / F.col("rssi_n_7"))
    return _history(c).select(*KEY, mean.alias("rssi_mean_7d"), F.col("rssi_max_7").alias("rssi_max_7d"))


def _users(c: Context):
    return c.user_days.withColumn("timestamp", snapshot_time("day", c.policy))


@query
def activity(c: Context):
    return _users(c).where("activity_7 > 0").select("timestamp", "user_id", *[F.col(f"activity_{w}").alias(f"activity_{w}d") for w in (1, 3, 7)])


@query
def degree(c: Context):
    return _users(c).where("degree_7 > 0").select("timestamp", "user_id", *[F.col(f"degree_{w}").alias(f"degree_{w}d") for w in (1, 3, 7)])


@query
def common_neighbours(c: Context):
    edges = fe.window_edges(c.pairs, c.span, c.policy.windows)
    return c.timed(fe.common_neighbours(c.recent_keys, edges, c.user_days, c.policy.windows)).select(*KEY, "window_days", "common_neighbors")


@query
def history_coverage(c: Context):
    return _users(c).where("scans_7 > 0").select("timestamp", "user_id", *[
        (F.col(f"scans_{w}") / (w * c.policy.expected_bins)).alias(f"coverage_{w}d") for w in (1, 3, 7)])


@query
def contact_probability(c: Context):
    return c.bounded(c.recent_keys, neighbours=False).select(*KEY, "window_days", "historical_contact_probability")


@query
def observed_days(c: Context):
    return c.bounded(c.recent_keys, neighbours=False).select(*KEY, "window_days", "observed_history_days")


@query
def time_context(c: Context):
    dated = type(c.policy)(min_scan_coverage=c.policy.min_scan_coverage, weekday_origin=0)
    return fe.time_context(c.timed(c.recent_keys), dated)


@query
def history_complete(c: Context):
    return fe.history_complete(c.timed(c.recent_keys), c.span, (1, 3, 7, 14))


@query
def feature_bank_14d(c: Context):
    return c.bank


@query
def feature_bank_bounded(c: Context):
    return c.bounded(c.recent_keys)


@query
def feature_window_view(c: Context):
    return fe.feature_window_view(c.bank, 7)


@query
def pair_trend(c: Context):
    return fe.pair_trend(c.timed(c.recent_keys), c.contacts, c.policy, 7)


# ---- joins and integrity -----------------------------------------------------------------------

@query
def one_to_one_join(c: Context):
    return integrity.one_to_one_join(c.timed(pit.candidates(c.pairs, c.span, 7)), c.timed(c.positives))


@query
def missing_scores(c: Context):
    return integrity.missing_scores(c.timed(c.positives), c.timed(c.recent_keys))


@query
def semi_filter(c: Context):
    return integrity.semi_filter(c.timed(c.positives), c.timed(c.recent_keys), KEY)


@query
def pool_sets(c: Context):
    return retrieval.pool_sets(c.retrieval_scores, c.unique, c.policy)


@query
def key_violations(c: Context):
    odd = c.labels.unionByName(c.labels.where("user_min = 0")).withColumn(
        "user_max", F.when(F.col("user_max") == 7, F.col("user_min")).otherwise(F.col("user_max")))
    return integrity.key_violations(odd)


@query
def cohort_reconcile(c: Context):
    reveal = pit.reveal_outcomes(c.recent_keys, c.contacts, c.seen, c.span)
    return integrity.cohort_reconcile(reveal, c.cohort)


@query
def table_diff(c: Context):
    rows = c.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_linenumber").alias("lines"), F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))
    changed = rows.withColumn("quantity", F.when(F.col("l_orderkey") % 13 == 0, F.col("quantity") + 1e-3).otherwise(F.col("quantity"))).withColumn(
        "lines", F.when(F.col("l_partkey") % 17 == 0, F.col("lines") + 1).otherwise(F.col("lines")))
    return integrity.table_diff(rows.where("l_orderkey % 50 <> 0"), changed.where("l_partkey % 50 <> 0"), ["l_orderkey", "l_partkey"],
                                ["lines"], ["quantity", "discount"])


@query
def fingerprint(c: Context):
    return integrity.fingerprint(c.labels, [*KEY, "label_24h"])


@query
def identity_checks(c: Context):
    rows = retrieval.retrieval_aggregate(c.retrieval_metrics, c.policy)
    n, total, pool = F.col("candidate_count"), F.col("future_observed_positive_pairs"), F.col("future_positive_pairs_in_candidate_pool")
    hits = F.col("observed_positive_hits_at_k")
    return integrity.identity_checks(rows, {
        "candidates_partition": n == pool + F.col("unknown_candidate_count"),
        "positives_partition": total == pool + F.col("future_positive_pairs_outside_candidate_pool"),
        "hits_bounded": (hits <= F.least(pool, F.col("actual_k"))) & (F.col("actual_k") <= F.least(n, F.col("k") * F.col("eligible_prediction_times"))),
        "capture_ratio": integrity.close_to(F.col("observed_positive_capture_at_k"), F.when(pool > 0, hits / pool)),
        "reach_ratio": integrity.close_to(F.col("candidate_reach_of_observed_positives"), F.when(total > 0, pool / total))})


# ---- cohorts, splits, folds --------------------------------------------------------------------

@query
def training_cohort(c: Context):
    return _label_int(splits.training_cohort(c.labels, c.bank)).select(*KEY, "label_24h", "contact_count_7d", "historical_contact_probability")


@query
def chrono_split(c: Context):
    return splits.chrono_split(c.cohort, c.policy).select(*KEY, "split")


@query
def validation_partition(c: Context):
    plan = splits.split_plan(splits.time_counts(c.cohort), c.policy.fractions)
    return splits.validation_plan(plan)


@query
def common_cohort(c: Context):
    return _label_int(c.cohort)


@query
def cohort_funnel(c: Context):
    return splits.cohort_funnel(c.labels, c.timed(c.recent_keys), c.span)


@query
def split_support(c: Context):
    return splits.split_support(c.cohort, c.policy)


@query
def purged_by_day(c: Context):
    return splits.purged_by_day(c.cohort, c.policy)


@query
def forward_folds(c: Context):
    return splits.forward_folds(c.cohort, c.policy, (10, 16, 19, 22))


@query
def rolling_folds(c: Context):
    return splits.rolling_folds(c.cohort, c.policy)


SALTS = ("s1", "s2", "s3", "s4", "s5")


@query
def participant_groups(c: Context):
    people = c.people.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in SALTS])))
    return people.select("salt", "user_id", splits.participant_group(F.col("user_id"), F.col("salt"), "scans").alias("side"))


@query
def holdout_gate(c: Context):
    return splits.holdout_gate(c.cohort, c.policy, SALTS, "scans")


@query
def feasibility(c: Context):
    return splits.feasibility(c.cohort, c.policy)


# ---- graphs ------------------------------------------------------------------------------------

@query
def historical_edges(c: Context):
    return graph.historical_edges(c.pairs, c.span, 7)


@query
def historical_nodes(c: Context):
    return graph.historical_nodes(graph.historical_edges(c.pairs, c.span, 7))


@query
def network_density(c: Context):
    return graph.network_density(graph.historical_edges(c.pairs, c.span, 3))


@query
def source_densities(c: Context):
    return retrieval.network_densities(c.unique, c.policy)


FOCUS = 5


@query
def bounded_subgraph_nodes(c: Context):
    return graph.bounded_subgraph(graph.historical_edges(c.pairs, c.span, 7), FOCUS, 12, 20)[0]


@query
def bounded_subgraph_edges(c: Context):
    return graph.bounded_subgraph(graph.historical_edges(c.pairs, c.span, 7), FOCUS, 12, 20)[1]


@query
def network_summary(c: Context):
    return graph.network_summary(c.unique)


@query
def components(c: Context):
    return graph.component_sizes(graph.components(graph.pair_records(c.unique)))


@query
def degree_histogram(c: Context):
    return graph.histogram(graph.degrees(graph.pair_records(c.unique)), "degree", graph.DEGREE_BINS)


@query
def pair_histogram(c: Context):
    return graph.histogram(graph.pair_records(c.unique), "records", graph.PAIR_BINS)


@query
def daily_repeat_pairs(c: Context):
    return graph.daily_repeat_pairs(c.unique)


@query
def repeated_pairs(c: Context):
    return graph.repeated_pairs(c.unique)


# ---- retrieval ---------------------------------------------------------------------------------

@query
def retrieval_scores(c: Context):
    return c.retrieval_scores


@query
def rank_scores(c: Context):
    return retrieval.rank_scores(c.retrieval_scores)


@query
def retrieval_metrics(c: Context):
    return c.retrieval_metrics


@query
def retrieval_aggregate(c: Context):
    return retrieval.retrieval_aggregate(c.retrieval_metrics, c.policy)


@query
def suppressed_retrieval(c: Context):
    rows = retrieval.retrieval_aggregate(c.retrieval_metrics, c.policy)
    ratios = ["observed_positive_capture_at_k", "observed_positive_capture_all_at_k", "candidate_reach_of_observed_positives", "actual_k"]
    return disclosure.suppress_family(rows, retrieval.COUNTS, ratios, 60)


@query
def retrieval_feasibility(c: Context):
    return retrieval.retrieval_feasibility(c.retrieval_metrics, c.unique, c.policy)


# ---- scores and metrics ------------------------------------------------------------------------

def _model(c: Context, name: str):
    return c.predictions.where(F.col("model") == name).select(*KEY, "label", "window_days", "p", "threshold")


@query
def score_constant(c: Context):
    return _model(c, "constant")


@query
def score_frequency(c: Context):
    return _model(c, "historical_frequency")


@query
def score_time_rule(c: Context):
    return _model(c, "time_rule")


@query
def prediction_entropy(c: Context):
    return c.predictions.select(*KEY, *MODEL, m.prediction_entropy(F.col("p")).alias("prediction_entropy"))


@query
def scorecard(c: Context):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda value, names: F.element_at(F.array(*[F.lit(x) for x in names]), (value + 1).cast("int"))
    answers = c.table("customer").select(
        k.alias("id"), F.when(k % 19 != 0, F.col("c_mktsegment")).alias("relationship"),
        pick(n % 6, ("same_area", "walkable", "city_far", "different_city", "unknown", None)).alias("distance"),
        pick(k % 6, ("zero", "one_two", "three_five", "six_plus", "unknown", None)).alias("frequency"),
        pick((k + n) % 7, ("day", "week", "month", "older", "never", "unknown", None)).alias("recency"),
        pick(F.floor(k / 3) % 5, ("often", "sometimes", "rare", "unknown", None)).alias("area"),
        pick(F.floor(k / 5) % 6, ("often", "sometimes", "different", "unknown", "weekly", None)).alias("timing"),
        pick(F.floor(k / 2) % 7, ("no", "no", "no", "no", "yes", "unknown", None)).alias("arrangement"))
    return card.scorecard(answers).select("id", "status", "known_factors", "score", "level")


@query
def impute_features(c: Context):
    bank = c.bounded(c.recent_keys, neighbours=False).where("window_days = 7")
    plan = splits.split_plan(splits.time_counts(c.cohort), c.policy.fractions)
    train = c.cohort.join(plan.where("split = 'train'"), "timestamp", "left_semi").select(*KEY).join(bank, KEY)
    names = ["rssi_mean", "historical_contact_probability", "recency_seconds", "observed_history_days"]
    tall = staged(train.select(*names), "train-features").select(
        F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("value")) for x in names])))
    median = m.exact_quantiles(tall, ["feature"], "value", {"median": 0.5})
    facts = tall.groupBy("feature").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"),
                                        F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return facts.join(median, "feature")


@query
def average_precision(c: Context):
    return m.average_precision(c.predictions, MODEL)


@query
def roc_auc(c: Context):
    return m.roc_auc(c.predictions, MODEL)


@query
def brier_logloss(c: Context):
    return m.brier_logloss(c.predictions, MODEL)


@query
def threshold_metrics(c: Context):
    return m.threshold_metrics(c.predictions, MODEL)


@query
def best_threshold(c: Context):
    return m.best_threshold(c.predictions, MODEL)


@query
def pr_curve(c: Context):
    return m.pr_curve(c.predictions, MODEL)


@query
def roc_curve(c: Context):
    return m.roc_curve(c.predictions, MODEL)


@query
def confusion(c: Context):
    return m.confusion(c.predictions, MODEL)


@query
def reliability(c: Context):
    return m.reliability(c.predictions, MODEL)


@query
def ece(c: Context):
    return m.ece(c.predictions, MODEL)


@query
def error_counts(c: Context):
    return m.error_counts(c.predictions, MODEL)


@query
def error_rows(c: Context):
    return m.error_rows(c.predictions).select(*KEY, *MODEL, "label", "p", "threshold", "high_confidence")


@query
def ranking_metrics(c: Context):
    return m.ranking_metrics(c.predictions, MODEL, c.policy.ranking_k)


@query
def frequency_groups(c: Context):
    counts = c.bounded(c.recent_keys, (7,), neighbours=False).select(*KEY, F.col("pair_contact_count").alias("n7"))
    n = F.col("n7")
    group = (F.when(n.isNull(), "unknown").when(n <= 1, "0–1").when(n <= 5, "2–5").when(n <= 20, "6–20").otherwise(">20"))
    rows = c.predictions.join(counts, KEY).withColumn("history_group", group)
    return m.binary_metrics(rows, [*MODEL, "history_group"])


@query
def sensitivity_table(c: Context):
    facts = c.bounded(c.recent_keys, (1,), neighbours=False).select(
        *KEY, "pair_contact_bins", F.least("scan_coverage_a", "scan_coverage_b").alias("least_coverage"))
    return audit.sensitivity_table(c.predictions.join(facts, KEY), MODEL, "pair_contact_bins", "least_coverage")


@query
def rolling_summary(c: Context):
    return rolling.rolling_summary(c.predictions, c.policy)


@query
def per_day_metrics(c: Context):
    return rolling.per_day_metrics(c.predictions)


@query
def model_contrast(c: Context):
    return rolling.model_contrast(c.predictions, c.policy.contrasts)


@query
def model_comparison(c: Context):
    pooled = m.binary_metrics(c.predictions, MODEL)
    docs = c.table("labels").select(F.lit("toxicity").alias("model"), F.lit(0).alias("window_days"), F.col("toxic").alias("label"),
                                    (1 - F.col("quality") * 0.9).alias("p"))
    return rolling.model_comparison({"rolling": pooled, "documents": m.brier_logloss(docs, MODEL)}, baselines.BASELINES)


@query
def paired_deltas(c: Context):
    return uncertainty.paired_deltas(c.predictions, c.policy.contrasts)


@query
def block_bootstrap(c: Context):
    return uncertainty.block_bootstrap(c.predictions, c.policy.contrasts, c.policy)


def _day_table(c: Context):
    return rolling.day_table(c.predictions, c.scored_cohort.where("window_days = 7"))


@query
def day_table(c: Context):
    return _day_table(c)


@query
def spearman(c: Context):
    table = _day_table(c).where("model <> 'constant'")
    # Averages are rounded first: two engines may add them in another order and split a tie.
    return rolling.day_correlations(m.rounded(table))


# ---- audit -------------------------------------------------------------------------------------

@query
def deadline_gate(c: Context):
    return audit.deadline_gate(c.timed(c.recent_keys), audit.contract(c))


@query
def asof_available(c: Context):
    return audit.availability(audit.audit_bank(c))


@query
def population_bias(c: Context):
    return audit.population_bias(audit.audit_samples(c))


@query
def daily_funnel(c: Context):
    return audit.daily_funnel(audit.audit_samples(c))


@query
def scoped_metrics(c: Context):
    return audit.scoped_metrics(audit.audit_predictions(c))


@query
def probability_quantiles(c: Context):
    return audit.probability_quantiles(audit.audit_predictions(c))


@query
def freshness_gate(c: Context):
    return freshness.freshness_gate(c.recent_keys, c.seen, c.policy, 3600)


# ---- exploration, disclosure, catalogue ----------------------------------------------------------

def _days(c: Context):
    first, last = c.span.scheduled
    return first + 1, last + 1


@query
def daily_trend(c: Context):
    return explore.daily_trend(explore.scope(c.contacts, users=(0, 3)), _days(c))


@query
def hourly_trend(c: Context):
    return explore.hourly_trend(c.contacts)


@query
def pair_frequency(c: Context):
    return explore.pair_frequency(c.contacts)


@query
def activity_topn(c: Context):
    return explore.activity_topn(c.contacts)


@query
def contact_matrix(c: Context):
    return explore.contact_matrix(c.contacts)


@query
def rssi_histogram(c: Context):
    return explore.rssi_histogram(c.contacts, explore.scope(c.contacts, days=(1, 14)))


@query
def coverage_trend(c: Context):
    return explore.coverage_trend(c.coverage)


@query
def overview(c: Context):
    return explore.overview(c.contacts, c.people, c.labels, c.span)


@query
def highlights(c: Context):
    days = disclosure.suppress_cells(graph.daily_repeat_pairs(c.unique), ["records"], c.policy.small_group)
    return explore.highlights(days, "dataset_id", "study_day", "records")


@query
def pair_cases(c: Context):
    outcomes = pit.backtest_outcomes(c.known_keys, c.contacts, c.seen, c.span)
    return explore.pair_cases(c.timed(c.recent_keys), c.bank, outcomes, 7)


@query
def suppressed_histogram(c: Context):
    bins = graph.histogram(graph.degrees(graph.pair_records(c.unique)), "degree", graph.DEGREE_BINS)
    return disclosure.suppressed_histogram(bins, "dataset_id", c.policy.small_group)


@query
def suppressed_days(c: Context):
    return disclosure.suppress_cells(graph.daily_repeat_pairs(c.unique), ["records", "active_pairs", "previous_day_repeated_pairs"], c.policy.small_group)


@query
def reference_table(c: Context):
    return disclosure.reference_table(c.labels, c.bank, c.policy)


@query
def reference_lookup(c: Context):
    k = F.col("c_custkey")
    pick = lambda value, names: F.element_at(F.array(*[F.lit(x) for x in names]), (value + 1).cast("int"))
    answers = c.table("customer").select(k.alias("id"), pick(k % 4, ("day", "week", "month", "older")).alias("recency"),
                                         pick(F.floor(k / 4) % 5, ("zero", "one_two", "three_five", "six_plus", "unknown")).alias("frequency"))
    return disclosure.reference_lookup(answers, disclosure.reference_table(c.labels, c.bank, c.policy))


def _catalog(c: Context):
    ship = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1995-01-01 00:00:00', l_shipdate)") + F.col("l_linenumber") * 20
    order = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1992-01-01 00:00:00', o_orderdate)")
    return catalog.catalog_scan({
        "scans": c.raw, "shipments": c.table("lineitem").select(ship.alias("timestamp"), F.col("l_partkey").alias("user_a"), F.col("l_suppkey").alias("user_b")),
        "orders": c.table("orders").select(order.alias("timestamp"), F.col("o_custkey").alias("user_a"), (F.col("o_orderkey") % 1500).alias("user_b"))})


@query
def catalog_scan(c: Context):
    return catalog.classify_rows(_catalog(c))


@query
def dataset_manifest(c: Context):
    return catalog.dataset_manifest(catalog.catalog_contacts(_catalog(c)))


@query
def dataset_days(c: Context):
    return catalog.dataset_days(catalog.catalog_contacts(_catalog(c)))


def _capacity(c: Context):
    return catalog.calendar_capacity(clean.unique_contacts(catalog.catalog_contacts(_catalog(c))), c.policy)


@query
def calendar_capacity(c: Context):
    return _capacity(c)


@query
def eligibility(c: Context):
    support = c.spark.createDataFrame([("scans", True, True, True), ("shipments", True, False, False), ("orders", False, False, False)],
                                      "dataset_id string, unit_verified boolean, coverage_supported boolean, coverage_checked boolean")
    return catalog.eligibility(catalog.dataset_manifest(catalog.catalog_contacts(_catalog(c))), _capacity(c), support)


@query
def diagnosis(c: Context):
    """From raw rows to split sizes in one long table."""
    report = clean.quality_report(c.raw, c.contacts, c.seen, c.people)
    names = ["input_rows", "invalid_id_rows", "self_contact_rows", "empty_scan_rows", "external_device_rows", "duplicate_contact_rows", "contact_rows", "participants"]
    raw = report.select(F.inline(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("long").alias("value")) for x in names])))
    label = F.col("label_24h")
    known = c.labels.agg(F.array(*[F.struct(F.lit(x).alias("measure"), value.cast("long").alias("value")) for x, value in (
        ("candidate_rows", F.count("*")), ("positive_labels", F.count_if(label == 1)), ("negative_labels", F.count_if(label == 0)),
        ("unknown_labels", F.count_if(label.isNull())), ("eligible_samples", F.count_if("eligible_for_evaluation")))]).alias("r")).select(F.inline("r"))
    sets = splits.chrono_split(c.cohort, c.policy).groupBy(F.concat(F.lit("split_"), F.col("split")).alias("measure")).agg(F.count("*").alias("value"))
    return raw.unionByName(known).unionByName(sets)


# ---- self-exciting forecasts ---------------------------------------------------------------------

def _cohort_events(c: Context):
    return hawkes.pair_events(c.contacts, c.policy).join(c.cohort_keys, ["day", *PAIR], "left_semi")


@query
def hawkes_excitation(c: Context):
    return hawkes.hawkes_excitation(_cohort_events(c), c.policy, c.policy.half_life_hours)


@query
def hawkes_forecast(c: Context):
    return hawkes.hawkes_forecast(_cohort_events(c), c.policy, c.policy.half_life_hours)


@query
def hawkes_short(c: Context):
    """The wider grid of half-lives, from five minutes to a day."""
    return hawkes.hawkes_forecast(_cohort_events(c), c.policy, tuple(x / 60 for x in c.policy.short_half_life_minutes))


def _load_trained() -> None:
    import queries.trained  # noqa: F401  (registers the trained-model queries)


_load_trained()
