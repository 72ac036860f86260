"""Label-free rankings over several independent sources and their observed-positive metrics.

Everything is keyed by (dataset_id, timestamp, window_days, method[, k]); sources never mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recontact.functions.timemath import history_day, horizon_day, snapshot_time
from recontact.operators.clean import PAIR
from recontact.operators.features import expand_smaller_end
from recontact.operators.pointintime import nested_presence, presence
from recontact.policy import DAY, Policy
from recontact.session import checkpointed

SOURCE = ["dataset_id"]
METHODS = ("historical_frequency", "last_contact_recency", "common_neighbors")
SNAPSHOT = ["dataset_id", "timestamp", "window_days"]


def source_spans(unique: DataFrame, policy: Policy) -> DataFrame:
    """First/last second of each source and its range of complete snapshot days."""
    ends = unique.groupBy("dataset_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return ends.select("dataset_id", "first", "last",
                       F.ceil((F.col("first") - policy.offset) / DAY).alias("first_day"),
                       F.floor((F.col("last") - DAY - policy.offset) / DAY).alias("last_day"))


def source_windows(unique: DataFrame, policy: Policy) -> DataFrame:
    """dataset_id, window_days: every source beside every window, whatever its length."""
    return unique.select("dataset_id").distinct().select("dataset_id", F.explode(F.array(*[F.lit(w) for w in policy.windows])).alias("window_days"))


def source_times(unique: DataFrame, policy: Policy) -> DataFrame:
    """dataset_id, window_days, day: snapshots with full history and full horizon."""
    spread = source_spans(unique, policy).withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in policy.windows])))
    start = F.col("first_day") + F.col("window_days")
    return spread.where(start <= F.col("last_day")).select(
        "dataset_id", "window_days", F.explode(F.sequence(start, "last_day")).alias("day"))


def retrieval_scores(unique: DataFrame, policy: Policy) -> DataFrame:
    """Frequency, recency and common-neighbour scores of the 1-day candidates.

    ``unique`` already holds one row per source, second and pair.
    """
    windows = policy.windows
    pairs = unique.groupBy(*SOURCE, *PAIR, history_day("timestamp", policy).alias("day")).agg(
        F.count("*").alias("contacts"), F.max("timestamp").alias("last_contact"))
    candidate = pairs.select(*SOURCE, *PAIR, "day", "last_contact", *[
        F.sum("contacts").over(Window.partitionBy(*SOURCE, *PAIR).orderBy("day").rangeBetween(-(w - 1), 0)).alias(f"count_{w}") for w in windows])
    times = source_times(unique, policy)  # sources x windows x days rows
    days = times.select(*SOURCE, "day").distinct()
    asked = candidate.join(days, [*SOURCE, "day"], "left_semi")
    graph = nested_presence(pairs, windows, tuple(SOURCE)).join(days, [*SOURCE, "day"], "left_semi")
    by = [*SOURCE, "day"]
    shared = expand_smaller_end(asked.select(*by, *PAIR), graph, _degrees(graph, by), by, windows)
    rows = asked.join(shared, [*by, *PAIR], "left").select(*by, *PAIR, "last_contact", F.inline(F.array(*[
        F.struct(F.lit(w).alias("window_days"), F.col(f"count_{w}").alias("records"), F.col(f"common_{w}").alias("common_neighbors"))
        for w in windows]))).join(times, [*SOURCE, "window_days", "day"], "left_semi")
    t = snapshot_time("day", policy)
    return rows.select(*SOURCE, t.alias("timestamp"), "window_days", *PAIR,
                       (F.col("records") / F.col("window_days")).alias("historical_frequency"),
                       (F.col("last_contact") - t).cast("double").alias("last_contact_recency"),
                       F.coalesce("common_neighbors", F.lit(0)).cast("double").alias("common_neighbors"))


def _degrees(graph: DataFrame, by: list[str]) -> DataFrame:
    ends = graph.select(*by, F.explode(F.array(*PAIR)).alias("user_id"))
    return ends.groupBy(*by, "user_id").agg(F.count("*").alias("degree"))


def network_densities(unique: DataFrame, policy: Policy) -> DataFrame:
    """Nodes, edges and density of each source's window graph at each complete snapshot."""
    pairs = unique.select(*SOURCE, *PAIR, history_day("timestamp", policy).alias("day")).distinct()
    graph = presence(pairs, policy.windows, tuple(SOURCE)).join(
        source_times(unique, policy), [*SOURCE, "window_days", "day"], "left_semi")
    nodes = _degrees(graph, [*SOURCE, "window_days", "day"]).groupBy(*SOURCE, "window_days", "day").agg(F.count("*").alias("nodes"), F.sum("degree").alias("ends"))
    n = F.col("nodes")
    return nodes.select(*SOURCE, snapshot_time("day", policy).alias("timestamp"), "window_days", "nodes",
                        (F.col("ends") / 2).cast("long").alias("edges"),
                        F.when(n > 1, F.col("ends") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"))


def by_method(scores: DataFrame) -> DataFrame:
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in METHODS])
    return scores.select(*SNAPSHOT, *PAIR, F.inline(methods))


def rank_scores(scores: DataFrame) -> DataFrame:
    """Full order within each (source, snapshot, window, method): score desc, then pair.

    One range exchange sorts everything; a position is the row's place in its sorted partition
    plus the rows of the same list in earlier partitions. A list of any length is thus spread
    over many tasks. The sorted rows are checkpointed, so both uses see the same partitions.
    """
    tall = by_method(scores)
    checked = tall.withColumn("score", F.when(F.col("score").isNull(), F.raise_error(
        F.lit("scoring evidence is missing")).cast("double")).otherwise(F.col("score")))
    group = [*SNAPSHOT, "method"]
    order = [*group, F.col("score").desc(), *PAIR]
    ordered = checkpointed(checked.repartitionByRange(*order).sortWithinPartitions(*order)
                           .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    pieces = ordered.groupBy(*group, "part").agg(F.count("*").alias("rows"), F.min("place").alias("first_place"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*group, "part", "first_place", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return ordered.join(offsets, [*group, "part"]).select(
        *group, *PAIR, "score", (F.col("place") - F.col("first_place") + F.col("before") + 1).alias("rank"))


def top_ranked(scores: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every list; partitions keep only their own first ``k`` before the exchange."""
    order = Window.partitionBy(*SNAPSHOT, "method").orderBy(F.col("score").desc(), *PAIR)
    return by_method(scores).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def future_pairs(unique: DataFrame, policy: Policy) -> DataFrame:
    day = horizon_day("timestamp", policy)
    return unique.select(*SOURCE, day.alias("day"), *PAIR).distinct()


def retrieval_metrics(scores: DataFrame, unique: DataFrame, policy: Policy) -> DataFrame:
    """Hits, pool sizes and capture ratios per list and K; no negative labels are implied."""
    future = future_pairs(unique, policy)
    totals = future.groupBy(*SOURCE, "day").agg(F.count("*").alias("future_observed_positive_pairs"))
    day = ((F.col("timestamp") - policy.offset) / DAY).cast("long")
    keyed = scores.withColumn("day", day)
    hit = future.withColumn("hit", F.lit(1))
    pools = keyed.join(hit, [*SOURCE, "day", *PAIR], "left").groupBy(*SOURCE, "day", "window_days").agg(
        F.count("*").alias("candidate_count"), F.count("hit").alias("future_positive_pairs_in_candidate_pool"))
    top = top_ranked(scores, max(policy.retrieval_k)).withColumn("day", day).join(hit, [*SOURCE, "day", *PAIR], "left")
    hits = top.groupBy(*SOURCE, "day", "window_days", "method").agg(*[
        F.count(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"hits_{k}") for k in policy.retrieval_k])
    methods = F.array(*[F.lit(m) for m in METHODS])
    lists = (source_times(unique, policy).join(pools, [*SOURCE, "day", "window_days"], "left").join(totals, [*SOURCE, "day"], "left")
             .withColumn("method", F.explode(methods)).join(hits, [*SOURCE, "day", "window_days", "method"], "left").na.fill(0))
    rows = lists.select(*SOURCE, snapshot_time("day", policy).alias("timestamp"), "window_days", "method",
                        "candidate_count", "future_observed_positive_pairs", "future_positive_pairs_in_candidate_pool",
                        F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("observed_positive_hits_at_k"))
                                           for k in policy.retrieval_k])))
    n, total, pool = F.col("candidate_count"), F.col("future_observed_positive_pairs"), F.col("future_positive_pairs_in_candidate_pool")
    found = F.col("observed_positive_hits_at_k")
    return rows.withColumns({
        "actual_k": F.least(F.col("k").cast("long"), n),
        "future_positive_pairs_outside_candidate_pool": total - pool, "unknown_candidate_count": n - pool,
        "observed_positive_capture_at_k": F.when(pool > 0, found / pool),
        "observed_positive_capture_all_at_k": F.when(total > 0, found / total),
        "candidate_reach_of_observed_positives": F.when(total > 0, pool / total),
        "status": F.when(n == 0, "no_candidates").when(total == 0, "no_future_observed_positives")
        .when(pool == 0, "no_positive_in_candidate_pool").otherwise("observed_positive_retrieval")})


COUNTS = ["candidate_count", "future_observed_positive_pairs", "future_positive_pairs_in_candidate_pool",
          "future_positive_pairs_outside_candidate_pool", "observed_positive_hits_at_k", "unknown_candidate_count"]


def retrieval_aggregate(metrics: DataFrame, policy: Policy) -> DataFrame:
    """Ratios of sums over snapshots, for all complete times and for the common 7-day times."""
    widest = max(policy.windows)
    common = metrics.where(F.col("window_days") == widest).select("dataset_id", "timestamp").distinct()
    scoped = metrics.withColumn("scope", F.lit("per_window")).unionByName(
        metrics.join(common, ["dataset_id", "timestamp"], "left_semi").withColumn("scope", F.lit("common_7d")))
    pool = F.col("future_positive_pairs_in_candidate_pool")
    sums = scoped.groupBy("dataset_id", "scope", "window_days", "method", "k").agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "actual_k")],
        F.count("*").alias("eligible_prediction_times"),
        F.count_if(F.col("candidate_count") > 0).alias("nonempty_candidate_times"),
        F.count_if(pool > 0).alias("times_with_positive_pool"))
    total, found = F.col("future_observed_positive_pairs"), F.col("observed_positive_hits_at_k")
    return sums.withColumns({
        "observed_positive_capture_at_k": F.when(pool > 0, found / pool),
        "observed_positive_capture_all_at_k": F.when(total > 0, found / total),
        "candidate_reach_of_observed_positives": F.when(total > 0, pool / total),
        "evidence_status": F.when(F.col("times_with_positive_pool") < 3, "descriptive_only_insufficient_times").otherwise("descriptive_only")})


def retrieval_feasibility(metrics: DataFrame, unique: DataFrame, policy: Policy) -> DataFrame:
    """Complete, non-empty and positive-pool snapshot counts of every source and window, zero for sources too short for one."""
    pool = F.col("future_positive_pairs_in_candidate_pool")
    times = metrics.where((F.col("method") == METHODS[0]) & (F.col("k") == min(policy.retrieval_k)))
    counted = times.groupBy("dataset_id", "window_days").agg(
        F.count("*").alias("complete_prediction_times"), F.count_if(F.col("candidate_count") > 0).alias("nonempty_candidate_times"),
        F.count_if(pool > 0).alias("positive_pool_times"))
    dense = source_windows(unique, policy).join(counted, ["dataset_id", "window_days"], "left").na.fill(0)
    return dense.withColumn("status", F.when(F.col("positive_pool_times") >= 3, "positive_retrieval_ready").otherwise("insufficient_history"))


def pool_sets(scores: DataFrame, unique: DataFrame, policy: Policy) -> DataFrame:
    """Sizes of the intersection and both differences of candidate and positive pair sets."""
    candidate = scores.where(F.col("window_days") == 1).select(
        *SOURCE, ((F.col("timestamp") - policy.offset) / DAY).cast("long").alias("day"), *PAIR)
    times = source_times(unique, policy).where(F.col("window_days") == 1)
    positive = future_pairs(unique, policy).join(times, [*SOURCE, "day"], "left_semi")
    sets = {"both": candidate.intersect(positive), "candidate_only": candidate.exceptAll(positive), "positive_only": positive.exceptAll(candidate)}
    parts = [frame.groupBy("dataset_id").agg(F.count("*").alias("pairs")).withColumn("part", F.lit(name)) for name, frame in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
