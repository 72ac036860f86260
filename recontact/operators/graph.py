"""Contact graphs as edge and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recontact.functions.timemath import Span, floor_div, snapshot_time
from recontact.operators.clean import PAIR
from recontact.policy import DAY
from recontact.session import checkpointed


def both_ends(edges: DataFrame, *columns: str) -> DataFrame:
    """One row per end: user_id, neighbour and the named columns."""
    ends = F.array(F.struct(F.col("user_min").alias("user_id"), F.col("user_max").alias("neighbour")),
                   F.struct(F.col("user_max").alias("user_id"), F.col("user_min").alias("neighbour")))
    return edges.select(F.inline(ends), *columns)


def historical_edges(pairs: DataFrame, span: Span, window_days: int) -> DataFrame:
    """Edge weight and last contact of ``[t-w, t)`` at every complete snapshot."""
    spread = pairs.select(F.explode(F.sequence("day", F.col("day") + window_days - 1)).alias("day"), *PAIR, "contacts", "last_contact")
    kept = spread.where(F.col("day").between(span.first_snapshot, span.last_snapshot))
    return kept.groupBy(snapshot_time("day", span.policy).alias("timestamp"), *PAIR).agg(
        F.sum("contacts").alias("weight"), F.max("last_contact").alias("last_contact"))


def historical_nodes(edges: DataFrame) -> DataFrame:
    return both_ends(edges, "timestamp", "weight", "last_contact").groupBy("timestamp", "user_id").agg(
        F.sum("weight").alias("activity"), F.count("*").alias("historical_degree"), F.max("last_contact").alias("last_contact"))


def network_density(edges: DataFrame) -> DataFrame:
    nodes = historical_nodes(edges).groupBy("timestamp").agg(F.count("*").alias("nodes"), F.sum("historical_degree").alias("ends"))
    n = F.col("nodes")
    return nodes.select("timestamp", "nodes", (F.col("ends") / 2).cast("long").alias("edges"),
                        F.when(n > 1, F.col("ends") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"))


def bounded_subgraph(edges: DataFrame, focus: int, max_nodes: int = 30, max_edges: int = 100) -> tuple[DataFrame, DataFrame]:
    """Per snapshot: the most active nodes with the focus and its strongest neighbour kept in,
    and the heaviest edges among them with at least one focus edge when there is one."""
    if not 2 <= max_nodes <= 100 or not 1 <= max_edges <= 300:
        raise ValueError("a bounded subgraph has 2..100 nodes and 1..300 edges")
    nodes = historical_nodes(edges)
    own = both_ends(edges.where((F.col("user_min") == focus) | (F.col("user_max") == focus)), "timestamp", "weight").where(F.col("user_id") == focus)
    strongest = own.groupBy("timestamp").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), F.col("neighbour")))["neighbour"].alias("strongest"))
    required = (F.col("user_id") == focus) | F.coalesce(F.col("user_id") == F.col("strongest"), F.lit(False))
    order = Window.partitionBy("timestamp").orderBy(F.col("required").desc(), F.col("activity").desc(), "user_id")
    picked = (nodes.join(strongest, "timestamp", "left").withColumn("required", required)
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_nodes)
              .select("timestamp", "user_id", "activity", "historical_degree", "last_contact"))
    inside = edges
    for end in PAIR:
        inside = inside.join(picked.select("timestamp", F.col("user_id").alias(end)), ["timestamp", end], "left_semi")
    # At most 100 nodes and so 4,950 edges per snapshot from here on.
    is_focus = (F.col("user_min") == focus) | (F.col("user_max") == focus)
    heaviest = Window.partitionBy("timestamp").orderBy(F.col("weight").desc(), "user_min", "user_max")
    neighbour = F.when(F.col("user_min") == focus, F.col("user_max")).otherwise(F.col("user_min"))
    best = Window.partitionBy("timestamp", "is_focus").orderBy(F.col("weight").desc(), neighbour)
    whole = Window.partitionBy("timestamp")
    ranked = (inside.withColumn("is_focus", is_focus).withColumn("place", F.row_number().over(heaviest))
              .withColumn("focus_place", F.when(F.col("is_focus"), F.row_number().over(best)))
              .withColumn("first_focus", F.min(F.when(F.col("is_focus"), F.col("place"))).over(whole)))
    shown_anyway = F.coalesce(F.col("first_focus") <= max_edges, F.lit(True))
    keep = ((F.col("place") < max_edges) | ((F.col("place") == max_edges) & shown_anyway)
            | (~shown_anyway & F.coalesce(F.col("focus_place") == 1, F.lit(False))))
    return picked, ranked.where(keep).select("timestamp", *PAIR, "weight", "last_contact")


def pair_records(unique: DataFrame) -> DataFrame:
    """Distinct edges of the whole archived graph with their number of unique records."""
    return unique.groupBy("dataset_id", *PAIR).agg(F.count("*").alias("records"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ends(edges, "dataset_id").groupBy("dataset_id", "user_id").agg(F.count("*").alias("degree"))


def network_summary(unique: DataFrame) -> DataFrame:
    edges = pair_records(unique)
    totals = edges.groupBy("dataset_id").agg(F.count("*").alias("edges"), F.sum("records").alias("unique_contact_records"))
    nodes = degrees(edges).groupBy("dataset_id").agg(F.count("*").alias("nodes"))
    n, e = F.col("nodes"), F.col("edges")
    return totals.join(nodes, "dataset_id").select(
        "dataset_id", "nodes", "edges", "unique_contact_records",
        F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"), (2 * e / n).alias("mean_degree"))


def components(edges: DataFrame, every: int = 3, limit: int = 60) -> DataFrame:
    """dataset_id, user_id, component (smallest id), by alternating star contraction.

    Each round links every node's larger neighbours to the smallest one around it, then its
    smaller neighbours likewise. Trees halve in depth, so rounds grow with log(nodes). A hub is
    reduced by a partial minimum before the exchange. Rounds are cut by reliable checkpoints.
    """
    key = ["dataset_id", "u"]
    links = edges.select("dataset_id", F.col("user_max").alias("u"), F.col("user_min").alias("v")).distinct()

    def large_star(current: DataFrame) -> DataFrame:
        both = current.select("dataset_id", F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy(*key).agg(F.least(F.min("v"), F.col("u")).alias("low"))
        return (both.where("v > u").join(low, key).select("dataset_id", F.col("v").alias("u"), F.col("low").alias("v"))
                .where("u <> v").distinct())

    def small_star(current: DataFrame) -> DataFrame:
        low = current.groupBy(*key).agg(F.min("v").alias("low"))
        moved = current.join(low, key).where("v <> low").select("dataset_id", F.col("v").alias("u"), F.col("low").alias("v"))
        return moved.unionByName(low.select(*key, F.col("low").alias("v"))).distinct()

    def signature(current: DataFrame):
        return current.agg(F.count("*"), F.sum(F.xxhash64("dataset_id", "u", "v").cast("decimal(38,0)"))).first()

    state, before = checkpointed(links), None
    for _ in range(limit):
        state = checkpointed(small_star(large_star(state)))
        now = signature(state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = state.select("dataset_id", F.col("v").alias("user_id")).distinct().withColumn("component", F.col("user_id"))
    return state.select("dataset_id", F.col("u").alias("user_id"), F.col("v").alias("component")).unionByName(roots)


def component_sizes(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("dataset_id", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("dataset_id").agg(F.count("*").alias("components"), F.max("n").alias("largest_component_nodes"))


# Histogram edges of the published tables (fixed values).
DEGREE_BINS = ((0, 5, "0–5"), (6, 20, "6–20"), (21, 50, "21–50"), (51, None, ">50"))
PAIR_BINS = ((1, 5, "1–5"), (6, 20, "6–20"), (21, 100, "21–100"), (101, None, ">100"))


def _bin(value: Column, bins) -> Column:
    chosen = None
    for low, high, name in bins:
        test = (value >= low) if high is None else value.between(low, high)
        chosen = F.when(test, F.lit(name)) if chosen is None else chosen.when(test, F.lit(name))
    return chosen


def histogram(values: DataFrame, column: str, bins) -> DataFrame:
    return values.groupBy("dataset_id", _bin(F.col(column), bins).alias("bin")).agg(F.count("*").alias("count"))


def daily_pairs(unique: DataFrame) -> DataFrame:
    return unique.groupBy("dataset_id", floor_div("timestamp", DAY).alias("d"), *PAIR).agg(F.count("*").alias("records"))


def daily_repeat_pairs(unique: DataFrame) -> DataFrame:
    """Per source and study day: records, active pairs and pairs also active the day before."""
    pairs = daily_pairs(unique)
    order = Window.partitionBy("dataset_id", *PAIR).orderBy("d")
    marked = pairs.withColumn("repeated", F.coalesce(F.lag("d").over(order) == F.col("d") - 1, F.lit(False)))
    counted = marked.groupBy("dataset_id", "d").agg(
        F.sum("records").alias("records"), F.count("*").alias("active_pairs"), F.count_if("repeated").alias("previous_day_repeated_pairs"))
    ends = pairs.groupBy("dataset_id").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    spine = ends.withColumn("d", F.explode(F.sequence("first_day", "last_day")))
    dense = spine.join(counted, ["dataset_id", "d"], "left")
    return dense.select("dataset_id", (F.col("d") - F.col("first_day") + 1).alias("study_day"), *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "active_pairs", "previous_day_repeated_pairs")])


def repeated_pairs(unique: DataFrame) -> DataFrame:
    days = daily_pairs(unique).groupBy("dataset_id", *PAIR).agg(F.count("*").alias("days"))
    return days.groupBy("dataset_id").agg(F.count_if(F.col("days") >= 2).alias("pairs_active_on_multiple_days"))
