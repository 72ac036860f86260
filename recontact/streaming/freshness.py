"""May a pair be scored now? Both ends need a recent observation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recontact.operators.clean import PAIR
from recontact.functions.timemath import snapshot_time
from recontact.operators.pointintime import attach_users
from recontact.policy import DAY, Policy


def check_age(max_age_seconds: int) -> None:
    if not 0 < max_age_seconds <= 3600:
        raise ValueError("the freshness limit is 1..3600 seconds")


def freshness_gate(keys: DataFrame, seen: DataFrame, policy: Policy, max_age_seconds: int = 600) -> DataFrame:
    """Batch form: age of each end's last observation in ``[t-1d, t)`` and the gate."""
    check_age(max_age_seconds)
    first = F.floor((F.col("timestamp") - policy.offset) / DAY).cast("long") + 1
    latest = (seen.where(F.col("scan_observed")).groupBy("user_id", first.alias("day"))
              .agg(F.max("timestamp").alias("latest")))
    t = F.col("timestamp")
    rows = attach_users(keys, latest, {"latest": ("latest_a", "latest_b")}).withColumn("timestamp", snapshot_time("day", policy))
    fresh = lambda side: F.coalesce(t - F.col(f"latest_{side}") <= max_age_seconds, F.lit(False))
    return rows.select("timestamp", *PAIR, (t - F.col("latest_a")).alias("age_a"), (t - F.col("latest_b")).alias("age_b"),
                       (fresh("a") & fresh("b")).alias("fresh"))


def latest_observations(stream: DataFrame) -> DataFrame:
    """Streaming form: the last observation of every participant.

    A maximum is indifferent to late and repeated rows, so the state is one row per participant
    and needs no watermark. ``stream`` has event_time (timestamp), user_id and scan_observed.
    """
    return stream.where(F.col("scan_observed")).groupBy("user_id").agg(F.max("event_time").alias("latest"))


def start_gate(stream: DataFrame, pairs: DataFrame, sink, checkpoint: str, max_age_seconds: int = 600,
               now=F.current_timestamp) -> StreamingQuery:
    """After every micro-batch, the pairs with two fresh ends go to ``sink(frame, batch_id)``."""
    check_age(max_age_seconds)

    def each(latest: DataFrame, batch_id: int) -> None:
        age = F.unix_timestamp(now()) - F.unix_timestamp("latest")
        fresh = latest.where(age.between(0, max_age_seconds)).select("user_id")
        ready = pairs
        for end in PAIR:
            ready = ready.join(fresh.withColumnRenamed("user_id", end), end, "left_semi")
        sink(ready, batch_id)

    return (latest_observations(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .foreachBatch(each).trigger(availableNow=True).start())


CHANGE = "user_min long, user_max long, changed_at timestamp, fresh boolean"
ENDS = "last_a long, last_b long, fresh boolean"


def gate_changes(stream: DataFrame, pairs: DataFrame, max_age_seconds: int = 600, delay_seconds: int = 60) -> DataFrame:
    """user_min, user_max, changed_at, fresh: one row whenever the gate of a pair opens or closes, in event time.

    ``stream`` has event_time (timestamp), user_id and scan_observed, ``pairs`` the distinct pairs to watch. A pair opens when both ends were seen within
    the limit of each other, at the later of the two times, and closes the limit after the earlier end's last observation, once the
    watermark (``delay_seconds`` behind the latest event) has passed that time; no row of the pair is needed for that. Later rows
    than the watermark allows are dropped. State is two times and a flag per pair with a recent end, and it goes when both are too old.
    An observation costs one row per watched pair of its participant; the pairs are joined by participant and never collected.
    """
    check_age(max_age_seconds)
    limit = max_age_seconds * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_a, last_b, fresh = state.get if state.exists else (None, None, False)
        for frame in frames:
            for at, is_a in zip(frame["at"], frame["is_a"], strict=True):
                if is_a:
                    last_a = int(at) if last_a is None else max(last_a, int(at))
                else:
                    last_b = int(at) if last_b is None else max(last_b, int(at))
        now, changes = state.getCurrentWatermarkMs(), []
        both = last_a is not None and last_b is not None
        if not fresh and both and abs(last_a - last_b) <= limit:
            fresh = True
            changes.append((*key, pd.Timestamp(max(last_a, last_b), unit="ms"), True))
        # An open gate waits for the earlier end, a closed one for the last trace of the pair.
        due = (min(last_a, last_b) if fresh else max(t for t in (last_a, last_b) if t is not None)) + limit
        if fresh and due <= now:
            fresh = False
            changes.append((*key, pd.Timestamp(due, unit="ms"), False))
            due = max(last_a, last_b) + limit
        if not fresh and due <= now:
            if state.exists:
                state.remove()
        else:
            state.update((last_a, last_b, fresh))
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame(changes, columns=["user_min", "user_max", "changed_at", "fresh"])

    watched = pairs.select(*PAIR, F.inline(F.array(*[F.struct(F.col(end).alias("user_id"), F.lit(end == PAIR[0]).alias("is_a")) for end in PAIR])))
    seen = stream.where(F.col("scan_observed")).withWatermark("event_time", f"{delay_seconds} seconds")
    rows = seen.join(watched, "user_id").select(*PAIR, "event_time", F.unix_millis("event_time").alias("at"), "is_a")
    return rows.groupBy(*PAIR).applyInPandasWithState(step, CHANGE, ENDS, "append", GroupStateTimeout.EventTimeTimeout)
