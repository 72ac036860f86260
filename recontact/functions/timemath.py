"""Integer time arithmetic that turns range conditions into equality keys.

Snapshot ``d`` is taken at ``t = d*86400 + offset``. A contact at ``ts`` is first seen by
snapshot day ``floor((ts-offset)/86400) + 1`` and stays inside a ``w``-day history for ``w``
snapshots, so ``t-w*86400 <= ts < t`` needs no range join. Likewise exactly one snapshot has
``ts`` inside its ``(t, t+24h]`` horizon.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from recontact.policy import DAY, Policy


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def floor_div(value, divisor: int) -> Column:
    # Integer division truncates toward zero; times before the first snapshot are negative.
    return F.floor(_col(value) / F.lit(divisor)).cast("long")


def history_day(ts, policy: Policy) -> Column:
    """First snapshot day whose history contains ``ts`` (strictly before the snapshot)."""
    return floor_div(_col(ts) - policy.offset, DAY) + 1


def horizon_day(ts, policy: Policy) -> Column:
    """The only snapshot day with ``ts`` in ``(t, t+24h]``."""
    return floor_div(_col(ts) - policy.offset - 1, DAY)


def snapshot_time(day, policy: Policy) -> Column:
    return (_col(day) * DAY + policy.offset).cast("long")


def sums_until(daily: DataFrame, asked: DataFrame, keys: list[str], columns: tuple[str, ...], at: str) -> DataFrame:
    """``asked`` with the sums of ``columns`` over the daily rows of the same keys whose timestamp is ``at`` or earlier; 0 without any.

    One running sum over both tables together: an asked row never meets the days it adds up, so work is one sort of daily and asked rows.
    """
    wanted = asked.select(*keys, F.col(at).alias("_at"), *[F.lit(0).cast("long").alias(c) for c in columns], F.struct(*asked.columns).alias("_asked"))
    days = daily.select(*keys, F.col("timestamp").alias("_at"), *[F.col(c).cast("long").alias(c) for c in columns],
                        F.lit(None).cast(wanted.schema["_asked"].dataType).alias("_asked"))
    upto = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = days.unionByName(wanted).select("_asked", *[F.sum(c).over(upto).alias(c) for c in columns])
    return summed.where("_asked IS NOT NULL").select("_asked.*", *columns)


def study_day(ts) -> Column:
    return floor_div(ts, DAY) + 1


@dataclass(frozen=True)
class Span:
    """First and last recorded second of a source, relative to its origin."""

    start: int
    end: int
    policy: Policy

    @classmethod
    def of(cls, frame: DataFrame, policy: Policy, column: str = "timestamp") -> "Span":
        row = frame.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        if row.lo is None:
            raise ValueError("the source has no rows")
        return cls(int(row.lo), int(row.hi), policy)

    @property
    def first_snapshot(self) -> int:
        return -((self.policy.offset - self.start) // DAY)

    @property
    def last_snapshot(self) -> int:
        return (self.end - DAY - self.policy.offset) // DAY

    def history_from(self, days: int) -> int:
        """First snapshot day with a full ``days`` history inside the source."""
        return self.first_snapshot + days

    @property
    def scheduled(self) -> tuple[int, int]:
        return self.start // DAY, self.end // DAY
