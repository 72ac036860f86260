"""Self-exciting forecast of a pair's next contact.

Intensity mu + alpha*beta*sum exp(-beta*(s - t_i)) with a fixed half-life; (mu, alpha) by maximum
likelihood on the distinct contact seconds of the last seven days. A pair has at most one event
per second, so an event list is bounded by the window, never by the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from recontact.functions.timemath import history_day, snapshot_time
from recontact.operators.clean import PAIR
from recontact.policy import DAY, HOUR, Policy

# Bounds of the fit (fixed values): mu per hour from below, alpha from both sides.
MU_MIN, ALPHA_MAX = 1e-6, 0.99
CELLS = 2_000_000


def pair_events(contacts: DataFrame, policy: Policy, days: int = 7) -> DataFrame:
    """day, pair, events: ascending distinct contact times in ``[t-days, t)``, in hours since its start."""
    daily = (contacts.select(*PAIR, "timestamp", history_day("timestamp", policy).alias("day")).distinct()
             .groupBy(*PAIR, "day").agg(F.array_sort(F.collect_list("timestamp")).alias("times")))
    recent = Window.partitionBy(*PAIR).orderBy("day").rangeBetween(-(days - 1), 0)
    listed = daily.select(*PAIR, "day", F.array_sort(F.flatten(F.collect_list("times").over(recent))).alias("times"))
    start = snapshot_time("day", policy) - days * DAY
    return listed.select("day", *PAIR, F.transform("times", lambda t: (t - start) / HOUR).alias("events"))


#: A fit with a larger residual has not settled.
SETTLED = 1e-6


def _excitation(times: np.ndarray, beta: float) -> np.ndarray:
    """A_i = (A_{i-1} + 1) * exp(-beta * gap): stable for any beta, column by column."""
    out = np.zeros_like(times)
    for i in range(1, times.shape[1]):
        out[:, i] = (out[:, i - 1] + 1) * np.exp(-beta * (times[:, i] - times[:, i - 1]))
    return out


def fit_rows(times: np.ndarray, live: np.ndarray, end: float, beta: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Projected Newton for all rows of a padded event matrix at once (the likelihood is concave)."""
    excite = np.where(live, beta * _excitation(times, beta), 0.0)
    loss = np.where(live, 1 - np.exp(-beta * (end - times)), 0.0).sum(axis=1)
    n = live.sum(axis=1)
    # Any start inside the bounds reaches the one maximum: a fifth of the events are taken for echoes.
    mu = np.maximum(0.8 * n / end, 2 * MU_MIN)
    alpha = np.full(len(mu), 0.2)

    def value(m, a):
        rate = np.where(live, m[:, None] + a[:, None] * excite, 1.0)
        return np.log(rate).sum(axis=1) - m * end - a * loss

    current = value(mu, alpha)
    for _ in range(rounds):
        inverse = np.where(live, 1.0 / np.where(live, mu[:, None] + alpha[:, None] * excite, 1.0), 0.0)
        weighted = excite * inverse
        g_mu, g_alpha = inverse.sum(axis=1) - end, weighted.sum(axis=1) - loss
        h_mm = (inverse ** 2).sum(axis=1) + 1e-12
        h_ma = (inverse * weighted).sum(axis=1)
        h_aa = (weighted ** 2).sum(axis=1) + 1e-12
        free_mu = ~((mu <= MU_MIN) & (g_mu < 0))
        free_alpha = ~(((alpha <= 0) & (g_alpha < 0)) | ((alpha >= ALPHA_MAX) & (g_alpha > 0)))
        g_mu, g_alpha = np.where(free_mu, g_mu, 0.0), np.where(free_alpha, g_alpha, 0.0)
        if max(np.abs(g_mu).max(), np.abs(g_alpha).max()) < 1e-9:
            break
        both = free_mu & free_alpha
        cross = np.where(both, h_ma, 0.0)
        det = np.maximum(h_mm * h_aa - cross ** 2, 1e-300)
        step_mu = np.where(free_mu, (h_aa * g_mu - cross * g_alpha) / det, 0.0)
        step_alpha = np.where(free_alpha, (h_mm * g_alpha - cross * g_mu) / det, 0.0)
        size, open_rows = np.ones(len(mu)), np.ones(len(mu), dtype=bool)
        moved = False
        for _ in range(40):
            new_mu = np.maximum(mu + size * step_mu, MU_MIN)
            new_alpha = np.clip(alpha + size * step_alpha, 0.0, ALPHA_MAX)
            new_value = value(new_mu, new_alpha)
            better = open_rows & (new_value > current)
            mu, alpha = np.where(better, new_mu, mu), np.where(better, new_alpha, alpha)
            current = np.where(better, new_value, current)
            moved |= bool(better.any())
            open_rows &= ~better
            if not open_rows.any():
                break
            size = np.where(open_rows, size / 2, size)
        if not moved:
            break
    return mu, alpha


def residuals(times: np.ndarray, live: np.ndarray, end: float, beta: float, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """How far each row is from the maximum: the larger slope of the likelihood that does not point out of the bounds.

    The likelihood is concave, so a row with residual 0 is its maximum, however it was found.
    """
    excite = np.where(live, beta * _excitation(times, beta), 0.0)
    inverse = np.where(live, 1.0 / np.where(live, mu[:, None] + alpha[:, None] * excite, 1.0), 0.0)
    g_mu = inverse.sum(axis=1) - end
    g_alpha = (excite * inverse).sum(axis=1) - np.where(live, 1 - np.exp(-beta * (end - times)), 0.0).sum(axis=1)
    g_mu = np.where((mu <= MU_MIN) & (g_mu < 0), 0.0, g_mu)
    g_alpha = np.where(((alpha <= 0) & (g_alpha < 0)) | ((alpha >= ALPHA_MAX) & (g_alpha > 0)), 0.0, g_alpha)
    return np.maximum(np.abs(g_mu) * mu, np.abs(g_alpha))


def forecast_rows(events: list[np.ndarray], end: float, beta: float, horizon: float = 24.0) -> np.ndarray:
    """P(at least one event in the horizon), ignoring excitation by future events."""
    return fitted_rows(events, end, beta, horizon)[0]


def fitted_rows(events: list[np.ndarray], end: float, beta: float, horizon: float = 24.0) -> tuple[np.ndarray, np.ndarray]:
    """``forecast_rows`` and the residual of every row's fit."""
    out, left = np.zeros(len(events)), np.zeros(len(events))
    lengths = np.array([len(e) for e in events])
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        # Rows of similar length share one padded matrix of bounded size.
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * max(lengths[order[stop]], 1) <= CELLS:
            stop += 1
        rows = order[start:stop]
        width = max(int(lengths[rows].max()), 1)
        times, live = np.full((len(rows), width), end), np.zeros((len(rows), width), dtype=bool)
        for i, r in enumerate(rows):
            times[i, :lengths[r]] = events[r]
            live[i, :lengths[r]] = True
        mu, alpha = fit_rows(times, live, end, beta)
        age = end - times
        decay = np.where(live, np.exp(-beta * age) - np.exp(-beta * (age + horizon)), 0.0).sum(axis=1)
        out[rows] = 1 - np.exp(-(mu * horizon + alpha * decay))
        left[rows] = residuals(times, live, end, beta, mu, alpha)
        start = stop
    return out, left


def decay_rate(hours: float) -> float:
    return math.log(2) / hours


def hawkes_forecast(events: DataFrame, policy: Policy, half_lives: tuple[float, ...], days: int = 7) -> DataFrame:
    """One row per key and half-life: its 24 h contact probability, the fit's residual and ``status`` (settled below ``SETTLED``)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(series: pd.Series) -> pd.Series:
        lists = [np.asarray(e, dtype=float) for e in series]
        fits = [fitted_rows(lists, days * 24.0, decay_rate(h)) for h in half_lives]
        columns = [fit[k] for k in (0, 1) for fit in fits]
        return pd.Series([list(row) for row in np.stack(columns, axis=1)]) if lists else pd.Series([], dtype=object)

    scored = events.withColumn("scores", solve("events"))
    k = len(half_lives)
    grid = F.arrays_zip(F.array(*[F.lit(float(h)) for h in half_lives]).alias("half_life_hours"), F.slice("scores", 1, k).alias("p"),
                        F.slice("scores", k + 1, k).alias("residual"))
    out = scored.select(snapshot_time("day", policy).alias("timestamp"), *PAIR, F.inline(grid))
    return out.withColumn("status", F.when(F.col("residual") < SETTLED, "settled").otherwise("not_settled"))


def excitation_totals(events: Column, beta: Column) -> Column:
    """struct(last, acc, total): the stable recursion folded over an ascending event array."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("acc"), F.lit(0.0).alias("total"))

    def step(state: Column, t: Column) -> Column:
        acc = F.when(state["last"].isNull(), F.lit(0.0)).otherwise((state["acc"] + 1) * F.exp(-beta * (t - state["last"])))
        return F.struct(t.alias("last"), acc.alias("acc"), (state["total"] + acc).alias("total"))

    return F.aggregate(events, start, step)


def hawkes_excitation(events: DataFrame, policy: Policy, half_lives: tuple[float, ...]) -> DataFrame:
    """Excitation at the last event and summed over events, per key and half-life."""
    spread = events.withColumn("half_life_hours", F.explode(F.array(*[F.lit(float(h)) for h in half_lives])))
    folded = spread.withColumn("x", excitation_totals(F.col("events"), F.log(F.lit(2.0)) / F.col("half_life_hours")))
    return folded.select(snapshot_time("day", policy).alias("timestamp"), *PAIR, "half_life_hours",
                         F.size("events").cast("long").alias("events"), F.col("x.acc").alias("last_excitation"), F.col("x.total").alias("excitation_sum"))
