"""The study as one object: each property is the next table of the pipeline.

A few tables are written out on first use, because several later steps read them: contacts,
pair-days, participant-days, the cohort with its rule inputs, the folds and the rolling predictions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.functions.timemath import Span
from recontact.operators import clean, features, pointintime as pit, splits
from recontact.plans import baselines
from recontact.policy import Policy
from recontact.session import configure, staged


class Study:
    """Tables of one source. Only the span (one row) is computed on construction."""

    def __init__(self, raw: DataFrame, policy: Policy, dataset_id: str = "scans"):
        self.spark: SparkSession = configure(raw.sparkSession)
        self.raw, self.policy, self.dataset_id = raw, policy, dataset_id
        self.span = Span.of(raw, policy)

    @cached_property
    def canonical(self) -> DataFrame:
        return clean.canonical_contacts(self.raw)

    @cached_property
    def contacts(self) -> DataFrame:
        return staged(clean.dedup_contacts(self.canonical), "contacts")

    @cached_property
    def seen(self) -> DataFrame:
        return clean.observations(self.raw, self.policy)

    @cached_property
    def people(self) -> DataFrame:
        return clean.participants(self.seen, self.contacts)

    @cached_property
    def coverage(self) -> DataFrame:
        return clean.daily_coverage(self.people, self.seen, self.span, self.policy)

    @cached_property
    def pairs(self) -> DataFrame:
        return staged(pit.pair_days(self.contacts, self.policy), "pair-days")

    @cached_property
    def scans(self) -> DataFrame:
        return staged(pit.user_scans(self.seen, self.policy), "scan-days")

    @cached_property
    def user_days(self) -> DataFrame:
        """Windowed activity, degree and scans of every participant at every snapshot."""
        return staged(features.user_history(self.pairs, self.scans, self.span, self.policy.bank_windows), "user-days")

    @cached_property
    def positives(self) -> DataFrame:
        return pit.future_positives(self.contacts, self.span)

    @cached_property
    def future_coverage(self) -> DataFrame:
        return pit.future_coverage(self.seen, self.span)

    @cached_property
    def known_keys(self) -> DataFrame:
        return pit.known_pairs(self.pairs, self.span)

    @cached_property
    def recent_keys(self) -> DataFrame:
        return pit.candidates(self.pairs, self.span)

    def _labels(self, keys: DataFrame) -> DataFrame:
        return pit.labels_24h(pit.label_evidence(keys, self.positives, self.future_coverage, self.policy), self.policy)

    @cached_property
    def labels(self) -> DataFrame:
        """Labels of every known pair."""
        return self._labels(self.known_keys)

    @cached_property
    def recent_labels(self) -> DataFrame:
        """Labels of the 1-day candidates only."""
        return self._labels(self.recent_keys)

    def timed(self, keys: DataFrame) -> DataFrame:
        return pit.with_time(keys, self.policy)

    @cached_property
    def cohort(self) -> DataFrame:
        """Eligible 1-day candidates with a full 7-day history; labels come with the candidates."""
        return staged(splits.common_cohort(self.recent_labels, self.timed(self.recent_keys), self.span, self.dataset_id), "cohort")

    @cached_property
    def cohort_keys(self) -> DataFrame:
        day = ((F.col("timestamp") - self.policy.offset) / 86400).cast("long")
        return self.cohort.select(day.alias("day"), "user_min", "user_max")

    def bounded(self, keys: DataFrame, windows: tuple[int, ...] | None = None, neighbours: bool = True) -> DataFrame:
        return features.bounded_bank(self.pairs, self.user_days, keys, self.span, windows or self.policy.windows, neighbours=neighbours)

    @cached_property
    def bank(self) -> DataFrame:
        return features.feature_bank(self.pairs, self.user_days, self.known_keys, self.span)

    @cached_property
    def scored_cohort(self) -> DataFrame:
        """Cohort rows per window with the two inputs of the untrained rules and what the days are described by."""
        facts = self.bounded(self.cohort_keys, neighbours=False).select(
            *pit.KEY, "window_days", F.col("historical_contact_probability").alias("probability"),
            F.col("recency_seconds").alias("recency"), "pair_contact_bins", "scan_coverage_a", "scan_coverage_b",
            "pair_contact_days", "participant_a_activity", "participant_b_activity")
        labels = self.cohort.select(*pit.KEY, F.col("label_24h").cast("int").alias("label"))
        return staged(labels.join(facts, pit.KEY), "scored-cohort")

    @cached_property
    def folds(self) -> DataFrame:
        """The rolling folds that may be evaluated, one row each."""
        return staged(splits.ready_folds(self.cohort, self.policy), "folds")

    @cached_property
    def predictions(self) -> DataFrame:
        """Rolling test predictions of the untrained rules: KEY, label, window_days, model, p, threshold."""
        rows = self.scored_cohort.select(*pit.KEY, "label", "window_days", "probability", "recency")
        scored = staged(baselines.score_baselines(rows, self.folds), "scored")
        return staged(baselines.with_thresholds(scored).drop("test_time"), "predictions")
