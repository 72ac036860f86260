"""The study objects the registered queries share, per session and folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.operators import clean, retrieval
from recontact.plans.study import Study
from recontact.policy import Policy
from recontact.session import configure, staged
from recontact.sources import derived

# A derived user scans about twice a day, so two of 288 bins count as covered and five rows
# per class carry a set.
POLICY = Policy(min_scan_coverage=2 / 288, min_class_rows=5)


class Context(Study):
    def __init__(self, spark: SparkSession, folder: str):
        configure(spark)
        self.folder = folder
        super().__init__(derived.scan_log(self.read(spark, folder, "events")), POLICY)

    @staticmethod
    def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
        return derived.read_table(spark, folder, name)

    def table(self, name: str) -> DataFrame:
        return self.read(self.spark, self.folder, name)

    @cached_property
    def catalog(self) -> DataFrame:
        """Canonical contacts with one namespace per event type; repeats kept."""
        return clean.canonical_contacts(self.raw, keep=("dataset_id",)).select("dataset_id", "timestamp", "user_min", "user_max")

    @cached_property
    def unique(self) -> DataFrame:
        return staged(clean.unique_contacts(self.catalog), "unique")

    @cached_property
    def retrieval_scores(self) -> DataFrame:
        return staged(retrieval.retrieval_scores(self.unique, self.policy), "retrieval-scores")

    @cached_property
    def retrieval_metrics(self) -> DataFrame:
        return staged(retrieval.retrieval_metrics(self.retrieval_scores, self.unique, self.policy), "retrieval-metrics")

    @cached_property
    def reveal_keys(self) -> DataFrame:
        """1-day candidates of every snapshot, also those with a cut-off horizon."""
        return self.pairs.where(F.col("day") >= self.span.first_snapshot).select("day", "user_min", "user_max")


_CONTEXTS: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, folder: str) -> Context:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, folder)
    return _CONTEXTS[key]
