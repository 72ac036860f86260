import pytest
from pyspark.sql import functions as F

from helpers import scan_rows, study
from recontact.operators.pointintime import KEY
from recontact.plans import audit, sealed
from recontact.plans.kept_models import ContractError
from recontact.policy import DAY


def scores_of(spark, rows):
    """A rule's scores of the keys of days 7 to 9, from what was known then."""
    bank = study(spark, rows).bounded(study(spark, rows).recent_keys, neighbours=False)
    return bank.where(F.col("timestamp").between(7 * DAY, 10 * DAY)).select(*KEY, "window_days", "pair_contact_bins", F.coalesce("historical_contact_probability", F.lit(0.5)).alias("p"))


def contacts(first, last):
    return [(d * DAY + h * 3600, a, a + 1, -60.0) for d in range(first, last) for h in (2, 9, 20) for a in range(d % 3, 6, 2)]


def test_later_rows_change_no_sealed_score(spark, tmp_path):
    early = scan_rows(range(7), 12, 7200) + contacts(0, 12)
    late = early + [(t + 12 * DAY, u, v, s) for t, u, v, s in scan_rows(range(7), 3, 7200)] + contacts(12, 15) + [(14 * DAY + 5, 0, 6, -50.0)]
    first = sealed.seal(scores_of(spark, early), str(tmp_path / "early"), 7 * DAY, by=["window_days"])
    second = sealed.seal(scores_of(spark, late).repartition(7), str(tmp_path / "late"), 7 * DAY, by=["window_days"])
    assert first["rows"] > 10 and first == second
    # A row inside the histories does change them.
    third = sealed.seal(scores_of(spark, early + [(7 * DAY + 5, 0, 1, -50.0), (7 * DAY + 8000, 0, 1, -50.0)]), str(tmp_path / "third"), 7 * DAY, by=["window_days"])
    assert third["digest"] != first["digest"]


@pytest.fixture()
def scored(spark):
    return spark.createDataFrame([(9 * DAY, 1, 2, 0.5), (9 * DAY, 1, 3, None), (10 * DAY, 1, 2, 0.25)], "timestamp long, user_min long, user_max long, p double")


def test_the_digest_is_of_a_multiset(spark, scored):
    digest = sealed.rows_digest(scored)
    assert digest[1] == 3 and sealed.rows_digest(scored.repartition(3).select("p", *KEY)) == digest
    assert sealed.rows_digest(scored.union(scored))[0] != digest[0]
    assert sealed.rows_digest(scored.withColumn("p", F.coalesce("p", F.lit(0.0))))[0] != digest[0]
    empty = sealed.rows_digest(scored.limit(0))
    assert empty[1] == 0 and len(empty[0]) == 64


def test_reveal_joins_only_what_was_sealed(spark, scored, tmp_path):
    folder = str(tmp_path / "sealed")
    sealed.seal(scored, folder, 9 * DAY)
    outcomes = spark.createDataFrame([(9 * DAY, 1, 2, 1), (9 * DAY, 1, 3, None), (10 * DAY, 1, 2, 0), (10 * DAY, 5, 6, 1)], "timestamp long, user_min long, user_max long, label int")
    found = sorted((r.timestamp // DAY, r.user_max, r.p, r.label) for r in sealed.reveal(spark, folder, outcomes).collect() if r.p is not None)
    assert found == [(9, 2, 0.5, 1), (10, 2, 0.25, 0)] and sealed.reveal(spark, folder, outcomes).count() == 3
    with pytest.raises(Exception, match="without an outcome"):
        sealed.reveal(spark, folder, outcomes.where("user_max <> 3")).count()
    with pytest.raises(Exception, match="an outcome twice"):
        sealed.reveal(spark, folder, outcomes.union(outcomes.limit(1))).select("p").collect()
    with pytest.raises(ContractError, match="columns"):
        sealed.reveal(spark, folder, outcomes.withColumnRenamed("label", "p"))
    # The same rows in other files are the same scores; another value, or a missing row, is refused.
    for name, rows in (("other", scored.withColumn("p", F.col("p") + 1e-9)), ("less", scored.where("user_max = 2"))):
        changed = str(tmp_path / name)
        sealed.seal(scored, changed, 9 * DAY)
        rows.write.mode("overwrite").parquet(f"{changed}/scores")
        with pytest.raises(ContractError, match="scores have been changed"):
            sealed.reveal(spark, changed, outcomes)


def test_what_cannot_be_sealed(spark, scored, tmp_path):
    with pytest.raises(ContractError, match="outcomes"):
        sealed.seal(scored.withColumn("label", F.lit(1)), str(tmp_path / "a"), 9 * DAY)
    with pytest.raises(Exception, match="information deadline"):
        sealed.seal(scored, str(tmp_path / "b"), 9 * DAY + 1)
    with pytest.raises(Exception, match="a null key"):
        sealed.seal(scored.withColumn("user_min", F.lit(None).cast("long")), str(tmp_path / "c"), 9 * DAY)
    with pytest.raises(ContractError, match="twice"):
        sealed.seal(scored.union(scored), str(tmp_path / "d"), 9 * DAY)
    assert not any((tmp_path / name / "seal").exists() for name in "abcd")


def test_audited_rows_are_rows_of_the_recent_bank(spark):
    # the bank was made a second time for keys that the first one already held.
    rows = [*scan_rows((1, 2, 3), 24, 3600), *[(d * DAY + 7 * u, u, u + 1, -60.0) for d in range(24) for u in (1, 2) if (d * u) % 3]]
    s = study(spark, rows, min_scan_coverage=2 / 288)
    bank = s.bounded(s.recent_keys, neighbours=False)
    shared = {tuple(r) for r in audit.audited_rows(s, bank).collect()}
    assert shared == {tuple(r) for r in s.bounded(audit.audited_keys(s), neighbours=False).collect()} and 0 < len(shared) < bank.count()
