"""Key constraints, checked joins, table differences, fingerprints and accounting identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recontact.operators.pointintime import KEY



def key_violations(rows: DataFrame, keys: list[str] = KEY, label: str | None = "label_24h") -> DataFrame:
    """Counts of null, repeated and non-canonical keys and of impossible labels (all zero is valid)."""
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    bad_label = (F.col(label).isNotNull() & ~F.col(label).isin(0, 1)) if label else F.lit(False)
    bad_pair = F.col("user_min") < 0
    bad_pair = bad_pair | (F.col("user_min") >= F.col("user_max"))
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad_label).alias("bad_labels"))
    zero = lambda value: F.coalesce(value, F.lit(0).cast("long"))
    return per_key.agg(
        zero(F.sum("n")).alias("rows"), zero(F.sum(F.when(null_key, F.col("n")))).alias("null_keys"),
        zero(F.sum(F.when(F.col("n") > 1, F.col("n") - 1))).alias("duplicate_rows"),
        zero(F.sum(F.when(bad_pair, F.col("n")))).alias("non_canonical_pairs"), zero(F.sum("bad_labels")).alias("bad_labels"))


def one_to_one_join(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Full outer join with provenance and the number of rows on each side per key."""
    l = left.groupBy(*keys).agg(F.count("*").alias("left_rows"))
    r = right.groupBy(*keys).agg(F.count("*").alias("right_rows"))
    joined = l.join(r, keys, "full").na.fill(0, ["left_rows", "right_rows"])
    side = (F.when(F.col("left_rows") == 0, "right_only").when(F.col("right_rows") == 0, "left_only").otherwise("both"))
    return joined.groupBy(side.alias("provenance")).agg(
        F.count("*").alias("keys"), F.count_if((F.col("left_rows") > 1) | (F.col("right_rows") > 1)).alias("repeated_keys"))


def refused(frame: DataFrame, faults: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """The rows (those to ``keep``), unless any of them has a fault: then the read fails with its name.

    The check is a condition on rows, so it stays whatever columns are read later, and when rows are only counted.
    """
    fault = F.concat_ws(", ", *[F.when(test, F.lit(name)) for name, test in faults.items()])
    # One condition: a second one could be pushed below a join and take the faulty rows away before they are seen.
    return frame.where(F.when(fault == "", F.lit(True) if keep is None else keep).otherwise(F.raise_error(F.concat(F.lit("rows refused: "), fault)).cast("boolean")))


def contract_join(left: DataFrame, right: DataFrame, keys: list[str] = KEY, spare_left: bool = False, spare_right: bool = False) -> DataFrame:
    """The matched rows of two tables with one row per key each; all columns, the keys once.

    Fails where a key is null or repeated on either side, or has no partner: unless rows of that side may be spare, which are then left
    out. One full outer join on keys; how often a key occurs is counted in the exchange that the join needs anyway.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    if shared or any(c.startswith("_j_") for c in (*left.columns, *right.columns)):
        raise ValueError(f"both sides have the columns {shared}, or one has a name that begins with _j_")
    alone = Window.partitionBy(*keys)
    sides = [frame.withColumn(f"_j_{side}", F.count("*").over(alone)) for frame, side in ((left, "left"), (right, "right"))]
    joined = sides[0].join(sides[1], keys, "full")
    times = {side: F.coalesce(F.col(f"_j_{side}"), F.lit(0)) for side in ("left", "right")}
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    faults = {"a null key": null_key, "a key repeated on the left": times["left"] > 1, "a key repeated on the right": times["right"] > 1}
    if not spare_left:
        faults["a key without partner on the right"] = times["right"] == 0
    if not spare_right:
        faults["a key without partner on the left"] = times["left"] == 0
    checked = refused(joined, faults, (times["left"] == 1) & (times["right"] == 1))
    return checked.select(*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])


def must_match(left: DataFrame, right: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Left join that fails on a row without a partner, whatever is read of it. ``flag`` is a non-null right column."""
    return refused(left.join(right, keys, "left"), {"a row has no matching key": F.col(flag).isNull()})


def missing_scores(rows: DataFrame, scored: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return rows.join(scored.select(*keys), keys, "left_anti")


def semi_filter(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(allowed.select(*keys).distinct(), keys, "left_semi")


def cohort_reconcile(samples: DataFrame, old: DataFrame) -> DataFrame:
    """Is the older cohort a subset of the new one, and do the labels agree?"""
    before = old.select(*KEY, F.col("label_24h").alias("old_label"))
    joined = samples.select(*KEY, "label_24h", F.lit(1).alias("present")).join(before, KEY, "full")
    matched = F.col("present").isNotNull() & F.col("old_label").isNotNull()
    return joined.agg(
        F.count("present").alias("samples"), F.count("old_label").alias("old_rows"), F.count_if(matched).alias("matched"),
        F.count_if(F.col("present").isNull()).alias("old_missing_in_new"),
        F.count_if(matched & ~F.col("label_24h").eqNullSafe(F.col("old_label"))).alias("label_conflicts"))


def table_diff(before: DataFrame, after: DataFrame, keys: list[str], exact: list[str], close: list[str],
               rtol: float = 1e-12, atol: float = 1e-12) -> DataFrame:
    """Per column: compared keys, differing values and keys on one side only."""
    names = [*exact, *close]
    old = before.select(*keys, F.struct(*names).alias("old"))
    new = after.select(*keys, F.struct(*names).alias("new"))
    both = old.join(new, keys, "full")

    def differs(name: str) -> Column:
        a, b = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name in exact:
            return ~a.eqNullSafe(b)
        return ~F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())

    matched = F.col("old").isNotNull() & F.col("new").isNotNull()
    one_sided = F.count_if(F.col("old").isNull() | F.col("new").isNull())
    summary = both.agg(F.array(*[F.struct(
        F.lit(name).alias("column_name"), F.count_if(matched).alias("compared"),
        F.count_if(matched & differs(name)).alias("differences"), one_sided.alias("one_sided_keys")) for name in names]).alias("rows"))
    return summary.select(F.inline("rows"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-insensitive hash of a table: the rows' 64-bit hashes xor-ed and summed."""
    value = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("rows"), F.bit_xor(value).alias("xor_hash"),
                    F.sum(value.cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def identity_checks(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each accounting rule over each row of an aggregate table: checked and failed counts."""
    results = rows.agg(F.array(*[F.struct(
        F.lit(name).alias("rule"), F.count("*").alias("checked"),
        F.count_if(~F.coalesce(rule, F.lit(False))).alias("failed")) for name, rule in rules.items()]).alias("rows"))
    return results.select(F.inline("rows"))


def close_to(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return (F.abs(a - b) <= tolerance + tolerance * F.abs(b)) | (a.isNull() & b.isNull())
