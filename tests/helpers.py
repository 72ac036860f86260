from recontact.plans.study import Study
from recontact.policy import DAY, Policy

T = 8 * DAY + 8 * 3600


def scan_rows(users, days, every=300):
    """Empty scans of every user through all days, so coverage is complete."""
    return [(t, u, -1, 0.0) for u in users for t in range(0, days * DAY, every)]


def study(spark, rows, **policy) -> Study:
    frame = spark.createDataFrame(rows, "timestamp long, user_a long, user_b long, rssi double")
    return Study(frame, Policy(**policy))


def at(frame, t, *columns):
    """{(user_min, user_max): row values} of one snapshot."""
    rows = frame.where(frame.timestamp == t).collect()
    return {(r.user_min, r.user_max): tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows}
