"""Counters against a naive fold, on data with ties, skew and slices of any width."""

from __future__ import annotations

import random
from collections import Counter, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazeledger.operators import access, ordered
from gazeledger.params import AuditParams

SCHEMA = ("user_id string, ts timestamp_ntz, source_file string, line_no long, target string, has_pii boolean, "
          "is_bulk boolean, effective_exposure long")
START = datetime(2024, 1, 1, 6, 0)


def make_rows(seed=5, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.6 else f"u{rng.randrange(4)}"
        # whole minutes: many events share a timestamp or lie exactly one hour apart
        ts = START + timedelta(minutes=rng.randrange(60 * 40))
        rows.append((user, ts, f"f{rng.randrange(2)}", i, f"t{rng.randrange(9)}", rng.random() < 0.4, rng.random() < 0.2, rng.randrange(9000)))
    return rows


def fold(rows, p):
    """One pass in counter order."""
    daily, after, bulk, targets, windows, alerts, rolling = Counter(), Counter(), Counter(), {}, {}, set(), {}
    for u, ts, f, line, target, has_pii, is_bulk, _ in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        day, ref = (u, ts.date()), f"{f}:{line}"
        daily[day] += 1
        if daily[day] == p.max_queries_per_day + 1:
            alerts.add((u, "daily", ref))
        elif daily[day] == p.critical_queries_per_day + 1:
            alerts.add((u, "daily_critical", ref))
        w = windows.setdefault(u, deque())
        while w and w[0] < ts - timedelta(hours=1):
            w.popleft()
        w.append(ts)
        rolling[line] = len(w)
        if len(w) == p.max_queries_per_hour + 1 and (u, ts.strftime("%Y%m%d%H")) not in targets:
            targets[(u, ts.strftime("%Y%m%d%H"))] = True
            alerts.add((u, "hourly", ref))
        if has_pii and not p.business_hours_start <= ts.hour < p.business_hours_end:
            after[day] += 1
            if after[day] == p.after_hours_threshold + 1:
                alerts.add((u, "after", ref))
        if is_bulk:
            bulk[day] += 1
            if bulk[day] == p.bulk_export_per_day + 1:
                alerts.add((u, "bulk", ref))
        seen = targets.setdefault(("t",) + day, set())
        if target not in seen:
            seen.add(target)
            if len(seen) == p.unique_targets_per_day + 1:
                alerts.add((u, "targets", ref))
    return rolling, alerts


@pytest.mark.parametrize("minutes", [5, 60])
def test_counters_match_fold(spark, minutes):
    p = AuditParams(
        max_queries_per_day=6, critical_queries_per_day=20, max_queries_per_hour=4, critical_queries_per_hour=90,
        after_hours_threshold=2, bulk_export_per_day=1, unique_targets_per_day=3, chunk_minutes=minutes)
    rows = make_rows()
    events = spark.createDataFrame(rows, SCHEMA)
    rolling, alerts = fold(rows, p)
    got = {r["line_no"]: r["rolling_count"] for r in access.rolling_hour(events, p).collect()}
    assert got == rolling
    names = {"AFTER_HOURS": "after", "BULK_EXPORT": "bulk"}
    found = {
        (r["user_id"], r["window"] or names.get(r["category"], "targets"), r["raw_reference"])
        for r in access.access_findings(events, p, surge=False).where("category <> 'PII_RECORD_EXPOSURE'")
        .select("user_id", "category", "raw_reference", "details.window").collect()
    }
    assert found == alerts
    peaks = {r["user_id"]: r["max_queries_per_hour"] for r in access.peak_hour(events, p).collect()}
    by_user = {}
    for u, _, _, line, *_ in rows:
        by_user[u] = max(by_user.get(u, 0), rolling[line])
    assert peaks == by_user


def test_equal_limits_raise_one_daily_alert(spark):
    p = AuditParams(max_queries_per_day=2, critical_queries_per_day=2)
    events = spark.createDataFrame([("u", START, "f", i, "t", False, False, 0) for i in range(4)], SCHEMA)
    kinds = [r["window"] for r in access.day_alerts(events, p).select("details.window").collect()]
    assert kinds == ["daily"]


def test_running_last_value_crosses_slices(spark):
    rows = [("f", i, "a" if i == 1 else ("b" if i == 7 else None)) for i in range(12)]
    df = spark.createDataFrame(rows, "f string, i long, v string").withColumn("s", F.floor(F.col("i") / 3))
    out = ordered.running(df, ["f"], "s", ["i"], sums={"n": F.lit(1)}, lasts={"last": F.col("v")})
    got = [(r["n"], r["last"]) for r in out.orderBy("i").collect()]
    assert got == [(i + 1, None if i < 1 else "a" if i < 7 else "b") for i in range(12)]


def test_surge_prefers_current_counts(spark):
    days = [("u", (START + timedelta(days=i)).date(), 10) for i in range(9)]
    old = spark.createDataFrame(days[:8], "user_id string, d date, cnt long").withColumn("cnt", F.lit(5).cast("long"))
    now = spark.createDataFrame(days[6:], "user_id string, d date, cnt long")
    row = access.daily_surge_rows(now, AuditParams(), old, str(days[8][1])).first()
    assert row["baseline_days"] == 8 and row["baseline_avg"] == pytest.approx((6 * 5 + 2 * 10) / 8)


def test_alert_plan_ranks_only_a_bounded_share(spark):
    events = spark.createDataFrame(make_rows(n=20), SCHEMA)
    plan = access.day_alerts(events, AuditParams())._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_nothing_shown_text(spark):
    from gazeledger.operators.justify import screen_estimate

    zero = {c: 0 for c in ("total_pii_records_exposed", "select_pii_query_count", "max_single_query_exposure",
                           "unknown_exposure_query_count")}
    text = spark.range(1).select(*[F.lit(v).alias(c) for c, v in zero.items()]).select(screen_estimate().alias("t")).first()["t"]
    assert text.startswith("▶ 화면 직접 노출 추정 불가") and text.count("\n") == 3


def test_equal_scores_are_ranked_over_many_partitions(spark):
    from gazeledger.operators import risk

    users = spark.range(20_000).select(F.format_string("u%05d", F.col("id") * 7919 % 20_000).alias("user_id"), F.lit(0.0).alias("risk_score"))
    users = users.union(spark.createDataFrame([("zz", 5.0), ("yy", 5.0)], users.schema))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = risk.user_ranks(users).withColumn("part", F.spark_partition_id()).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r["position"] for r in rows] == list(range(1, 20_003))
    assert [r["user_id"] for r in rows] == ["yy", "zz", *(f"u{i:05d}" for i in range(20_000))]
