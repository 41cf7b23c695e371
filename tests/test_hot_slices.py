"""One user with nine tenths of all events in one second: same results, bounded groups. Streams that keep the latest count."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gazeledger.operators import access
from gazeledger.operators.ordered import cut_slices, running
from gazeledger.params import AuditParams
from gazeledger.streaming import alerts
from gazeledger.streaming.runner import run_latest

WHOLE = AuditParams(max_queries_per_hour=30)
SMALL = replace(WHOLE, slice_rows=40)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(6)
    rows = [("hot", "2024-03-01 10:00:00", i) for i in range(900)]
    rows += [(rng.choice(["hot", "kim", "lee"]), f"2024-03-0{rng.randint(1, 2)} {rng.randint(9, 11):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}", 900 + i) for i in range(200)]
    return spark.createDataFrame([(*r, f"f{r[2] % 3}.log") for r in rows], "user_id string, at string, line_no long, source_file string").select(
        "user_id", F.col("at").cast("timestamp_ntz").alias("ts"), "line_no", "source_file", F.lit("t").alias("target"),
        F.lit(False).alias("has_pii"), F.lit(False).alias("is_bulk"), F.lit(0).alias("effective_exposure")).repartition(5).cache()


def table(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["running_daily", "rolling_hour", "peak_hour", "user_access_stats", "alert_hourly"])
def test_same_results_with_cut_slices(events, name):
    run = getattr(access, name)
    whole, small = run(events, WHOLE), run(events, SMALL)
    assert whole.columns == small.columns and table(whole) == table(small)


def test_rolling_count_by_brute_force(events):
    rows = [(r["user_id"], r["ts"].timestamp(), r["source_file"], r["line_no"]) for r in events.collect()]
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
    for r in access.rolling_hour(events, SMALL).collect():
        at = (r["ts"].timestamp(), r["source_file"], r["line_no"])
        assert r["rolling_count"] == sum(u == r["user_id"] and at[0] - 3600 <= t and (t, f, n) <= at for u, t, f, n in rows)


def test_cuts_bound_the_groups(events):
    staged = events.withColumn("_slice", F.lit(1))
    order = ["ts", "source_file", "line_no"]
    cut, found = cut_slices(staged, ["user_id"], "_slice", order, 100)
    sizes = [r["count"] for r in cut.where("user_id = 'hot'").groupBy("_cut").count().collect()]
    assert found and sum(sizes) > 900 and max(sizes) <= 2 * 100 and cut.count() == events.count()
    assert cut.where("user_id <> 'hot' and _cut <> 0").count() == 0
    assert cut_slices(staged, ["user_id"], "_slice", order, 10_000) == (staged, False)
    ranked = running(staged, ["user_id"], "_slice", order, sums={"n": F.lit(1)}, lasts={"seen": F.when(F.col("line_no") % 7 == 0, F.col("line_no"))}, slice_rows=100)
    plain = running(staged, ["user_id"], "_slice", order, sums={"n": F.lit(1)}, lasts={"seen": F.when(F.col("line_no") % 7 == 0, F.col("line_no"))})
    assert table(ranked) == table(plain)


def test_stream_keeps_the_latest_count(spark, events, tmp_path):
    days = events.select("user_id", "ts")
    for i, part in enumerate(days.randomSplit([1.0, 1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_latest(alerts.stream_daily_counts(stream, "10 days"), ["user_id", "d"])
    assert table(got) == table(access.daily_counts(events))
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema(days.schema).parquet(str(tmp_path / "none"))
    assert run_latest(alerts.stream_daily_counts(none), ["user_id", "d"]).count() == 0
