"""Tables that runs and streams keep: daily counts by partitions, alerts of a stream by days."""

import random
from datetime import date, datetime, timedelta

from gazeledger.params import AuditParams
from gazeledger.sources import store
from gazeledger.streaming import alerts

P = AuditParams().with_overrides({
    "max_queries_per_day": 12, "critical_queries_per_day": 20, "max_queries_per_hour": 5, "critical_queries_per_hour": 9,
    "after_hours_threshold": 2, "bulk_export_per_day": 2, "unique_targets_per_day": 4})
SCHEMA = "user_id string, ts timestamp_ntz, source_file string, line_no bigint, target string, has_pii boolean, is_bulk boolean"


def counts(spark, rows):
    return spark.createDataFrame(rows, "user_id string, d date, cnt bigint")


def parts(folder):
    return {f"{p.parent.name}/{p.name}" for p in folder.glob("daily_counts/counts/run=*/d=*")}


def test_a_run_rewrites_only_its_days(spark, tmp_path):
    folder, day = str(tmp_path), date(2024, 1, 1)
    assert store.read_daily_counts(spark, folder).count() == 0
    store.save_daily_counts(counts(spark, [("a", day, 1), ("b", day, 2), ("a", day + timedelta(1), 3)]), folder, day, P)
    store.save_daily_counts(counts(spark, [("a", day + timedelta(1), 7), ("c", day + timedelta(1), 8)]), folder, day, P)
    assert parts(tmp_path) == {"run=1/d=2024-01-01", "run=1/d=2024-01-02", "run=2/d=2024-01-02"}
    want = {("a", day, 1), ("b", day, 2), ("a", day + timedelta(1), 7), ("c", day + timedelta(1), 8)}
    assert {tuple(r) for r in store.read_daily_counts(spark, folder).collect()} == want

    # a run that stops before its list is written leaves the counts as they are
    counts(spark, [("z", day, 1)]).write.partitionBy("d").parquet(f"{folder}/daily_counts/counts/run=3")
    assert {tuple(r) for r in store.read_daily_counts(spark, folder).collect()} == want
    store.save_daily_counts(counts(spark, []), folder, day, P)
    assert {tuple(r) for r in store.read_daily_counts(spark, folder).collect()} == want


def test_old_days_and_unlisted_partitions_go(spark, tmp_path):
    folder, day = str(tmp_path), date(2024, 1, 1)
    for n in range(5):
        now = day + timedelta(20 * n)
        store.save_daily_counts(counts(spark, [("a", now, n), ("a", now - timedelta(60), 9)]), folder, now, P)
    found = {tuple(r) for r in store.read_daily_counts(spark, folder).collect()}
    assert found == {("a", day + timedelta(20 * n), n) for n in (3, 4)}
    # three lists are kept; what only older ones named is gone
    assert {p.name for p in tmp_path.glob("daily_counts/lists/run=*")} == {"run=3", "run=4", "run=5"}
    assert len(parts(tmp_path)) == 4


def keyed(rows):
    return sorted((r["user_id"], r["kind"], r["severity"], r["ts"], r["raw_reference"]) for r in rows)


def test_stream_alerts_equal_a_batch_whatever_the_order(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 3, 1)
    rows = []
    for n in range(900):
        at = start + timedelta(days=rng.randrange(3), minutes=rng.choice([5, 20, 23 * 60 + 30, 600]) + rng.randrange(30))
        rows.append((rng.choice(["hot", "hot", "hot", "u1", "u2"]), at, "f", n, rng.choice(["", "t1", "t2", "t3", "t4", "t5", "t6"]), rng.random() < 0.3, rng.random() < 0.1))
    rows.append((None, None, "f", 1, None, None, None))
    dealt = [rows[i::4] for i in range(4)]
    for n, some in enumerate(dealt):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = keyed(alerts.stream_alerts(stream, P, late_days=5).collect())
    want = keyed(alerts.threshold_alerts(spark.createDataFrame(rows, SCHEMA).where("ts is not null"), P).collect())
    assert got == want and len(want) > 20 and {k for _, k, *_ in want} == {"daily", "daily_critical", "hourly", "after_hours", "bulk", "unique_targets"}


def test_rows_behind_the_late_days_are_dropped(spark, tmp_path):
    def some(day, first):
        return [("u", datetime(2024, 3, day, 10, n), "f", first + n, "", False, False) for n in range(14)]

    for n, part in enumerate((some(10, 0), some(1, 100), some(9, 200))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    days = {r["ts"].day for r in alerts.stream_alerts(stream, P).where("kind = 'daily'").collect()}
    assert days == {9, 10}


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    assert alerts.stream_alerts(stream, P).count() == 0
