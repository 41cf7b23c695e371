"""History tables: snapshots of runs and daily counts; export of report tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeledger.operators.history import merge_daily_counts, snapshot_meta, snapshot_users
from gazeledger.params import AuditParams
from gazeledger.session import materialise

META_SCHEMA = (
    "run_id string, period_days int, saved_at timestamp_ntz, total_events bigint, total_lines bigint, "
    "user_count bigint, start_date date, end_date date"
)
USER_SCHEMA = (
    "run_id string, user_id string, risk_score double, risk_level string, pii_event_count bigint, "
    "total_events bigint, max_queries_per_day bigint, max_queries_per_hour bigint, after_hours_count bigint, "
    "bulk_export_count bigint, flagged_event_count bigint, total_pii_records_exposed bigint, "
    "max_single_query_exposure bigint, pii_types_str string, start_date date, end_date date"
)
COUNT_SCHEMA = "user_id string, d date, cnt bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_snapshot(
    summary: DataFrame, folder: str, start: date, end: date, total_events: int, total_lines: int,
    saved_at: datetime | None = None,
) -> str:
    """Append one run: its users first, then the meta row that makes the run visible."""
    saved_at = saved_at or datetime.now()
    run_id = f"{start}_{end}_{saved_at:%Y%m%d_%H%M%S}"
    spark = summary.sparkSession
    snapshot_users(summary, run_id, start, end).write.mode("append").partitionBy("start_date", "end_date").parquet(
        f"{folder}/snapshot_user")
    users = spark.read.schema(USER_SCHEMA).parquet(f"{folder}/snapshot_user").where(F.col("run_id") == run_id).count()
    snapshot_meta(spark, run_id, start, end, saved_at, total_events, total_lines, users).write.mode(
        "append").partitionBy("start_date", "end_date").parquet(f"{folder}/snapshot_meta")
    return run_id


def read_snapshot_meta(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/snapshot_meta", META_SCHEMA)


def read_snapshot_users(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/snapshot_user", USER_SCHEMA)


# Runs whose daily counts stay readable by those that still use them.
GRACE_RUNS = 3


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs whose list of days was written to its end."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/_SUCCESS")
    fs = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(glob) or [])


def _days(spark: SparkSession, path: str, run: int) -> dict[date, int]:
    """The run that wrote each day's counts, as a run's list tells; at most the retained days."""
    rows = spark.read.schema("d date, written bigint").parquet(f"{path}/lists/run={run}").collect()
    return {r["d"]: r["written"] for r in rows}


def _read_days(spark: SparkSession, path: str, days: dict[date, int]) -> DataFrame:
    if not days:
        return spark.createDataFrame([], COUNT_SCHEMA)
    parts = [f"{path}/counts/run={run}/d={d}" for d, run in sorted(days.items())]
    return spark.read.schema("user_id string, cnt bigint, run bigint, d date").option("basePath", f"{path}/counts").parquet(
        *parts).select("user_id", "d", "cnt")


def read_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The daily counts of the newest complete run."""
    path = f"{folder}/daily_counts"
    runs = _complete(spark, f"{path}/lists")
    return _read_days(spark, path, _days(spark, path, runs[-1]) if runs else {})


def save_daily_counts(current: DataFrame, folder: str, today: date, params: AuditParams) -> None:
    """Merge into the stored counts: only the days that ``current`` holds are written, each as a partition of this run.

    A run's list names the run that wrote each day; it is written last and makes the run visible at once, so that a failed
    write leaves the old counts in place. Days past the retention leave the list; what the last ``GRACE_RUNS`` lists do not
    name is deleted.
    """
    spark = current.sparkSession
    path = f"{folder}/daily_counts"
    runs = _complete(spark, f"{path}/lists")
    old = _days(spark, path, runs[-1]) if runs else {}
    run = (runs or [0])[-1] + 1
    first = today - timedelta(params.retention_days)
    current = materialise(current.where(F.col("d") >= F.lit(first)).select("user_id", "d", "cnt"), "daily-counts")
    touched = {r["d"] for r in current.select("d").distinct().collect()}
    before = _read_days(spark, path, {d: r for d, r in old.items() if d in touched})
    merged = merge_daily_counts(before, current, today, params)
    merged.repartition("d", F.pmod(F.xxhash64("user_id"), F.lit(8))).write.mode("overwrite").partitionBy("d").parquet(
        f"{path}/counts/run={run}")
    days = {d: r for d, r in old.items() if d >= first} | dict.fromkeys(touched, run)
    spark.createDataFrame(sorted(days.items()), "d date, written bigint").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/lists/run={run}")
    _drop_unlisted(spark, path, [*runs, run])


def _drop_unlisted(spark: SparkSession, path: str, runs: list[int]) -> None:
    named = {item for run in runs[-GRACE_RUNS:] for item in _days(spark, path, run).items()}
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for run in runs[:-GRACE_RUNS]:
        fs.delete(paths(f"{path}/lists/run={run}"), True)
    for status in fs.globStatus(paths(f"{path}/counts/run=*/d=*")) or []:
        run, day = (part.split("=")[1] for part in status.getPath().toString().split("/")[-2:])
        if int(run) <= runs[-1] and (date.fromisoformat(day), int(run)) not in named:
            fs.delete(status.getPath(), True)


def export_reports(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write report tables as parquet, json or csv (csv cannot hold nested columns; they become JSON text)."""
    for name, df in tables.items():
        if fmt == "csv":
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
            df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        writer = df.write.mode("overwrite")
        (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(f"{folder}/{name}")
