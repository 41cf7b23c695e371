"""Comparison of runs: snapshots, nearest earlier run, per-user differences."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeledger.operators.risk import pii_types_text
from gazeledger.params import AuditParams
from gazeledger.schemas import SNAPSHOT_USER_FIELDS

NUMERIC_FIELDS = [f for f in SNAPSHOT_USER_FIELDS if f not in ("risk_level", "pii_types_str")]
SHIFTS = {"week": 7, "month": 30}


def _day(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


# --- snapshots ------------------------------------------------------------------


def snapshot_users(summary: DataFrame, run_id: str, start: date | str, end: date | str) -> DataFrame:
    """The compared fields of a user summary, tagged with run and period."""
    rows = summary if "pii_types_str" in summary.columns else summary.withColumn(
        "pii_types_str", pii_types_text(F.col("pii_types")))
    return rows.select(
        F.lit(run_id).alias("run_id"), "user_id", *SNAPSHOT_USER_FIELDS,
        _day(start).alias("start_date"), _day(end).alias("end_date"))


def snapshot_meta(
    spark: SparkSession, run_id: str, start: date, end: date, saved_at: datetime,
    total_events: int, total_lines: int, user_count: int,
) -> DataFrame:
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        (F.datediff(_day(end), _day(start)) + 1).alias("period_days"),
        F.lit(saved_at.isoformat(sep=" ")).cast("timestamp_ntz").alias("saved_at"),
        F.lit(total_events).cast("bigint").alias("total_events"),
        F.lit(total_lines).cast("bigint").alias("total_lines"),
        F.lit(user_count).cast("bigint").alias("user_count"),
        _day(start).alias("start_date"),
        _day(end).alias("end_date"),
    )


def snapshot_list(meta: DataFrame) -> DataFrame:
    """Runs by period and time of saving, newest first."""
    return meta.orderBy(F.col("start_date").desc(), F.col("end_date").desc(), F.col("saved_at").desc())


def snapshot_exact(meta: DataFrame, start: date | str | Column, end: date | str | Column) -> DataFrame:
    """The latest run of exactly this period (no row without one)."""
    days = F.datediff(_day(end), _day(start)) + 1
    same = meta.where(
        (F.col("start_date") == _day(start)) & (F.col("end_date") == _day(end)) & (F.col("period_days") == days))
    return same.agg(F.max_by("run_id", F.struct("saved_at", "run_id")).alias("run_id")).where("run_id IS NOT NULL")


def snapshot_closest(
    meta: DataFrame, start: date | str | Column, end: date | str | Column, params: AuditParams,
) -> DataFrame:
    """The run of similar length whose period lies nearest, however far; the first by name on ties."""
    days = F.datediff(_day(end), _day(start)) + 1
    distance = F.abs(F.datediff("start_date", _day(start))) + F.abs(F.datediff("end_date", _day(end)))
    near = meta.where(F.abs(F.col("period_days") - days) <= params.closest_tolerance_days)
    best = F.min_by(
        F.struct("run_id", distance.alias("distance"), "start_date", "end_date"),
        F.struct(distance, F.col("start_date"), F.col("end_date"), F.col("saved_at"), F.col("run_id")),
    )
    return near.agg(best.alias("b")).where("b IS NOT NULL").select("b.*")


def prior_users(
    meta: DataFrame, users: DataFrame, start: date, end: date, shift_days: int, params: AuditParams,
) -> DataFrame:
    """Users of the run one shift earlier: the exact period if it holds users, else the nearest run."""
    first, last = start - timedelta(days=shift_days), end - timedelta(days=shift_days)
    # a run without users does not count as an exact match
    exact = snapshot_exact(meta, first, last).join(
        meta.where(F.col("user_count") > 0).select("run_id"), "run_id", "left_semi")
    choice = exact.select(F.lit(0).alias("turn"), "run_id").unionByName(
        snapshot_closest(meta, first, last, params).select(F.lit(1).alias("turn"), "run_id"))
    chosen = choice.agg(F.min_by("run_id", "turn").alias("run_id"))  # one row
    return users.join(F.broadcast(chosen), "run_id", "left_semi")


# --- differences ----------------------------------------------------------------


def user_deltas(summary: DataFrame, prior: DataFrame) -> DataFrame:
    """Current minus prior for users of both runs; NULL counts as 0."""
    now = summary.select("user_id", *[F.col(f).alias(f"now_{f}") for f in NUMERIC_FIELDS])
    then = prior.select("user_id", "risk_level", "pii_types_str", *NUMERIC_FIELDS)
    return now.join(then, "user_id").select(
        "user_id",
        *[(F.coalesce(f"now_{f}", F.lit(0)) - F.coalesce(f, F.lit(0))).alias(f) for f in NUMERIC_FIELDS],
        F.coalesce("risk_level", F.lit("-")).alias("risk_level_prev"),
        F.coalesce("pii_types_str", F.lit("-")).alias("pii_types_prev"),
    )


def trend_arrow(delta: Column) -> Column:
    return F.when(delta > 0, "↑").when(delta < 0, "↓").otherwise("→")


def trend_word(delta: Column) -> Column:
    """Arrow with a word; ``-`` without a prior run."""
    return (
        F.when(delta.isNull(), "-").when(delta > 0, "↑ 증가").when(delta < 0, "↓ 감소").otherwise("→ 유지"))


def signed(delta: Column, decimals: int = 0) -> Column:
    """Number with its sign; NULL stays NULL."""
    text = F.format_string(f"%+.{decimals}f", delta.cast("double")) if decimals else F.format_string("%+d", delta.cast("bigint"))
    return F.when(delta.isNotNull(), text)


def trend_label(delta: Column, decimals: int = 0) -> Column:
    return F.concat(trend_arrow(delta), F.lit(" "), signed(delta, decimals))


def prior_score(score: Column, delta: Column) -> Column:
    return F.bround(score - delta, 2)


def with_deltas(summary: DataFrame, week: DataFrame, month: DataFrame) -> DataFrame:
    """The summary with ``week`` and ``month`` difference structs, NULL without a prior run."""
    out = summary
    for name, deltas in (("week", week), ("month", month)):
        cols = [c for c in deltas.columns if c != "user_id"]
        out = out.join(deltas.select("user_id", F.struct(*cols).alias(name)), "user_id", "left")
    return out


def newly_risky(compared: DataFrame, rule: str = "any") -> DataFrame:
    """Users now HIGH or CRITICAL who were LOW or MEDIUM.

    ``any``: in the prior week or month; ``week``: in the prior week; ``first``: in the prior week, or in
    the prior month when there is no prior week.
    """
    week, month = F.col("week.risk_level_prev"), F.col("month.risk_level_prev")
    before = F.coalesce(week, month)
    low = lambda level: F.coalesce(level.isin("LOW", "MEDIUM"), F.lit(False))
    test = {"any": low(week) | low(month), "week": low(week), "first": low(before)}[rule]
    return compared.where(F.col("risk_level").isin("HIGH", "CRITICAL") & test).withColumn("prev_level", before)


# --- daily counts -----------------------------------------------------------------


def merge_daily_counts(old: DataFrame, current: DataFrame, today: date | str, params: AuditParams) -> DataFrame:
    """Current counts replace old ones of the same user and day; days past the retention go."""
    merged = old.select("user_id", "d", F.col("cnt").alias("_old")).join(
        current.select("user_id", "d", "cnt"), ["user_id", "d"], "full")
    return merged.where(F.col("d") >= F.date_sub(_day(today), params.retention_days)).select(
        "user_id", "d", F.coalesce("cnt", "_old").alias("cnt"))
