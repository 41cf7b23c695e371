"""Registered queries: access counting (A rows) and filters (F rows) on the access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeledger.operators import access, filters, history
from gazeledger.params import AuditParams
from gazeledger.plans.registry import query
from gazeledger.plans.views import view, with_views

# limits low enough to fire on the given tables
TEST_PARAMS = AuditParams(
    max_queries_per_day=4, critical_queries_per_day=6, max_queries_per_hour=1, critical_queries_per_hour=5,
    after_hours_threshold=1, bulk_export_per_day=1, unique_targets_per_day=4,
    pii_single_query_high=2_500, pii_single_query_critical=10_000, year_hint=2024,
)
P = TEST_PARAMS
BASE = with_views("access_log")
ORDER = "ts, source_file, line_no"


def log(spark: SparkSession, sf: str) -> DataFrame:
    return filters.counter_eligible(view(spark, sf, "access_log"))


def _us(name: str = "ts"):
    return F.unix_micros(F.col(name).cast("timestamp"))


def finding_rows(df: DataFrame) -> DataFrame:
    """Findings as plain columns."""
    return df.select(
        "finding_id", "category", "severity", "user_id", _us().alias("ts_us"), "evidence", "raw_reference",
        F.coalesce(F.col("details.count"), F.col("details.unique_targets"), F.col("details.exposure")).alias("measure"),
    )


@query("daily_counts", f"""{BASE}
select user_id, cast(cast(ts as date) as varchar) as d, count(*) as cnt from access_log group by 1, 2""")
def daily_counts(spark, sf):
    return access.daily_counts(log(spark, sf)).withColumn("d", F.col("d").cast("string"))


@query("running_daily", f"""{BASE}
select user_id, line_no, row_number() over (partition by user_id, cast(ts as date) order by {ORDER}) as running_count
from access_log""")
def running_daily(spark, sf):
    return access.running_daily(log(spark, sf), P).select("user_id", "line_no", "running_count")


@query("rolling_hour", f"""{BASE}
select user_id, line_no,
 row_number() over (partition by user_id order by {ORDER})
 - count(*) over (partition by user_id order by epoch_us(ts) range between unbounded preceding and 3600000001 preceding)
 as rolling_count from access_log""")
def rolling_hour(spark, sf):
    return access.rolling_hour(log(spark, sf), P).select("user_id", "line_no", "rolling_count")


# SQL of the alerts: rows = (user_id, category, severity, ts, reference, evidence, measure)
ROLLING_SQL = f"""rolled as (select *,
 row_number() over (partition by user_id order by {ORDER})
 - count(*) over (partition by user_id order by epoch_us(ts) range between unbounded preceding and 3600000001 preceding) as rolling
 from access_log)"""


def _finding_sql(rows: str) -> str:
    return f"""select substr(sha256(user_id || reference || category),1,12) as finding_id, category, severity, user_id,
 epoch_us(ts) as ts_us, evidence, reference as raw_reference, cast(measure as bigint) as measure from ({rows})"""


REF = "source_file || ':' || cast(line_no as varchar)"


def _nth_sql(where: str, n: int, category: str, severity: str, evidence: str) -> str:
    return f"""select user_id, '{category}' as category, '{severity}' as severity, ts, {REF} as reference,
 {evidence} as evidence, {n} as measure
 from (select *, row_number() over (partition by user_id, cast(ts as date) order by {ORDER}) as rn
       from access_log where {where}) where rn = {n}"""


def alert_sql(p: AuditParams) -> dict[str, str]:
    hour_text = "strftime(ts, '%Y-%m-%d %H:00')"
    return {
        "alert_daily": _nth_sql(
            "true", p.max_queries_per_day + 1, "EXCESSIVE_ACCESS",
            "CRITICAL" if p.max_queries_per_day + 1 > p.critical_queries_per_day else "HIGH",
            f"'일별 조회 건수 {p.max_queries_per_day + 1}건 (임계값: {p.max_queries_per_day}건)'"),
        "alert_daily_critical": _nth_sql(
            "true", p.critical_queries_per_day + 1, "EXCESSIVE_ACCESS", "CRITICAL",
            f"'일별 조회 건수 {p.critical_queries_per_day + 1}건 (위험 임계값: {p.critical_queries_per_day}건) - 즉각 조사 필요'"),
        "alert_hourly": f"""select user_id, 'EXCESSIVE_ACCESS' as category, 'HIGH' as severity, ts, {REF} as reference,
 '1시간 내 조회 건수 {p.max_queries_per_hour + 1}건 (임계값: {p.max_queries_per_hour}건/시간)' as evidence,
 {p.max_queries_per_hour + 1} as measure
 from (select *, row_number() over (partition by user_id, {hour_text} order by {ORDER}) as turn
       from rolled where rolling = {p.max_queries_per_hour + 1}) where turn = 1""",
        "alert_after_hours": _nth_sql(
            "has_pii and (hour(ts) < 8 or hour(ts) >= 19)", p.after_hours_threshold + 1, "AFTER_HOURS", "HIGH",
            f"'업무 외 시간(' || strftime(ts, '%H:%M') || ') 개인정보 {p.after_hours_threshold + 1}건 조회'"),
        "alert_bulk": _nth_sql(
            "is_bulk", p.bulk_export_per_day + 1, "BULK_EXPORT", "HIGH",
            f"'하루 대량 조회 {p.bulk_export_per_day + 1}건 (임계값: {p.bulk_export_per_day}건)'"),
        "alert_single_exposure": f"""select user_id, 'PII_RECORD_EXPOSURE' as category, severity, ts, {REF} as reference,
 '단일 쿼리 개인정보 ' || format('{{:,}}', effective_exposure) || '건 노출 (PII필드 -개 × 결과 ' ||
 format('{{:,}}', result_row_count) || '건)' as evidence, effective_exposure as measure
 from (select *, row_number() over (partition by user_id, cast(ts as date), line_no, severity order by ts, source_file) as turn
  from (select *, case when effective_exposure >= {p.pii_single_query_critical} then 'CRITICAL' else 'HIGH' end as severity
        from access_log where effective_exposure >= {p.pii_single_query_high})) where turn = 1""",
        "alert_unique_targets": f"""select user_id, 'EXCESSIVE_ACCESS' as category, 'MEDIUM' as severity, ts, {REF} as reference,
 '하루 고유 대상 {p.unique_targets_per_day + 1}개 접근 (임계값: {p.unique_targets_per_day}개)' as evidence,
 {p.unique_targets_per_day + 1} as measure
 from (select *, row_number() over (partition by user_id, cast(ts as date) order by {ORDER}) as rn
  from (select *, row_number() over (partition by user_id, cast(ts as date), target order by {ORDER}) as seen
        from access_log where target <> '') where seen = 1) where rn = {p.unique_targets_per_day + 1}""",
    }


ALERT_SQL = alert_sql(P)
SURGE_SQL = f"""days as (select user_id, cast(ts as date) as d, count(*) as cnt from access_log group by 1, 2),
surge as (select *, (cnt - avg_cnt) / avg_cnt as ratio from (
 select *, count(*) over w as n_days, avg(cnt) over w as avg_cnt from days
 window w as (partition by user_id order by d rows between 30 preceding and 1 preceding))
 where n_days >= 7 and avg_cnt <> 0 and (cnt - avg_cnt) / avg_cnt > 0.10)"""

def _alert(name: str, fn) -> None:
    ctes = f"{BASE}, {ROLLING_SQL}" if name == "alert_hourly" else BASE

    @query(name, f"{ctes} {_finding_sql(ALERT_SQL[name])}")
    def run(spark, sf):
        return finding_rows(fn(log(spark, sf), P))


_alert("alert_daily", access.alert_daily)
_alert("alert_daily_critical", access.alert_daily_critical)
_alert("alert_hourly", access.alert_hourly)
_alert("alert_after_hours", access.alert_after_hours)
_alert("alert_bulk", access.alert_bulk)
_alert("alert_single_exposure", access.alert_single_exposure)
_alert("alert_unique_targets", access.alert_unique_targets)


@query("daily_surge", f"""{BASE}, {SURGE_SQL}
select user_id, cast(d as varchar) as d, cnt, n_days as baseline_days,
 cast(floor(avg_cnt * 1000 + 0.5) as bigint) as baseline_avg_x1000,
 cast(floor(ratio * 100000 + 0.5) as bigint) as ratio_x100000,
 case when ratio >= 0.5 then 'HIGH' else 'MEDIUM' end as severity,
 substr(sha256(user_id || 'EXCESSIVE_ACCESS'),1,12) as finding_id from surge""")
def daily_surge(spark, sf):
    rows = access.daily_surge_rows(access.daily_counts(log(spark, sf)), P)
    return rows.select(
        "user_id", F.col("d").cast("string").alias("d"), "cnt", "baseline_days",
        F.floor(F.col("baseline_avg") * 1000 + 0.5).cast("bigint").alias("baseline_avg_x1000"),
        F.floor(F.col("ratio") * 100000 + 0.5).cast("bigint").alias("ratio_x100000"),
        F.when(F.col("ratio") >= P.surge_high_ratio, "HIGH").otherwise("MEDIUM").alias("severity"),
        access.finding_id(F.col("user_id"), F.lit(""), F.lit("EXCESSIVE_ACCESS")).alias("finding_id"),
    )


@query("peak_day", f"""{BASE}
select user_id, max(cnt) as max_queries_per_day, strftime(min(d) filter (where cnt = top), '%Y-%m-%d') as peak_day
from (select *, max(cnt) over (partition by user_id) as top from
 (select user_id, cast(ts as date) as d, count(*) as cnt from access_log group by 1, 2)) group by 1""")
def peak_day(spark, sf):
    return access.peak_day(access.daily_counts(log(spark, sf)))


PEAK_SQL = """select user_id, rolling as max_queries_per_hour, strftime(ts, '%Y-%m-%d %H:00') as peak_hour
from (select *, row_number() over (partition by user_id order by rolling desc, ts, source_file, line_no) as turn from rolled)
where turn = 1"""


@query("peak_hour", f"{BASE}, {ROLLING_SQL} {PEAK_SQL}")
def peak_hour(spark, sf):
    return access.peak_hour(log(spark, sf), P)


def stats_ctes() -> str:
    return f"""{ROLLING_SQL},
days as (select user_id, cast(ts as date) as d, count(*) as cnt,
  count(*) filter (where has_pii and (hour(ts) < 8 or hour(ts) >= 19)) as after,
  count(*) filter (where is_bulk) as bulk, count(distinct target) as targets from access_log group by 1, 2),
peaks as ({PEAK_SQL}),
stats as (select d.user_id, max(cnt) as max_queries_per_day, any_value(p.max_queries_per_hour) as max_queries_per_hour,
  any_value(p.peak_hour) as peak_hour,
  strftime(min(d) filter (where cnt = top), '%Y-%m-%d') as peak_day, cast(sum(after) as bigint) as after_hours_count,
  cast(sum(bulk) as bigint) as bulk_export_count, max(targets) as unique_targets_per_day
  from (select *, max(cnt) over (partition by user_id) as top from days) d join peaks p on p.user_id = d.user_id group by 1)"""


@query("user_access_stats", f"{BASE}, {stats_ctes()} select * from stats")
def user_access_stats(spark, sf):
    return access.user_access_stats(log(spark, sf), P)


@query("finding_id", f"""{BASE}
select line_no, substr(sha256(user_id || {REF} || 'BULK_EXPORT'),1,12) as finding_id from access_log""")
def finding_id(spark, sf):
    ref = F.concat_ws(":", "source_file", F.col("line_no").cast("string"))
    return view(spark, sf, "access_log").select(
        "line_no", access.finding_id(F.col("user_id"), ref, F.lit("BULK_EXPORT")).alias("finding_id"))


@query("alert_dedup", f"""{BASE}
select 'bulk|' || user_id || '|' || cast(cast(ts as date) as varchar) as alert_key, count(*) as n,
 strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as kept_at, arg_min({REF}, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || {REF}) as kept
 from access_log where is_bulk group by 1""")
def alert_dedup(spark, sf):
    """Every bulk read raised as an alert, reduced to the first per user and day."""
    rows = log(spark, sf).where("is_bulk").withColumn("d", F.to_date("ts"))
    raised = access._finding(
        rows, "BULK_EXPORT", "HIGH", F.lit(""), {"date": F.col("d").cast("string")})
    once = access.alert_dedup(raised)
    counts = access.alert_keys(raised).groupBy("alert_key").agg(F.count(F.lit(1)).alias("n"))
    return once.join(counts, "alert_key").select("alert_key", "n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("kept_at"), F.col("raw_reference").alias("kept"))


# --- filters --------------------------------------------------------------------


@query("date_range", f"""{BASE}, gaps as (select line_no, case when line_no % 7 = 0 then null else ts end as ts from access_log)
select line_no from gaps where ts is null or cast(ts as date) between date '2024-01-08' and date '2024-01-14'""")
def date_range(spark, sf):
    gaps = view(spark, sf, "access_log").select(
        "line_no", F.when(F.col("line_no") % 7 == 0, F.lit(None)).otherwise(F.col("ts")).alias("ts"))
    return filters.date_range(gaps, "2024-01-08", "2024-01-14").select("line_no")


@query("business_hours", f"""{BASE}
select cast(hour(ts) as bigint) as h, hour(ts) >= 8 and hour(ts) < 19 as inside, count(*) as n from access_log group by 1, 2""")
def business_hours(spark, sf):
    return log(spark, sf).groupBy(
        F.hour("ts").cast("bigint").alias("h"), filters.in_business_hours(F.col("ts"), P).alias("inside")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("counter_eligible", f"""{BASE}, gaps as (select line_no, case when line_no % 7 = 0 then null else ts end as ts,
 case when line_no % 5 = 0 then null else user_id end as user_id from access_log)
select line_no, user_id from gaps where ts is not null and user_id is not null""")
def counter_eligible(spark, sf):
    gaps = view(spark, sf, "access_log").select(
        "line_no",
        F.when(F.col("line_no") % 7 == 0, F.lit(None)).otherwise(F.col("ts")).alias("ts"),
        F.when(F.col("line_no") % 5 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
    )
    return filters.counter_eligible(gaps).select("line_no", "user_id")


# --- daily-count store ------------------------------------------------------------


@query("daily_counts_merge", f"""{BASE},
days as (select user_id, cast(ts as date) as d, count(*) as cnt from access_log group by 1, 2),
old as (select user_id, d, cnt + 100 as cnt from days where d <= date '2024-01-20'),
cur as (select user_id, d, cnt from days where d >= date '2024-01-15')
select coalesce(cur.user_id, old.user_id) as user_id, cast(coalesce(cur.d, old.d) as varchar) as d, coalesce(cur.cnt, old.cnt) as cnt
from old full join cur on old.user_id = cur.user_id and old.d = cur.d
where coalesce(cur.d, old.d) >= date '2024-02-10' - 35""")
def daily_counts_merge(spark, sf):
    days = access.daily_counts(log(spark, sf))
    old = days.where("d <= '2024-01-20'").withColumn("cnt", F.col("cnt") + 100)
    merged = history.merge_daily_counts(old, days.where("d >= '2024-01-15'"), "2024-02-10", P)
    return merged.withColumn("d", F.col("d").cast("string"))
