"""Registered queries: roll-up and score (R), history (H), justification (J), report tables (T)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeledger.functions.pii_values import mask_value
from gazeledger.operators import access, exposure, filters, history, justify, reports, risk
from gazeledger.params import AuditParams
from gazeledger.plans.queries_access import BASE, ROLLING_SQL, _us, alert_sql, log, stats_ctes
from gazeledger.plans.registry import query
from gazeledger.plans.views import view
from gazeledger.session import materialise

# limits that spread the given users over all levels
R = AuditParams(
    max_queries_per_day=4, critical_queries_per_day=6, max_queries_per_hour=1, critical_queries_per_hour=5,
    after_hours_threshold=3, bulk_export_per_day=12, unique_targets_per_day=12,
    pii_exposure_medium=20_000, pii_exposure_high=60_000, pii_exposure_critical=400_000,
    pii_single_query_high=9_000, pii_single_query_critical=30_000, year_hint=2024,
)


def _x100(col: str):
    return F.floor(F.col(col) * 100 + 0.5).cast("bigint").alias(f"{col}_x100")


# --- SQL of the roll-up -----------------------------------------------------------



def findings_ctes(p: AuditParams) -> str:
    """CTEs ``rolled`` and ``findings`` over ``access_log``: all counter alerts and one finding per personal-data event."""
    parts = "\nunion all ".join(f"({sql})" for sql in alert_sql(p).values())
    pii = f"""select user_id, 'PII_EXPOSURE' as category,
 case when effective_exposure >= 20000 then 'CRITICAL' when effective_exposure >= 5000 then 'HIGH' else 'HIGH' end as severity,
 ts, source_file || ':' || cast(line_no as varchar) as reference, '' as evidence, 0 as measure
 from access_log where has_pii"""
    return f"""{ROLLING_SQL},
findings as (select user_id, category, severity, ts, reference, evidence, cast(measure as bigint) as measure
 from ({parts} union all ({pii})))"""


def summary_ctes(p: AuditParams) -> str:
    """CTE ``summary`` (and ``findings``) of all users of ``access_log``."""
    med, high, crit = p.pii_exposure_medium, p.pii_exposure_high, p.pii_exposure_critical
    stats = stats_ctes().split(",\n", 1)[1]
    stats = stats[stats.index("days as"):]
    return f"""{findings_ctes(p)},
{stats},
counted as (select user_id, count(*) as flagged_event_count,
  count(*) filter (where severity = 'CRITICAL') as critical_finding_count,
  count(*) filter (where severity = 'HIGH') as high_finding_count,
  count(*) filter (where category = 'PII_EXPOSURE') as pii_finding_count,
  count(*) filter (where category = 'EXCESSIVE_ACCESS') as excess_finding_count from findings group by 1),
evs as (select user_id, count(*) as total_events, count(*) filter (where has_pii) as pii_event_count,
  cast(coalesce(sum(effective_exposure) filter (where exposure_type in ('FULL_EXPOSURE','PARTIAL_EXPOSURE')),0) as bigint) as total_pii_records_exposed,
  coalesce(max(effective_exposure) filter (where exposure_type in ('FULL_EXPOSURE','PARTIAL_EXPOSURE')),0) as max_single_query_exposure,
  count(*) filter (where exposure_type in ('FULL_EXPOSURE','PARTIAL_EXPOSURE') and effective_exposure is null) as unknown_exposure_query_count,
  count(*) filter (where exposure_type in ('FULL_EXPOSURE','PARTIAL_EXPOSURE')) as select_pii_query_count,
  count(*) filter (where exposure_type = 'SEARCH_ONLY') as search_only_query_count from access_log group by 1),
rollup_rows as (select e.user_id, total_events, pii_event_count, total_pii_records_exposed, max_single_query_exposure,
  unknown_exposure_query_count, select_pii_query_count, search_only_query_count,
  max_queries_per_hour, max_queries_per_day, after_hours_count, bulk_export_count, unique_targets_per_day, peak_hour, peak_day,
  coalesce(flagged_event_count,0) as flagged_event_count, coalesce(critical_finding_count,0) as critical_finding_count,
  coalesce(high_finding_count,0) as high_finding_count, coalesce(pii_finding_count,0) as pii_finding_count,
  coalesce(excess_finding_count,0) as excess_finding_count
  from evs e left join stats s on s.user_id = e.user_id left join counted c on c.user_id = e.user_id),
parts as (select *,
  least(25.0::double, critical_finding_count * 4.0::double + high_finding_count * 1.5::double) as score_pii,
  least(30.0::double, greatest(
   case when total_pii_records_exposed >= {crit} then 30.0::double
    when total_pii_records_exposed >= {high} then 15.0::double + (total_pii_records_exposed - {high}) / {crit - high}::double * 15.0::double
    when total_pii_records_exposed >= {med} then 5.0::double + (total_pii_records_exposed - {med}) / {high - med}::double * 10.0::double
    else least(5.0::double, total_pii_records_exposed / {med}::double * 5.0::double) end,
   case when max_single_query_exposure >= {p.pii_single_query_critical} then 25.0::double
    when max_single_query_exposure >= {p.pii_single_query_high} then 15.0::double else 0.0::double end)) as score_exposure,
  least(20.0::double, max_queries_per_day / {p.max_queries_per_day}::double * 12.0::double
   + max_queries_per_hour / {p.max_queries_per_hour}::double * 8.0::double) as score_excess,
  least(10.0::double, after_hours_count / {p.after_hours_threshold}::double * 10.0::double)
   + least(10.0::double, bulk_export_count / {p.bulk_export_per_day}::double * 10.0::double)
   + least(5.0::double, unique_targets_per_day / {p.unique_targets_per_day}::double * 5.0::double) as score_behavior
  from rollup_rows),
totals as (select *, least(100.0::double, score_pii + score_exposure + score_excess + score_behavior) as risk_total from parts),
leveled as (select *, case when risk_total >= 70 then 4 when risk_total >= 45 then 3 when risk_total >= 20 then 2 else 1 end as l0 from totals),
summary as (select * exclude (l0), round_even(risk_total, 2) as risk_score, list_extract(['LOW','MEDIUM','HIGH','CRITICAL'], greatest(
   case when total_pii_records_exposed >= {crit} then 4 when total_pii_records_exposed >= {high} and l0 = 2 then 3 else l0 end,
   case when high_finding_count > 0 then 2 else 1 end, case when critical_finding_count > 0 then 3 else 1 end)) as risk_level
  from leveled)"""


SUMMARY = f"{BASE}, {summary_ctes(R)}"


def access_pii_findings(events: DataFrame) -> DataFrame:
    """One finding per personal-data event of the access log, in the findings layout."""
    from gazeledger.operators.pii import escalated_severity

    rows = events.where("has_pii")
    number = F.concat(F.lit("010-1234-"), F.lpad((F.col("line_no") % 10000).cast("string"), 4, "0"))
    out = access._finding(
        rows, "PII_EXPOSURE", escalated_severity(F.lit("HIGH"), F.col("effective_exposure"), R), F.lit(""), {
            "effective_exposure": F.col("effective_exposure"),
            "result_row_count": F.col("result_row_count"),
            "exposure_type": F.col("exposure_type"),
            "original_value": number,
            "redacted_value": mask_value(number, "PHONE"),
        })
    return out.withColumn("pii_types", F.array(F.lit("PHONE")))


def findings(spark: SparkSession, sf: str, params: AuditParams = R) -> DataFrame:
    events = log(spark, sf)
    return access_pii_findings(events).unionByName(access.access_findings(events, params, surge=False))


def summary(spark: SparkSession, sf: str, params: AuditParams = R) -> DataFrame:
    events = log(spark, sf)
    return risk.user_summary(
        events, findings(spark, sf, params), access.user_access_stats(events, params), params)


def audited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Findings and scored users as written tables, for queries that read them more than once."""
    events = log(spark, sf)
    found = materialise(findings(spark, sf), "findings")
    return found, materialise(
        risk.user_summary(events, found, access.user_access_stats(events, R), R), "summary")


@query("findings_union", f"""{BASE}, {findings_ctes(R)}
select user_id, category, severity, epoch_us(ts) as ts_us, reference as raw_reference from findings""")
def findings_union(spark, sf):
    events = log(spark, sf)
    both = risk.findings_union(access_pii_findings(events), access.access_findings(events, R, surge=False))
    return both.select("user_id", "category", "severity", _us().alias("ts_us"), "raw_reference")


@query("finding_counts", f"{BASE}, {findings_ctes(R)}, " + """c as (select user_id, count(*) as flagged_event_count,
  count(*) filter (where severity = 'CRITICAL') as critical_finding_count,
  count(*) filter (where severity = 'HIGH') as high_finding_count,
  count(*) filter (where category = 'PII_EXPOSURE') as pii_finding_count,
  count(*) filter (where category = 'EXCESSIVE_ACCESS') as excess_finding_count from findings group by 1) select * from c""")
def finding_counts(spark, sf):
    return risk.finding_counts(findings(spark, sf))


@query("user_rollup", f"{SUMMARY} select * from rollup_rows")
def user_rollup(spark, sf):
    events = log(spark, sf)
    return risk.user_rollup(events, findings(spark, sf), access.user_access_stats(events, R)).drop("pii_types")


def _score(name: str) -> None:
    @query(name, f"{SUMMARY} select user_id, cast(floor({name} * 100 + 0.5) as bigint) as {name}_x100 from summary")
    def run(spark, sf):
        return summary(spark, sf).select("user_id", _x100(name))


for _name in ("score_pii", "score_exposure", "score_excess", "score_behavior"):
    _score(_name)


@query("risk_level", f"{SUMMARY} select user_id, cast(floor(risk_total * 100 + 0.5) as bigint) as risk_total_x100, risk_level from summary")
def risk_level(spark, sf):
    return summary(spark, sf).select("user_id", _x100("risk_total"), "risk_level")


@query("rank_users", f"""{SUMMARY} select user_id, risk_level,
 row_number() over (order by risk_score desc, user_id) as position from summary""")
def rank_users(spark, sf):
    users = audited(spark, sf)[1].select("user_id", "risk_level", "risk_score")
    return risk.user_ranks(users).select("user_id", "risk_level", "position")


@query("top_k_users", f"""{SUMMARY} select user_id, cast(floor(risk_score * 100 + 0.5) as bigint) as risk_score_x100, risk_level
 from summary order by risk_score desc, user_id limit 10""")
def top_k_users(spark, sf):
    return risk.top_k_users(summary(spark, sf)).select("user_id", _x100("risk_score"), "risk_level")


@query("risk_distribution", f"""{SUMMARY} select l.risk_level, count(s.user_id) as users
 from (select unnest(['LOW','MEDIUM','HIGH','CRITICAL']) as risk_level) l left join summary s on s.risk_level = l.risk_level group by 1""")
def risk_distribution(spark, sf):
    return risk.risk_distribution(summary(spark, sf))


STATS_SQL = """select count(*) as total_users, count(*) filter (where risk_level = 'CRITICAL') as critical_users,
 count(*) filter (where risk_level = 'HIGH') as high_users, count(*) filter (where risk_level = 'MEDIUM') as medium_users,
 count(*) filter (where risk_level = 'LOW') as low_users, cast(sum(flagged_event_count) as bigint) as total_findings,
 cast(sum(pii_finding_count) as bigint) as pii_findings, cast(sum(excess_finding_count) as bigint) as excess_findings,
 cast(sum(total_pii_records_exposed) as bigint) as total_pii_records_exposed,
 max(max_single_query_exposure) as max_single_query_exposure,
 count(*) filter (where select_pii_query_count > 0) as select_pii_users from summary"""


@query("global_stats", f"{SUMMARY} {STATS_SQL}")
def global_stats(spark, sf):
    return risk.global_stats(summary(spark, sf)).drop("pii_types")


@query("min_risk", f"{SUMMARY} select user_id, risk_level from summary where risk_level in ('HIGH','CRITICAL')")
def min_risk(spark, sf):
    return filters.min_risk(summary(spark, sf), "HIGH").select("user_id", "risk_level")


@query("category_selection", f"""{SUMMARY}, kept as (select user_id, count(*) as n, count(*) filter (where severity = 'CRITICAL') as c,
 count(*) filter (where severity = 'HIGH') as h from findings where category in ('EXCESSIVE_ACCESS','BULK_EXPORT') group by 1)
select s.user_id, coalesce(n, 0) as flagged_event_count, cast(0 as bigint) as total_pii_records_exposed, cast(0 as bigint) as after_hours_count,
 max_queries_per_day, bulk_export_count,
 cast(floor(least(25.0::double, coalesce(c,0) * 4.0::double + coalesce(h,0) * 1.5::double) * 100 + 0.5) as bigint) as score_pii_x100,
 cast(0 as bigint) as score_exposure_x100
from summary s left join kept k on k.user_id = s.user_id""")
def category_selection(spark, sf):
    """Excess check alone: misuse findings go and misuse measures are zero before scoring."""
    events = log(spark, sf)
    users = risk.user_summary(
        events, findings(spark, sf), access.user_access_stats(events, R), R, misuse=False, excess=True)
    return users.select(
        "user_id", "flagged_event_count", "total_pii_records_exposed", "after_hours_count",
        "max_queries_per_day", "bulk_export_count", _x100("score_pii"), _x100("score_exposure"))


# --- exposure per user ------------------------------------------------------------


@query("exposure_rollup", f"""{SUMMARY} select user_id, total_pii_records_exposed, max_single_query_exposure,
 unknown_exposure_query_count, select_pii_query_count, search_only_query_count from evs""")
def exposure_rollup(spark, sf):
    return exposure.exposure_rollup(view(spark, sf, "access_log"))


@query("exposure_level", f"""{SUMMARY} select user_id, case when total_pii_records_exposed >= {R.pii_exposure_critical} then 'CRITICAL'
 when total_pii_records_exposed >= {R.pii_exposure_high} then 'HIGH' when total_pii_records_exposed >= {R.pii_exposure_medium} then 'MEDIUM'
 else 'LOW' end as exposure_level from evs""")
def exposure_level(spark, sf):
    rows = exposure.exposure_rollup(view(spark, sf, "access_log"))
    return rows.select("user_id", exposure.exposure_level(F.col("total_pii_records_exposed"), R).alias("exposure_level"))


@query("exposure_display", f"""{SUMMARY} select user_id, format('{{:,}}', total_pii_records_exposed) || '건' ||
 case when unknown_exposure_query_count > 0 then ' + 건수미확인 ' || cast(unknown_exposure_query_count as varchar) || '건' else '' end
 as exposure_display from evs""")
def exposure_display(spark, sf):
    return reports.user_display(exposure.exposure_rollup(view(spark, sf, "access_log")))


# --- history ----------------------------------------------------------------------

WEEKS = {"before": ("2024-01-08", "2024-01-14"), "now": ("2024-01-15", "2024-01-21")}


def _period_summary(spark: SparkSession, sf: str, period: str) -> DataFrame:
    start, end = WEEKS[period]
    events = filters.date_range(log(spark, sf), start, end)
    found = access_pii_findings(events).unionByName(access.access_findings(events, R, surge=False))
    return risk.user_summary(events, found, access.user_access_stats(events, R), R)


def _period_sql(period: str) -> str:
    """A subquery with the summary of one week."""
    start, end = WEEKS[period]
    base = BASE.replace("from events", f"from events where cast(ts as date) between date '{start}' and date '{end}'")
    return f"({base}, {summary_ctes(R)} select * from summary)"


BOTH_WEEKS = f"WITH now_s AS {_period_sql('now')}, old_s AS {_period_sql('before')}"


def _weeks(spark, sf):
    now, old = (materialise(_period_summary(spark, sf, p), p) for p in ("now", "before"))
    start, end = WEEKS["before"]
    return now, history.snapshot_users(old, "r1", start, end)


@query("user_deltas", f"""{BOTH_WEEKS} select n.user_id,
 cast(floor((n.risk_score - o.risk_score) * 100 + 0.5) as bigint) as risk_score_x100,
 n.total_events - o.total_events as total_events, n.pii_event_count - o.pii_event_count as pii_event_count,
 n.max_queries_per_day - o.max_queries_per_day as max_queries_per_day,
 n.max_queries_per_hour - o.max_queries_per_hour as max_queries_per_hour,
 n.after_hours_count - o.after_hours_count as after_hours_count, n.bulk_export_count - o.bulk_export_count as bulk_export_count,
 n.flagged_event_count - o.flagged_event_count as flagged_event_count,
 n.total_pii_records_exposed - o.total_pii_records_exposed as total_pii_records_exposed,
 n.max_single_query_exposure - o.max_single_query_exposure as max_single_query_exposure,
 o.risk_level as risk_level_prev from now_s n join old_s o on o.user_id = n.user_id""")
def user_deltas(spark, sf):
    now, old = _weeks(spark, sf)
    return history.user_deltas(now, old).drop("pii_types_prev").withColumn(
        "risk_score", F.floor(F.col("risk_score") * 100 + 0.5).cast("bigint")).withColumnRenamed("risk_score", "risk_score_x100")


@query("trend_arrow", f"""{BOTH_WEEKS}, d as (select n.user_id, n.total_events - o.total_events as delta
 from now_s n join old_s o on o.user_id = n.user_id)
select user_id, case when delta > 0 then '↑' when delta < 0 then '↓' else '→' end || ' ' ||
 case when delta >= 0 then '+' else '' end || cast(delta as varchar) as label from d""")
def trend_arrow(spark, sf):
    now, old = _weeks(spark, sf)
    return history.user_deltas(now, old).select("user_id", history.trend_label(F.col("total_events")).alias("label"))


@query("newly_risky", f"""{BOTH_WEEKS} select n.user_id, o.risk_level as prev_level, n.risk_level
 from now_s n join old_s o on o.user_id = n.user_id
 where n.risk_level in ('HIGH','CRITICAL') and o.risk_level in ('LOW','MEDIUM')""")
def newly_risky(spark, sf):
    now, old = _weeks(spark, sf)
    deltas = history.user_deltas(now, old)
    compared = history.with_deltas(now, deltas, deltas.where(F.lit(False)))
    return history.newly_risky(compared, "any").select("user_id", "prev_level", "risk_level")


@query("prior_score", f"""{BOTH_WEEKS} select n.user_id, cast(floor(o.risk_score * 100 + 0.5) as bigint) as prior_score_x100
 from now_s n join old_s o on o.user_id = n.user_id""")
def prior_score(spark, sf):
    now, old = _weeks(spark, sf)
    deltas = history.user_deltas(now, old).select("user_id", F.col("risk_score").alias("delta"))
    return now.join(deltas, "user_id").select(
        "user_id",
        F.floor(history.prior_score(F.col("risk_score"), F.col("delta")) * 100 + 0.5).cast("bigint").alias("prior_score_x100"))


# runs made from the order dates: one run per day, of 5 to 9 days length
RUNS_SQL = """runs as (select 'r' || cast(o_orderdate as varchar) as run_id, cast(o_orderdate as date) as start_date,
 cast(o_orderdate as date) + cast(4 + count(*) % 5 as integer) as end_date, cast(5 + count(*) % 5 as integer) as period_days,
 cast(max(o_orderkey) as bigint) as saved, count(*) as user_count from orders group by o_orderdate)"""


def _runs(spark, sf):
    n = F.count(F.lit(1))
    days = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("start_date"), F.col("o_orderdate").cast("string").alias("s")).agg(
        n.alias("user_count"), F.max("o_orderkey").alias("saved"))
    return days.select(
        F.concat(F.lit("r"), "s").alias("run_id"), "start_date",
        F.date_add("start_date", (4 + F.col("user_count") % 5).cast("int")).alias("end_date"),
        (5 + F.col("user_count") % 5).cast("int").alias("period_days"),
        F.timestamp_seconds("saved").cast("timestamp_ntz").alias("saved_at"),
        "user_count", F.col("user_count").alias("total_events"), F.col("user_count").alias("total_lines"),
    )


TARGET = (date(1995, 6, 5), date(1995, 6, 11))


@query("snapshot_list", f"""WITH {RUNS_SQL} select run_id, cast(start_date as varchar) as start_date,
 cast(end_date as varchar) as end_date, cast(period_days as bigint) as period_days, user_count from runs""")
def snapshot_list(spark, sf):
    return history.snapshot_list(_runs(spark, sf)).select(
        "run_id", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        F.col("period_days").cast("bigint").alias("period_days"), "user_count")


@query("snapshot_exact", f"""WITH {RUNS_SQL}, t as (select max(start_date) as s from runs where period_days = 7)
select run_id from runs, t where start_date = s and end_date = s + 6""")
def snapshot_exact(spark, sf):
    runs = _runs(spark, sf)
    # the newest week-long run, found by data; one row
    newest = runs.where("period_days = 7").agg(F.max("start_date").alias("s")).first()["s"]
    from datetime import timedelta

    return history.snapshot_exact(runs, newest, newest + timedelta(days=6))


@query("snapshot_closest", f"""WITH {RUNS_SQL}
select run_id, cast(abs(start_date - date '{TARGET[0]}') + abs(end_date - date '{TARGET[1]}') as bigint) as distance
from runs where abs(period_days - 7) <= 3
order by abs(start_date - date '{TARGET[0]}') + abs(end_date - date '{TARGET[1]}'), start_date, end_date limit 1""")
def snapshot_closest(spark, sf):
    return history.snapshot_closest(_runs(spark, sf), *TARGET, R).select("run_id", F.col("distance").cast("bigint").alias("distance"))


@query("prior_periods", f"""WITH {RUNS_SQL}, shifts as (select 'week' as name, 7 as n union all select 'month', 30),
ranked as (select name, run_id, row_number() over (partition by name order by
  case when start_date = date '{TARGET[0]}' - n and end_date = date '{TARGET[1]}' - n then 0 else 1 end,
  abs(start_date - (date '{TARGET[0]}' - n)) + abs(end_date - (date '{TARGET[1]}' - n)), start_date, end_date) as turn
 from runs, shifts where abs(period_days - 7) <= 3)
select name, run_id from ranked where turn = 1""")
def prior_periods(spark, sf):
    runs = _runs(spark, sf)
    parts = [
        history.prior_users(runs, runs.select("run_id"), *TARGET, days, R).select(F.lit(name).alias("name"), "run_id")
        for name, days in history.SHIFTS.items()
    ]
    return parts[0].unionByName(parts[1])


# --- justification ------------------------------------------------------------------

d4, h4 = R.max_queries_per_day, R.max_queries_per_hour
JUST_SQL = f"""{SUMMARY}, cand as (select *,
 (case when max_single_query_exposure >= 20000 then 55 when max_single_query_exposure >= 5000 then 35 when max_single_query_exposure >= 1000 then 15 else 0 end
 + case when total_pii_records_exposed >= 100000 then 40 when total_pii_records_exposed >= 50000 then 30
     when total_pii_records_exposed >= 10000 then 20 when total_pii_records_exposed >= 1000 then 8 else 0 end
 + case when after_hours_count >= 20 then 40 when after_hours_count >= 5 then 25 when after_hours_count >= 1 then 12 else 0 end
 + case when max_queries_per_day >= {d4 * 4} then 30 when max_queries_per_day >= {d4 * 2} then 20 when max_queries_per_day >= {d4} then 8 else 0 end
 + case when max_queries_per_hour >= {h4 * 4} then 20 when max_queries_per_hour >= {h4} then 10 else 0 end
 + least(20, bulk_export_count * 5)) * (case when risk_level = 'CRITICAL' then 1.25::double else 1.0::double end) as priority_score
 from summary where risk_level in ('CRITICAL','HIGH','MEDIUM')),
ranked as (select *, case when priority_score >= 100 then '즉시' when priority_score >= 60 then '긴급' else '검토' end as urgency,
 row_number() over (order by priority_score desc, risk_score desc, user_id) as priority_rank from cand)"""


def scored(spark, sf):
    return justify.justification_scores(audited(spark, sf)[1], R)


@query("just_candidates", f"{JUST_SQL} select user_id, risk_level from cand")
def just_candidates(spark, sf):
    return justify.just_candidates(summary(spark, sf)).select("user_id", "risk_level")


@query("priority_score", f"{JUST_SQL} select user_id, cast(floor(priority_score * 100 + 0.5) as bigint) as priority_score_x100 from cand")
def priority_score(spark, sf):
    return scored(spark, sf).select("user_id", _x100("priority_score"))


@query("urgency", f"{JUST_SQL} select urgency, count(*) as users from ranked group by 1")
def urgency(spark, sf):
    return scored(spark, sf).groupBy("urgency").agg(F.count(F.lit(1)).alias("users"))


@query("priority_rank", f"{JUST_SQL} select user_id, priority_rank from ranked")
def priority_rank(spark, sf):
    return scored(spark, sf).select("user_id", "priority_rank")


@query("top_k_justification", f"{JUST_SQL} select user_id, priority_rank, urgency from ranked where priority_rank <= 10")
def top_k_justification(spark, sf):
    return justify.top_k_justification(scored(spark, sf)).select("user_id", "priority_rank", "urgency")


_fmt = lambda c: f"format('{{:,}}', {c})"
REASONS_SQL = f"""{JUST_SQL}, night as (select user_id, strftime(ts, '%Y-%m-%d') as d, hour(ts) as h, measure, reference from (
  select *, row_number() over (partition by user_id order by ts, reference) as turn from findings
  where category = 'AFTER_HOURS' and hour(ts) <> 0) where turn = 1),
sentences as (select r.user_id, list_filter([
 case when max_single_query_exposure >= 20000 then '[긴급] 단일 쿼리 1건에서 개인정보 ' || {_fmt('max_single_query_exposure')} || '건 일시 노출 — 의도적 대량 추출 또는 무단 반출 가능성'
  when max_single_query_exposure >= 5000 then '단일 쿼리에서 개인정보 ' || {_fmt('max_single_query_exposure')} || '건 반환 (화면 또는 API 응답으로 노출된 것으로 추정)'
  when max_single_query_exposure >= 1000 then '단일 쿼리에서 개인정보 ' || {_fmt('max_single_query_exposure')} || '건 반환' end,
 case when total_pii_records_exposed >= 10000 then '점검 기간 내 이름·전화번호 등 개인정보가 포함된 쿼리를 ' || {_fmt('select_pii_query_count')} || '건 실행, 총 ' || {_fmt('total_pii_records_exposed')} || '건의 개인정보 레코드 노출 추정'
  when total_pii_records_exposed >= 1000 then 'SELECT 절에 개인정보 컬럼을 포함한 쿼리 ' || {_fmt('select_pii_query_count')} || '건 실행, 총 ' || {_fmt('total_pii_records_exposed')} || '건 노출 추정' end,
 case when after_hours_count > 0 then '업무 시간(08:00~19:00) 외 개인정보 조회 ' || {_fmt('after_hours_count')} || '건 발생 (개인정보보호법 시행령 제30조 접근권한 관리 위반 소지)' end,
 case when max_queries_per_day >= {d4} then '일별 최대 ' || {_fmt('max_queries_per_day')} || '회 조회 — 정책 임계값({d4}회) 대비 ' || {_fmt(f'(max_queries_per_day - {d4})')} || '회 초과 (비정상 자동화 또는 반복 접근 의심)' end,
 case when max_queries_per_hour >= {h4} then '1시간 내 최대 ' || {_fmt('max_queries_per_hour')} || '회 집중 조회 (임계값 {h4}회 초과 — 스크립트·매크로 사용 의심)' end,
 case when bulk_export_count > 0 then '대량 데이터 조회(BULK) ' || {_fmt('bulk_export_count')} || '건 발생 — 데이터 추출·외부 전송 가능성 확인 필요' end,
 case when n.user_id is not null then '최초 야간 조회 사례: ' || n.d || ' ' || lpad(cast(n.h as varchar), 2, '0') || '시경 개인정보 ' || cast(n.measure as varchar) || '건 조회 (참조: ' || n.reference || ')' end
 ], lambda x: x is not null) as reasons, max_single_query_exposure as m, total_pii_records_exposed as t, after_hours_count as a, max_queries_per_day as q
 from ranked r left join night n on n.user_id = r.user_id)"""


def _with_reasons(spark, sf):
    found, users = audited(spark, sf)
    nights = justify.first_after_hours(found)
    return justify.justification_scores(users, R).join(nights, "user_id", "left").withColumn("reasons", justify.reasons(R))


@query("reasons", f"{REASONS_SQL} select user_id, array_to_string(reasons, '|') as reasons from sentences")
def reasons(spark, sf):
    return _with_reasons(spark, sf).select("user_id", F.array_join("reasons", "|").alias("reasons"))


@query("one_line", f"""{REASONS_SQL}, p as (select *, list_filter([
  case when m >= 20000 then '단일 ' || {_fmt('m')} || '건 노출' when t >= 10000 then '총 ' || {_fmt('t')} || '건 노출' end,
  case when a > 0 then '야간 ' || cast(a as varchar) || '건' end,
  case when q >= {d4} then '일 ' || {_fmt('q')} || '회 과다조회' end], lambda x: x is not null) as parts from sentences)
select user_id, user_id || ': ' || case when len(parts) > 0 then array_to_string(parts, ' / ') else substr(reasons[1], 1, 60) end as summary_one_line from p""")
def one_line(spark, sf):
    return _with_reasons(spark, sf).select(
        "user_id", justify.one_line(R, F.get("reasons", 0)).alias("summary_one_line"))


KEY_SQL = f"""{SUMMARY}, keyed as (select f.*, s.risk_level, a.exposure_type, a.result_row_count, a.line_no, row_number() over (partition by f.user_id order by
 case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end,
 case when category = 'PII_EXPOSURE' then -coalesce(a.effective_exposure, 0) else 0 end,
 f.ts, reference, substr(sha256(f.user_id || reference || category),1,12), category, evidence) as finding_rank
 from findings f join summary s on s.user_id = f.user_id
 left join access_log a on a.source_file || ':' || cast(a.line_no as varchar) = f.reference)"""


@query("key_findings", f"""{KEY_SQL} select user_id, cast(finding_rank as bigint) as finding_rank, category, risk_level as severity,
 strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp_str, reference as raw_reference from keyed where finding_rank <= 5""")
def key_findings(spark, sf):
    rows = justify.key_finding_rows(*audited(spark, sf))
    return rows.select(
        "user_id", F.col("finding_rank").cast("bigint").alias("finding_rank"), "category", "severity",
        "timestamp_str", "raw_reference")


_HOW = (
    "\n▶ 실제 화면 내용을 정확히 확인하려면:\n   1) DB 감사 로그에서 해당 세션 ID의 쿼리 및 Rows_sent 확인\n"
    "   2) 애플리케이션 서버 로그에서 API 응답 내용 또는 화면 렌더링 데이터 확인\n"
    "   3) DB Performance Schema / Slow Query Log 상세 조회\n"
    "   4) DLP 솔루션 또는 네트워크 패킷 캡처 (민감정보 탐지 솔루션 연동 시)\n"
    "   ※ 본 보고서의 수치는 SELECT 쿼리 분석 기반 추정값입니다."
)


# every user of the given tables has shown something, so the text for "nothing shown" is left to the tests
SCREEN_SQL = f"""array_to_string(list_filter(['▶ 화면(또는 API 응답) 노출 추정',
 case when select_pii_query_count > 0 and total_pii_records_exposed > 0 then '   이름·전화번호·주소 등 개인정보 컬럼을 SELECT 절에 포함한 쿼리 '
  || {_fmt('select_pii_query_count')} || '건이 실행되었으며,
   이 쿼리들이 반환한 결과 건수를 합산하면 총 ' || {_fmt('total_pii_records_exposed')} || '건의 개인정보 레코드가 화면 또는 응답으로 전달된 것으로 추정됩니다.' end,
 case when max_single_query_exposure > 0 then '
   ※ 단일 조회 최대 노출: ' || {_fmt('max_single_query_exposure')} || '건
      (한 번의 쿼리로 ' || {_fmt('max_single_query_exposure')} || '명 분량의 개인정보가 한꺼번에 반환)' end,
 case when unknown_exposure_query_count > 0 then '
   ※ 결과 건수 확인 불가 쿼리 ' || {_fmt('unknown_exposure_query_count')} || '건 추가 존재
      (로그에 결과 건수가 기록되지 않아 위 수치에 미포함 — 실제 노출량은 더 클 수 있음)' end,
 '{_HOW}'], lambda x: x is not null), chr(10))"""


@query("screen_estimate", f"{SUMMARY} select user_id, {SCREEN_SQL} as screen_estimate from summary")
def screen_estimate(spark, sf):
    return summary(spark, sf).select("user_id", justify.screen_estimate().alias("screen_estimate"))


QUESTIONS_SQL = f"""list_filter([
 case when total_pii_records_exposed >= 1000 or select_pii_query_count > 0 then '이름·전화번호 등 개인정보 컬럼이 포함된 쿼리를 점검 기간 내 '
  || {_fmt('select_pii_query_count')} || '건 실행하셨습니다. 각 조회의 구체적인 업무 목적을 설명해 주세요.' end,
 case when max_single_query_exposure >= 5000 then '단일 쿼리에서 ' || {_fmt('max_single_query_exposure')}
  || '건의 개인정보를 한꺼번에 조회하셨습니다. 해당 조회가 필요했던 구체적 업무를 설명하고, 결과 데이터를 어떻게 활용하셨는지 (화면 확인, 파일 저장, 외부 전송 여부) 답변해 주세요.' end,
 case when after_hours_count > 0 then '업무 시간(08:00~19:00) 외에 개인정보를 포함한 조회가 ' || {_fmt('after_hours_count')}
  || '건 발생하였습니다. 야간·주말 조회가 필요했던 사유와 승인 여부를 설명해 주세요.' end,
 case when max_queries_per_day >= {d4} then '하루 최대 ' || {_fmt('max_queries_per_day')}
  || '회의 조회가 발생하였습니다. 단시간 내 대량 조회가 발생한 상황(자동화 스크립트 사용 여부, 특정 작업 수행 여부)을 설명해 주세요.' end,
 case when bulk_export_count > 0 then '대량 데이터 조회가 ' || {_fmt('bulk_export_count')}
  || '건 감지되었습니다. 데이터를 파일로 내려받거나 외부 시스템으로 전송하셨다면 목적, 상대방, 현재 보관 방법을 알려주세요.' end,
 '조회하신 개인정보를 업무 목적 외 용도로 활용하거나, 외부로 반출(출력, 다운로드, 메신저·이메일 전송 등)하신 사례가 있으신가요? 있다면 상세 내용을 기재해 주세요.'
 ], lambda x: x is not null)"""


@query("questions", f"{JUST_SQL} select user_id, array_to_string({QUESTIONS_SQL}, '|') as questions from cand")
def questions(spark, sf):
    return scored(spark, sf).select("user_id", F.array_join(justify.questions(R), "|").alias("questions"))


# --- report tables ------------------------------------------------------------------


@query("rpt_summary", f"{SUMMARY} {STATS_SQL}")
def rpt_summary(spark, sf):
    return reports.rpt_summary(summary(spark, sf)).drop("pii_types")


LABEL_SQL = "case {0} when 'CRITICAL' then '최고위험' when 'HIGH' then '고위험' when 'MEDIUM' then '중위험' else '저위험' end"


@query("rpt_users", f"""{SUMMARY} select user_id, total_events, pii_event_count, '-' as pii_types_str, total_pii_records_exposed,
 max_single_query_exposure, select_pii_query_count, max_queries_per_hour, max_queries_per_day, peak_hour, peak_day,
 after_hours_count, bulk_export_count, flagged_event_count, cast(floor(risk_score * 100 + 0.5) as bigint) as risk_score_x100,
 {LABEL_SQL.format('risk_level')} as risk_label from summary""")
def rpt_users(spark, sf):
    return reports.rpt_users(summary(spark, sf)).withColumn(
        "risk_score", F.floor(F.col("risk_score") * 100 + 0.5).cast("bigint")).withColumnRenamed("risk_score", "risk_score_x100")


@query("rpt_pii_detail", f"""{SUMMARY} select f.user_id, strftime(f.ts, '%Y-%m-%d %H:%M:%S') as timestamp_str, 'PHONE' as pii_types_str,
 case a.exposure_type when 'PARTIAL_EXPOSURE' then 'PII컬럼직접출력' when 'NONE' then '없음' else '?' end as exposure_label,
 coalesce(cast(a.result_row_count as varchar), '건수미확인') as result_rows, {LABEL_SQL.format('s.risk_level')} as risk_label, reference as raw_reference,
 '010-****-' || lpad(cast(a.line_no % 10000 as varchar), 4, '0') as value, '' as evidence
 from findings f join summary s on s.user_id = f.user_id
 join access_log a on a.source_file || ':' || cast(a.line_no as varchar) = f.reference where category = 'PII_EXPOSURE'
 order by s.risk_score desc, f.user_id, f.ts""")
def rpt_pii_detail(spark, sf):
    return reports.rpt_pii_detail(*audited(spark, sf))


@query("rpt_finding_detail", f"""{SUMMARY} select f.user_id, strftime(f.ts, '%Y-%m-%d %H:%M:%S') as timestamp_str,
 case category when 'PII_EXPOSURE' then 'PII 오남용' when 'PII_RECORD_EXPOSURE' then 'PII 레코드 노출' when 'EXCESSIVE_ACCESS' then '과다조회'
  when 'AFTER_HOURS' then '업무외시간조회' else '대량조회' end as category_label,
 case when category = 'PII_EXPOSURE' then 'PHONE' else '-' end as pii_types_str,
 {LABEL_SQL.format('s.risk_level')} as risk_label, evidence, reference as raw_reference
 from findings f join summary s on s.user_id = f.user_id""")
def rpt_finding_detail(spark, sf):
    return reports.rpt_finding_detail(*audited(spark, sf))


def _items(spark, sf):
    found, users = audited(spark, sf)
    return justify.justification(users, found, R)


_TENTHS = "((cast(floor(r.risk_score * 100 + 0.5) as bigint) + 5) // 10)"


@query("rpt_justification", f"""{REASONS_SQL} select '#' || cast(r.priority_rank as varchar) || chr(10) || r.urgency as priority, r.user_id,
 {LABEL_SQL.format('r.risk_level')} as risk_label,
 cast({_TENTHS} // 10 as varchar) || '.' || cast({_TENTHS} % 10 as varchar) as risk_score_text,
 coalesce(array_to_string(list_transform(s.reasons, lambda x: '• ' || x), chr(10)), '') as reasons,
 array_to_string(list_transform(q.questions, lambda x, i: 'Q' || cast(i as varchar) || '. ' || x), chr(10)) as questions,
 '' as explanation, '' as handling
 from ranked r join sentences s on s.user_id = r.user_id join (select user_id, {QUESTIONS_SQL} as questions from cand) q on q.user_id = r.user_id""")
def rpt_justification(spark, sf):
    return reports.rpt_justification(_items(spark, sf))


@query("rpt_evidence", f"""{JUST_SQL}{KEY_SQL[len(SUMMARY):]}, shown as (select user_id, {SCREEN_SQL} as screen_estimate from summary)
select k.user_id, '#' || cast(r.priority_rank as varchar) as priority, {LABEL_SQL.format('k.risk_level')} as severity_kr,
 strftime(k.ts, '%Y-%m-%d %H:%M:%S') as timestamp_str,
 case category when 'PII_EXPOSURE' then '개인정보 노출' when 'PII_RECORD_EXPOSURE' then '단일 대량 개인정보 노출' when 'EXCESSIVE_ACCESS' then '과다조회'
  when 'AFTER_HOURS' then '업무외시간 조회' else '대량 조회' end as category_kr,
 case when category = 'PII_EXPOSURE' then 'PHONE' else '-' end as pii_types_str,
 case when category = 'PII_EXPOSURE' then '010-****-' || lpad(cast(k.line_no % 10000 as varchar), 4, '0') else '' end as value,
 case when category <> 'PII_EXPOSURE' then '' when k.exposure_type = 'FULL_EXPOSURE' then '전체컬럼 노출(SELECT*)'
  when k.exposure_type = 'PARTIAL_EXPOSURE' then 'PII컬럼 직접 출력' when k.exposure_type = 'SEARCH_ONLY' then '검색조건만 사용' else '' end as exposure_type_kr,
 case when category = 'PII_EXPOSURE' then coalesce(cast(k.result_row_count as varchar), '미상') else '미상' end as result_rows,
 k.evidence, k.reference as raw_reference, cast(k.finding_rank as integer) as finding_rank, s.screen_estimate
 from keyed k join ranked r on r.user_id = k.user_id join shown s on s.user_id = k.user_id where k.finding_rank <= 5""")
def rpt_evidence(spark, sf):
    return reports.rpt_evidence(_items(spark, sf))


# users that the earlier month knows as well
MONTH_USERS = "length(user_id) % 2 = 0"


@query("rpt_comparison", f"""{BOTH_WEEKS} select n.user_id, {LABEL_SQL.format('n.risk_level')} as risk_label,
 case when o.user_id is null then '-' when n.risk_score > o.risk_score then '↑ 증가' when n.risk_score < o.risk_score then '↓ 감소' else '→ 유지' end as week_trend,
 case when o.user_id is null then '-' else case when n.pii_event_count >= o.pii_event_count then '+' else '' end || cast(n.pii_event_count - o.pii_event_count as varchar) end as week_pii_change,
 case when m.user_id is null then '-' when n.risk_score > m.risk_score then '↑ 증가' when n.risk_score < m.risk_score then '↓ 감소' else '→ 유지' end as month_trend,
 case when m.user_id is null then '-' else case when n.pii_event_count >= m.pii_event_count then '+' else '' end || cast(n.pii_event_count - m.pii_event_count as varchar) end as month_pii_change,
 case when m.user_id is null then '-' else case when n.max_queries_per_day >= m.max_queries_per_day then '+' else '' end || cast(n.max_queries_per_day - m.max_queries_per_day as varchar) end as month_day_max_change,
 n.pii_event_count, n.max_queries_per_day, n.after_hours_count,
 case when n.risk_level in ('HIGH','CRITICAL') and o.risk_level in ('LOW','MEDIUM') then o.risk_level || ' → ' || n.risk_level else '-' end as new_risk
 from now_s n left join old_s o on o.user_id = n.user_id
 left join (select * from old_s where {MONTH_USERS}) m on m.user_id = n.user_id""")
def rpt_comparison(spark, sf):
    now, old = _weeks(spark, sf)
    week = history.user_deltas(now, old)
    table = reports.rpt_comparison(now, week, week.where(MONTH_USERS))
    return table.select(
        "user_id", "risk_label", "week_trend", "week_pii_change", "month_trend", "month_pii_change", "month_day_max_change",
        "pii_event_count", "max_queries_per_day", "after_hours_count", "new_risk")


@query("rpt_display", f"""{BASE}, {findings_ctes(R)} select user_id, reference as raw_reference,
 strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp_str, case when category = 'PII_EXPOSURE' then 'PHONE' else '-' end as pii_types_str,
 {LABEL_SQL.format('severity')} as severity_label, category from findings""")
def rpt_display(spark, sf):
    rows = findings(spark, sf)
    shown = reports.rpt_display(rows.withColumn("finding_id", F.concat_ws("|", "category", "raw_reference")))
    parts = F.split("finding_id", r"\|")
    return shown.select(
        "user_id", F.get(parts, 1).alias("raw_reference"), "timestamp_str", "pii_types_str", "severity_label",
        F.get(parts, 0).alias("category"))


@query("field_labels", """select event_id as line_no, case event_id % 4 when 0 then '개인정보 컬럼' when 1 then '이름, 전화번호'
 when 2 then '이메일, other_column, 카드번호' else '생년월일' end as labels from events""")
def field_labels(spark, sf):
    """Names of selected columns as labels: known and unknown ones, in either case, repeated, and none."""
    fields = [[], ["NAME", "phone", "name", "tel"], ["email", "other_column", "card_no", "Mail"], ["dob", "birthdate"]]
    arrays = F.array(*[F.array(*[F.lit(x) for x in own]).cast("array<string>") for own in fields])
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("line_no"), justify.field_labels(F.get(arrays, (F.col("event_id") % 4).cast("int"))).alias("labels"))
