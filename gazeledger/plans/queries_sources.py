"""Registered queries: sources and sinks (S) and the streaming forms (X).

Each writes data derived from the given tables into the shared folder, reads it back through the source
under test, and is compared with the tables themselves.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeledger.operators import access
from gazeledger.operators.ordered import running
from gazeledger.plans.queries_access import BASE, ROLLING_SQL, P, alert_sql, log
from gazeledger.plans.queries_risk import LABEL_SQL, SUMMARY, audited
from gazeledger.plans.queries_text import RAW_PHONE, RAW_PII, R, SEC
from gazeledger.plans.registry import query
from gazeledger.plans.views import texts, view, with_views
from gazeledger.session import new_folder
from gazeledger.sources import records, store, text, xml
from gazeledger.streaming import alerts
from gazeledger.streaming.runner import run_available, run_latest

# --- sources ------------------------------------------------------------------------


# Lines of a written log file: logs are rolled over, and a compressed file is read by one task.
FILE_ROWS = 250_000


def _written(spark, sf, name: str, compression: str = "none") -> str:
    """A derived log as text files, each in line order; more lines give more files."""
    folder = new_folder(spark, "text")
    lines = view(spark, sf, name)
    files = max(4, -(-lines.count() // FILE_ROWS))
    (lines.repartitionByRange(files, "line_no").sortWithinPartitions("line_no").select("raw_line")
     .write.option("compression", compression).text(folder))
    return folder


def _numbered(lines: DataFrame) -> DataFrame:
    """Do the line numbers of every file run from 1 without gaps, and in the order of its lines? No file stands in one group."""
    rows = lines.select(
        "source_file", "line_no", F.regexp_extract("raw_line", r"(\d+)\z", 1).cast("bigint").alias("e"),
        F.floor(F.col("line_no") / P.chunk_lines).cast("bigint").alias("_slice"))
    rows = running(
        rows, ["source_file"], "_slice", ["line_no"], lasts={"before": F.col("e"), "above": F.col("line_no")}, include_current=False)
    files = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"),
        F.count_if(F.col("above").isNull() | (F.col("above") < F.col("line_no"))).alias("numbers"),
        F.count_if(F.col("e") < F.col("before")).alias("swapped"), F.count_distinct("e").alias("events"))
    gaps = F.col("last") - F.col("n") + F.col("first") - 1 + F.col("n") - F.col("numbers")
    return files.agg(
        F.sum("n").alias("lines"), F.sum("events").alias("events"), F.sum(gaps).alias("gaps"), F.sum("swapped").alias("swapped"))


NUMBERED_SQL = "select count(*) as lines, count(*) as events, cast(0 as bigint) as gaps, cast(0 as bigint) as swapped from events"


@query("log_scan", "select count(*) as lines from events")
def log_scan(spark, sf):
    """Overlapping patterns and a missing file: every line once."""
    folder = _written(spark, sf, "web_log")
    lines = text.read_log_lines(spark, [f"{folder}/part-*.txt", f"{folder}/part-0*", f"{folder}/no-such-file.log"])
    return lines.agg(F.count(F.lit(1)).alias("lines"))


@query("line_numbers", NUMBERED_SQL)
def line_numbers(spark, sf):
    return _numbered(text.read_log_lines(spark, [_written(spark, sf, "web_log") + "/part-*"]))


@query("gzip_scan", NUMBERED_SQL)
def gzip_scan(spark, sf):
    return _numbered(text.read_log_lines(spark, [_written(spark, sf, "web_log", "gzip") + "/*.gz"]))


@query("charset_fallback", f"""{with_views('hangul_log')} select charset, raw_line, count(*) as n from hangul_log,
 (select unnest(['MS949', 'UTF-8']) as charset) group by 1, 2""")
def charset_fallback(spark, sf):
    """The same Korean lines in two charsets."""
    folder = new_folder(spark, "charset")
    lines = view(spark, sf, "hangul_log").select("raw_line")
    for name, charset in (("MS949", "EUC-KR"), ("UTF-8", "UTF-8")):
        lines.write.option("encoding", charset).csv(f"{folder}/{name}")
    raw = text.read_lines(spark, text.resolve_paths(spark, [f"{folder}/*/part-*"]))
    charsets = text.file_charsets(raw)
    return text.decode_lines(raw, charsets).join(charsets, "source_file").groupBy("charset", "raw_line").agg(
        F.count(F.lit(1)).alias("n"))


@query("multiline_records", f"""{with_views('oracle_log')}, numbered as (select *, sum(case when raw_line like 'ACTION%' then 1 else 0 end)
 over (order by line_no rows unbounded preceding) as rec from oracle_log)
select min(line_no) as start_line_no, cast(0 as bigint) as part, string_agg(raw_line, chr(10) order by line_no) as record from numbered group by rec""")
def multiline_records(spark, sf):
    return records.multiline_records(view(spark, sf, "oracle_log"), r"\AACTION", P).drop("source_file")


XML_SCHEMA = "_timestamp string, _user string, query string, rowsAffected string, clientIp string"


def _xml_folder(spark, sf) -> str:
    folder = new_folder(spark, "xml")
    e = texts(spark, sf, "events")
    e.select(F.concat(
        F.lit('<event timestamp="'), F.substring(F.col("ts").cast("string"), 1, 19), F.lit('" user="u'), F.col("user_id"),
        F.lit('"><query>SELECT name FROM '), F.col("event_type"), F.lit("</query><rowsAffected>"), F.col("event_id"),
        F.lit("</rowsAffected><clientIp>10.0.0."), F.col("event_id") % 250, F.lit("</clientIp></event>"),
    )).write.text(folder)
    return folder


_XML_E = "substr(cast(ts as varchar),1,19)"


@query("xml_events", f"""select {_XML_E} as stamp, 'u' || cast(user_id as varchar) as user_id, 'SELECT name FROM ' || event_type as query,
 event_id as n, 'event  timestamp=' || {_XML_E} || '  user=u' || cast(user_id as varchar) || '|event  query=SELECT name FROM ' || event_type ||
 '  rowsAffected=' || cast(event_id as varchar) || '  clientIp=10.0.0.' || cast(event_id%250 as varchar) || '|query  SELECT name FROM ' || event_type ||
 '|rowsAffected  ' || cast(event_id as varchar) || '|clientIp  10.0.0.' || cast(event_id%250 as varchar) as lines from events""")
def xml_events(spark, sf):
    rows = xml.xml_lines(xml.read_xml(spark, _xml_folder(spark, sf), "event", XML_SCHEMA), "event")
    return rows.select(
        F.col("_timestamp").alias("stamp"), F.col("_user").alias("user_id"), "query",
        F.col("rowsAffected").cast("bigint").alias("n"), F.array_join("lines", "|").alias("lines"))


@query("snapshot_write", f"""{SUMMARY} select user_id, risk_level, total_events, flagged_event_count, cast(31 as bigint) as period_days,
 (select count(*) from summary) as user_count from summary""")
def snapshot_write(spark, sf):
    folder = new_folder(spark, "history")
    run = store.write_snapshot(
        audited(spark, sf)[1], folder, date(2024, 1, 1), date(2024, 1, 31), 1, 1, datetime(2024, 2, 1, 8, 0))
    meta = store.read_snapshot_meta(spark, folder).where(F.col("run_id") == run)
    return store.read_snapshot_users(spark, folder).join(
        meta.select("run_id", F.col("period_days").cast("bigint").alias("period_days"), "user_count"), "run_id").select(
        "user_id", "risk_level", "total_events", "flagged_event_count", "period_days", "user_count")


@query("daily_counts_store", f"""{BASE} select user_id, cast(cast(ts as date) as varchar) as d,
 count(*) + case when cast(ts as date) < date '2024-01-15' then 100 else 0 end as cnt from access_log group by user_id, cast(ts as date)""")
def daily_counts_store(spark, sf):
    """Two saves: the second replaces the days it holds."""
    folder = new_folder(spark, "history")
    days = access.daily_counts(log(spark, sf))
    store.save_daily_counts(days.withColumn("cnt", F.col("cnt") + 100), folder, date(2024, 1, 31), P)
    store.save_daily_counts(days.where("d >= '2024-01-15'"), folder, date(2024, 1, 31), P)
    return store.read_daily_counts(spark, folder).withColumn("d", F.col("d").cast("string"))


@query("report_tables", f"""{SUMMARY} select fmt, user_id, total_events, pii_event_count, pii_types_str, peak_hour, peak_day, risk_label,
 cast(floor(risk_score * 100 + 0.5) as bigint) as risk_score_x100 from (select *, '-' as pii_types_str, {LABEL_SQL.format('risk_level')} as risk_label from summary),
 (select unnest(['csv','json','parquet']) as fmt)""")
def report_tables(spark, sf):
    """The user report in every format, row by row."""
    from gazeledger.operators.reports import rpt_users

    users = rpt_users(audited(spark, sf)[1])
    parts = []
    for fmt in ("csv", "json", "parquet"):
        folder = new_folder(spark, "report")
        store.export_reports({"users": users}, folder, fmt)
        reader = spark.read.schema(users.schema)
        back = (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(f"{folder}/users")
        parts.append(back.select(
            F.lit(fmt).alias("fmt"), "user_id", "total_events", "pii_event_count", "pii_types_str", "peak_hour", "peak_day", "risk_label",
            F.floor(F.col("risk_score") * 100 + 0.5).cast("bigint").alias("risk_score_x100")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- streams ------------------------------------------------------------------------


def _stream(batch: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """A stream over a batch table written to the shared folder, all of it or so many files in each micro-batch."""
    spark = batch.sparkSession
    folder = new_folder(spark, name)
    batch.write.parquet(folder)
    reader = spark.readStream.schema(batch.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


@query("stream_daily_counts", f"""{BASE} select user_id, cast(cast(ts as date) as varchar) as d, count(*) as cnt from access_log group by 1, 2""")
def stream_daily_counts(spark, sf):
    """The latest count of every user and day, the last one included."""
    counts = run_latest(alerts.stream_daily_counts(_stream(log(spark, sf), "events"), "1 hour"), ["user_id", "d"])
    return counts.withColumn("d", F.col("d").cast("string"))


def _stream_alert_sql() -> str:
    sql = alert_sql(P)
    kinds = {"alert_daily": "daily", "alert_daily_critical": "daily_critical", "alert_hourly": "hourly",
             "alert_after_hours": "after_hours", "alert_bulk": "bulk", "alert_unique_targets": "unique_targets"}
    parts = " union all ".join(
        f"select user_id, '{kind}' as kind, category, severity, epoch_us(ts) as ts_us, reference from ({sql[name]})"
        for name, kind in kinds.items())
    return f"{BASE}, {ROLLING_SQL} select * from ({parts})"


@query("stream_alerts", _stream_alert_sql())
def stream_alerts(spark, sf):
    found = alerts.stream_alerts(_stream(log(spark, sf), "events"), P)
    return found.select(
        "user_id", "kind", "category", "severity", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("raw_reference").alias("reference"))


@query("stream_pii_findings", f"""select 'pg.log:' || cast(event_id as varchar) as raw_reference, 'u' || cast(user_id as varchar) as user_id,
 {SEC} as ts_us, {RAW_PHONE} as original_value from events where {RAW_PII}""")
def stream_pii_findings(spark, sf):
    from gazeledger.operators import parse

    # two files for each core, so that a task's lines do not grow with the stream
    lines = _stream(view(spark, sf, "raw_log"), "lines", 2 * spark.sparkContext.defaultParallelism)
    found = run_available(alerts.stream_pii_findings(lines, R, parse.parse_postgres))
    return found.select(
        "raw_reference", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("details.original_value").alias("original_value"))


@query("stream_alert_dedup", f"""{BASE} select 'bulk|' || user_id || '|' || cast(cast(ts as date) as varchar) as alert_key
from access_log where is_bulk group by 1""")
def stream_alert_dedup(spark, sf):
    rows = log(spark, sf).where("is_bulk").withColumn("d", F.to_date("ts"))
    raised = access._finding(rows, "BULK_EXPORT", "HIGH", F.lit(""), {"date": F.col("d").cast("string")})
    return run_available(alerts.stream_alert_dedup(_stream(raised, "alerts"), "40 days")).select("alert_key")


@query("stream_single_exposure", f"""{BASE} select user_id, line_no,
 case when effective_exposure >= {P.pii_single_query_critical} then 'CRITICAL' else 'HIGH' end as severity, effective_exposure
 from access_log where effective_exposure >= {P.pii_single_query_high}""")
def stream_single_exposure(spark, sf):
    found = run_available(alerts.stream_single_exposure(_stream(log(spark, sf), "events"), P))
    return found.select("user_id", "line_no", "severity", "effective_exposure")


@query("audit_files", f"""select count(*) as total_events, count(*) filter (where {RAW_PII}) as pii_events,
 count(distinct user_id) as users from events""")
def audit_files(spark, sf):
    """Log files through the whole audit, with history."""
    from gazeledger.plans.audit import run_audit

    folder = _written(spark, sf, "raw_log")
    result = run_audit(
        spark, [f"{folder}/part-*"], "2024-01-01", "2024-01-31", R, history_folder=new_folder(spark, "history"),
        today=date(2024, 2, 1))
    return result.summary.agg(
        F.sum("total_events").alias("total_events"), F.sum("pii_event_count").alias("pii_events"),
        F.count(F.lit(1)).alias("users"))
