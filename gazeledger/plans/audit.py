"""The whole audit as one plan: lines or events in, report tables out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gazeledger.operators import access, exposure, filters, history, justify, parse, pii, reports, risk
from gazeledger.params import AuditParams
from gazeledger.session import clear_folders, materialise
from gazeledger.sources import store
from gazeledger.sources.text import resolve_paths, scan_logs
from gazeledger.sources.xml import read_xml_logs


@dataclass
class AuditResult:
    """Tables of one run; all are lazy except those written on the way."""

    events: DataFrame
    findings: DataFrame
    summary: DataFrame          # users at or above the asked level
    week: DataFrame | None      # differences to the run one week earlier
    month: DataFrame | None
    justification: DataFrame
    reports: dict[str, DataFrame]
    metrics: dict[str, int] = field(default_factory=dict)
    run_id: str | None = None

    def close(self) -> None:
        """Delete the tables written on the way, which hold values in clear text; the result can not be read afterwards."""
        clear_folders(self.events.sparkSession)


def scan_events(events: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Period filter first, then the costly text work."""
    return exposure.estimate_exposure(pii.scan_pii(filters.date_range(events, start, end)))


def counted(events: DataFrame) -> DataFrame:
    """The view of scanned events that the counters read."""
    return filters.counter_eligible(events).select(
        "user_id", "ts", "source_file", "line_no", "target",
        (F.size("pii_hits") > 0).alias("has_pii"), "is_bulk", "effective_exposure", "result_row_count",
        "pii_select_fields", "pii_select_count", "is_select_star",
    )


def all_findings(events: DataFrame, params: AuditParams, history_counts: DataFrame | None, end: date | str) -> DataFrame:
    seen = counted(events)
    return pii.pii_findings(events, params).unionByName(
        access.access_findings(seen, params, history_counts, str(end)))


def analyze(
    events: DataFrame, params: AuditParams, end: date | str, history_counts: DataFrame | None = None,
    misuse: bool = True, excess: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Findings and scored users of a scanned events table."""
    findings = materialise(all_findings(events, params, history_counts, end), "findings")
    stats = access.user_access_stats(counted(events), params)
    summary = materialise(risk.user_summary(events, findings, stats, params, misuse, excess), "summary")
    return filters.select_findings(findings, misuse, excess), summary


def read_inputs(spark: SparkSession, patterns: list[str], params: AuditParams, log_format: str) -> tuple[DataFrame, DataFrame]:
    """Events of all files that the patterns name, and ``source_file, lines``. Files ending in ``.xml`` give the lines of their
    records, free-form ones; those without records are read like any other file."""
    paths = resolve_paths(spark, patterns)
    in_xml = [p for p in paths if p.lower().endswith(".xml")]
    records, plain = read_xml_logs(spark, in_xml)
    lines, files = scan_logs(spark, [p for p in paths if p in plain or p not in in_xml])
    events, counts = parse.parse(lines, params, log_format), files.select("source_file", "lines")
    if len(plain) < len(in_xml):
        records = materialise(records, "xml-lines")
        events = events.unionByName(parse.parse_generic(records, params))
        counts = counts.unionByName(records.groupBy("source_file").agg(F.count(F.lit(1)).alias("lines")))
    return events, counts


def run_audit(
    spark: SparkSession,
    log_files: list[str],
    start: date | str,
    end: date | str,
    params: AuditParams | None = None,
    log_format: str = "auto",
    misuse: bool = True,
    excess: bool = True,
    min_level: str = "LOW",
    history_folder: str | None = None,
    save_history: bool = True,
    today: date | None = None,
) -> AuditResult:
    """Read, parse, scan, count, score, compare and rank.

    Scanned events are written once, since counters, findings and roll-up all read them. ``metrics`` counts what the run
    read: lines from the counts of the splits, parsed events (of any period) on the way of the scan, so nothing is read
    again; lines that gave no event of their own are skipped ones.
    """
    params = params or AuditParams()
    start = date.fromisoformat(str(start))
    end = date.fromisoformat(str(end))
    if params.year_hint is None:
        params = replace(params, year_hint=end.year)
    parsed, files = read_inputs(spark, log_files, params, log_format)
    made = Observation("parsed events")
    events = materialise(scan_events(parsed.observe(made, F.count(F.lit(1)).alias("n")), start, end), "events")

    old_counts = store.read_daily_counts(spark, history_folder) if history_folder else None
    findings, summary = analyze(events, params, end, old_counts, misuse, excess)
    shown = filters.min_risk(summary, min_level)

    week = month = None
    if history_folder:
        meta = store.read_snapshot_meta(spark, history_folder)
        users = store.read_snapshot_users(spark, history_folder)
        # written before this run is added, so that it is not compared with itself
        week, month = (
            materialise(history.user_deltas(shown, history.prior_users(meta, users, start, end, days, params)), name)
            for name, days in history.SHIFTS.items()
        )
        store.save_daily_counts(access.daily_counts(counted(events)), history_folder, today or date.today(), params)

    total_events, total_lines, parsed_events = events.count(), files.agg(F.sum("lines")).first()[0] or 0, made.get["n"]
    run_id = None
    if history_folder and save_history:
        run_id = store.write_snapshot(
            summary, history_folder, start, end, total_events, total_lines, datetime.now())

    listed = findings.join(shown.select("user_id"), "user_id", "left_semi").select(*findings.columns)
    items = justify.justification(shown, listed, params)
    tables = {
        "summary": reports.rpt_summary(shown),
        "users": reports.rpt_users(shown),
        "pii_detail": reports.rpt_pii_detail(listed, shown),
        "finding_detail": reports.rpt_finding_detail(listed, shown),
        "justification": reports.rpt_justification(items),
        "evidence": reports.rpt_evidence(items),
    }
    if week is not None:
        tables["comparison"] = reports.rpt_comparison(shown, week, month)
    return AuditResult(
        events, listed, shown, week, month, items, tables,
        {"total_events": total_events, "total_lines": total_lines, "parsed_events": parsed_events,
         "skipped_lines": total_lines - parsed_events}, run_id)
