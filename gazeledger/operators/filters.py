"""Row predicates and filters of the audit."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions.regex import contains_any, let, matches
from gazeledger.params import AuditParams


def date_range(df: DataFrame, start: date | str, end: date | str, ts: str = "ts") -> DataFrame:
    """Inclusive period; rows without a timestamp pass.

    The bounds are written on the timestamp itself, so the filter reaches a parquet scan.
    """
    first = F.lit(str(start)).cast("date").cast("timestamp_ntz")
    after = F.date_add(F.lit(str(end)).cast("date"), 1).cast("timestamp_ntz")
    return df.where(F.col(ts).isNull() | ((F.col(ts) >= first) & (F.col(ts) < after)))


def has_trigger_keyword(text: Column) -> Column:
    """Cheap substring gate in front of the pattern scan."""
    return let(F.lower(text), lambda lower: contains_any(lower, C.TRIGGER_KEYWORDS))


def has_number_shape(text: Column) -> Column:
    """Phone, resident-number, card or IPv4 shape."""
    return matches(text, C.NUMBER_SHAPES, "(?Ud)")


def scan_gate(text: Column, log_type: Column) -> Column:
    """Lines worth a scan: a keyword, or a number shape in a free-form log."""
    return has_trigger_keyword(text) | (
        log_type.isin("unknown", "generic", "app") & has_number_shape(text))


def in_business_hours(ts: Column, params: AuditParams) -> Column:
    """NULL timestamps count as inside."""
    hour = F.hour(ts)
    return F.coalesce(
        (hour >= params.business_hours_start) & (hour < params.business_hours_end), F.lit(True))


def level_rank(level: Column) -> Column:
    """1 for LOW up to 4 for CRITICAL."""
    return F.array_position(F.array(*[F.lit(v) for v in C.LEVELS]), level).cast("int")


def min_risk(summaries: DataFrame, level: str) -> DataFrame:
    return summaries.where(level_rank(F.col("risk_level")) >= C.LEVELS.index(level) + 1)


def select_findings(findings: DataFrame, misuse: bool, excess: bool) -> DataFrame:
    """Keep the categories of the chosen checks."""
    if misuse and excess:
        return findings
    allowed = (C.MISUSE_CATEGORIES if misuse else []) + (C.EXCESS_CATEGORIES if excess else [])
    return findings.where(F.col("category").isin(allowed))


def select_measures(summaries: DataFrame, misuse: bool, excess: bool) -> DataFrame:
    """Zero the measures of a check that is off; to be applied before scoring."""
    off: dict[str, Column] = {}
    if not (misuse and excess):
        if not misuse:
            zero = ["total_pii_records_exposed", "max_single_query_exposure", "pii_event_count", "after_hours_count"]
            off.update({c: F.lit(0).cast("bigint") for c in zero})
            off["pii_types"] = F.array().cast("array<string>")
        if not excess:
            zero = ["max_queries_per_day", "max_queries_per_hour", "bulk_export_count", "unique_targets_per_day"]
            off.update({c: F.lit(0).cast("bigint") for c in zero})
    return summaries.withColumns(off) if off else summaries


def first_part(events: DataFrame) -> Column:
    """False for the further parts of a record that is longer than one event: text to scan, but no access of its own."""
    return F.try_element_at("extra", F.lit("part")).isNull() if "extra" in events.columns else F.lit(True)


def counter_eligible(events: DataFrame) -> DataFrame:
    """Events that the counters see: timestamp and user present, and the first part of their record."""
    return events.where(F.col("ts").isNotNull() & (F.col("user_id") != "") & first_part(events))
