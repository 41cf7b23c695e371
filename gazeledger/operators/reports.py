"""The logical report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.operators import justify
from gazeledger.operators.exposure import exposure_display
from gazeledger.operators.history import newly_risky, prior_score, signed, trend_word, with_deltas
from gazeledger.operators.risk import global_stats, pii_types_text


def rpt_summary(summary: DataFrame) -> DataFrame:
    return global_stats(summary)


def rpt_users(summary: DataFrame) -> DataFrame:
    """One row per user in rank order, 16 columns."""
    return summary.orderBy(F.col("risk_score").desc(), "user_id").select(
        "user_id", "total_events", "pii_event_count",
        pii_types_text(F.col("pii_types")).alias("pii_types_str"),
        "total_pii_records_exposed", "max_single_query_exposure", "select_pii_query_count",
        "max_queries_per_hour", "max_queries_per_day", "peak_hour", "peak_day",
        "after_hours_count", "bulk_export_count", "flagged_event_count", "risk_score",
        justify.level_label(F.col("risk_level")).alias("risk_label"),
    )


def _in_rank_order(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """Findings with the level of their user. Order: user rank, then time."""
    return findings.join(summary.select("user_id", "risk_score", "risk_level"), "user_id")


def _order() -> list[Column]:
    return [
        F.col("risk_score").desc(), F.col("user_id").asc(), F.col("ts").asc_nulls_first(),
        F.col("raw_reference").asc(), F.col("finding_id").asc(), F.col("category").asc(),
        F.col("evidence").asc(),
    ]


def _types_text() -> Column:
    return F.when(F.size("pii_types") > 0, F.array_join("pii_types", ", ")).otherwise("-")


def rpt_pii_detail(findings: DataFrame, summary: DataFrame, unmask: bool = False, rows: int | None = None) -> DataFrame:
    """Personal-data findings in rank order; the value is masked unless asked otherwise. ``rows`` limits the list where a
    report shows only its top."""
    d = F.col("details")
    value = d["original_value"] if unmask else d["redacted_value"]
    listed = _in_rank_order(findings.where(F.col("category") == "PII_EXPOSURE"), summary).orderBy(*_order())
    listed = listed.limit(rows) if rows is not None else listed
    return listed.select(
        "user_id",
        justify.time_text(F.col("ts")).alias("timestamp_str"),
        _types_text().alias("pii_types_str"),
        F.coalesce(value, F.lit("")).alias("value"),
        justify._labels(C.DETAIL_EXPOSURE_LABELS, d["exposure_type"], F.coalesce(d["exposure_type"], F.lit(""))).alias("exposure_label"),
        F.coalesce(d["result_row_count"].cast("string"), F.lit("건수미확인")).alias("result_rows"),
        justify.level_label(F.col("risk_level")).alias("risk_label"),
        "evidence",
        "raw_reference",
    )


def rpt_finding_detail(findings: DataFrame, summary: DataFrame, rows: int | None = None) -> DataFrame:
    """All findings in rank order; ``rows`` limits the list where a report shows only its top."""
    listed = _in_rank_order(findings, summary).orderBy(*_order())
    listed = listed.limit(rows) if rows is not None else listed
    return listed.select(
        "user_id",
        justify.time_text(F.col("ts")).alias("timestamp_str"),
        justify.category_label(F.col("category"), detail=True).alias("category_label"),
        _types_text().alias("pii_types_str"),
        justify.level_label(F.col("risk_level")).alias("risk_label"),
        "evidence",
        "raw_reference",
    )


def rpt_justification(items: DataFrame) -> DataFrame:
    """The request form: reasons and numbered questions, two empty columns to fill in."""
    bullets = F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("• "), r)), "\n")
    numbered = F.array_join(F.transform(
        "questions", lambda q, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(". "), q)), "\n")
    return items.orderBy("priority_rank").select(
        F.concat(F.lit("#"), F.col("priority_rank").cast("string"), F.lit("\n"), F.col("urgency")).alias("priority"),
        "user_id",
        justify.level_label(F.col("risk_level")).alias("risk_label"),
        F.format_string("%.1f", "risk_score").alias("risk_score_text"),
        bullets.alias("reasons"),
        numbered.alias("questions"),
        F.lit("").alias("explanation"),
        F.lit("").alias("handling"),
    )


def rpt_evidence(items: DataFrame, unmask: bool = False) -> DataFrame:
    """One row per key finding."""
    rows = items.where(F.size("key_findings") > 0).select(
        "user_id", "priority_rank", "screen_estimate", F.inline("key_findings"))
    return rows.select(
        "user_id",
        F.concat(F.lit("#"), F.col("priority_rank").cast("string")).alias("priority"),
        "severity_kr", "timestamp_str", "category_kr", "pii_types_str",
        (F.col("original_value") if unmask else F.col("redacted_value")).alias("value"),
        "exposure_type_kr",
        F.coalesce(F.col("result_rows").cast("string"), F.lit("미상")).alias("result_rows"),
        "evidence", "raw_reference", "finding_rank",
        "screen_estimate",
    )


def rpt_comparison(summary: DataFrame, week: DataFrame, month: DataFrame) -> DataFrame:
    """Every user against the prior week and month; ``-`` without a prior run."""
    compared = with_deltas(summary, week, month)
    risen = newly_risky(compared, "any").select("user_id", F.col("prev_level").alias("_prev"))
    score = F.col("risk_score")
    cells: list[Column] = []
    for name in ("week", "month"):
        d = F.col(f"{name}.risk_score")
        cells += [
            prior_score(score, d).alias(f"{name}_prior_score"),
            F.coalesce(signed(d, 1), F.lit("-")).alias(f"{name}_score_change"),
            trend_word(d).alias(f"{name}_trend"),
            F.coalesce(signed(F.col(f"{name}.pii_event_count")), F.lit("-")).alias(f"{name}_pii_change"),
            F.coalesce(signed(F.col(f"{name}.max_queries_per_day")), F.lit("-")).alias(f"{name}_day_max_change"),
        ]
    return compared.join(risen, "user_id", "left").select(
        "user_id",
        justify.level_label(F.col("risk_level")).alias("risk_label"),
        score,
        *cells,
        "pii_event_count", "max_queries_per_day", "after_hours_count",
        F.coalesce(F.concat(F.col("_prev"), F.lit(" → "), F.col("risk_level")), F.lit("-")).alias("new_risk"),
    )


def rpt_display(findings: DataFrame) -> DataFrame:
    """Findings with their display texts."""
    return findings.select(
        "finding_id", "user_id",
        justify.time_text(F.col("ts")).alias("timestamp_str"),
        _types_text().alias("pii_types_str"),
        justify.level_label(F.col("severity")).alias("severity_label"),
        justify.category_label(F.col("category")).alias("category_label"),
    )


def user_display(summary: DataFrame) -> DataFrame:
    """Users with their exposure text."""
    return summary.select(
        "user_id",
        exposure_display(F.col("total_pii_records_exposed"), F.col("unknown_exposure_query_count")).alias("exposure_display"),
    )
