"""Per-user roll-up, risk score, level, and totals over users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.operators.exposure import exposure_rollup_aggs
from gazeledger.operators.filters import first_part, select_findings, select_measures
from gazeledger.operators.ordered import ranked
from gazeledger.params import AuditParams

ACCESS_MEASURES = [
    "max_queries_per_hour", "max_queries_per_day", "after_hours_count", "bulk_export_count",
    "unique_targets_per_day",
]
EVENT_MEASURES = [
    "total_events", "pii_event_count", "total_pii_records_exposed", "max_single_query_exposure",
    "unknown_exposure_query_count", "select_pii_query_count", "search_only_query_count",
]
FINDING_MEASURES = [
    "flagged_event_count", "critical_finding_count", "high_finding_count", "pii_finding_count",
    "excess_finding_count",
]


def findings_union(pii: DataFrame, access: DataFrame) -> DataFrame:
    """All findings in time order, those without a time first."""
    return pii.unionByName(access).orderBy(F.col("ts").asc_nulls_first(), "raw_reference", "finding_id", "category")


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("flagged_event_count"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_finding_count"),
        F.count_if(F.col("severity") == "HIGH").alias("high_finding_count"),
        F.count_if(F.col("category") == "PII_EXPOSURE").alias("pii_finding_count"),
        F.count_if(F.col("category") == "EXCESSIVE_ACCESS").alias("excess_finding_count"),
    )


def _event_rollup(events: DataFrame) -> DataFrame:
    """Event measures per user; the types of its personal data when hits are present."""
    user = F.coalesce(F.nullif("user_id", F.lit("")), F.lit(C.UNKNOWN_USER)).alias("user_id")
    has_hits = "pii_hits" in events.columns
    has_pii = F.size("pii_hits") > 0 if has_hits else F.col("has_pii")
    # the set of types has at most one entry per pattern, so it is small for any user
    types = F.flatten(F.collect_set(F.array_sort(F.array_distinct("pii_hits.pii_type")))) if has_hits else F.array().cast("array<string>")
    return events.groupBy(user).agg(
        F.count_if(first_part(events)).alias("total_events"),
        F.count_if(has_pii).alias("pii_event_count"),
        (F.array_sort(F.array_distinct(types)) if has_hits else F.first(types)).alias("pii_types"),
        *exposure_rollup_aggs(),
    )


def user_rollup(events: DataFrame, findings: DataFrame, access_stats: DataFrame) -> DataFrame:
    """One row per user seen in events or findings; missing measures are 0.

    All three inputs are aggregated by user before they meet, so no user is a hot join key.
    """
    joined = (
        _event_rollup(events)
        .join(finding_counts(findings), "user_id", "full")
        .join(access_stats, "user_id", "left")
    )
    measures = EVENT_MEASURES + ACCESS_MEASURES + FINDING_MEASURES
    return joined.select(
        "user_id",
        F.coalesce("pii_types", F.array().cast("array<string>")).alias("pii_types"),
        F.coalesce("peak_hour", F.lit("")).alias("peak_hour"),
        F.coalesce("peak_day", F.lit("")).alias("peak_day"),
        *[F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in measures],
    )


# --- score --------------------------------------------------------------------


def score_pii() -> Column:
    return F.least(F.lit(25.0), F.col("critical_finding_count") * 4.0 + F.col("high_finding_count") * 1.5)


def score_exposure(params: AuditParams) -> Column:
    """0-5, 5-15, 15-30 along the exposure limits, with a floor by the largest single query."""
    exposed, single = F.col("total_pii_records_exposed"), F.col("max_single_query_exposure")
    medium, high, critical = params.pii_exposure_medium, params.pii_exposure_high, params.pii_exposure_critical
    base = (
        F.when(exposed >= critical, 30.0)
        .when(exposed >= high, 15.0 + (exposed - high) / F.lit(max(critical - high, 1)) * 15.0)
        .when(exposed >= medium, 5.0 + (exposed - medium) / F.lit(max(high - medium, 1)) * 10.0)
        .otherwise(F.least(F.lit(5.0), exposed / F.lit(max(medium, 1)) * 5.0))
    )
    floor = F.when(single >= params.pii_single_query_critical, 25.0).when(
        single >= params.pii_single_query_high, 15.0).otherwise(0.0)
    return F.least(F.lit(30.0), F.greatest(base, floor))


def score_excess(params: AuditParams) -> Column:
    def share(measure: str, limit: int) -> Column:
        return F.col(measure) / F.lit(limit) if limit > 0 else F.lit(0.0)

    return F.least(
        F.lit(20.0),
        share("max_queries_per_day", params.max_queries_per_day) * 12.0
        + share("max_queries_per_hour", params.max_queries_per_hour) * 8.0,
    )


def score_behavior(params: AuditParams) -> Column:
    def part(measure: str, limit: int, top: float) -> Column:
        return F.least(F.lit(top), F.col(measure) / F.lit(max(limit, 1)) * top)

    return (
        part("after_hours_count", params.after_hours_threshold, 10.0)
        + part("bulk_export_count", params.bulk_export_per_day, 10.0)
        + part("unique_targets_per_day", params.unique_targets_per_day, 5.0)
    )


def risk_level(total: Column, params: AuditParams) -> Column:
    """Level of the unrounded score, raised by exposure and by single findings."""
    exposed = F.col("total_pii_records_exposed")
    base = F.when(total >= 70, 4).when(total >= 45, 3).when(total >= 20, 2).otherwise(1)
    by_high = F.when((exposed >= params.pii_exposure_high) & (base == 2), 3).otherwise(base)
    by_critical = F.when(exposed >= params.pii_exposure_critical, 4).otherwise(by_high)
    by_findings = F.greatest(
        by_critical,
        F.when(F.col("high_finding_count") > 0, 2).otherwise(1),
        F.when(F.col("critical_finding_count") > 0, 3).otherwise(1),
    )
    return F.get(F.array(*[F.lit(v) for v in C.LEVELS]), by_findings - 1)


def score_users(rollup: DataFrame, params: AuditParams) -> DataFrame:
    """Adds the score parts, ``risk_total`` (unrounded), ``risk_score`` and ``risk_level``."""
    scored = rollup.withColumns({
        "score_pii": score_pii(),
        "score_exposure": score_exposure(params),
        "score_excess": score_excess(params),
        "score_behavior": score_behavior(params),
    })
    total = F.least(
        F.lit(100.0),
        F.col("score_pii") + F.col("score_exposure") + F.col("score_excess") + F.col("score_behavior"))
    return scored.withColumn("risk_total", total).withColumns({
        "risk_score": F.bround("risk_total", 2),
        "risk_level": risk_level(F.col("risk_total"), params),
    })


def user_summary(
    events: DataFrame, findings: DataFrame, access_stats: DataFrame, params: AuditParams,
    misuse: bool = True, excess: bool = True,
) -> DataFrame:
    """Roll-up, choice of checks, score."""
    rollup = user_rollup(events, select_findings(findings, misuse, excess), access_stats)
    if not (misuse and excess):
        # users whose findings are all of the other check keep their row
        rollup = user_rollup(events, findings, access_stats).select("user_id").join(rollup, "user_id", "left").na.fill(0)
        rollup = rollup.withColumns({
            "pii_types": F.coalesce("pii_types", F.array().cast("array<string>")),
            "peak_hour": F.coalesce("peak_hour", F.lit("")),
            "peak_day": F.coalesce("peak_day", F.lit("")),
        })
    return score_users(select_measures(rollup, misuse, excess), params)


def rank_users(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("risk_score").desc(), "user_id")


def user_ranks(summary: DataFrame) -> DataFrame:
    """Adds ``position``: the place of every user by falling score, then name."""
    return ranked(summary, [F.col("risk_score").desc(), F.col("user_id").asc()], "position")


def top_k_users(summary: DataFrame, k: int = 10) -> DataFrame:
    return rank_users(summary).limit(k)


def pii_types_text(types: Column) -> Column:
    return F.when(F.size(types) > 0, F.array_join(F.array_sort(types), ", ")).otherwise(F.lit("-"))


# --- totals over users ----------------------------------------------------------


def risk_distribution(summary: DataFrame) -> DataFrame:
    """Users per level, all four levels present."""
    row = summary.agg(*[F.count_if(F.col("risk_level") == v).alias(v) for v in C.LEVELS])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("risk_level"), F.col(v).alias("users")) for v in reversed(C.LEVELS)])))


def global_stats(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("total_users"),
        *[F.count_if(F.col("risk_level") == v).alias(f"{v.lower()}_users") for v in reversed(C.LEVELS)],
        F.coalesce(F.sum("flagged_event_count"), F.lit(0)).alias("total_findings"),
        F.coalesce(F.sum("pii_finding_count"), F.lit(0)).alias("pii_findings"),
        F.coalesce(F.sum("excess_finding_count"), F.lit(0)).alias("excess_findings"),
        F.coalesce(F.sum("total_pii_records_exposed"), F.lit(0)).alias("total_pii_records_exposed"),
        F.coalesce(F.max("max_single_query_exposure"), F.lit(0)).alias("max_single_query_exposure"),
        F.count_if(F.col("select_pii_query_count") > 0).alias("select_pii_users"),
        # at most one entry per pattern
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pii_types")))), ", ").alias("pii_types"),
    )


def pii_type_users(summary: DataFrame) -> DataFrame:
    """Users per type."""
    return summary.select(F.explode(F.array_distinct("pii_types")).alias("pii_type")).groupBy("pii_type").agg(
        F.count(F.lit(1)).alias("users"))
