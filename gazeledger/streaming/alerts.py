"""Streaming forms of the counters, the scan and the alert de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeledger.operators import access, exposure, parse, pii
from gazeledger.params import AuditParams
from gazeledger.streaming.runner import run_by_day


def stream_daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per user and day of a stream. In append mode a day comes out when the watermark has passed it; in update mode,
    kept by ``runner.run_latest``, every day has its count so far."""
    return (
        events.withColumn("_at", F.col("ts").cast("timestamp"))
        .withWatermark("_at", delay)
        .groupBy(F.window("_at", "1 day").alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("user_id", F.to_date("w.start").alias("d"), "cnt")
    )


def stream_pii_findings(lines: DataFrame, params: AuditParams, parser=parse.parse_generic) -> DataFrame:
    """Findings of a stream of raw lines; stateless, the same expressions as in batch."""
    return pii.pii_findings(exposure.estimate_exposure(pii.scan_pii(parser(lines, params))), params)


def stream_alert_dedup(findings: DataFrame, delay: str = "2 days") -> DataFrame:
    """First alert of every key of a findings stream."""
    keyed = access.alert_keys(findings).withColumn("_at", F.col("ts").cast("timestamp"))
    return keyed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["alert_key"]).drop("_at")


def threshold_alerts(events: DataFrame, params: AuditParams) -> DataFrame:
    """All threshold alerts but single exposure and surge, one row per crossing, with their ``kind``."""
    found = reduce(DataFrame.unionByName, [
        access.day_alerts(events, params), access.alert_hourly(events, params), access.alert_unique_targets(events, params)])
    return access.alert_keys(found).withColumn("kind", F.substring_index("alert_key", "|", 1)).drop("alert_key")


def stream_alerts(events: DataFrame, params: AuditParams, late_days: int = 2) -> DataFrame:
    """The threshold alerts of an event stream, equal to those of a batch over its rows, late ones included."""
    columns = ["user_id", "ts", "source_file", "line_no", "target", "has_pii", "is_bulk"]
    return run_by_day(events.select(*columns), lambda rows: threshold_alerts(rows, params), late_days)


def stream_single_exposure(events: DataFrame, params: AuditParams, delay: str = "2 days") -> DataFrame:
    """Single-query exposure alerts of a stream, one per user, day, line (of a file) and level."""
    exposed = F.col("effective_exposure")
    return (
        events.where(exposed >= min(params.pii_single_query_high, params.pii_single_query_critical))
        .withColumns({
            "severity": F.when(exposed >= params.pii_single_query_critical, "CRITICAL").otherwise("HIGH"),
            "d": F.to_date("ts"),
            "_at": F.col("ts").cast("timestamp"),
        })
        .withWatermark("_at", delay)
        .dropDuplicatesWithinWatermark(["user_id", "d", "source_file", "line_no", "severity"])
        .select("user_id", "d", "line_no", "severity", "source_file", "effective_exposure")
    )
