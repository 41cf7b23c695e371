"""Column layouts of the tables that jobs hand to each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_LINES = "source_file string, line_no bigint, raw_line string"

HIT = (
    "struct<pii_type:string,severity:string,redacted_value:string,original_value:string,"
    "match_start:int,match_end:int>"
)
HITS = f"array<{HIT}>"

EVENT_COLUMNS = [
    "source_file", "line_no", "raw_line", "ts", "user_id", "ip_address", "action", "target",
    "query_text", "log_type", "is_bulk", "extra",
]

# name -> type of the optional values a finding may carry
DETAILS = {
    "window": "string",
    "date": "string",
    "hour": "string",
    "count": "bigint",
    "exposure": "bigint",
    "result_rows": "bigint",
    "pii_fields": "array<string>",
    "is_select_star": "boolean",
    "unique_targets": "bigint",
    "baseline_avg": "double",
    "baseline_days": "bigint",
    "surge_pct": "double",
    "exposure_type": "string",
    "result_row_count": "bigint",
    "pii_select_fields": "array<string>",
    "effective_exposure": "bigint",
    "original_value": "string",
    "redacted_value": "string",
}

FINDING_COLUMNS = [
    "finding_id", "category", "severity", "user_id", "ts", "pii_types", "evidence", "raw_reference",
    "score", "details",
]

SNAPSHOT_USER_FIELDS = [
    "risk_score", "risk_level", "pii_event_count", "total_events", "max_queries_per_day",
    "max_queries_per_hour", "after_hours_count", "bulk_export_count", "flagged_event_count",
    "total_pii_records_exposed", "max_single_query_exposure", "pii_types_str",
]


def details_struct(values: dict[str, Column]) -> Column:
    """The details struct with the given values and NULL for the rest."""
    return F.struct(*[
        (values[n].cast(t) if n in values else F.lit(None).cast(t)).alias(n) for n, t in DETAILS.items()
    ])
