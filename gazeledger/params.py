"""Thresholds and settings; every operator takes an ``AuditParams``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class AuditParams:
    # Default thresholds of the audit rules.
    max_queries_per_day: int = 500
    critical_queries_per_day: int = 2000
    max_queries_per_hour: int = 100
    critical_queries_per_hour: int = 500
    business_hours_start: int = 8
    business_hours_end: int = 19
    after_hours_threshold: int = 5
    bulk_select_row_threshold: int = 1000
    bulk_export_per_day: int = 3
    unique_targets_per_day: int = 50
    daily_surge_threshold_pct: float = 10
    daily_surge_min_baseline_days: int = 7
    pii_exposure_medium: int = 1_000
    pii_exposure_high: int = 10_000
    pii_exposure_critical: int = 50_000
    pii_single_query_high: int = 5_000
    pii_single_query_critical: int = 20_000

    # Fixed values that the rules keep out of the threshold table.
    escalate_critical: int = 20_000
    escalate_high: int = 5_000
    surge_high_ratio: float = 0.5
    baseline_days: int = 30
    retention_days: int = 35
    closest_tolerance_days: int = 3

    # Settings of this engine.
    year_hint: int | None = None   # year given to timestamps that carry none; a run takes that of its period, else today's
    ts_mode: str = "strict"        # or "lenient": also accept ',ms' and fraction + 'Z'
    chunk_minutes: int = 10        # time slice that bounds one window group; divides 60
    slice_rows: int = 200_000      # a time slice of one user with more rows is cut again, by its rows
    chunk_lines: int = 100_000     # line slice that bounds one per-file window group
    part_bytes: int = 1 << 20      # longer records of several lines are worked on in parts of this size

    def __post_init__(self) -> None:
        if self.chunk_minutes < 1 or 60 % self.chunk_minutes:
            raise ValueError("chunk_minutes must divide 60")
        if self.ts_mode not in ("strict", "lenient"):
            raise ValueError(f"unknown ts_mode {self.ts_mode!r}")

    def with_overrides(self, overrides: dict[str, Any]) -> "AuditParams":
        """Shallow update; names that no rule reads are ignored, as a threshold file may hold more."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in overrides.items() if k in known})
