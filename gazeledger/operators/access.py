"""Access counting: days, rolling hours, alerts, per-user statistics.

Input is a counter-eligible events table with ``user_id, ts, source_file, line_no, target, has_pii,
is_bulk, effective_exposure`` (plus ``result_row_count``, ``pii_select_fields``, ``pii_select_count`` and
``is_select_star`` when findings shall carry them). Counters run in (ts, source_file, line_no) order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeledger.functions.extract import short_hash
from gazeledger.operators.filters import in_business_hours
from gazeledger.operators.ordered import cut_slices, nth_rows, running
from gazeledger.params import AuditParams
from gazeledger.schemas import details_struct

ORDER = ["ts", "source_file", "line_no"]
_HOUR_US = 3_600_000_000


def _slice(params: AuditParams, ts: Column | None = None) -> Column:
    """Number of the time slice a timestamp falls into."""
    ts = F.col("ts") if ts is None else ts
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.floor(micros / F.lit(params.chunk_minutes * 60_000_000)).cast("bigint")


def _prepared(events: DataFrame, params: AuditParams) -> DataFrame:
    return events.withColumns({"d": F.to_date("ts"), "_slice": _slice(params)})


def _grouped(num: Column) -> Column:
    """Number with thousands separators."""
    return F.format_number(num.cast("bigint"), 0)


# --- counts -----------------------------------------------------------------


def daily_counts(events: DataFrame) -> DataFrame:
    """Events per user and day."""
    return events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("cnt"))


def running_daily(events: DataFrame, params: AuditParams) -> DataFrame:
    """Adds ``d`` and ``running_count``: which event of the user's day this one is."""
    return running(
        _prepared(events, params), ["user_id", "d"], "_slice", ORDER, sums={"running_count": F.lit(1)},
        slice_rows=params.slice_rows,
    ).drop("_slice")


def _slice_loads(events: DataFrame, params: AuditParams) -> DataFrame:
    """Per user and slice: its count and the counts of the slices that a one-hour window can reach."""
    reach = 60 // params.chunk_minutes
    counts = events.groupBy("user_id", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    by_slice = Window.partitionBy("user_id").orderBy("_slice")
    return counts.withColumns({
        # all slices that may hold events of the last hour, and those that surely lie inside it
        "_behind": F.coalesce(F.sum("_n").over(by_slice.rangeBetween(-reach, -1)), F.lit(0)),
        "_sure": F.sum("_n").over(by_slice.rangeBetween(-(reach - 1), 0)),
    })


def _rolling(events: DataFrame, loads: DataFrame, params: AuditParams) -> DataFrame:
    """Rolling one-hour count of the events in the slices listed in ``loads``.

    Slices with very many rows are cut again along the order of events and marks. Each event also stands, one hour later, as an
    expiry mark in the slice where it leaves the window. The
    count at an event is then: earlier events of its slice + everything behind - expired marks so far. An
    event exactly one hour old still counts.
    """
    reach = 60 // params.chunk_minutes
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    keep = [c for c in events.columns if c != "_slice"]
    copies = events.select(
        *keep,
        F.inline(F.array(
            F.struct(F.col("_slice"), micros.alias("_at"), F.lit(0).alias("_mark")),
            F.struct((F.col("_slice") + reach).alias("_slice"), (micros + _HOUR_US).alias("_at"), F.lit(1).alias("_mark")),
        )),
    )
    order = ["_at", "_mark", "source_file", "line_no"]
    copies = copies.join(loads.select("user_id", "_slice", "_behind"), ["user_id", "_slice"])
    copies, cut = cut_slices(copies, ["user_id"], "_slice", order, params.slice_rows)
    net = 1 - 2 * F.col("_mark")
    if cut:
        counted = running(copies, ["user_id", "_slice"], "_cut", order, sums={"_net": net}).drop("_cut")
    else:
        upto_here = Window.partitionBy("user_id", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = copies.withColumn("_net", F.sum(net).over(upto_here))
    return counted.where("_mark = 0").withColumn("rolling_count", F.col("_behind") + F.col("_net")).drop(
        "_slice", "_at", "_mark", "_behind", "_net")


def rolling_hour(events: DataFrame, params: AuditParams) -> DataFrame:
    """Adds ``rolling_count``: the user's events of the last hour up to and including this one."""
    ready = _prepared(events, params)
    return _rolling(ready, _slice_loads(ready, params), params).drop("d")


def _hour_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00")


def peak_day(daily: DataFrame) -> DataFrame:
    """Per user the largest daily count and the first day that reached it."""
    return daily.groupBy("user_id").agg(
        F.max("cnt").alias("max_queries_per_day"),
        F.date_format(
            F.max_by("d", F.struct(F.col("cnt"), -F.unix_date("d"))), "yyyy-MM-dd").alias("peak_day"),
    )


def peak_hour(events: DataFrame, params: AuditParams) -> DataFrame:
    """Per user the largest rolling count and the clock hour of the event that first reached it.

    Only slices whose upper bound reaches the user's best sure count can hold the peak.
    """
    ready = _prepared(events, params).select("user_id", "ts", "source_file", "line_no", "_slice")
    loads = _slice_loads(ready, params)
    floor = Window.partitionBy("user_id")
    able = loads.withColumn("_floor", F.max("_sure").over(floor)).where(
        F.col("_n") + F.col("_behind") >= F.col("_floor"))
    counted = _rolling(ready, able, params)
    return counted.groupBy("user_id").agg(
        F.max("rolling_count").alias("max_queries_per_hour"),
        F.min_by(
            _hour_text(F.col("ts")),
            F.struct(-F.col("rolling_count"), F.col("ts"), F.col("source_file"), F.col("line_no")),
        ).alias("peak_hour"),
    )


def user_access_stats(events: DataFrame, params: AuditParams) -> DataFrame:
    """Per user: peaks, after-hours and bulk totals, largest number of distinct targets in a day."""
    per_day = events.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_if(F.col("has_pii") & ~in_business_hours(F.col("ts"), params)).alias("after"),
        F.count_if("is_bulk").alias("bulk"),
    )
    per_user = per_day.groupBy("user_id").agg(
        F.max("cnt").alias("max_queries_per_day"),
        F.date_format(
            F.max_by("d", F.struct(F.col("cnt"), -F.unix_date("d"))), "yyyy-MM-dd").alias("peak_day"),
        F.sum("after").alias("after_hours_count"),
        F.sum("bulk").alias("bulk_export_count"),
    )
    targets = (
        events.where(F.col("target") != "")
        .select("user_id", F.to_date("ts").alias("d"), "target").distinct()
        .groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("user_id").agg(F.max("n").alias("unique_targets_per_day"))
    )
    return (
        per_user.join(peak_hour(events, params), "user_id", "left")
        .join(targets, "user_id", "left")
        .select(
            "user_id", "max_queries_per_day", "max_queries_per_hour", "peak_hour", "peak_day",
            "after_hours_count", "bulk_export_count",
            F.coalesce("unique_targets_per_day", F.lit(0)).alias("unique_targets_per_day"),
        )
    )


# --- alerts -----------------------------------------------------------------


def finding_id(user: Column, reference: Column, category: Column) -> Column:
    return short_hash(user, reference, category)


def _finding(
    rows: DataFrame, category: Column | str, severity: Column | str, evidence: Column,
    details: dict[str, Column], reference: Column | None = None,
) -> DataFrame:
    category = F.lit(category) if isinstance(category, str) else category
    severity = F.lit(severity) if isinstance(severity, str) else severity
    reference = F.concat_ws(":", "source_file", F.col("line_no").cast("string")) if reference is None else reference
    return rows.select(
        finding_id(F.col("user_id"), reference, category).alias("finding_id"),
        category.alias("category"),
        severity.alias("severity"),
        "user_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.array().cast("array<string>").alias("pii_types"),
        evidence.alias("evidence"),
        reference.alias("raw_reference"),
        F.lit(0.0).alias("score"),
        details_struct(details).alias("details"),
    )


def _day_text() -> Column:
    return F.date_format("d", "yyyy-MM-dd")


def _day_rules(params: AuditParams) -> dict[str, tuple[Column, int]]:
    """Condition and ordinal of the event that raises each per-day alert."""
    return {
        "daily": (F.lit(True), params.max_queries_per_day + 1),
        "daily_critical": (F.lit(True), params.critical_queries_per_day + 1),
        "after_hours": (
            F.col("has_pii") & ~in_business_hours(F.col("ts"), params), params.after_hours_threshold + 1),
        "bulk": (F.col("is_bulk"), params.bulk_export_per_day + 1),
    }


def day_alerts(events: DataFrame, params: AuditParams, kinds: list[str] | None = None) -> DataFrame:
    """Alerts raised by the n-th event of a kind in a user's day; all kinds share one pass."""
    rules = _day_rules(params)
    if params.critical_queries_per_day == params.max_queries_per_day:
        # one event crosses both limits; it raises the daily alert alone
        rules = {k: r for k, r in rules.items() if k != "daily_critical" or kinds == ["daily_critical"]}
    chosen = {k: r for k, r in rules.items() if kinds is None or k in kinds}
    rows = nth_rows(_prepared(events, params), ["user_id", "d"], "_slice", ORDER, chosen)
    if kinds == ["daily_critical"] and params.critical_queries_per_day == params.max_queries_per_day:
        rows = rows.where(F.lit(False))
    kind = F.col("kind")

    def pick(values: dict[str, Column]) -> Column:
        chain = F
        for k, v in values.items():
            chain = chain.when(kind == k, v)
        return chain.otherwise(F.lit(None))

    n = {k: limit for k, (_, limit) in rules.items()} | {"daily_critical": params.critical_queries_per_day + 1}
    category = pick({
        "daily": F.lit("EXCESSIVE_ACCESS"), "daily_critical": F.lit("EXCESSIVE_ACCESS"),
        "after_hours": F.lit("AFTER_HOURS"), "bulk": F.lit("BULK_EXPORT"),
    })
    above = n["daily"] > params.critical_queries_per_day
    severity = F.when((kind == "daily_critical") | ((kind == "daily") & above), "CRITICAL").otherwise("HIGH")
    evidence = pick({
        "daily": F.lit(f"일별 조회 건수 {n['daily']}건 (임계값: {params.max_queries_per_day}건)"),
        "daily_critical": F.lit(
            f"일별 조회 건수 {n['daily_critical']}건 (위험 임계값: {params.critical_queries_per_day}건) - 즉각 조사 필요"),
        "after_hours": F.concat(
            F.lit("업무 외 시간("), F.date_format("ts", "HH:mm"), F.lit(f") 개인정보 {n['after_hours']}건 조회")),
        "bulk": F.lit(f"하루 대량 조회 {n['bulk']}건 (임계값: {params.bulk_export_per_day}건)"),
    })
    return _finding(rows, category, severity, evidence, {
        "window": F.when(kind.isin("daily", "daily_critical"), kind),
        "hour": F.when(kind == "after_hours", F.hour("ts").cast("string")),
        "count": pick({k: F.lit(v) for k, v in n.items()}),
        "date": _day_text(),
    })


def alert_daily(events: DataFrame, params: AuditParams) -> DataFrame:
    """The event that takes a user's day past the daily limit."""
    return day_alerts(events, params, ["daily"])


def alert_daily_critical(events: DataFrame, params: AuditParams) -> DataFrame:
    """The event that takes a user's day past the critical limit."""
    return day_alerts(events, params, ["daily_critical"])


def alert_after_hours(events: DataFrame, params: AuditParams) -> DataFrame:
    """The personal-data event outside business hours that passes the daily limit."""
    return day_alerts(events, params, ["after_hours"])


def alert_bulk(events: DataFrame, params: AuditParams) -> DataFrame:
    """The bulk read that passes the daily limit."""
    return day_alerts(events, params, ["bulk"])


def alert_hourly(events: DataFrame, params: AuditParams) -> DataFrame:
    """Rolling count passing the hourly limit, once per user and clock hour.

    Slices that cannot reach the limit are never sorted.
    """
    n = params.max_queries_per_hour + 1
    ready = _prepared(events, params).select("user_id", "ts", "source_file", "line_no", "_slice")
    loads = _slice_loads(ready, params).where(F.col("_n") + F.col("_behind") >= n)
    rows = (
        _rolling(ready, loads, params)
        .where(F.col("rolling_count") == n)
        .groupBy("user_id", _hour_text(F.col("ts")).alias("hour_text"))
        .agg(F.min(F.struct(*ORDER)).alias("first"))
        .select("user_id", "hour_text", "first.*")
    )
    return _finding(
        rows, "EXCESSIVE_ACCESS",
        "CRITICAL" if n > params.critical_queries_per_hour else "HIGH",
        F.lit(f"1시간 내 조회 건수 {n}건 (임계값: {params.max_queries_per_hour}건/시간)"),
        {"window": F.lit("hourly"), "count": F.lit(n), "hour": F.col("hour_text")},
    )


def _optional(df: DataFrame, name: str, cast: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(cast)


def alert_single_exposure(events: DataFrame, params: AuditParams) -> DataFrame:
    """Single query over the exposure limits, once per user, day, line (of a file) and level."""
    exposure = F.col("effective_exposure")
    staged = events.where(
        (exposure > 0)
        & (exposure >= min(params.pii_single_query_high, params.pii_single_query_critical))
    ).select(
        "user_id",
        "source_file",
        "line_no",
        F.to_date("ts").alias("d"),
        F.when(exposure >= params.pii_single_query_critical, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.struct(
            "ts", exposure.alias("exposure"),
            _optional(events, "result_row_count", "bigint").alias("result_rows"),
            _optional(events, "pii_select_fields", "array<string>").alias("pii_fields"),
            _optional(events, "pii_select_count", "int").alias("field_count"),
            _optional(events, "is_select_star", "boolean").alias("is_select_star"),
        ).alias("row"),
    )
    rows = (
        staged.groupBy("user_id", "d", "source_file", "line_no", "severity")
        .agg(F.min_by("row", "row.ts").alias("row"))
        .select("user_id", "d", "source_file", "line_no", "severity", "row.*")
    )
    return _finding(
        rows, "PII_RECORD_EXPOSURE", F.col("severity"),
        F.concat(
            F.lit("단일 쿼리 개인정보 "), _grouped(F.col("exposure")), F.lit("건 노출 (PII필드 "),
            F.coalesce(F.col("field_count").cast("string"), F.lit("-")), F.lit("개 × 결과 "),
            F.coalesce(_grouped(F.col("result_rows")), F.lit("-")), F.lit("건)"),
        ),
        {
            "exposure": F.col("exposure"),
            "result_rows": F.col("result_rows"),
            "pii_fields": F.col("pii_fields"),
            "is_select_star": F.when(F.col("severity") == "CRITICAL", F.col("is_select_star")),
        },
    )


def alert_unique_targets(events: DataFrame, params: AuditParams) -> DataFrame:
    """The event that brings the day's distinct targets past the limit.

    First sightings are aggregated per target; the literal rank bound keeps at most that many rows per
    user-day from each task.
    """
    n = params.unique_targets_per_day + 1
    first_seen = (
        events.where(F.col("target") != "")
        .groupBy("user_id", F.to_date("ts").alias("d"), "target")
        .agg(F.min(F.struct(*ORDER)).alias("first"))
        .select("user_id", "d", "first.*")
    )
    rows = first_seen.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("user_id", "d").orderBy(*ORDER))
    ).where(F.col("_rank") == n)
    return _finding(
        rows, "EXCESSIVE_ACCESS", "MEDIUM",
        F.lit(f"하루 고유 대상 {n}개 접근 (임계값: {params.unique_targets_per_day}개)"),
        {"unique_targets": F.lit(n), "date": _day_text()},
    )


def daily_surge_rows(
    current: DataFrame, params: AuditParams, history: DataFrame | None = None, target_date: str | None = None,
) -> DataFrame:
    """Days whose count exceeds the mean of the up to 30 recorded days before.

    ``current`` and ``history`` are daily counts; current values replace those of history. A user's window
    holds one row per day.
    """
    base = current.withColumn("_now", F.lit(True))
    if history is not None:
        both = history.select("user_id", "d", F.col("cnt").alias("_old")).join(current, ["user_id", "d"], "full")
        base = both.select(
            "user_id", "d", F.coalesce("cnt", "_old").alias("cnt"), F.col("cnt").isNotNull().alias("_now"))
    prior = Window.partitionBy("user_id").orderBy("d").rowsBetween(-params.baseline_days, -1)
    rows = base.withColumns({
        "baseline_days": F.count(F.lit(1)).over(prior),
        "baseline_avg": F.avg("cnt").over(prior),
    }).where(
        F.col("_now")
        & (F.col("baseline_days") >= params.daily_surge_min_baseline_days)
        & (F.col("baseline_avg") != 0)
    )
    if target_date is not None:
        rows = rows.where(F.col("d") == F.lit(str(target_date)).cast("date"))
    ratio = (F.col("cnt") - F.col("baseline_avg")) / F.col("baseline_avg")
    return rows.withColumn("ratio", ratio).where(
        F.col("ratio") > params.daily_surge_threshold_pct / 100.0).drop("_now")


def alert_surge(
    current: DataFrame, params: AuditParams, history: DataFrame | None = None, target_date: str | None = None,
) -> DataFrame:
    """Findings for days far above the user's recent mean."""
    rows = daily_surge_rows(current, params, history, target_date).withColumn(
        "ts", F.col("d").cast("timestamp_ntz"))
    return _finding(
        rows, "EXCESSIVE_ACCESS",
        F.when(F.col("ratio") >= params.surge_high_ratio, "HIGH").otherwise("MEDIUM"),
        F.format_string(
            "당일 조회 %d건 - 최근 %d일 평균 %.0f건 대비 %.1f%% 초과",
            F.col("cnt"), F.col("baseline_days"), F.col("baseline_avg"), F.col("ratio") * 100),
        {
            "window": F.lit("daily_surge"),
            "date": _day_text(),
            "count": F.col("cnt"),
            "baseline_avg": F.round("baseline_avg", 1),
            "baseline_days": F.col("baseline_days"),
            "surge_pct": F.round(F.col("ratio") * 100, 1),
        },
        reference=F.lit(""),
    )


def access_findings(
    events: DataFrame, params: AuditParams, history: DataFrame | None = None,
    target_date: str | None = None, surge: bool = True,
) -> DataFrame:
    """All alerts of the counters as one findings table."""
    parts = [
        day_alerts(events, params),
        alert_hourly(events, params),
        alert_single_exposure(events, params),
        alert_unique_targets(events, params),
    ]
    if surge:
        parts.append(alert_surge(daily_counts(events), params, history, target_date))
    return reduce(DataFrame.unionByName, parts)


def alert_keys(findings: DataFrame) -> DataFrame:
    """Adds ``alert_key``: what makes an alert a repetition of an earlier one."""
    d = F.col("details")
    kind = F.coalesce(
        d["window"],
        F.when(F.col("category") == "AFTER_HOURS", "after_hours"),
        F.when(F.col("category") == "BULK_EXPORT", "bulk"),
        F.when(F.col("category") == "PII_RECORD_EXPOSURE",
               F.concat(F.lit("single_exposure_"), F.lower("severity"))),
        F.lit("unique_targets"),
    )
    line = F.when(F.col("category") == "PII_RECORD_EXPOSURE", F.col("raw_reference"))
    slot = F.when(d["window"] == "hourly", d["hour"]).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return findings.withColumn("alert_key", F.concat_ws("|", kind, "user_id", slot, line))


def alert_dedup(findings: DataFrame) -> DataFrame:
    """First alert of every key."""
    keyed = alert_keys(findings)
    cols = findings.columns
    return (
        keyed.groupBy("alert_key")
        .agg(F.min_by(F.struct(*cols), F.struct("ts", "raw_reference")).alias("row"))
        .select("alert_key", "row.*")
    )
