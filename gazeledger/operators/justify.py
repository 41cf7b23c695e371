"""Who has to explain themselves: priority, reasons, evidence, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.operators.filters import level_rank
from gazeledger.operators.ordered import ranked
from gazeledger.operators.risk import pii_types_text
from gazeledger.params import AuditParams

_single = lambda: F.col("max_single_query_exposure")
_total = lambda: F.col("total_pii_records_exposed")
_after = lambda: F.col("after_hours_count")
_day = lambda: F.col("max_queries_per_day")
_hour = lambda: F.col("max_queries_per_hour")
_bulk = lambda: F.col("bulk_export_count")
_selects = lambda: F.col("select_pii_query_count")


def _n(value: Column) -> Column:
    """Number with thousands separators."""
    return F.format_number(value.cast("bigint"), 0)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labels(mapping: dict[str, str], key: Column, default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), default)


def level_label(level: Column) -> Column:
    return _labels(C.LEVEL_LABELS, level, level)


def category_label(category: Column, detail: bool = False) -> Column:
    return _labels(C.DETAIL_CATEGORY_LABELS if detail else C.CATEGORY_LABELS, category, category)


def time_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(C.UNKNOWN_TIME))


def just_candidates(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("risk_level").isin("CRITICAL", "HIGH", "MEDIUM"))


def _tier(measure: Column, *steps: tuple[int, int]) -> Column:
    """Points of the first limit that the measure reaches."""
    chain = F
    for limit, points in steps:
        chain = chain.when(measure >= limit, points)
    return chain.otherwise(0)


def priority_score(params: AuditParams) -> Column:
    """Need for an explanation, from seven parts."""
    day, hour = params.max_queries_per_day, params.max_queries_per_hour
    score = (
        _tier(_single(), (20_000, 55), (5_000, 35), (1_000, 15))
        + _tier(_total(), (100_000, 40), (50_000, 30), (10_000, 20), (1_000, 8))
        + _tier(_after(), (20, 40), (5, 25), (1, 12))
        + _tier(_day(), (day * 4, 30), (day * 2, 20), (day, 8))
        + _tier(_hour(), (hour * 4, 20), (hour, 10))
        + F.least(F.lit(20), _bulk() * 5)
        + F.least(F.lit(15), F.size("pii_types") * 4)
    )
    return F.bround(score * F.when(F.col("risk_level") == "CRITICAL", 1.25).otherwise(1.0), 2).cast("double")


def urgency(score: Column) -> Column:
    return F.when(score >= 100, "즉시").when(score >= 60, "긴급").otherwise("검토")


def first_after_hours(findings: DataFrame) -> DataFrame:
    """Per user the earliest after-hours finding that has a date and a non-zero hour."""
    d = F.col("details")
    rows = findings.where(
        (F.col("category") == "AFTER_HOURS") & (d["hour"] != "0") & d["date"].isNotNull())
    return rows.groupBy("user_id").agg(F.min_by(
        F.struct(d["date"].alias("date"), d["hour"].alias("hour"), d["count"].alias("count"), "raw_reference"),
        F.struct("ts", "raw_reference"),
    ).alias("night"))


def reasons(params: AuditParams) -> Column:
    """Reason sentences in fixed order; needs ``night`` of ``first_after_hours``."""
    day, hour = params.max_queries_per_day, params.max_queries_per_hour
    office = f"{params.business_hours_start:02d}:00~{params.business_hours_end:02d}:00"
    night = F.col("night")
    single = (
        F.when(_single() >= 20_000, _text(
            "[긴급] 단일 쿼리 1건에서 개인정보 ", _n(_single()), "건 일시 노출 — 의도적 대량 추출 또는 무단 반출 가능성"))
        .when(_single() >= 5_000, _text(
            "단일 쿼리에서 개인정보 ", _n(_single()), "건 반환 (화면 또는 API 응답으로 노출된 것으로 추정)"))
        .when(_single() >= 1_000, _text("단일 쿼리에서 개인정보 ", _n(_single()), "건 반환"))
    )
    total = (
        F.when(_total() >= 10_000, _text(
            "점검 기간 내 이름·전화번호 등 개인정보가 포함된 쿼리를 ", _n(_selects()), "건 실행, 총 ", _n(_total()),
            "건의 개인정보 레코드 노출 추정"))
        .when(_total() >= 1_000, _text(
            "SELECT 절에 개인정보 컬럼을 포함한 쿼리 ", _n(_selects()), "건 실행, 총 ", _n(_total()), "건 노출 추정"))
    )
    found = F.array_compact(F.array(
        single,
        total,
        F.when(_after() > 0, _text(
            f"업무 시간({office}) 외 개인정보 조회 ", _n(_after()),
            "건 발생 (개인정보보호법 시행령 제30조 접근권한 관리 위반 소지)")),
        F.when(_day() >= day, _text(
            "일별 최대 ", _n(_day()), f"회 조회 — 정책 임계값({day:,}회) 대비 ", _n(_day() - day),
            "회 초과 (비정상 자동화 또는 반복 접근 의심)")),
        F.when(_hour() >= hour, _text(
            "1시간 내 최대 ", _n(_hour()), f"회 집중 조회 (임계값 {hour:,}회 초과 — 스크립트·매크로 사용 의심)")),
        F.when(_bulk() > 0, _text(
            "대량 데이터 조회(BULK) ", _n(_bulk()), "건 발생 — 데이터 추출·외부 전송 가능성 확인 필요")),
        F.when(F.size("pii_types") >= 3, _text(
            "다양한 개인정보 유형(", pii_types_text(F.col("pii_types")), ") 접근 — 광범위 정보 수집 가능성")),
        F.when(night.isNotNull(), _text(
            "최초 야간 조회 사례: ", night["date"], " ", F.lpad(night["hour"], 2, "0"), "시경 개인정보 ",
            night["count"].cast("string"), "건 조회 (참조: ", night["raw_reference"], ")")),
    ))
    fallback = _text(
        "위험 점수 ", F.format_string("%.1f", "risk_score"), "점 (", F.col("risk_level"), ") — 세부 내역은 아래 핵심 증거 참조")
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def screen_estimate() -> Column:
    """What the screens are likely to have shown."""
    nothing = (
        "▶ 화면 직접 노출 추정 불가\n"
        "   검출된 개인정보가 주로 WHERE 절 검색 조건(예: 전화번호로 고객 검색)에 사용되었거나,\n"
        "   쿼리 결과 건수를 로그에서 확인할 수 없어 노출량을 정량화하기 어렵습니다.\n"
        "   단, 개인정보가 검색 키로 사용된 것 자체는 위반 소지가 있을 수 있습니다."
    )
    how = (
        "\n▶ 실제 화면 내용을 정확히 확인하려면:\n"
        "   1) DB 감사 로그에서 해당 세션 ID의 쿼리 및 Rows_sent 확인\n"
        "   2) 애플리케이션 서버 로그에서 API 응답 내용 또는 화면 렌더링 데이터 확인\n"
        "   3) DB Performance Schema / Slow Query Log 상세 조회\n"
        "   4) DLP 솔루션 또는 네트워크 패킷 캡처 (민감정보 탐지 솔루션 연동 시)\n"
        "   ※ 본 보고서의 수치는 SELECT 쿼리 분석 기반 추정값입니다."
    )
    unknown = F.col("unknown_exposure_query_count")
    paragraphs = F.array_compact(F.array(
        F.lit("▶ 화면(또는 API 응답) 노출 추정"),
        F.when((_selects() > 0) & (_total() > 0), _text(
            "   이름·전화번호·주소 등 개인정보 컬럼을 SELECT 절에 포함한 쿼리 ", _n(_selects()), "건이 실행되었으며,\n"
            "   이 쿼리들이 반환한 결과 건수를 합산하면 총 ", _n(_total()),
            "건의 개인정보 레코드가 화면 또는 응답으로 전달된 것으로 추정됩니다.")),
        F.when(_single() > 0, _text(
            "\n   ※ 단일 조회 최대 노출: ", _n(_single()), "건\n      (한 번의 쿼리로 ", _n(_single()),
            "명 분량의 개인정보가 한꺼번에 반환)")),
        F.when(unknown > 0, _text(
            "\n   ※ 결과 건수 확인 불가 쿼리 ", _n(unknown), "건 추가 존재\n"
            "      (로그에 결과 건수가 기록되지 않아 위 수치에 미포함 — 실제 노출량은 더 클 수 있음)")),
        F.lit(how),
    ))
    return F.when((_total() == 0) & (_selects() == 0), F.lit(nothing)).otherwise(F.array_join(paragraphs, "\n"))


def field_labels(fields: Column) -> Column:
    """Column names as Korean labels, each once, in order."""
    labels = F.array_distinct(F.transform(fields, lambda f: _labels(C.FIELD_LABELS, F.lower(f), f)))
    return F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(F.lit("개인정보 컬럼"))


def key_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """Per user the ``k`` gravest findings: severity, exposure, time.

    The literal rank bound keeps at most ``k`` rows per user from each task.
    """
    exposure = F.coalesce(F.col("details.effective_exposure"), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(
        level_rank(F.col("severity")).desc(), exposure.desc(), F.col("ts").asc_nulls_first(),
        "raw_reference", "finding_id", "category", "evidence"))
    return findings.withColumn("finding_rank", rank).where(F.col("finding_rank") <= k)


def key_finding_rows(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """The gravest findings with display fields; the shown severity is the level of the user."""
    d = F.col("details")
    fields, rows, exposed = d["pii_select_fields"], d["result_row_count"], d["effective_exposure"]
    kind = category_label(F.col("category"))
    types = F.when(F.size("pii_types") > 0, F.array_join("pii_types", ", ")).otherwise("-")
    head = F.when(F.size(fields) > 0, _text("[", kind, "] ", field_labels(fields), " 컬럼 조회")).otherwise(
        _text("[", kind, "] ", types))
    line = _text(
        head,
        F.when(rows > 0, _text(" — 결과 ", _n(rows), "건 반환")).otherwise(F.lit("")),
        F.when(exposed > 0, _text(" (노출 추정 ", _n(exposed), "건)")).otherwise(F.lit("")),
    )
    shown = key_findings(findings).join(summary.select("user_id", "risk_level"), "user_id")
    return shown.select(
        "user_id", "finding_rank", "finding_id", "category", kind.alias("category_kr"),
        F.col("risk_level").alias("severity"),
        level_label(F.col("risk_level")).alias("severity_kr"),
        time_text(F.col("ts")).alias("timestamp_str"),
        types.alias("pii_types_str"),
        _labels(C.KEY_EXPOSURE_LABELS, d["exposure_type"], F.lit("")).alias("exposure_type_kr"),
        rows.alias("result_rows"),
        exposed.alias("effective_exposure"),
        F.coalesce(d["original_value"], F.lit("")).alias("original_value"),
        F.coalesce(d["redacted_value"], F.lit("")).alias("redacted_value"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        "raw_reference",
        line.alias("summary"),
    )


def questions(params: AuditParams) -> Column:
    """Questions for the user; the last one is always asked."""
    office = f"{params.business_hours_start:02d}:00~{params.business_hours_end:02d}:00"
    return F.array_compact(F.array(
        F.when((_total() >= 1_000) | (_selects() > 0), _text(
            "이름·전화번호 등 개인정보 컬럼이 포함된 쿼리를 점검 기간 내 ", _n(_selects()),
            "건 실행하셨습니다. 각 조회의 구체적인 업무 목적을 설명해 주세요.")),
        F.when(_single() >= 5_000, _text(
            "단일 쿼리에서 ", _n(_single()),
            "건의 개인정보를 한꺼번에 조회하셨습니다. 해당 조회가 필요했던 구체적 업무를 설명하고, "
            "결과 데이터를 어떻게 활용하셨는지 (화면 확인, 파일 저장, 외부 전송 여부) 답변해 주세요.")),
        F.when(_after() > 0, _text(
            f"업무 시간({office}) 외에 개인정보를 포함한 조회가 ", _n(_after()),
            "건 발생하였습니다. 야간·주말 조회가 필요했던 사유와 승인 여부를 설명해 주세요.")),
        F.when(_day() >= params.max_queries_per_day, _text(
            "하루 최대 ", _n(_day()),
            "회의 조회가 발생하였습니다. 단시간 내 대량 조회가 발생한 상황"
            "(자동화 스크립트 사용 여부, 특정 작업 수행 여부)을 설명해 주세요.")),
        F.when(_bulk() > 0, _text(
            "대량 데이터 조회가 ", _n(_bulk()),
            "건 감지되었습니다. 데이터를 파일로 내려받거나 외부 시스템으로 전송하셨다면 "
            "목적, 상대방, 현재 보관 방법을 알려주세요.")),
        F.lit(
            "조회하신 개인정보를 업무 목적 외 용도로 활용하거나, "
            "외부로 반출(출력, 다운로드, 메신저·이메일 전송 등)하신 사례가 있으신가요? "
            "있다면 상세 내용을 기재해 주세요."),
    ))


def one_line(params: AuditParams, first_reason: Column) -> Column:
    """Subject line: the main measures, else the first reason."""
    parts = F.array_compact(F.array(
        F.when(_single() >= 20_000, _text("단일 ", _n(_single()), "건 노출"))
        .when(_total() >= 10_000, _text("총 ", _n(_total()), "건 노출")),
        F.when(_after() > 0, _text("야간 ", _after().cast("string"), "건")),
        F.when(_day() >= params.max_queries_per_day, _text("일 ", _n(_day()), "회 과다조회")),
    ))
    return _text(
        F.col("user_id"), ": ",
        F.when(F.size(parts) > 0, F.array_join(parts, " / ")).otherwise(F.substring(first_reason, 1, 60)))


def priority_ranking(candidates: DataFrame) -> DataFrame:
    """Adds ``priority_rank`` over all candidates: score, then risk, then user."""
    order = [F.col("priority_score").desc(), F.col("risk_score").desc(), F.col("user_id").asc()]
    return ranked(candidates, order, "priority_rank")


def justification_scores(summary: DataFrame, params: AuditParams) -> DataFrame:
    """Candidates with priority score, urgency and rank."""
    scored = just_candidates(summary).withColumn("priority_score", priority_score(params))
    return priority_ranking(scored.withColumn("urgency", urgency(F.col("priority_score"))))


def justification(summary: DataFrame, findings: DataFrame, params: AuditParams) -> DataFrame:
    """One row per candidate with reasons, estimate, evidence, questions and subject line."""
    ranked = justification_scores(summary, params)
    keys = key_finding_rows(findings, summary)
    fields = [c for c in keys.columns if c != "user_id"]
    evidence = keys.groupBy("user_id").agg(  # at most five rows per user
        F.array_sort(F.collect_list(F.struct(*fields))).alias("key_findings"))
    rows = ranked.join(first_after_hours(findings), "user_id", "left").join(evidence, "user_id", "left")
    rows = rows.withColumn("reasons", reasons(params))
    return rows.select(
        "priority_rank", "user_id", "risk_score", "risk_level", "priority_score", "urgency", "reasons",
        screen_estimate().alias("screen_estimate"),
        "key_findings",
        questions(params).alias("questions"),
        one_line(params, F.get("reasons", 0)).alias("summary_one_line"),
    )


def top_k_justification(ranked: DataFrame, k: int = 10) -> DataFrame:
    return ranked.where(F.col("priority_rank") <= k).orderBy("priority_rank")
