"""How many personal records a logged SQL statement showed; a keyword heuristic over the query log."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions.regex import DOTALL, by_flags, contains_any, extracted, first_group, folded, let, matches, once, strip
from gazeledger.params import AuditParams

SHOWING = ["FULL_EXPOSURE", "PARTIAL_EXPOSURE"]


# Substrings of the lower-cased text that each row-count pattern needs: one of every list.
_ROW_NEEDS = [
    [["rows_sent"]], [["processed"]], [["rowsaffected", "rowscount"]], [["건"], ["반환", "조회", "검색", "출력"]], [["건"], ["반환", "결과"]],
    [["returned"], ["row"]], [["row"], ["returned", "sent", "affected", "fetched"]],
    [["selectlist", "executequery", "findall"], ["result"]],
    [[f"{what}{of}" for what in ("total", "result") for of in ("count", "size", "rows")]],
    [["fetchsize", "fetchcount"]], [["row"], ["set"]], [["rows"], ["="]], [["affected"], ["row"]],
]


def is_select(sql: Column) -> Column:
    return matches(sql, r"\bSELECT\b")


def select_star(sql: Column) -> Column:
    return matches(sql, r"\bSELECT\s+(?:\*|\w+\.\*)")


def sensitive_table(sql: Column) -> Column:
    """The plain table list after the first usable FROM names a sensitive table."""
    tables = F.lower(extracted(sql, r"""\bFROM\s+([\w,\s`"']+?)(?:\bWHERE\b|\bJOIN\b|\bORDER\b|$)"""))
    return let(tables, lambda t: contains_any(t, C.SENSITIVE_TABLES))


def select_list(sql: Column) -> Column:
    """Text between SELECT and FROM without what stands in parentheses; closing ones of depth 1 stay."""

    def outside(raw: Column) -> Column:
        # '(' opens a level before it is written, ')' closes one before it is written: at depth zero only
        # plain text and the ')' that returns to zero remain. Pieces end at each bracket.
        def step(acc: Column, piece: Column) -> Column:
            mark = F.left(piece, F.lit(1))
            depth = acc["depth"] + F.when(mark == "(", 1).when(mark == ")", -1).otherwise(0)
            return F.struct(
                depth.alias("depth"),
                F.concat(acc["text"], F.when(depth == 0, piece).otherwise(F.lit(""))).alias("text"),
            )

        pieces = F.split(raw, r"(?=[()])", -1)
        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
        return F.when(
            raw.contains("(") | raw.contains(")"), F.aggregate(pieces, start, step, lambda acc: acc["text"])
        ).otherwise(raw)

    return F.when(
        is_select(sql),
        strip(let(extracted(sql, r"\bSELECT\s+(.*?)\bFROM\b", flags=DOTALL), outside)),
    ).otherwise(F.lit(""))


def where_clause(sql: Column) -> Column:
    pattern = r"\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b|;|$)"
    return F.when(is_select(sql), strip(extracted(sql, pattern, flags=DOTALL))).otherwise(F.lit(""))


def pii_columns(clause: Column) -> Column:
    """Comma-separated entries of a clause whose last name part contains a personal-data keyword."""

    def name(entry: Column) -> Column:
        plain = by_flags(entry, "(?iuU)", lambda f: F.regexp_replace(entry, f + r"\bAS\s+\w+", ""))
        last = F.element_at(F.split(strip(plain), r"\.", -1), -1)
        return F.btrim(F.lower(strip(last)), F.lit("`\"' "))

    names = F.transform(F.split(clause, ",", -1), name)
    return F.when(
        clause != "", F.filter(names, lambda n: contains_any(n, C.PII_COLUMN_KEYWORDS))
    ).otherwise(F.array().cast("array<string>"))


def result_rows(text: Column) -> Column:
    """Row count of the first pattern that gives one; NULL when the log does not tell."""

    def count(pattern: str) -> Column:
        # text without a digit is no number, so it needs no test
        return F.replace(first_group(text, pattern), F.lit(","), F.lit("")).try_cast("bigint")

    def search(low: Column) -> Column:
        def possible(needs: list[list[str]]) -> Column:
            return reduce(and_, [contains_any(low, words) for words in needs])

        return F.coalesce(*[F.when(possible(needs), count(p)) for needs, p in zip(_ROW_NEEDS, C.ROW_COUNT_PATTERNS)])

    return F.when(matches(text, r"\d", "(?U)"), let(folded(text), search))


def select_count(star: Column, sensitive: Column, fields: Column) -> Column:
    """Number of personal fields a row shows; a star counts as 3, or 5 on a sensitive table."""
    return F.when(star & sensitive, 5).when(star, 3).otherwise(F.size(fields))


def has_select_pii(star: Column, fields: Column) -> Column:
    return star | (F.size(fields) > 0)


def exposure_type(select: Column, star: Column, count: Column, where_fields: Column) -> Column:
    return (
        F.when(~select, "NONE")
        .when((count > 0) & star, "FULL_EXPOSURE")
        .when(count > 0, "PARTIAL_EXPOSURE")
        .when(F.size(where_fields) > 0, "SEARCH_ONLY")
        .otherwise("NONE")
    )


def effective_exposure(rows: Column, count: Column) -> Column:
    """Rows times fields; NULL when the rows are unknown or nothing is shown."""
    return F.when(count > 0, F.try_multiply(rows, count.cast("bigint")))


def estimate_exposure(events: DataFrame, sql: str = "query_text", context: str = "raw_line") -> DataFrame:
    """Adds the exposure columns to an events table."""
    q = F.col(sql)
    fields = F.array().cast("array<string>")
    staged = events.withColumns({
        "_select": once(is_select(q)),
        "is_select_star": once(select_star(q)),
        "is_sensitive_table": once(sensitive_table(q)),
        "_context": once(F.concat(F.coalesce(F.col(context), F.lit("")), F.lit(" "), q)),
    })
    staged = staged.withColumns({
        "result_row_count": once(result_rows(F.col("_context"))),
        "_list": once(F.when(F.col("_select") & ~F.col("is_select_star"), select_list(q))),
        "_where": once(F.when(F.col("_select"), where_clause(q))),
    })
    staged = staged.withColumns({
        "pii_select_fields": once(F.coalesce(pii_columns(F.col("_list")), fields)),
        "pii_where_fields": once(F.coalesce(pii_columns(F.col("_where")), fields)),
    })
    staged = staged.withColumn(
        "pii_select_count",
        select_count(F.col("is_select_star"), F.col("is_sensitive_table"), F.col("pii_select_fields")),
    )
    return staged.withColumns({
        "exposure_type": exposure_type(
            F.col("_select"), F.col("is_select_star"), F.col("pii_select_count"), F.col("pii_where_fields")),
        "effective_exposure": effective_exposure(F.col("result_row_count"), F.col("pii_select_count")),
    }).drop("_select", "_context", "_list", "_where")


def exposure_rollup_aggs() -> list[Column]:
    """Aggregates of the per-user exposure roll-up."""
    showing = F.col("exposure_type").isin(SHOWING)
    shown = F.when(showing, F.col("effective_exposure"))
    return [
        F.coalesce(F.sum(shown), F.lit(0)).cast("bigint").alias("total_pii_records_exposed"),
        F.greatest(F.coalesce(F.max(shown), F.lit(0)), F.lit(0)).cast("bigint").alias("max_single_query_exposure"),
        F.count_if(showing & F.col("effective_exposure").isNull()).alias("unknown_exposure_query_count"),
        F.count_if(showing).alias("select_pii_query_count"),
        F.count_if(F.col("exposure_type") == "SEARCH_ONLY").alias("search_only_query_count"),
    ]


def exposure_rollup(events: DataFrame) -> DataFrame:
    user = F.coalesce(F.nullif("user_id", F.lit("")), F.lit(C.UNKNOWN_USER)).alias("user_id")
    return events.groupBy(user).agg(*exposure_rollup_aggs())


def exposure_level(exposed: Column, params: AuditParams) -> Column:
    """Level by exposed records alone."""
    return (
        F.when(exposed >= params.pii_exposure_critical, "CRITICAL")
        .when(exposed >= params.pii_exposure_high, "HIGH")
        .when(exposed >= params.pii_exposure_medium, "MEDIUM")
        .otherwise("LOW")
    )


def _grouped(number: Column) -> Column:
    return F.format_number(number.cast("bigint"), 0)


def exposure_display(exposed: Column, unknown: Column) -> Column:
    """Per-user text, e.g. ``1,200건 + 건수미확인 3건``."""
    return F.concat(
        _grouped(exposed), F.lit("건"),
        F.when(unknown > 0, F.concat(F.lit(" + 건수미확인 "), unknown.cast("string"), F.lit("건"))).otherwise(F.lit("")),
    )


def event_exposure_display(kind: Column, where_fields: Column, count: Column, exposure: Column) -> Column:
    """Per-event text: search condition, unknown count, or the exposed records."""
    fields = F.when(F.size(where_fields) > 0, F.concat_ws(",", where_fields)).otherwise(F.lit("-"))
    return (
        F.when(kind.isin("NONE", "SEARCH_ONLY"), F.concat(F.lit("검색조건("), fields, F.lit(")")))
        .when(exposure.isNull(), F.concat(F.lit("노출필드 "), count.cast("string"), F.lit("개 (건수미상)")))
        .otherwise(F.concat(_grouped(exposure), F.lit("건")))
    )


def exposure_summary(count: Column, rows: Column, exposure: Column) -> Column:
    """Per-statement text: fields × rows = records."""
    head = F.concat(F.lit("노출 필드 "), count.cast("string"), F.lit("개"))
    return F.when(exposure.isNull(), F.concat(head, F.lit(" (건수 미상)"))).otherwise(
        F.concat(head, F.lit(" × "), _grouped(rows), F.lit("건 = "), _grouped(exposure), F.lit("건")))
