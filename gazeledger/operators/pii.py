"""Personal data in text: scan, overlap rule, masks, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions.extract import short_hash
from gazeledger.functions.pii_values import VALIDATORS, mask_value
from gazeledger.functions.regex import (
    ASCII_IGNORE_CASE, OPEN, SHUT, all_spans, by_flags, contains_any, folded, is_ascii, let, matches, once, unmark,
)
from gazeledger.operators.filters import level_rank, scan_gate
from gazeledger.params import AuditParams
from gazeledger.schemas import HITS, details_struct

RULES = {name: (pattern, severity, grouped) for name, pattern, severity, grouped in C.PII_RULES}

# What a text must hold for a pattern to match at all: a number of digits, and one of some substrings of the
# lower-cased text. A type whose needs are not met does not start its regex.
_NEEDS: dict[str, tuple[int, list[str]]] = {
    "RRN": (13, []),
    "PHONE": (9, []),
    "ACCOUNT_NO": (10, ["계좌", "account", "acct", "bankno", "bank_no"]),
    "CREDIT_CARD": (16, []),
    "PASSPORT": (7, []),
    "EMAIL": (0, ["@"]),
    "NAME_IN_QUERY": (0, ["name", "이름", "성명", "고객명", "사용자명", "담당자", "접속자", "수검자"]),
    "ADDRESS": (1, ["시", "도", "군", "구"]),
    "EMP_ID_IN_QUERY": (4, ["emp", "사원", "사번", "직원", "staff_", "user_id", "userid"]),
    "EMP_ID_STANDALONE": (6, []),
    "BIRTHDATE": (8, ["birth", "생년월일", "dob"]),
    "IP_ADDRESS": (0, []),  # see _address_marks
}
_IN_A_ROW = ("RRN", "PASSPORT", "EMP_ID_STANDALONE")  # need six digits in a row
_HANGUL = ("NAME_IN_QUERY", "ADDRESS")  # need two syllables in a row

_SPOKEN = f"[{C.SPOKEN_DIGITS}]"
_SPOKEN_RUN = rf"{_SPOKEN}(?:[ \t]*-?[ \t]*{_SPOKEN}){{2,}}"


# --- spoken digits ------------------------------------------------------------


def spoken_digits(text: Column) -> Column:
    """Replace runs of three or more spoken digits; blanks inside a run go, hyphens stay."""

    def convert(pieces: Column) -> Column:
        def piece(p: Column) -> Column:
            parts = F.split(p, SHUT, 2)
            return F.concat(
                F.translate(F.get(parts, 0), C.SPOKEN_DIGITS + " \t", C.SPOKEN_VALUES), F.get(parts, 1))

        return F.concat(
            F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces) - 1), piece), ""))

    marked = F.regexp_replace(unmark(text), _SPOKEN_RUN, OPEN + "$0" + SHUT)
    converted = let(
        F.split(marked, OPEN, -1), lambda ps: F.when(F.size(ps) > 1, convert(ps)).otherwise(text))
    return F.when(~is_ascii(text) & text.rlike(_SPOKEN), converted).otherwise(text)


# --- scan ---------------------------------------------------------------------


def type_spans(text: Column, pii_type: str) -> Column:
    """Valid matches of one pattern as ARRAY<STRUCT<start, end, value>>, in text order."""
    pattern, _, grouped = RULES[pii_type]
    value = 1 if grouped else 0
    spans = F.when(is_ascii(text), all_spans(text, pattern, value, ASCII_IGNORE_CASE)).otherwise(
        all_spans(text, pattern, value))
    if pii_type in VALIDATORS:
        spans = F.filter(spans, lambda s: VALIDATORS[pii_type](s["value"]))
    return spans


def _hangul(text: Column) -> Column:
    return ~is_ascii(text) & text.rlike("[가-힣]{2}")


def may_hold(text: Column) -> Column:
    """What any pattern needs: four digits in a row, a dot between digits, an at sign, two colons with no more than four hex
    digits between them, or two Hangul syllables in a row. Most texts hold none of it."""
    return (
        text.contains("@") | matches(text, r"\d(?:\d{3}|\.\d)", "(?U)")
        | (text.contains(":") & text.rlike(":[0-9a-fA-F]{0,4}:")) | _hangul(text))


def _address_marks(text: Column) -> Column:
    """Four dotted numbers, a double colon or four colons: no IP address goes without."""
    def count(mark: str) -> Column:
        return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))

    dotted = (count(".") >= 3) & matches(text, r"(?:\d{1,3}\.){3}\d", "(?U)")
    return dotted | text.contains("::") | (count(":") >= 4)


def _possible(pii_type: str, known: Column) -> Column:
    count, words = _NEEDS[pii_type]
    lower = known["lower"]
    if pii_type == "IP_ADDRESS":
        return _address_marks(lower)
    test = known["digits"] >= count if count else F.lit(True)
    if pii_type in _IN_A_ROW:
        test = test & known["in_a_row"]
    if pii_type in _HANGUL:
        test = test & known["hangul"]
    return test & contains_any(lower, words) if words else test


def _type_hits(text: Column, pii_type: str) -> Column:
    severity = RULES[pii_type][1]
    return F.transform(
        type_spans(text, pii_type),
        lambda s: F.struct(
            F.lit(pii_type).alias("pii_type"),
            F.lit(severity).alias("severity"),
            mask_value(s["value"], pii_type).alias("redacted_value"),
            s["value"].alias("original_value"),
            s["start"].alias("match_start"),
            s["end"].alias("match_end"),
        ),
    ).cast(HITS)


def resolve_overlaps(by_type: Column) -> Column:
    """Fold ARRAY<ARRAY<hit>> in priority order; a hit that starts or ends inside an accepted one is out.

    A hit that encloses an accepted one stays. Hits of one type never overlap each other.
    """

    def accept(taken: Column, hits: Column) -> Column:
        def clear(h: Column) -> Column:
            return ~F.exists(
                taken,
                lambda t: ((t["match_start"] <= h["match_start"]) & (h["match_start"] < t["match_end"]))
                | ((t["match_start"] < h["match_end"]) & (h["match_end"] <= t["match_end"])),
            )

        return F.when(F.size(hits) == 0, taken).otherwise(F.concat(taken, F.filter(hits, clear)))

    return F.aggregate(by_type, F.array().cast(HITS), accept)


def scan_text(text: Column) -> Column:
    """All hits of one text, in pattern priority order."""

    def scan(known: Column) -> Column:
        hits = [
            F.when(_possible(name, known), _type_hits(text, name)).otherwise(
                F.array().cast(HITS))
            for name in RULES
        ]
        return resolve_overlaps(F.array(*hits))

    digits = F.char_length(by_flags(text, "(?U)", lambda f: F.regexp_replace(text, f + r"\D+", "")))
    in_a_row = matches(text, r"\d{6}", "(?U)")
    return let(
        F.struct(digits.alias("digits"), in_a_row.alias("in_a_row"), _hangul(text).alias("hangul"), folded(text).alias("lower")), scan)


def first_per_value(hits: Column) -> Column:
    """Keep the first hit of every (type, value)."""

    def keyed(keys: Column) -> Column:
        return F.transform(F.array_distinct(keys), lambda k: F.element_at(hits, F.array_position(keys, k).cast("int")))

    return F.when(
        F.size(hits) > 1,
        let(F.transform(hits, lambda h: F.concat(h["pii_type"], F.lit(SHUT), h["original_value"])), keyed),
    ).otherwise(hits)


def scan_pii(events: DataFrame, text: str | None = None, log_type: str = "log_type") -> DataFrame:
    """Adds ``pii_hits``.

    The text is scanned as written and, when it holds spoken digits, once more with them as digits. Offsets
    of the second scan refer to the rewritten text. The gate is tried only on texts that may hold a match.
    """
    source = F.col(text) if text else F.coalesce(F.nullif("query_text", F.lit("")), F.col("raw_line"))
    kind = F.col(log_type) if log_type in events.columns else F.lit("unknown")
    staged = events.withColumn("_text", source)
    staged = staged.withColumn("_plain", once(spoken_digits(F.col("_text"))))
    texts = F.when(F.col("_plain") == F.col("_text"), F.array("_text")).otherwise(F.array("_text", "_plain"))
    hits = let(F.flatten(F.transform(texts, scan_text)), first_per_value)
    none = F.array().cast(HITS)
    wanted = F.exists(texts, may_hold) & scan_gate(F.col("_plain"), kind)
    return staged.withColumn("pii_hits", F.coalesce(once(F.when(wanted, hits)), none)).drop("_text", "_plain")


def hits_of_type(df: DataFrame, pii_type: str, text: str, keys: list[str]) -> DataFrame:
    """One row per valid match of one pattern, without the overlap rule."""
    spans = df.select(*keys, once(type_spans(F.col(text), pii_type)).alias("_spans"))
    found = spans.select(*keys, F.explode("_spans").alias("s"))
    return found.select(
        *keys,
        F.col("s.start").alias("match_start"),
        F.col("s.end").alias("match_end"),
        F.col("s.value").alias("value"),
        mask_value(F.col("s.value"), pii_type).alias("masked"),
    )


# --- hits to findings ---------------------------------------------------------


def event_severity(hits: Column) -> Column:
    """Worst severity of an event's hits, NULL without hits."""
    worst = F.array_max(F.transform(hits, lambda h: level_rank(h["severity"])))
    return F.get(F.array(*[F.lit(v) for v in C.LEVELS]), worst - 1)


def escalated_severity(severity: Column, exposure: Column, params: AuditParams) -> Column:
    """Severity raised by the number of records the query exposed."""
    return (
        F.when(exposure >= params.escalate_critical, F.lit("CRITICAL"))
        .when((exposure >= params.escalate_high) & (severity != "CRITICAL"), F.lit("HIGH"))
        .otherwise(severity)
    )


def severity_score(severity: Column) -> Column:
    scores = F.create_map(*[F.lit(x) for pair in C.SEVERITY_SCORES.items() for x in pair])
    return F.coalesce(F.try_element_at(scores, severity), F.lit(0.0))


def evidence_snippet(text: Column, start: Column, end: Column, pii_type: Column, value: Column) -> Column:
    """A stretch of the text with a ``[TYPE:value]`` tag in place of the match: the first 200 characters if the match lies
    in them, else the match with up to 100 characters on either side."""
    early = end <= 200
    first = F.when(early, F.lit(0)).otherwise(F.greatest(start - 100, F.lit(0)))
    after = F.when(early, 200 - end).otherwise(F.lit(100))
    return F.concat(
        F.substring(text, first + 1, start - first),
        F.lit("["), pii_type, F.lit(":"), value, F.lit("]"),
        F.substring(text, end + 1, after),
    )


def pii_findings(events: DataFrame, params: AuditParams) -> DataFrame:
    """One finding per hit of a scanned events table (``pii_hits`` and exposure columns present)."""
    def have(name: str, cast: str) -> Column:
        return F.col(name) if name in events.columns else F.lit(None).cast(cast)

    rows = events.where(F.size("pii_hits") > 0).select(
        "source_file", "line_no",
        F.coalesce(F.nullif("user_id", F.lit("")), F.lit(C.UNKNOWN_USER)).alias("user_id"),
        "ts",
        F.coalesce(F.nullif("query_text", F.lit("")), F.col("raw_line")).alias("_text"),
        have("exposure_type", "string").alias("exposure_type"),
        have("result_row_count", "bigint").alias("result_row_count"),
        have("pii_select_fields", "array<string>").alias("pii_select_fields"),
        have("effective_exposure", "bigint").alias("effective_exposure"),
        have("is_select_star", "boolean").alias("is_select_star"),
        F.inline("pii_hits"),
    )
    severity = escalated_severity(F.col("severity"), F.col("effective_exposure"), params)
    return rows.withColumn("severity", severity).select(
        short_hash(F.col("source_file"), F.col("line_no"), F.col("pii_type"), F.col("match_start")).alias("finding_id"),
        F.lit("PII_EXPOSURE").alias("category"),
        "severity",
        "user_id",
        "ts",
        F.array("pii_type").alias("pii_types"),
        evidence_snippet(
            F.col("_text"), F.col("match_start"), F.col("match_end"), F.col("pii_type"), F.col("original_value")
        ).alias("evidence"),
        F.concat_ws(":", "source_file", F.col("line_no").cast("string")).alias("raw_reference"),
        severity_score(F.col("severity")).alias("score"),
        details_struct({
            c: F.col(c) for c in (
                "exposure_type", "result_row_count", "pii_select_fields", "effective_exposure",
                "is_select_star", "original_value", "redacted_value")
        }).alias("details"),
    )


def pii_types_per_user(events: DataFrame) -> DataFrame:
    """Distinct types per user as a sorted array."""
    pairs = events.select(
        F.coalesce(F.nullif("user_id", F.lit("")), F.lit(C.UNKNOWN_USER)).alias("user_id"),
        F.explode(F.array_distinct("pii_hits.pii_type")).alias("pii_type"),
    )
    return pairs.groupBy("user_id").agg(F.array_sort(F.collect_set("pii_type")).alias("pii_types"))
