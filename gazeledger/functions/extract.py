"""Fields that every log family takes out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions.regex import CASE_SENSITIVE, first_group, folded, let, matches

# A substring of the lower-cased text without which each user pattern cannot match.
_USER_NEEDS = ["user", "employee", "emp", "사원번호", "db user", "loginid", "account", "["]
_BULK_NEEDS = ["limit", "rownum", "fetch", "top"]


def user_id(text: Column) -> Column:
    """First pattern whose value is usable: two characters or more and no placeholder."""

    def usable(value: Column) -> Column:
        return F.when((F.char_length(value) >= 2) & ~F.lower(value).isin(C.NOT_USERS), value)

    def search(low: Column) -> Column:
        return F.coalesce(*[
            F.when(low.contains(need), let(first_group(text, p), usable))
            for need, p in zip(_USER_NEEDS, C.USER_PATTERNS)
        ])

    return let(folded(text), search)


def ip_address(text: Column) -> Column:
    return F.when(text.contains("."), first_group(text, C.IP_PATTERN, 0, CASE_SENSITIVE))


def action(text: Column) -> Column:
    return F.upper(first_group(text, C.ACTION_PATTERN))


def table_name(sql: Column) -> Column:
    return first_group(sql, C.TABLE_PATTERN)


def bulk_flag(sql: Column, row_threshold: int) -> Column:
    """A row limit at or above the threshold, or a star select without a condition."""

    def large(pattern: str) -> Column:
        return let(
            first_group(sql, pattern),
            lambda n: F.coalesce((F.char_length(n) > 18) | (n.try_cast("bigint") >= row_threshold), F.lit(False)),
        )

    def test(low: Column) -> Column:
        flag = low.contains("select") & matches(sql, C.BULK_STAR_PATTERN)
        for need, pattern in zip(_BULK_NEEDS, C.BULK_PATTERNS):
            flag = flag | (low.contains(need) & large(pattern))
        return flag

    return let(folded(sql), test)


def query_fingerprint(sql: Column) -> Column:
    """Hash of the statement without its literals."""
    shape = F.regexp_replace(sql, r"'[^']*'", "?")
    shape = F.regexp_replace(shape, r"(?U)\b\d+\b", "?")
    shape = F.trim(F.regexp_replace(shape, r"(?U)\s+", " "))
    return F.substring(F.md5(F.upper(shape).cast("binary")), 1, 12)


def short_hash(*parts: Column) -> Column:
    """First 12 hex digits of SHA-256 over the joined parts."""
    return F.substring(F.sha2(F.concat(*[p.cast("string") for p in parts]), 256), 1, 12)
