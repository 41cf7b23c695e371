"""Timestamps found anywhere in a log line, as TIMESTAMP_NTZ wall-clock time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeledger.functions.regex import let

# Month names and the accepted timestamp layouts.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

_YEAR = r"(?!0000)\d{4}"
_LEAP = r"(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d"
_TZ = r"[+\-](?:[01]\d|2[0-3])[0-5]\d"
_NAMES = "|".join(MONTHS)


def _date(sep: str) -> str:
    """Calendar dates that exist; leap days only in leap years."""
    return (
        rf"(?:{_YEAR}{sep}(?:(?:0[1-9]|1[0-2]){sep}(?:0[1-9]|1\d|2[0-8])"
        rf"|(?:0[13-9]|1[0-2]){sep}(?:29|30)|(?:0[13578]|1[02]){sep}31)"
        rf"|(?!0000){_LEAP}{sep}02{sep}29)"
    )


# A fraction or 'Z' decides whether a layout accepts the stamp: 1-6 digits without 'Z', or 'T…Z' alone.
_ISO = (
    rf"(?<d>{_date('-')})(?:"
    rf"[T ](?<a>{_TIME}(?:\.\d{{1,6}}(?!\d)|(?![.,]\d)))(?!Z)"
    rf"|T(?<b>{_TIME})Z)"
)
_ISO_LENIENT = rf"(?<d>{_date('-')})[T ](?<a>{_TIME})(?:[.,](?<b>\d{{1,6}}))?"
_APACHE = rf"((?:0[1-9]|[12]\d|3[01])|(?<!\d)[1-9])/({_NAMES})/({_YEAR}):({_TIME})\s{_TZ}"
_SYSLOG = rf"({_NAMES})\s+(3[01]|[12]\d|0[1-9]|[1-9](?!\d))\s+({_TIME})"
_SLASH = rf"({_date('/')})\s+({_TIME})"


def _iso_text(text: Column, lenient: bool) -> Column:
    if lenient:
        stamp = F.regexp_extract(text, _ISO_LENIENT, 0)
        return F.replace(stamp, F.lit(","), F.lit("."))
    return F.rtrim(F.regexp_extract(text, _ISO, 0), F.lit("Z"))


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(name)).cast("int")


def _named_month(text: Column, pattern: str, day: int, month: int, clock: int, year: Column) -> Column:
    """Build the stamp of a layout with month names; impossible days give NULL."""

    def build(parts: Column) -> Column:
        time = F.split(F.get(parts, clock - 1), ":")
        return F.try_make_timestamp_ntz(
            year if year is not None else F.get(parts, 2).cast("int"),
            _month_number(F.get(parts, month - 1)),
            F.get(parts, day - 1).cast("int"),
            F.get(time, 0).cast("int"),
            F.get(time, 1).cast("int"),
            F.get(time, 2).cast("decimal(8,6)"),
        )

    return F.when(
        text.rlike(pattern),
        let(
            F.array(*[F.regexp_extract(text, pattern, g) for g in range(1, 5 if year is None else 4)]),
            build,
        ),
    )


def parse_timestamp(text: Column, year_hint: int, mode: str = "strict") -> Column:
    """First stamp that some layout accepts, tried as ISO, Apache, syslog, slash date.

    Offsets are dropped, not applied. ``strict`` leaves comma milliseconds and fraction + ``Z`` as NULL;
    ``lenient`` accepts both. A stamp without a year, or with year 1900, gets ``year_hint``.
    """
    iso = let(
        _iso_text(text, mode == "lenient"),
        lambda s: F.when(s != "", s.try_cast("timestamp_ntz")),
    )
    apache = _named_month(text, "(?i)" + _APACHE, 1, 2, 4, None)
    # A layout without a year is read as a non-leap year first, so 29 February never parses.
    syslog = F.when(
        ~text.rlike(r"(?i)\bFeb\s+29\s"),
        _named_month(text, "(?i)" + _SYSLOG, 2, 1, 3, F.lit(year_hint)),
    )
    slash = let(
        F.regexp_replace(F.regexp_extract(text, _SLASH, 0), r"\s+", " "),
        lambda s: F.when(s != "", F.replace(s, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")),
    )
    return let(
        F.coalesce(iso, apache, syslog, slash),
        lambda ts: F.when(
            F.year(ts) == 1900,
            F.try_make_timestamp_ntz(
                F.lit(year_hint), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                F.second(ts).cast("decimal(8,6)") + (F.date_format(ts, "SSSSSS").cast("int") / F.lit(1000000)).cast("decimal(8,6)"),
            ),
        ).otherwise(ts),
    )
