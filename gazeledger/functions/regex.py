"""Column helpers around Spark's regex functions.

Flags: ``i`` case-insensitive, ``u``/``U`` Unicode case folding and classes, ``d`` only ``\\n`` ends a
line (so ``.`` and ``$`` treat ``\\r`` as an ordinary character), ``s`` dot matches everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_CASE = "(?iuUd)"
CASE_SENSITIVE = "(?Ud)"
DOTALL = "(?iuUds)"
# The same meaning for text without characters beyond ASCII, where the costly Unicode classes are not needed.
ASCII_IGNORE_CASE = "(?id)"
_ASCII = {IGNORE_CASE: ASCII_IGNORE_CASE, CASE_SENSITIVE: "(?d)", DOTALL: "(?ids)", "(?iuU)": "(?i)", "(?U)": ""}

# Control characters used as marks inside rewritten text.
OPEN, SHUT, SEP = "\u0001", "\u0002", "\u0003"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value`` itself, kept where it is computed.

    Catalyst pushes filters below a projection by copying the expressions they refer to, which would run
    costly text work again in every filter. It does not do so across a non-deterministic column, so the
    value is tied to a condition on the partition number that always holds.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def by_flags(text: Column, flags: str, build: Callable[[str], Column]) -> Column:
    """``build(flags)``, for ASCII text with the cheaper flags of the same meaning."""
    return F.when(is_ascii(text), build(_ASCII[flags])).otherwise(build(flags)) if flags in _ASCII else build(flags)


def folded(text: Column) -> Column:
    """Lower case for substring gates in front of a case-blind pattern: the letters that such a pattern
    also takes for i and s count as these."""
    for odd, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def unmark(text: Column) -> Column:
    """Replace the mark characters one for one, so offsets stay valid."""
    return F.when(
        text.rlike(f"[{OPEN}{SHUT}{SEP}]"), F.translate(text, OPEN + SHUT + SEP, "\ufffd" * 3)
    ).otherwise(text)


def matches(text: Column, pattern: str, flags: str = IGNORE_CASE) -> Column:
    return by_flags(text, flags, lambda f: text.rlike(f + pattern))


def extracted(text: Column, pattern: str, group: int = 1, flags: str = IGNORE_CASE) -> Column:
    """Group of the first match; empty without a match."""
    return by_flags(text, flags, lambda f: F.regexp_extract(text, f + pattern, group))


def filled(text: Column) -> Column:
    """NULL instead of empty text; the text is worked out once."""
    return let(text, lambda t: F.when(t != "", t))


def first_group(text: Column, pattern: str, group: int = 1, flags: str = IGNORE_CASE) -> Column:
    """Group of the first match; NULL without a match or with an empty group."""
    return filled(extracted(text, pattern, group, flags))


def line_groups(text: Column, pattern: str, groups: int, flags: str = IGNORE_CASE) -> Column:
    """All groups of a match at the line start as ARRAY<STRING>, else NULL; one regex run per line.

    Groups that took no part in the match are empty strings.
    """
    rewritten = by_flags(text, flags, lambda f: F.regexp_replace(
        unmark(text),
        F.lit(f + r"\A" + pattern + r"(?s:.*)\z"),
        F.lit(OPEN + OPEN.join(f"${g}" for g in range(1, groups + 1))),
    ))
    return let(
        rewritten,
        lambda r: F.when(r.startswith(OPEN), F.split(F.substring(r, 2, 2_000_000_000), OPEN, -1)),
    )


def group(parts: Column, index: int) -> Column:
    """1-based group of a ``line_groups`` array; NULL when absent or empty."""
    return F.nullif(F.get(parts, index - 1), F.lit(""))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Plain substring test; words that contain another word of the list are redundant."""
    words = list(words)
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    test = F.lit(False)
    for word in needed:
        test = test | text.contains(word)
    return test


def strip(text: Column) -> Column:
    """Remove whitespace at both ends."""
    return let(text, lambda t: F.when(is_ascii(t), F.btrim(t, F.lit(" \t\n\x0b\f\r"))).otherwise(
        F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")))


def all_spans(text: Column, pattern: str, value_group: int = 0, flags: str = IGNORE_CASE) -> Column:
    """Every match as ARRAY<STRUCT<start INT, end INT, value STRING>> with 0-based code-point offsets.

    The text is rewritten once with marks around each match, split at the marks, and the piece lengths
    are summed up.
    """
    head = OPEN + "$0" + SHUT
    marked = F.regexp_replace(
        unmark(text), F.lit(flags + pattern), F.lit(head + (f"${value_group}" + SHUT if value_group else SHUT))
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, piece: Column) -> Column:
        def place(parts: Column) -> Column:
            match, value, rest = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
            end = acc["pos"] + F.char_length(match)
            return F.struct(
                (end + F.char_length(rest)).alias("pos"),
                F.concat(
                    acc["spans"],
                    F.array(F.struct(
                        acc["pos"].alias("start"),
                        end.alias("end"),
                        (F.when(value != "", value).otherwise(match) if value_group else match).alias("value"),
                    )),
                ).alias("spans"),
            )

        return let(F.split(piece, SHUT, 3), place)

    def collect(pieces: Column) -> Column:
        start = F.struct(F.char_length(F.get(pieces, 0)).alias("pos"), none.alias("spans"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces) - 1), start, step, lambda acc: acc["spans"])

    return let(
        F.split(marked, OPEN, -1),
        lambda pieces: F.when(F.size(pieces) > 1, collect(pieces)).otherwise(none),
    )
