"""Secret scan (operator 4), in Spark's own expressions only.

Four kinds of spans, in code points with exclusive ends:

* ``assign``, ``access``, ``hex``: fixed patterns, leftmost and not overlapping within a kind; matches that are too
  short are dropped.
* ``entropy``: candidate strings (runs of key characters) in which a window that slides over the characters reaches the
  Shannon entropy asked for its character class. The window keeps a count per character; a step changes two counts and
  the sum of n * log2(n), so each window costs the same. Windows that reach the bound and overlap form one span. A
  candidate shorter than its class's window is one window, with the bound in proportion to the greatest entropy it can have.
  Candidates that the allow-list names (plain words, digits only, paths, placeholders) are left out, and so are spans
  that a fixed pattern already covers.

Texts and candidates of any length are read whole, in time that grows with their length. NULL texts count as empty; empty texts have no spans and the digest of the empty string. Every input row gives one
output row, also repeated rows and rows with a NULL id; empty tables give empty results. ``find`` returns its own columns
only; ``redact`` keeps all columns of its input and changes the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.functions.regex import all_spans, let

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same matches as AKIA[A-Z0-9]+ of 18 or more characters
HEX = r"[0-9a-f]{16,}"  # the same matches as [0-9a-f]+ of 16 or more characters
_ZERO = 48  # the code of a count of 0
KINDS = ["assign", "access", "hex", "entropy"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# class: (pattern of the whole candidate, window, least bits per character); the first that fits counts
CLASSES = {
    "hex": (r"\A(?:[0-9a-f]+|[0-9A-F]+)\z", 20, 3.0),
    "alphanumeric": (r"\A[A-Za-z0-9]+\z", 20, 3.7),
    "base64": (r"\A[A-Za-z0-9+/_=-]+\z", 24, 3.9),
}
# No pattern repeats a group: Java's matcher would recurse once per repetition, and a long text would end the JVM.
ALLOWED = [
    r"\A(?!.*[0-9])(?!.*[A-Za-z][A-Z])",  # words and compounds, paths: no digit, capitals only at the start of a word
    r"\A[A-Z][A-Z+/_=-]*\z",  # the same in capitals
    r"\A[0-9+/_=-]+\z",  # numbers, dates, rules
    r"(?i)example|placeholder|changeme|xxxx|\A(.)\1*\z",
]
PIECE = 256  # characters of a candidate that one fold goes over
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(SPANS)


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def fixed_spans(text: Column) -> list[Column]:
    """The spans of the three fixed kinds. A cheap test of the whole text goes before each pattern."""
    lower = F.lower(text)
    named = F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | lower.contains(word)
    assign = F.filter(all_spans(text, ASSIGN, 2, "(?i)"), lambda s: F.char_length(s["value"]) >= ASSIGN_VALUE)
    return [
        F.when(named, _of_kind(assign, 0)).otherwise(_none()),
        F.when(text.contains("AKIA"), _of_kind(all_spans(text, ACCESS, 0, ""), 1)).otherwise(_none()),
        F.when(text.rlike(HEX), _of_kind(all_spans(text, HEX, 0, ""), 2)).otherwise(_none()),
    ]


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def _piece_windows(value: Column, window: int, least: float) -> Column:
    """Merged windows of a short ``value``. The counts are kept in a string with one digit per character of the alphabet."""

    def place(at: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(value, at, 1))

    def step(state: Column, at: Column) -> Column:
        def moved(io: Column) -> Column:
            came, left = io["came"], io["left"]

            def count(of: Column) -> Column:
                return F.ascii(F.substring(state["counts"], of, 1)) - _ZERO

            def put(counts: Column, of: Column, n: Column) -> Column:
                return F.overlay(counts, F.char(n + _ZERO), of, 1)

            before_in, before_out = count(came), count(left)
            same = came == left
            total = state["total"] + F.when(same, 0.0).otherwise(
                _weight(before_in + 1) - _weight(before_in)
                + F.when(left > 0, _weight(before_out - 1) - _weight(before_out)).otherwise(0.0))
            added = put(state["counts"], came, before_in + 1)
            counts = F.when(same, state["counts"]).when(left > 0, put(added, left, before_out - 1)).otherwise(added)
            high = (at >= window) & (F.lit(math.log2(window)) - total / window >= least)
            start, last = at - window, F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), state["spans"]), -1)
            joins = last["end"] >= start
            grown = F.concat(
                F.when(joins, F.slice(state["spans"], 1, F.size(state["spans"]) - 1)).otherwise(state["spans"]),
                F.array(F.struct(F.when(joins, last["start"]).otherwise(start).alias("start"), at.alias("end"))))
            return F.struct(counts.alias("counts"), total.alias("total"), F.when(high, grown).otherwise(state["spans"]).alias("spans"))

        inner = F.when(at > window, place(at - window)).otherwise(F.lit(0))
        return let(F.struct(place(at).alias("came"), inner.alias("left")), moved)

    zero = F.struct(
        F.lit(chr(_ZERO) * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), zero, step, lambda s: s["spans"])


def high_windows(value: Column, window: int, least: float) -> Column:
    """Merged windows of ``value`` whose entropy is at least ``least`` bits: ARRAY<STRUCT<start, end>>, offsets in it.

    The value is cut into pieces that reach ``window - 1`` characters back, so every window lies in exactly one piece and
    the work grows with the length.
    """

    def of_pieces(pieces: Column) -> Column:
        def own(piece: Column, i: Column) -> Column:
            back = F.when(i > 0, F.lit(window - 1)).otherwise(F.lit(0))
            whole = F.when(i > 0, F.concat(F.right(F.get(pieces, i - 1), F.lit(window - 1)), piece)).otherwise(piece)
            return let(whole, lambda text: F.transform(_piece_windows(text, window, least), lambda w: F.struct(
                (w["start"] + i * PIECE - back).alias("start"), (w["end"] + i * PIECE - back).alias("end"))))

        return F.flatten(F.transform(pieces, own))

    def merged(spans: Column) -> Column:
        """Spans stand in order, so each joins its neighbour or none."""
        first = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["end"] < s["start"]))
        last = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > s["end"]))
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    pieces = F.regexp_extract_all(value, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    return let(let(pieces, of_pieces), merged)


def high_whole(value: Column, window: int, least: float) -> Column:
    """The same for a value shorter than ``window``: all of it, or nothing."""
    n = F.char_length(value)
    letters = F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(value, i, 1)))
    total = F.aggregate(letters, F.lit(0.0), lambda t, c: t + _weight(n - F.char_length(F.replace(value, c, F.lit("")))))
    high = F.log2(n) - total / n >= least / math.log2(window) * F.log2(n)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(high, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(none)


def entropy_spans(text: Column, classes: dict[str, tuple[str, int, float]] | None = None, allowed: list[str] | None = None) -> Column:
    allowed = ALLOWED if allowed is None else allowed

    def suspicious(value: Column) -> Column:
        test = F.lit(True)
        for pattern in allowed:
            test = test & ~value.rlike(pattern)
        return test

    def windows(value: Column) -> Column:
        found = F.array().cast("array<struct<start:int,end:int>>")
        for pattern, window, least in reversed(list((classes or CLASSES).values())):
            own = F.when(F.char_length(value) < window, high_whole(value, window, least)).otherwise(high_windows(value, window, least))
            found = F.when(value.rlike(pattern), own).otherwise(found)
        return found

    candidates = F.filter(all_spans(text, CANDIDATE, 0, ""), lambda s: suspicious(s["value"]))
    found = F.flatten(F.transform(candidates, lambda c: F.transform(windows(c["value"]), lambda w: F.struct(
        (c["start"] + w["start"]).alias("start"), F.lit(3).alias("kind"), (c["start"] + w["end"]).alias("end")))))
    return F.when(text.rlike(CANDIDATE), found).otherwise(_none())


def with_spans(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_assign``, ``_access``, ``_hex`` and ``_entropy``, arrays of spans."""
    df = df.withColumn("_text", F.coalesce(text, F.lit("")))
    df = df.withColumns(dict(zip(["_assign", "_access", "_hex", "_rise"], [*fixed_spans(F.col("_text")), entropy_spans(F.col("_text"))], strict=True)))
    base = F.concat("_assign", "_access", "_hex")
    uncovered = F.filter("_rise", lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    return df.withColumn("_entropy", uncovered).drop("_rise")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every document: counts per kind, the digest of the fixed ones and all of them as text."""
    spans = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"))
    spans = spans.select("doc_id", "_assign", "_access", "_hex", "_entropy")
    return spans.select(
        "doc_id",
        *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.concat("_assign", "_access", "_hex")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(*[f"_{k}" for k in KINDS])).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one. NULL texts stay NULL."""
    own = docs.withColumn("_row", F.struct(*docs.columns)).select("_row")
    spans = with_spans(own, F.col("_row")[text_col]).select("_row", F.array_sort(F.concat(*[f"_{k}" for k in KINDS])).alias("_all"))

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), done), -1)
        joins = last["end"] > s["start"]
        return F.concat(
            F.when(joins, F.slice(done, 1, F.size(done) - 1)).otherwise(done),
            F.array(F.struct(F.when(joins, last["start"]).otherwise(s["start"]).alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))

    merged = F.aggregate("_all", F.array().cast("array<struct<start:int,end:int>>"), merge)
    clean = F.aggregate(
        F.reverse(merged), F.col("_row")[text_col],
        lambda t, s: F.overlay(t, F.lit(mark), s["start"] + 1, s["end"] - s["start"]))
    changed = F.when(F.size("_all") > 0, clean).otherwise(F.col("_row")[text_col])
    return spans.select(*[changed.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
