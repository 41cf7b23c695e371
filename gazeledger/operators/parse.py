"""Raw lines to events, one function per log family.

Every parser maps ``(source_file, line_no, raw_line)`` to the columns of ``schemas.EVENT_COLUMNS``. Web,
application, free-form and PostgreSQL lines are plain projections; MySQL session users and Oracle blocks
need the order of lines and use sliced running values.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions import extract
from gazeledger.functions.regex import (
    CASE_SENSITIVE, DOTALL, IGNORE_CASE, extracted, filled, first_group, group, line_groups, matches, once, strip,
)
from gazeledger.functions.timestamps import parse_timestamp
from gazeledger.operators.ordered import running, tasks_for
from gazeledger.params import AuditParams
from gazeledger.schemas import EVENT_COLUMNS
from gazeledger.session import checked_broadcast, materialise
from gazeledger.sources.records import joined_lines, placed_lines

_KEEP = ["source_file", "line_no", "raw_line"]
_NO_EXTRA = "map<string,string>"


def _extra(**values: Column) -> Column:
    """Map of the non-NULL values."""
    entries = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def _events(rows: DataFrame, log_type: str, **fields: Column) -> DataFrame:
    """Select the event columns; fields that a family does not know stay NULL."""
    text = {"raw_line": F.col("raw_line")} | fields
    types = {"ts": "timestamp_ntz", "is_bulk": "boolean", "extra": _NO_EXTRA, "line_no": "bigint"}
    out = []
    for name in EVENT_COLUMNS:
        if name == "log_type":
            col = F.lit(log_type)
        elif name == "query_text":
            col = F.coalesce(F.nullif(text[name], F.lit("")), text["raw_line"])
        elif name == "is_bulk":
            col = F.coalesce(text.get(name, F.lit(False)), F.lit(False))
        elif name == "extra":
            col = F.coalesce(text.get(name, F.lit(None).cast(_NO_EXTRA)), F.create_map().cast(_NO_EXTRA))
        elif name in text:
            col = text[name]
        elif name in ("source_file", "line_no"):
            col = F.col(name)
        else:
            col = F.lit(None)
        col = col.cast(types.get(name, "string"))
        costly = name in ("ts", "user_id", "ip_address", "action", "target", "query_text", "is_bulk", "extra")
        out.append((once(col) if costly and name in text else col).alias(name))
    return rows.select(*out)


def skip_blank(lines: DataFrame, comments: bool = False) -> DataFrame:
    """Drop blank lines, and comment lines where a family has them. A line is worked out before, not within, the filter."""
    kept = lines.withColumn("raw_line", once(F.col("raw_line"))).where(matches(F.col("raw_line"), r"\S", "(?U)"))
    return kept.where(~F.col("raw_line").startswith("#")) if comments else kept


def _stamp(text: Column, params: AuditParams) -> Column:
    return parse_timestamp(text, params.year_hint or date.today().year, params.ts_mode)


# --- web ----------------------------------------------------------------------


def parse_web(lines: DataFrame, params: AuditParams) -> DataFrame:
    """Apache/Nginx combined lines; other lines become events that carry only their text."""
    line = F.col("raw_line")
    rows = skip_blank(lines).withColumn("_m", once(line_groups(line, C.WEB_LINE, 7, CASE_SENSITIVE)))
    m = lambda i: group(F.col("_m"), i)
    hit = F.col("_m").isNotNull()
    path = m(5)
    params_text = F.coalesce(F.nullif(F.regexp_extract(path, r"\?(.+)\z", 1), F.lit("")), F.lit(""))
    return _events(
        rows, "web",
        ts=F.when(hit, _stamp(m(3), params)),
        user_id=F.when(hit, F.coalesce(F.nullif(m(2), F.lit("-")), extract.user_id(line))),
        ip_address=m(1),
        action=m(4),
        target=F.split_part(path, F.lit("?"), F.lit(1)),
        query_text=F.when(hit, F.concat_ws(" ", m(4), path, params_text)).otherwise(line),
        extra=F.when(hit, _extra(status_code=m(6), url_path=path)),
    )


# --- application ----------------------------------------------------------------


def parse_app(lines: DataFrame, params: AuditParams) -> DataFrame:
    """Log4j, then Python logging, then syslog, then a leading timestamp, else the whole line."""
    line = F.col("raw_line")
    rows = skip_blank(lines, comments=True).withColumn("_log4j", once(line_groups(line, C.LOG4J_LINE, 5)))
    rows = rows.withColumn(
        "_py", F.when(F.col("_log4j").isNull(), line_groups(line, C.PYLOG_LINE, 4)))
    rows = rows.withColumn(
        "_sys",
        F.when(F.col("_log4j").isNull() & F.col("_py").isNull(), line_groups(line, C.SYSLOG_LINE, 5, CASE_SENSITIVE)),
    )
    log4j, py, sys_ = F.col("_log4j"), F.col("_py"), F.col("_sys")
    structured = log4j.isNotNull() | py.isNotNull() | sys_.isNotNull()
    stamped = F.when(~structured, line_groups(line, C.STAMPED_LINE, 2, CASE_SENSITIVE))
    rows = rows.withColumn("_stamped", stamped)
    rows = rows.withColumns({
        # NULL message = none of the structured layouts
        "_message": F.coalesce(F.get(log4j, 4), F.get(py, 3), F.get(sys_, 4)),
        "_when": F.coalesce(F.get(log4j, 0), F.get(py, 0), F.get(sys_, 0), F.get(F.col("_stamped"), 0)),
    })
    message = F.col("_message")
    text = F.coalesce(message, line)
    known = structured | F.col("_stamped").isNotNull()
    return _events(
        rows, "app",
        ts=F.when(known, _stamp(F.col("_when"), params)),
        user_id=F.when(log4j.isNotNull(), F.coalesce(extract.user_id(message), extract.user_id(line)))
        .otherwise(extract.user_id(text)),
        ip_address=F.when(known, extract.ip_address(text)),
        action=F.when(known, extract.action(text)),
        target=group(sys_, 2),
        query_text=text,
        extra=F.when(log4j.isNotNull(), _extra(level=group(log4j, 2), logger=group(log4j, 4)))
        .when(py.isNotNull(), _extra(level=group(py, 3), module=group(py, 2)))
        .when(sys_.isNotNull(), _extra(process=group(sys_, 3), pid=group(sys_, 4))),
    )


# --- free form ------------------------------------------------------------------


def parse_generic(lines: DataFrame, params: AuditParams) -> DataFrame:
    """Free-form lines; blank lines and comments are skipped."""
    rows = lines.withColumn("raw_line", once(F.col("raw_line"))).withColumn("_text", once(strip(F.col("raw_line")))).where(
        (F.col("_text") != "") & ~F.col("_text").startswith("#"))
    text = F.col("_text")
    return _events(
        rows, "unknown",
        ts=_stamp(text, params),
        user_id=extract.user_id(text),
        ip_address=extract.ip_address(text),
        action=extract.action(text),
        query_text=text,
    )


# --- database -------------------------------------------------------------------


def _pg_or_plain(rows: DataFrame, params: AuditParams) -> DataFrame:
    """PostgreSQL server lines, and any other database line by its general fields."""
    line = F.col("raw_line")
    rows = rows.withColumn("_m", once(line_groups(line, C.PG_LINE, 5, DOTALL)))
    hit = F.col("_m").isNotNull()
    rows = rows.withColumn("_msg", F.when(hit, strip(F.get(F.col("_m"), 4))))
    msg = F.col("_msg")
    statement = F.coalesce(
        filled(strip(extracted(msg, r"\A" + C.PG_DURATION, flags=DOTALL))),
        filled(strip(extracted(msg, r"\A" + C.PG_STATEMENT, flags=DOTALL))),
        filled(strip(extracted(msg, C.PG_AUDIT, 3))),
        msg,
    )
    rows = rows.withColumn("_sql", once(F.when(hit, statement).otherwise(line)))
    sql = F.col("_sql")
    db = group(F.col("_m"), 4)
    return _events(
        rows, "db",
        ts=_stamp(F.when(hit, F.get(F.col("_m"), 0)).otherwise(line), params),
        user_id=F.coalesce(group(F.col("_m"), 3), extract.user_id(line)),
        ip_address=extract.ip_address(line),
        action=extract.action(F.coalesce(F.nullif(sql, F.lit("")), line)),
        target=F.coalesce(db, extract.table_name(sql)),
        query_text=sql,
        is_bulk=extract.bulk_flag(sql, params.bulk_select_row_threshold),
        extra=F.when(hit, _extra(pid=group(F.col("_m"), 2), pg_db=db, db_type=F.lit("postgresql")))
        .otherwise(_extra(db_type=F.lit("generic"))),
    )


def _marked(lines: DataFrame, params: AuditParams, wanted: Column | None = None) -> DataFrame:
    """Non-blank lines with the MySQL groups (of ``wanted`` ones) and the slice of lines they belong to."""
    line = F.col("raw_line")
    hit = matches(line, r"\A" + C.MYSQL_LINE)
    return skip_blank(lines).withColumns({
        "_my": once(F.when(hit if wanted is None else wanted & hit, line_groups(line, C.MYSQL_LINE, 4))),
        "_slice": F.floor(F.col("line_no") / params.chunk_lines).cast("bigint"),
    })


def _mysql(marked: DataFrame, params: AuditParams) -> DataFrame:
    """MySQL general log; a Connect line names the user of its thread for the lines that follow."""
    line = F.col("raw_line")
    rows = marked.where(F.col("_my").isNotNull()).withColumns({
        "_thread": F.get("_my", 1),
        "_connect": F.when(
            F.lower(F.get("_my", 2)) == "connect", first_group(line, r"\A" + C.MYSQL_CONNECT, 3)),
    })
    # thread, slice and line number decide; _my stays an array and travels along
    rows = running(
        rows, ["source_file", "_thread"], "_slice", ["line_no"], lasts={"_session": F.col("_connect")}
    ).where(F.col("_connect").isNull())
    rows = rows.withColumn("_sql", strip(F.get("_my", 3)))
    sql = F.col("_sql")
    return _events(
        rows, "db",
        ts=_stamp(F.get("_my", 0), params),
        user_id=F.coalesce(F.col("_session"), extract.user_id(sql)),
        ip_address=extract.ip_address(line),
        action=F.upper(F.get("_my", 2)),
        target=extract.table_name(sql),
        query_text=sql,
        is_bulk=extract.bulk_flag(sql, params.bulk_select_row_threshold),
        extra=_extra(thread_id=F.col("_thread"), db_type=F.lit("mysql")),
    )


def _stored(lines: DataFrame, params: AuditParams, wanted: Column | None = None) -> DataFrame:
    """Non-blank lines with the marks of database lines, written: the ordered passes read them several times."""
    line = F.col("raw_line")
    free = F.col("_my").isNull() if wanted is None else wanted & F.col("_my").isNull()
    return materialise(_marked(lines, params, wanted).withColumns({
        "_start": once(free & matches(line, r"\A" + C.ORACLE_START)),
        "_end": once(free & matches(line, C.ORACLE_END)),
    }), "db-lines")


def oracle_edges(stored: DataFrame) -> DataFrame:
    """The lines that open (``_opens``) or close an audit block; a file's last block may never close.

    Works on marker lines only. A line may carry a start mark, an end mark or both: a start mark opens a
    block when none is open, an end mark closes an open one, and a line with both flips the state. Whether
    a block is open before a line is thus the last plain mark, flipped by the number of double marks since.
    """
    marks = stored.where("_start or _end").select("source_file", "line_no", "_slice", "_start", "_end")
    both = F.col("_start") & F.col("_end")
    # written after each step, since a running value reads its rows twice
    if marks.where(both).isEmpty():
        marks = marks.withColumn("_flips", F.lit(0).cast("bigint"))
    else:
        marks = materialise(running(
            marks, ["source_file"], "_slice", ["line_no"], sums={"_flips": both.cast("int")}, include_current=False), "marks")
    # one number: twice the flips before a plain mark, one more if it opens
    marks = running(
        marks, ["source_file"], "_slice", ["line_no"],
        lasts={"_plain": F.when(~both, F.col("_flips") * 2 + F.col("_start").cast("bigint"))}, include_current=False)
    plain = F.coalesce(F.col("_plain"), F.lit(0))
    is_open = (plain % 2 == 1) != ((F.col("_flips") - F.floor(plain / 2)) % 2 == 1)
    marks = marks.withColumn("_is_open", is_open).where("(_start and not _is_open) or (_end and _is_open)")
    return materialise(marks.select("source_file", "line_no", "_slice", (~F.col("_is_open")).alias("_opens")), "marks")


def _oracle_lines(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines with ``_first``, the line that opens their block, inside a block; ``_closing`` marks the line that closes it."""
    place = lambda role: (F.col("line_no") * 3 + role).alias("_place")
    # a block begins before its first line and ends behind its last one
    borders = edges.select(
        "source_file", "line_no", "_slice", F.lit(None).cast("string").alias("raw_line"), F.lit(False).alias("_end"),
        place(F.when(F.col("_opens"), 0).otherwise(2)),
        F.when(F.col("_opens"), F.col("line_no")).otherwise(F.lit(-1).cast("bigint")).alias("_edge"))
    nothing = F.lit(None).cast("bigint")
    body = stored.where(F.col("_my").isNull()).select(*_KEEP, "_slice", "_end", place(F.lit(1)), nothing.alias("_edge"))
    slices = stored.select("source_file", "_slice").distinct().select("*", nothing.alias("_place"), nothing.alias("_edge"))
    rows = running(
        body.unionByName(borders), ["source_file"], "_slice", ["_place"], lasts={"_last": F.col("_edge")},
        totals_of=slices.unionByName(borders.select(*slices.columns)), tasks=tasks_for(stored)).where("_place % 3 = 1")
    first = F.nullif("_last", F.lit(-1).cast("bigint"))
    return rows.select(*_KEEP, first.alias("_first"), (F.col("_end") & (F.col("line_no") > first)).alias("_closing"))


def _short_and_long(lines: DataFrame, edges: DataFrame, params: AuditParams) -> tuple[DataFrame, DataFrame | None]:
    """The lines of closed blocks that fit one part, and of longer ones if there are any.

    No block of a file is longer than its longest line times its longest block; only files where that is more than a part
    are summed up by block.
    """
    block = ["source_file", "_first"]
    last = lambda cond: F.max(F.when(cond, F.col("line_no")))
    unclosed = edges.groupBy("source_file").agg(last(F.col("_opens")).alias("_first"), last(~F.col("_opens")).alias("_until")).where(
        "_until is null or _first > _until").select(*block)
    unclosed = checked_broadcast(unclosed, "unclosed")  # at most one a file
    inside = lines.where(F.col("_first").isNotNull()).join(unclosed, block, "left_anti")
    size = F.octet_length("raw_line").cast("bigint") + 1
    bounds = inside.groupBy("source_file").agg(F.max(size).alias("_line"), F.max(F.when(
        F.col("_closing"), F.col("line_no") - F.col("_first") + 1)).alias("_lines"))
    files = checked_broadcast(bounds.where(F.col("_line") * F.col("_lines") > params.part_bytes).select("source_file"), "files")
    if files.isEmpty():
        return inside, None
    sizes = inside.join(files, "source_file", "left_semi").groupBy(*block).agg(F.sum(size).alias("_bytes"))
    longer = checked_broadcast(sizes.where(F.col("_bytes") > params.part_bytes).select(*block), "long-blocks")
    if longer.isEmpty():
        return inside, None
    return inside.join(longer, block, "left_anti"), inside.join(longer, block, "left_semi")


def _block_parts(inside: DataFrame, params: AuditParams) -> DataFrame:
    """The text of closed blocks as parts of bounded size: ``_text``, ``_closing`` (the block ends in this part) and
    what its neighbours need, ``_head`` (the first lines) and ``_next``."""
    sliced = inside.withColumn("_slice", F.floor(F.col("line_no") / params.chunk_lines).cast("bigint"))
    # every block's last line, the closing one, is on all of its parts
    ends = inside.where("_closing").select("source_file", "_first", F.col("line_no").alias("_until"))
    placed = placed_lines(sliced, ["source_file"], F.col("line_no") == F.col("_first"), params.part_bytes)
    return _joined_parts(placed.join(ends, ["source_file", "_first"]))


def _joined_parts(placed: DataFrame) -> DataFrame:
    """``_until`` is the closing line of a block; without it, the last line of a part is."""
    until = F.max("_until" if "_until" in placed.columns else "line_no")
    parts = placed.groupBy("source_file", "_first", F.col("part").alias("_part")).agg(
        F.collect_list(F.struct("line_no", "raw_line")).alias("_lines"),
        F.max("line_no").alias("_last"),
        until.alias("_until"),
        F.max("next_part").alias("_next")).withColumnRenamed("_until", "line_no")
    head = F.array_join(F.transform(F.slice(F.array_sort("_lines"), 1, C.ORACLE_FIELD_LINES), lambda s: s["raw_line"]), "\n")
    return parts.select(
        "source_file", "_first", "line_no", "_part", "_next", joined_lines(F.col("_lines")).alias("_text"), head.alias("_head"),
        (F.col("_last") == F.col("line_no")).alias("_closing"))


def _oracle_columns(rows: DataFrame, field: dict[str, Column], sql: Column, params: AuditParams, part: Column) -> DataFrame:
    rows = rows.withColumns({f"_{k}": filled(strip(v)) for k, v in field.items()} | {"_query": sql})
    return _events(
        rows, "db",
        raw_line=F.col("_text"),
        ts=_stamp(F.col("_stamp"), params),
        user_id=F.coalesce("_db_user", "_os_user"),
        action=F.col("_action"),
        target=F.col("_object"),
        query_text=F.col("_query"),
        is_bulk=extract.bulk_flag(F.coalesce("_query", "_text"), params.bulk_select_row_threshold),
        extra=_extra(os_user=F.col("_os_user"), db_type=F.lit("oracle"), part=part),
    )


def _oracle_events(lines: DataFrame, edges: DataFrame, params: AuditParams) -> DataFrame:
    """One event per closed block; its line number is that of the closing line.

    A block of more than ``params.part_bytes`` gives an event for every part of its text, all with the block's fields and
    line number. Those behind the first carry ``extra['part']``: they are scanned like any text, but are no further access.
    """
    short, longer = _short_and_long(lines, edges, params)
    first = F.lit(0).cast("bigint")
    parts = _joined_parts(short.withColumns({"part": first, "next_part": first}))
    text = F.col("_text")
    found = {name: extracted(text, pattern) for name, pattern in C.ORACLE_FIELDS.items()}
    single = _oracle_columns(
        parts, {k: v for k, v in found.items() if k != "sql"}, F.coalesce(filled(strip(found["sql"])), text),
        params, F.lit(None).cast("string"))
    if longer is None:
        return single
    return single.unionByName(_long_block_events(materialise(_block_parts(longer, params), "long-blocks"), params))


def _long_block_events(parts: DataFrame, params: AuditParams) -> DataFrame:
    """Events of blocks in several parts.

    A field's value may stand some lines below its mark, so a part is searched with the first lines of the next one, and a
    match counts where it begins. The SQL text runs on through the indented lines at the start of the following parts.
    """
    block = ["source_file", "_first"]
    behind = parts.select(*block, F.col("_part").alias("_next"), F.col("_head").alias("_ahead"))
    rows = parts.join(behind, [*block, "_next"], "left")
    text = F.col("_text")
    wide = F.concat_ws("\n", text, "_ahead")

    def begins_here(pattern: str, value: Column) -> Column:
        at = F.regexp_instr(wide, F.lit(IGNORE_CASE + pattern))
        return F.when((at > 0) & (at <= F.char_length(text)), value)

    patterns = {k: v for k, v in C.ORACLE_FIELDS.items() if k != "sql"}
    sql = IGNORE_CASE + C.ORACLE_FIELDS["sql"]
    own = F.regexp_extract(text, sql, 1)
    rows = rows.withColumns({
        **{f"_f_{k}": begins_here(p, F.regexp_extract(wide, IGNORE_CASE + p, 1)) for k, p in patterns.items()},
        "_own": F.when(begins_here(C.ORACLE_FIELDS["sql"], F.lit(True)), own),  # empty: the value starts in the next part
        "_sql_end": F.regexp_instr(text, F.lit(sql)) - 1 + F.char_length(F.regexp_extract(text, sql, 0)),
        "_run": F.regexp_extract(text, r"\A((?:\s[^\n]+(?:\n|\z))*+)", 1),
        "_run_on": F.regexp_extract(text, r"\A([^\n]+(?:\n\s+[^\n]+)*+)", 1),
    }).drop("_head", "_ahead")
    rows = materialise(rows, "long-blocks")
    ends = F.col("_own").isNotNull() & ((F.col("_own") == "") | (F.col("_sql_end") == F.char_length(text)))
    marks = rows.select(
        *block, "_part", "_next", *[f"_f_{k}" for k in patterns],
        F.col("_own").isNotNull().alias("_mark"), ends.alias("_ends"), (F.col("_own") == "").alias("_bare"),
        (F.char_length("_run") == F.char_length(text)).alias("_all_run"), (F.char_length("_run_on") == F.char_length(text)).alias("_all_on"))
    facts = marks.groupBy(*block).agg(
        *[F.min_by(f"_f_{k}", F.when(F.col(f"_f_{k}").isNotNull(), F.col("_part"))).alias(f"_v_{k}") for k in patterns],
        F.min_by(F.struct("_part", "_next", "_ends", "_bare"), F.when(F.col("_mark"), F.col("_part"))).alias("_sql"))
    facts = checked_broadcast(facts, "blocks")
    after_mark = F.col("_bare_next") & (F.col("_part") == F.col("_sql._next"))
    stop = marks.join(facts.select(*block, "_sql"), block).where("_sql._ends and _part > _sql._part").withColumn(
        "_bare_next", F.col("_sql._bare")).where(~F.when(after_mark, F.col("_all_on")).otherwise(F.col("_all_run")))
    stop = checked_broadcast(stop.groupBy(*block).agg(F.min("_part").alias("_stop")), "blocks")
    joined = rows.join(facts, block).join(stop, block, "left").withColumn("_bare_next", F.col("_sql._bare"))
    continues = F.col("_sql._ends") & (F.col("_part") > F.col("_sql._part")) & (F.coalesce(F.col("_part") <= F.col("_stop"), F.lit(True)))
    piece = F.when(F.col("_part") == F.col("_sql._part"), F.col("_own")).when(
        continues, F.when(after_mark, F.col("_run_on")).otherwise(F.col("_run")))
    number = F.when(F.col("_part") > 0, F.col("_part").cast("string"))
    return _oracle_columns(
        joined, {k: F.col(f"_v_{k}") for k in patterns}, F.coalesce(F.nullif(strip(piece), F.lit("")), text), params, number)


def parse_mysql(lines: DataFrame, params: AuditParams) -> DataFrame:
    """The MySQL lines among ``lines``."""
    return _mysql(_marked(lines, params), params)


def parse_oracle(lines: DataFrame, params: AuditParams) -> DataFrame:
    """The audit blocks among ``lines``."""
    return _oracle(_stored(lines, params), params)[1]


def _oracle(stored: DataFrame, params: AuditParams) -> tuple[DataFrame, DataFrame]:
    """Lines outside blocks, and the events of blocks."""
    edges = oracle_edges(stored)
    lines = materialise(_oracle_lines(stored, edges), "oracle")
    return lines.where(F.col("_first").isNull()).select(*_KEEP), _oracle_events(lines, edges, params)


def parse_postgres(lines: DataFrame, params: AuditParams) -> DataFrame:
    """PostgreSQL server log, with the general database fallback."""
    return _pg_or_plain(skip_blank(lines), params)


def _db_marks() -> list[Column]:
    """Aggregates of a file's lines: does it hold MySQL lines, Oracle marks?"""
    line = F.col("raw_line")
    return [
        F.bool_or(matches(line, r"\A" + C.MYSQL_LINE)).alias("_has_mysql"),
        F.bool_or(matches(line, r"\A" + C.ORACLE_START)).alias("_has_oracle"),
    ]


def parse_db(lines: DataFrame, params: AuditParams) -> DataFrame:
    """All database logs: MySQL lines, Oracle blocks, PostgreSQL lines, anything else.

    One pass marks the lines and writes them; the marks tell which files hold MySQL lines or Oracle blocks.
    """
    stored = _stored(lines, params)
    marks = [F.bool_or(F.col("_my").isNotNull()).alias("_has_mysql"), F.bool_or("_start").alias("_has_oracle")]
    return _db_events(stored, checked_broadcast(stored.groupBy("source_file").agg(*marks), "kinds"), params)


def _ordered(kinds: DataFrame) -> tuple[bool, bool]:
    """Are there files with MySQL lines, with Oracle marks?"""
    mysql, oracle = kinds.agg(F.bool_or("_has_mysql"), F.bool_or("_has_oracle")).first()
    return bool(mysql), bool(oracle)


def _db_events(stored: DataFrame, kinds: DataFrame, params: AuditParams) -> DataFrame:
    """Events of written, marked lines. Only files that ``kinds`` names so take the ordered passes; all other lines stay a
    plain projection."""
    mysql, oracle = _ordered(kinds)
    known, parts = stored.join(kinds, "source_file"), []
    plain = known.where(F.col("_my").isNull() & ~F.col("_has_oracle")).select(*_KEEP)
    if mysql:
        parts.append(_mysql(known.where("_has_mysql"), params))
    if oracle:
        outside, events = _oracle(known.where("_has_oracle"), params)
        plain = plain.unionByName(outside)
        parts.append(events)
    return reduce(DataFrame.unionByName, parts, _pg_or_plain(plain, params))


def parse_postgres_csv(lines: DataFrame, params: AuditParams) -> DataFrame:
    """PostgreSQL csvlog; lines of another shape are skipped."""
    line = F.col("raw_line")
    rows = skip_blank(lines).withColumn("_m", once(line_groups(line, C.PG_CSV, 4))).where(F.col("_m").isNotNull())
    rows = rows.withColumn("_msg", F.coalesce(first_group(line, C.PG_CSV_MESSAGE), line))
    statement = strip(F.regexp_extract(F.col("_msg"), DOTALL + r"\A" + C.PG_STATEMENT, 1))
    rows = rows.withColumn(
        "_sql",
        F.when(F.col("_msg").rlike(DOTALL + r"\A" + C.PG_STATEMENT), statement).otherwise(F.col("_msg")))
    sql = F.col("_sql")
    db = group(F.col("_m"), 3)
    return _events(
        rows, "db",
        raw_line=line,
        ts=_stamp(F.get("_m", 0), params),
        user_id=F.get("_m", 1),
        ip_address=F.get("_m", 3),
        action=extract.action(sql),
        target=F.coalesce(db, extract.table_name(sql)),
        query_text=sql,
        is_bulk=extract.bulk_flag(sql, params.bulk_select_row_threshold),
        extra=_extra(pg_db=db, db_type=F.lit("postgresql")),
    )


# --- choice of family -------------------------------------------------------------


PARSERS = {
    "db": parse_db,
    "postgresql": parse_db,
    "mysql": parse_mysql,
    "oracle": parse_oracle,
    "pg_csv": parse_postgres_csv,
    "web": parse_web,
    "app": parse_app,
    "generic": parse_generic,
}


def detect_format(lines: DataFrame, sample_size: int | None = None) -> DataFrame:
    """Best format per file from its non-blank lines: ``source_file, format, family, score``.

    Score = share of matching lines × weight; the first declared format wins ties. One aggregate over all lines; with
    ``sample_size`` only that many first lines of a file count, and the rank bound keeps no more of them from each task.
    """
    sample = skip_blank(lines)
    if sample_size is not None:
        first = F.row_number().over(Window.partitionBy("source_file").orderBy("line_no"))
        sample = sample.withColumn("_n", first).where(F.col("_n") <= sample_size)
    return _best_format(sample.groupBy("source_file").agg(*_votes()))


# What a line must hold for a signature to match at all, where that is a single character.
_SIGNATURE_NEEDS = {"oracle_audit": ":", "mssql_audit": ",", "postgresql_csv": ",", "csv_generic": ","}


def _votes() -> list[Column]:
    """Aggregates of a file's lines: the weighted share of lines that match each format."""
    line = F.col("raw_line")

    def vote(name: str, pattern: str) -> Column:
        # a signature starts at a line end only where the text holds one, else it need not be tried at every character
        found = F.when(line.contains("\n"), line.rlike("(?imuUd)" + pattern)).otherwise(matches(line, pattern))
        return F.when(line.contains(_SIGNATURE_NEEDS[name]), found).otherwise(False) if name in _SIGNATURE_NEEDS else found

    return [(F.avg(vote(name, pattern).cast("int")) * weight).alias(name) for name, pattern, weight, _ in C.FORMAT_SIGNATURES]


def _best_format(scores: DataFrame) -> DataFrame:
    """``source_file, format, family, score`` and the columns of ``scores`` that are no votes."""
    ranked = F.array(*[
        F.struct(F.col(name).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("format"),
                 F.lit(family).alias("family"))
        for i, (name, _, _, family) in enumerate(C.FORMAT_SIGNATURES)
    ])
    votes = [name for name, *_ in C.FORMAT_SIGNATURES]
    others = [c for c in scores.columns if c != "source_file" and c not in votes]
    best = scores.select("source_file", F.array_max(ranked).alias("b"), *others)
    found = F.col("b.score") > 0
    named = F.when(found & (F.col("b.family") != "generic"), F.col("b.format")).otherwise("generic")
    return best.select(
        "source_file", named.alias("format"),
        F.when(found, F.col("b.family")).otherwise("generic").alias("family"),
        F.col("b.score").alias("score"), *others,
    )


def parse(lines: DataFrame, params: AuditParams, log_format: str = "auto") -> DataFrame:
    """Events of all lines, with a forced family or the one detected per file.

    Detection and the marks of database files share one pass over the lines. If the files are of one family that takes
    lines one by one, parsing is a second pass; else that pass marks the lines and writes them, and every family reads its own.
    """
    if log_format != "auto":
        return PARSERS[log_format](lines, params)
    seen = _best_format(skip_blank(lines).groupBy("source_file").agg(*_votes(), *_db_marks()))
    family = checked_broadcast(seen.select("source_file", "family", "_has_mysql", "_has_oracle"), "families")
    kinds = family.where("family = 'db'").select("source_file", "_has_mysql", "_has_oracle")
    present = {row["family"] for row in family.select("family").distinct().collect()}  # at most four
    if not present:
        return parse_generic(lines, params)
    ordered = "db" in present and any(_ordered(kinds))
    if present == {"db"} and not ordered:
        return parse_postgres(lines, params)
    if len(present) == 1 and not ordered:
        return PARSERS[present.pop()](lines, params)
    own = F.col("family") == "db" if ordered else F.lit(False)
    stored = _stored(lines.join(family.select("source_file", "family"), "source_file"), params, own)
    parts = []
    for name in ("db", "web", "app", "generic"):
        if name in present:
            rows = stored.where(F.col("family") == name)
            parts.append(_db_events(rows, kinds, params) if name == "db" else PARSERS[name](rows.select(*_KEEP), params))
    return reduce(DataFrame.unionByName, parts)


def parse_counts(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines read, events made and lines skipped (blank, comment, consumed, part of a block)."""
    one, zero = F.lit(1).alias("l"), F.lit(0).alias("e")
    both = lines.select(one, zero).unionByName(events.select(F.lit(0).alias("l"), F.lit(1).alias("e")))
    totals = both.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("e"), F.lit(0)).alias("total_events"))
    return totals.withColumn("skipped_lines", F.col("total_lines") - F.col("total_events"))
