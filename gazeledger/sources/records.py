"""Records that span several lines, as numbered parts of bounded size.

A record may be a whole file, so it never stands in one group or one value: lines get the byte position of the record that
they belong to from sliced running sums, and a part takes the lines whose position falls into the same ``part_bytes``. A
group is thus one part, whatever the length of the record; a record that fits one part is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.operators.ordered import running, tasks_for
from gazeledger.params import AuditParams
from gazeledger.session import materialise


def placed_lines(lines: DataFrame, keys: list[str], starts: Column, part_bytes: int, tasks: int | None = None) -> DataFrame:
    """Adds ``start_line_no`` of the record that a line belongs to, its ``part`` (from 0, gaps possible) and ``next_part``,
    that of the line behind it if it is in the same record.

    ``keys`` and ``_slice`` group the lines, ``starts`` marks those that open a record. The first line of all opens one
    anyway.
    """
    size = F.octet_length("raw_line").cast("bigint") + 1
    summed = running(
        lines, keys, "_slice", ["line_no"], sums={"_bytes": F.octet_length("raw_line") + 1, "_n": F.lit(1)}, tasks=tasks)
    opened = F.struct(F.col("line_no").alias("line"), (F.col("_bytes") - size).alias("before"))
    carried = running(summed, keys, "_slice", ["line_no"], lasts={"_opened": F.when(starts | (F.col("_n") == 1), opened)}, tasks=tasks)
    behind = F.col("_bytes") - F.col("_opened.before")
    return carried.withColumns({
        "start_line_no": F.col("_opened.line"),
        "part": F.floor((behind - size) / part_bytes).cast("bigint"),
        "next_part": F.floor(behind / part_bytes).cast("bigint"),
    }).drop("_bytes", "_n", "_opened")


def joined_lines(numbered: Column) -> Column:
    """The text of a list of ``line_no, raw_line``."""
    return F.array_join(F.transform(F.array_sort(numbered), lambda s: s["raw_line"]), "\n")


def multiline_records(lines: DataFrame, start_pattern: str, params: AuditParams) -> DataFrame:
    """``source_file, start_line_no, part, record``: a line that matches the pattern opens a new record.

    A record longer than ``params.part_bytes`` comes out as several rows, whole lines each, ``part`` counting from 0; joined
    by a line end they are the record. The lines are written once, since every running value reads them twice; tasks are as many
    as bound the lines of each.
    """
    staged = materialise(lines.withColumns({
        "_start": F.col("raw_line").rlike(start_pattern),
        "_slice": F.floor(F.col("line_no") / params.chunk_lines).cast("bigint"),
    }), "record-lines")
    tasks, part = tasks_for(staged), ["source_file", "start_line_no", "part"]
    placed = placed_lines(staged, ["source_file"], F.col("_start"), params.part_bytes, tasks)
    parts = (placed.repartition(tasks, *part) if tasks else placed).groupBy(*part).agg(
        F.collect_list(F.struct("line_no", "raw_line")).alias("_lines"))
    return parts.select("source_file", "start_line_no", "part", joined_lines(F.col("_lines")).alias("record"))
