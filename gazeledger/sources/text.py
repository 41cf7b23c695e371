"""Log files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeledger.functions.regex import once
from gazeledger.session import materialise

# Small per-split and per-file tables are broadcast up to this many rows (a row is some 200 bytes).
BROADCAST_ROWS = 100_000

# The charsets after UTF-8.
KOREAN_CHARSET, LAST_CHARSET = "MS949", "ISO-8859-1"


def resolve_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Expand globs on any Hadoop file system; sorted, without duplicates, missing ones left out."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found: set[str] = set()
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            found.add(status.getPath().toString())
    return sorted(found)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table that is known to have at most ``rows`` rows, if that is few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _file_name() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), r"^file:(?://)?", "")


def _scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        _file_name().alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )


def split_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per split of a file, from the one pass over the text that needs no line numbers: its lines, and the charsets
    that all of them fit. Written, since numbers, charsets and totals all read it."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # the pass that reads the lines must see the same splits, also when executors came or went in between
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    value = F.col("value")
    return materialise(_scan(spark, paths).groupBy("source_file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), *_fits(value)), "splits")


def read_lines(spark: SparkSession, paths: list[str], splits: DataFrame | None = None) -> DataFrame:
    """``source_file, line_no, value`` of text or gzip files; ``value`` holds the undecoded line.

    Each split numbers its own lines; the counts of the splits before it in the file are added. No file is
    sorted and none has to fit one task.
    """
    splits = split_counts(spark, paths) if splits is None else splits
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select(
        "source_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    # a split that the counts do not know would mean that the files changed in between
    missing = F.raise_error(F.concat(F.lit("no line count for a part of "), F.col("source_file"))).cast("bigint")
    return _scan(spark, paths).join(small(shifts, splits.count()), ["source_file", "_block"], "left").select(
        "source_file", F.coalesce(F.col("_id") + F.col("_shift"), missing).alias("line_no"), "value")


def _decoded(value: Column, charset: str) -> Column:
    return F.decode(value.cast("binary"), charset)


def _fits(value: Column) -> list[Column]:
    return [
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.bool_and(~_decoded(value, KOREAN_CHARSET).contains("\ufffd")).alias("korean"),
    ]


def _charset() -> Column:
    return F.when(F.col("utf8"), "UTF-8").when(F.col("korean"), KOREAN_CHARSET).otherwise(LAST_CHARSET).alias("charset")


def file_charsets(lines: DataFrame) -> DataFrame:
    """Charset per file from all of its lines: UTF-8, else Korean, else Latin-1. One aggregate, combined on the map side."""
    return lines.groupBy("source_file").agg(*_fits(F.col("value"))).select("source_file", _charset())


def file_totals(splits: DataFrame) -> DataFrame:
    """``source_file, lines, charset`` of every file that holds a line."""
    totals = splits.groupBy("source_file").agg(
        F.sum("_n").alias("lines"), F.bool_and("utf8").alias("utf8"), F.bool_and("korean").alias("korean"))
    return totals.select("source_file", "lines", _charset())


def decode_lines(lines: DataFrame, charsets: DataFrame) -> DataFrame:
    """``source_file, line_no, raw_line`` with undecodable bytes replaced by U+FFFD."""
    value = F.col("value")
    text = (
        F.when(F.col("charset") == "UTF-8", F.make_valid_utf8(value))
        .when(F.col("charset") == KOREAN_CHARSET, _decoded(value, KOREAN_CHARSET))
        .otherwise(_decoded(value, LAST_CHARSET))
    )
    return lines.join(charsets, "source_file").select(
        "source_file", "line_no", once(F.rtrim(text, F.lit("\r"))).alias("raw_line"))


def scan_logs(spark: SparkSession, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Numbered, decoded lines of all files that the patterns name, and ``source_file, lines, charset`` of the files.

    The text is read once for the counts and charsets of its splits, and once whenever the lines are used.
    """
    paths = resolve_paths(spark, patterns)
    if not paths:
        return (spark.createDataFrame([], "source_file string, line_no bigint, raw_line string"),
                spark.createDataFrame([], "source_file string, lines bigint, charset string"))
    splits = split_counts(spark, paths)
    files = file_totals(splits)
    charsets = small(files.select("source_file", "charset"), len(paths))
    return decode_lines(read_lines(spark, paths, splits), charsets), files


def read_log_lines(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Numbered, decoded lines of all files that the patterns name."""
    return scan_logs(spark, patterns)[0]
