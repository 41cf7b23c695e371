"""XML audit files: one row per record element, and its content as log lines.

Files are split at the closing tags of records, so a file of any layout (indented, all in one line, nested elements) is
read in parallel. What lies outside the records and records that are not well-formed become plain lines: no text is lost.
``read_xml_logs`` finds out tag and schema by itself; text is read as UTF-8.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeledger.operators.ordered import running
from gazeledger.session import materialise

_VALUE = "_VALUE"


_BROKEN = "_broken_record"


def _split(spark: SparkSession, paths: list[str] | str, row_tag: str) -> DataFrame:
    """``source_file, piece, place, record, outside``: the text of a record and the text before it.

    Records without content (``<tag ... />``) stand in pieces of their own.
    """
    tag = re.escape(row_tag)
    parts = spark.read.option("lineSep", f"</{row_tag}>").text(paths).select(
        F.regexp_replace(F.col("_metadata.file_path"), r"^file:(?://)?", "").alias("source_file"),
        F.monotonically_increasing_id().alias("piece"), "value")
    whole = rf"(?s)\A(.*)(<{tag}(?:\s[^<>]*)?(?<!/)>.*)\z"
    empty = rf"<{tag}(?:\s[^<>]*)?/>"
    opened = F.regexp_extract("value", whole, 2)
    outside = F.when(opened != "", F.regexp_extract("value", whole, 1)).otherwise(F.col("value"))
    parts = parts.select(
        "source_file", "piece", F.nullif(opened, F.lit("")).alias("opened"), outside.alias("outside"))
    records = F.concat(
        F.regexp_extract_all("outside", F.lit(f"({empty})"), 1),
        F.when(F.col("opened").isNotNull(), F.array(F.concat("opened", F.lit(f"</{row_tag}>")))).otherwise(F.array().cast("array<string>")))
    return parts.select(
        "source_file", "piece", F.regexp_replace("outside", empty, " ").alias("outside"), F.posexplode_outer(records).alias("place", "record"))


def _pieces(spark: SparkSession, paths: list[str] | str, row_tag: str, schema: T.StructType) -> DataFrame:
    """The records with their parsed columns, ``row``."""
    full = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "ignoreNamespace": "true"}
    return _split(spark, paths, row_tag).select(
        "source_file", "piece", "place", "record", F.from_xml("record", full, options).alias("row"),
        F.when(F.coalesce("place", F.lit(0)) == 0, F.col("outside")).alias("outside"))


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _sound() -> Column:
    return F.col("record").isNotNull() & F.col("row").isNotNull() & F.col(f"row.{_BROKEN}").isNull()


def read_xml(spark: SparkSession, paths: list[str] | str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Well-formed record elements as rows. Attributes are columns with a leading underscore."""
    fields = _schema(schema)
    return _pieces(spark, paths, row_tag, fields).where(_sound()).select("row.*").drop(_BROKEN)


def _local(name: str) -> str:
    return name.lstrip("_").split(":")[-1]


def _pair(name: str, value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text != "", F.concat(F.lit(name + "="), text))


def _is_attribute(field: T.StructField) -> bool:
    return field.name.startswith("_") and field.name != _VALUE


def _own_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return value[_VALUE] if _VALUE in kind.names else F.lit(None).cast("string")
    return value.cast("string")


def _attributes(value: Column, kind: T.DataType) -> list[Column]:
    if not isinstance(kind, T.StructType):
        return []
    return [_pair(_local(f.name), value[f.name]) for f in kind.fields if _is_attribute(f)]


def _element_lines(tag: str, value: Column, kind: T.DataType) -> Column:
    """Lines of one element: its attributes, its children in one line, then every child by itself."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        return F.flatten(F.coalesce(
            F.transform(value, lambda v: _element_lines(tag, v, inner)), F.array().cast("array<array<string>>")))
    children = [f for f in kind.fields if not f.name.startswith("_")] if isinstance(kind, T.StructType) else []
    if not children:
        body = F.array_compact(F.array(*_attributes(value, kind), F.nullif(F.trim(_own_text(value, kind)), F.lit(""))))
        line = F.concat_ws("  ", F.lit(tag), body)
        return F.when(F.size(body) > 0, F.array(line)).otherwise(F.array().cast("array<string>"))

    def joined(parts: list[Column]) -> Column:
        found = F.array_compact(F.flatten(F.array(*parts)))
        return F.when(F.size(found) > 0, F.concat_ws("  ", F.lit(tag), found))

    def child_parts(f: T.StructField) -> Column:
        def one(v: Column, k: T.DataType) -> Column:
            return F.array(_pair(_local(f.name), _own_text(v, k)), *_attributes(v, k))

        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            return F.flatten(F.coalesce(
                F.transform(value[f.name], lambda v: one(v, inner)), F.array().cast("array<array<string>>")))
        return one(value[f.name], f.dataType)

    attributes = _attributes(value, kind)
    head = [joined([F.array(*attributes)])] if attributes else []
    return F.flatten(F.array(
        F.array_compact(F.array(*head, joined([child_parts(f) for f in children]))),
        *[_element_lines(_local(f.name), value[f.name], f.dataType) for f in children],
    ))


def xml_lines(rows: DataFrame, row_tag: str) -> DataFrame:
    """Adds ``lines``: the text lines of every record element, ready for the scan."""
    value = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.withColumn("lines", _element_lines(row_tag, value, rows.schema))


def xml_raw_lines(spark: SparkSession, paths: list[str] | str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """``source_file, line_no, raw_line`` of XML files: the lines of sound records, and as they stand the lines of broken
    ones and of all text outside records. Numbers rise along each split of a file."""
    fields = _schema(schema)
    plain = F.array().cast("array<string>")

    def lines_of(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(line)), lambda line: line != "")

    pieces = _pieces(spark, paths, row_tag, fields)
    own = F.when(_sound(), _element_lines(row_tag, F.col("row"), fields)).otherwise(F.coalesce(lines_of(F.col("record")), plain))
    lines = pieces.select("source_file", F.explode(F.concat(F.coalesce(lines_of(F.col("outside")), plain), own)).alias("raw_line"))
    return lines.select("source_file", (F.monotonically_increasing_id() + 1).alias("line_no"), "raw_line")


def _tags(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every opening tag of the files: ``source_file, place, name, names, depth``; ``names`` holds the tag's and its attributes'
    as schemas write them, ``depth`` the number of elements around it."""
    tag = r"<(/?)([^\s<>/!?=]+)([^<>]*)\z"
    pieces = spark.read.option("lineSep", ">").text(paths).select(
        F.regexp_replace(F.col("_metadata.file_path"), r"^file:(?://)?", "").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"),
        F.regexp_extract("value", tag, 2).alias("name"), F.regexp_extract("value", tag, 1).alias("closing"),
        F.regexp_extract("value", tag, 3).alias("rest")).where("name <> ''")
    step = F.when(F.col("closing") != "", -1).when(F.col("rest").endswith("/"), 0).otherwise(1)
    attributes = F.regexp_extract_all("rest", F.lit(r"([^\s=\"'/]+)\s*=\s*(?:\"[^\"]*+\"|'[^']*+')"), 1)
    staged = pieces.select("source_file", "_block", "_id", "name", "closing", step.alias("step"), F.concat(
        F.array("name"), F.transform(attributes, lambda a: F.concat(F.lit("_"), a))).alias("names"))
    summed = running(staged, ["source_file"], "_block", ["_block", "_id"], sums={"after": F.col("step")})
    return summed.where("closing = ''").select(
        "source_file", F.struct("source_file", "_block", "_id").alias("place"), "name", "names", (F.col("after") - F.col("step")).alias("depth"))


def _in_order(kind: T.DataType, places: dict[str, int]) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_in_order(kind.elementType, places), kind.containsNull)
    if not isinstance(kind, T.StructType):
        return kind
    fields = sorted(kind.fields, key=lambda f: (places.get(_local(f.name) if not f.name.startswith("_") else f.name, len(places)), f.name))
    return T.StructType([T.StructField(f.name, _in_order(f.dataType, places), f.nullable) for f in fields])


def _merged_schema(records: DataFrame, tag: str) -> T.StructType:
    """The schema of all well-formed records, merged in the tasks; the reader of a column of texts exists on the JVM side only."""
    spark = records.sparkSession
    reader = spark.read.options(rowTag=tag, inferSchema="false", ignoreNamespace="true", mode="PERMISSIVE")
    text = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.xml(text), spark).schema


def describe_xml(spark: SparkSession, paths: list[str]) -> list[tuple[str, T.StructType, list[str]]]:
    """Record tag, schema and files: what stands in the files tells how to read them.

    Records are the elements directly inside the root with the most frequent name (of equal ones the first by name). Their
    schema merges the element trees of all records; all values are text, and fields stand in the order in which the files
    first name them. Files without such elements are left out. Only names come to the driver.
    """
    tags = materialise(_tags(spark, paths), "tags")
    counts = tags.where("depth = 1").groupBy("source_file", "name").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.groupBy("source_file").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("tag")).collect()
    named = tags.select("place", F.posexplode("names").alias("n", "own")).groupBy("own").agg(F.min(F.struct("place", "n")).alias("at"))
    places = {}
    for row in named.orderBy("at").select("own").collect():
        local = row["own"].split(":")[-1]
        places.setdefault(local if not row["own"].startswith("_") else "_" + local.lstrip("_"), len(places))
    found = []
    for tag in sorted({r["tag"] for r in chosen}):
        files = sorted(r["source_file"] for r in chosen if r["tag"] == tag)
        own = [p for p in paths if re.sub(r"^file:(?://)?", "", p) in set(files)]
        schema = _merged_schema(_split(spark, own, tag).select("record").where("record is not null"), tag)
        kept = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
        if kept.fields:
            found.append((tag, _in_order(kept, places), own))
    return found


def read_xml_logs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """``source_file, line_no, raw_line`` of XML files of any kind, and the files that hold no records."""
    lines, left = spark.createDataFrame([], "source_file string, line_no bigint, raw_line string"), set(paths)
    for tag, schema, files in describe_xml(spark, paths) if paths else []:
        lines = lines.unionByName(xml_raw_lines(spark, files, tag, schema))
        left -= set(files)
    return lines, sorted(left)
