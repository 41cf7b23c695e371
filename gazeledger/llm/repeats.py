"""Substring de-duplication (operator 6): content-defined chunks, de-duplicated by digest.

A gear rolling hash cuts every text into chunks (``chunks``). Each two chunks that follow each other give a digest; a
digest seen in two or more documents marks both chunks as repeated, and repeated stretches that overlap join to runs.
Since neighbouring chunks must repeat together, two common lines that meet by chance are not one run. Runs of at least
``min_chars`` characters are reported; text inserted before or inside a document moves no border beyond the 26 bytes
after it.

The first document (smallest id) that holds a stretch owns and keeps it. A run whose stretches have several owners is
reported as several passages without overlap. A chunk that stands in a stretch of its own document is kept there; all
else is cut, so what is cut from one document stays in another. ``source_doc_id`` is the document that keeps the passage;
parts of fewer than ``min_chars`` characters that yet another document keeps are cut with the passage beside them. Kept
parts of fewer characters are not reported; cut ones are, as their run is long enough.

Digests have 64 bits and a run needs several of them. Repeats within one document alone do not count. NULL and empty
texts have no passages. Rows that repeat an id count as one document; their runs are merged. Rows with a NULL id are left out. Very long texts are read whole. Empty tables
give empty results. Only the named columns are read; ``without_repeats`` keeps all columns.

The digests are counted with map-side partial sums, and joined back under a plan that may split a digest with very many
rows; no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeledger.llm.chunks import borders
from gazeledger.llm.common import mix, span_hashes, text_blocks, text_column

MIN_CHARS = 130
STRETCH = "digest bigint, doc_id bigint, start int, end int"


def stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest and place (in characters, end exclusive) of every two neighbouring chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_blocks(text_column(batch, "text")):
                starts, owners = borders(data, offsets)
                if len(starts) < 2:
                    continue
                ends = np.append(starts[1:], len(data))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                hashes = span_hashes(data, starts, ends)
                first = np.flatnonzero(owners[1:] == owners[:-1])
                digests = mix(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[first + 1])
                base = chars[offsets[owners[first]]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(digests.view(np.int64)), batch.column(0).take(pa.array(lo + owners[first])),
                    pa.array((chars[starts[first]] - base).astype(np.int32)), pa.array((chars[ends[first + 1]] - base).astype(np.int32)),
                ], ["digest", "doc_id", "start", "end"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return own.mapInArrow(cut, STRETCH)


def repeated_passages(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, source_doc_id, kept`` for every passage that also stands in another document."""
    places = stretches(docs, id_col, text_col)
    seen = places.groupBy("digest").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    repeated = places.join(seen.where("source <> last").select("digest", "source"), "digest").select("doc_id", "start", "end", "source")
    before = Window.partitionBy("doc_id").orderBy("start", "end")
    so_far = before.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    own = F.col("source") == F.col("doc_id")
    marked = repeated.withColumn("opens", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    # of the place up to the next start: what an own stretch covers, then what only stretches of other documents cover
    numbered = marked.select(
        "doc_id", "start", F.sum("opens").over(so_far).alias("run"), F.lead("start").over(before).alias("next"),
        F.coalesce(F.max(F.when(own, F.col("end"))).over(so_far), F.lit(-1)).alias("own"),
        F.max(F.when(~own, F.struct("end", "source"))).over(so_far).alias("other"))
    parts = F.array(
        F.struct("start", F.least("own", "next").alias("end"), F.col("doc_id").alias("source")),
        F.struct(F.greatest("start", "own").alias("start"), F.least("other.end", "next").alias("end"), F.col("other.source").alias("source")))
    parts = numbered.select("doc_id", "run", F.inline(F.filter(parts, lambda p: p["source"].isNotNull() & (p["end"] > p["start"]))))
    along = Window.partitionBy("doc_id").orderBy("start")
    same = (F.lag("source").over(along) == F.col("source")) & (F.lag("run").over(along) == F.col("run"))
    parts = parts.withColumn("turns", (~F.coalesce(same, F.lit(False))).cast("int"))
    parts = parts.withColumn("passage", F.sum("turns").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = parts.groupBy("doc_id", "run", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("source").alias("source_doc_id"))
    whole = Window.partitionBy("doc_id", "run")
    length = F.col("end") - F.col("start")
    found = found.withColumn("total", F.max("end").over(whole) - F.min("start").over(whole)).where(F.col("total") >= min_chars)
    found = found.withColumn("kept", F.col("doc_id") == F.col("source_doc_id"))
    found = found.withColumn("region", F.sum(F.col("kept").cast("int")).over(whole.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    # short parts go with the long one before them, those at the front with the one after
    longs = F.sum((length >= min_chars).cast("int")).over(
        Window.partitionBy("doc_id", "run", "kept", "region").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    joined = found.withColumn("part", F.greatest(longs, F.lit(1))).groupBy("doc_id", "run", "kept", "region", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("source_doc_id", F.struct(length, -F.col("start"))).alias("source_doc_id"))
    return joined.where(~F.col("kept") | (length >= min_chars)).select("doc_id", "start", "end", "source_doc_id", "kept")


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the passages that another document keeps; every other character stays."""
    cuts = passages.where("not kept").groupBy(F.col("doc_id").alias("_cut_id")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    own = docs.select(F.struct(*docs.columns).alias("_row"))
    joined = own.join(cuts, own["_row"][id_col] == cuts["_cut_id"], "left")
    text = F.col("_row")[text_col]
    rest = F.aggregate(F.reverse("_cuts"), text, lambda t, c: F.overlay(t, F.lit(""), c["start"] + 1, c["end"] - c["start"]))
    return joined.select(*[F.when(F.size("_cuts") > 0, rest).otherwise(text).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
