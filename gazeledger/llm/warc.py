"""WARC archives with dictionary compression (operator 5).

A Zstandard dictionary is trained on records of the pages to be archived, stands in a leading skippable frame of every
archive, and each record is a frame of its own, so archives can be read from any record on.

Pages with equal payloads (the html in UTF-8, NULL as the empty payload) of at least ``min_revisit_bytes`` bytes are
stored once: the row with the largest id is the response, the others are revisit records that refer to it. Rows that
repeat the largest id are responses too. A row without an id never stands for others; if no row of a group has an id,
all are responses. An empty table gives no archive and an empty result. Only the three named columns are read.

Archives are written by the task of each partition under a name made of the partition's number, first to a temporary
name and then moved, so a task that runs again replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeledger.llm.common import materialise
from gazeledger.session import checked_broadcast, new_folder

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS, SAMPLE_CHARS = 200, 32_768
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PAGE = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"
ARCHIVE = "path string, records bigint, bytes bigint"


def open_store(uri: str):
    """File system and path of a URI; plain paths and ``file:`` are local."""
    if "://" not in uri:
        return pa.fs.LocalFileSystem(), uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record. Ids of pages stand in extension headers, since record ids must be URIs."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"X-Refers-To-Page-Id: {refers_to}"] if revisit else []),
        f"X-Payload-Bytes: {len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; too few or too small samples serve as raw content themselves."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an open archive."""
    head = stream.read(8)
    if len(head) < 8:
        return
    magic, size = struct.unpack("<II", head)
    if magic == DICTIONARY_MAGIC:
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    else:
        stream.seek(0)
        reader = zstandard.ZstdDecompressor()
    with io.BufferedReader(reader.stream_reader(stream, read_across_frames=True), 1 << 20) as plain:
        while line := plain.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"no record starts here: {line[:40]!r}")
            fields = {}
            while (line := plain.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                fields[name] = value
            block = plain.read(int(fields["Content-Length"]))
            if plain.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut off")
            yield fields, block


def with_decisions(pages: DataFrame, min_revisit_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Payload pages with ``revisit`` and ``keeper``; only digests that repeat are joined, and broadcast only if few."""
    own = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = own.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    return own.join(checked_broadcast(groups, "payloads"), "sha", "left").withColumn(
        "revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(False)))


def write(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, level: int = 3,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write one archive per partition into ``folder``; returns the written list of archives (``ARCHIVE``)."""
    own = with_decisions(pages, min_revisit_bytes, id_col, url_col, html_col)
    least = [r["sha"] for r in own.select("sha").distinct().orderBy("sha").limit(SAMPLE_RECORDS).collect()]
    sample = own.where(F.col("sha").isin(least)).groupBy("sha").agg(
        F.min_by(F.struct("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html")), F.struct("page_id", "url")).alias("r")
    ).orderBy("sha").select("r.*").collect()
    dictionary = train([record(r["page_id"], r["url"], r["html"].encode(), None, False) for r in sample])

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stream, count = None, 0
        files, root = open_store(folder)
        final = f"{root}/part-{task.partitionId():06d}.warc.zst"
        draft = f"{final}.{task.taskAttemptId()}.tmp"
        packer = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    files.create_dir(root, recursive=True)
                    stream = files.open_output_stream(draft)
                    if dictionary:
                        stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                stream.write(packer.compress(record(row["page_id"], row["url"], row["html"].encode(), row["keeper"], row["revisit"])))
                count += 1
        if stream is not None:
            size = stream.tell()
            stream.close()
            files.move(draft, final)
            name = f"{folder}/{final.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [count], "bytes": [size]})

    return materialise(own.select("page_id", "url", "html", "keeper", "revisit").mapInArrow(archive, ARCHIVE), "archives")


def read(archives: DataFrame, with_html: bool = True) -> DataFrame:
    """The records of written archives, one task each: the columns of ``PAGE``. Sizes and digests of responses are taken
    from the payload as read; a digest that differs from the header's is an error."""
    columns = [c.split()[0] for c in PAGE.split(", ")][: None if with_html else -1]

    def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = open_store(path)
                rows, held = [], 0
                with files.open_input_file(name) as stream:
                    for fields, block in read_records(stream):
                        payload = block.partition(b"\r\n\r\n")[2]
                        revisit = fields["WARC-Type"] == "revisit"
                        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and stated != digest(payload):
                            raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} is damaged")
                        number = fields.get("X-Page-Id")
                        rows.append((
                            None if number is None else int(number), fields.get("WARC-Target-URI"),
                            int(fields["X-Payload-Bytes"]) if revisit else len(payload), stated, fields["WARC-Type"],
                            int(fields["X-Refers-To-Page-Id"]) if revisit else None, None if revisit else payload.decode()))
                        held += len(payload) if with_html else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = dict(zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()], strict=False))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kinds[c]) for c, x in zip(columns, zip(*rows, strict=True), strict=False)], columns)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(pages_of, PAGE if with_html else PAGE.rsplit(", ", 1)[0])


def archive_and_read(spark: SparkSession, pages: DataFrame, with_html: bool = False, **options) -> DataFrame:
    """Archive the pages in a new shared folder and read the archives back."""
    return read(write(pages, new_folder(spark, "warc"), **options), with_html)
