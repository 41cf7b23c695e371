import base64
import hashlib
import struct
from pathlib import Path

import pytest

from gazeledger.llm import warc

SCHEMA = "page_id bigint, url string, html string, keeper int, sha int"


def expected(pages, least=0):
    groups = {}
    for p, _, h, *_ in pages:
        groups.setdefault((h or "").encode(), []).append(p)
    out = []
    for p, _, h, *_ in pages:
        payload = (h or "").encode()
        ids = [x for x in groups[payload] if x is not None]
        top = max(ids, default=None)
        revisit = len(payload) >= least and top is not None and p != top
        out.append((p, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    pages = [(i, f"http://x.org/{i}\r\nWARC: 1", f"<p>Tëxt {i % 7} {'x' * (i % 5)}</p>", 1, 2) for i in range(40)]
    pages += [(50, None, None, 1, 2), (51, "u", "", 1, 2), (51, "u", "", 1, 2), (None, "u", "<p>Tëxt 0 </p>", 0, 0), (None, "n", "own", 0, 0), (60, "long", "ab\r\n\r\n" * 300_000, 0, 0)]
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    archives = warc.write(df, f"file://{tmp_path}/a", min_revisit_bytes=least)
    rows = warc.read(archives).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr) == expected(pages, least)
    html = {p: h for p, _, h, *_ in pages}
    assert all(r["html"] == (html[r["page_id"]] or "") for r in rows if r["record_type"] == "response" and r["page_id"] is not None)
    files = sorted(Path(tmp_path, "a").glob("*.warc.zst"))
    assert files and not list(Path(tmp_path, "a").glob("*.tmp"))
    magic, size = struct.unpack("<II", files[0].read_bytes()[:8])
    assert magic == 0x184D2A5D and size > 0


def test_empty_table(spark, tmp_path):
    assert warc.archive_and_read(spark, spark.createDataFrame([], SCHEMA)).count() == 0
