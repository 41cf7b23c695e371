"""Inputs whose telling part comes late, is hidden or is repeated elsewhere: nothing of it may be lost."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gazeledger.operators import access, exposure, parse, pii, reports
from gazeledger.params import AuditParams
from gazeledger.plans.audit import run_audit
from gazeledger.sources import xml
from gazeledger.sources.text import read_log_lines

P = AuditParams(year_hint=2024)


def lines(spark, texts, name="a.log"):
    return spark.createDataFrame([(name, i + 1, t) for i, t in enumerate(texts)], "source_file string, line_no long, raw_line string")


def test_charset_that_shows_late(spark, tmp_path):
    path = tmp_path / "late.log"
    path.write_bytes(b"plain ascii line that is long enough to fill the head of the file\n" * 80 + "이름=홍길동\n".encode("euc-kr"))
    rows = read_log_lines(spark, [str(path)]).orderBy("line_no").collect()
    assert rows[-1]["raw_line"] == "이름=홍길동" and len(rows) == 81


def test_row_count_late_in_an_oracle_block(spark):
    ids = ", ".join(str(i) for i in range(400))
    block = ['ACTION : "SELECT name, phone FROM members WHERE id IN (' + ids + ')"', 'DB USER : "KIM"', "ROWS PROCESSED: 50000", "RETURNCODE: 0"]
    events = exposure.estimate_exposure(parse.parse_oracle(lines(spark, block), P))
    row = events.first()
    assert row["result_row_count"] == 50_000 and row["effective_exposure"] == 100_000


def test_one_line_number_in_three_files(spark):
    rows = [(f"f{i}.log", 7, "kim", 50_000) for i in range(3)] + [("f0.log", 7, "kim", 50_000)]
    df = spark.createDataFrame(rows, "source_file string, line_no long, user_id string, effective_exposure long").withColumn(
        "ts", F.lit("2024-03-01 10:00:00").cast("timestamp_ntz"))
    found = access.alert_dedup(access.alert_single_exposure(df, P)).collect()
    assert sorted(r["raw_reference"] for r in found) == ["f0.log:7", "f1.log:7", "f2.log:7"]


def test_stamp_without_a_year_takes_that_of_the_period(spark, tmp_path):
    path = tmp_path / "syslog.log"
    path.write_text("Nov  5 10:00:00 host sshd[1]: user=kim phone=010-1234-5678\n" * 3)
    result = run_audit(spark, [str(path)], "2026-11-01", "2026-11-30", log_format="app", today=date(2026, 12, 1))
    assert result.events.count() == 3
    assert {str(r["ts"]) for r in result.events.collect()} == {"2026-11-05 10:00:00"}
    folders = [f.removeprefix("file:") for f in result.events.inputFiles()]
    assert folders and all(Path(f.removeprefix("//")).exists() for f in folders)
    result.close()
    assert not any(Path(f.removeprefix("//")).exists() for f in folders)


@pytest.mark.parametrize("text", ["x일 \u0001 phone=010-1234-5678", "\u0002phone=010-1234-5678 \u0003일이삼", "일이삼 \u0001\u0002 phone 010-1234-5678"])
def test_control_characters_hide_nothing(spark, text):
    df = spark.createDataFrame([(text, "db")], "raw_line string, log_type string")
    assert "010-1234-5678" in [h["original_value"] for h in pii.scan_pii(df, "raw_line").first()["pii_hits"]]


def test_evidence_holds_a_late_hit(spark):
    df = spark.createDataFrame([("a" * 500 + " 010-1234-5678 " + "b" * 500, 501, 514), ("x 010-1234-5678 " + "b" * 300, 2, 15)], "t string, a int, b int")
    got = [r[0] for r in df.select(pii.evidence_snippet(F.col("t"), F.col("a"), F.col("b"), F.lit("PHONE"), F.lit("010-1234-5678"))).collect()]
    assert got[0] == "a" * 99 + " [PHONE:010-1234-5678] " + "b" * 99
    assert got[1] == "x [PHONE:010-1234-5678] " + "b" * 184


def test_detail_report_has_no_cut(spark):
    assert "limit" not in reports.rpt_pii_detail.__code__.co_names or reports.rpt_pii_detail.__defaults__ == (False, None)


XML_SCHEMA = "_user string, query string, note struct<_lang string, _VALUE string>"


@pytest.mark.parametrize("layout", ["pretty", "one line", "crlf"])
def test_xml_layouts(spark, tmp_path, layout):
    text = """<?xml version="1.0"?>
<log owner="010-1111-2222">
  <head>contact 010-3333-4444</head>
  <event user="kim">
    <query>SELECT name FROM a</query>
    <note lang="ko">two
 lines</note>
  </event>
  <event user="lee" />
  <event user="broken"><query>call 010-5555-6666</wrong>
  </event>
  <event user="park"><query>SELECT 1</query></event>
  <eventual>010-7777-8888</eventual>
</log>
"""
    text = text.replace("\n", "") if layout == "one line" else text.replace("\n", "\r\n") if layout == "crlf" else text
    path = tmp_path / "a.xml"
    path.write_text(text, newline="")
    rows = xml.read_xml(spark, str(path), "event", XML_SCHEMA).collect()
    assert [r["_user"] for r in rows] == ["kim", "lee", "park"]
    assert [r["query"] for r in rows] == ["SELECT name FROM a", None, "SELECT 1"] and rows[0]["note"]["_lang"] == "ko"
    found = [r["raw_line"] for r in xml.xml_raw_lines(spark, str(path), "event", XML_SCHEMA).orderBy("line_no").collect()]
    joined = "\n".join(found)
    for value in ("010-1111-2222", "010-3333-4444", "010-5555-6666", "010-7777-8888", "user=kim", "user=lee", "user=park"):
        assert joined.count(value) == 1, value
