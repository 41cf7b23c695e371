"""Golden tables for the text rules, and the scan against a plain fold on small inputs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions import extract
from gazeledger.functions.timestamps import parse_timestamp
from gazeledger.operators import exposure, parse, pii
from gazeledger.params import AuditParams

P = AuditParams()


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_spoken_digits(spark):
    assert column(spark, [
        "공일공-일이삼사-오육칠팔", "공 일 공 일 이 삼 사 오 육 칠 팔", "010-일이삼사-오육칠팔", "오이 주세요", "plain",
    ], pii.spoken_digits) == ["010-1234-5678", "01012345678", "010-1234-5678", "오이 주세요", "plain"]


@pytest.mark.parametrize("text,expected", [
    ("주민 800101-1000008", [("RRN", "80****-*******")]),
    ("주민 800101-1234567", []),
    ("card 4111-1111-1111-1111", [("CREDIT_CARD", "4111-****-****-1111")]),
    ("phone 010-1234-5678", [("PHONE", "010-****-5678")]),
    ("mail hong@company.com name", [("EMAIL", "ho**@company.com")]),
    ("이름=홍길동", [("NAME_IN_QUERY", "홍**")]),
    ("담당자: admin01", []),
    ("where c070901", [("EMP_ID_STANDALONE", "c*****1")]),
    ("birth=1990-01-15", [("BIRTHDATE", "1990-**-**")]),
    ("client 192.168.1.55", [("IP_ADDRESS", "192.168.1.**")]),
    ("client 127.0.0.1", []),
    ("본인인증 주민번호 확인: 팔공공일공일-일공공공공공팔", [("RRN", "80****-*******")]),
    ("계좌이체: 계좌번호 이삼사오육칠팔구공일이삼사", [("ACCOUNT_NO", "234*******234")]),
])
def test_scan(spark, text, expected):
    df = spark.createDataFrame([(text, "db")], "raw_line string, log_type string")
    hits = pii.scan_pii(df, "raw_line").first()["pii_hits"]
    assert [(h["pii_type"], h["redacted_value"]) for h in hits] == expected


UNCHECKED = {"RRN", "CREDIT_CARD", "IP_ADDRESS"}


def fold(text):
    """Spans per type in priority order; the overlap rule applied one by one. The texts hold no numbers
    with a check digit and no addresses, so only names need a check of their value."""
    taken = []
    for name, pattern, _, grouped in C.PII_RULES:
        if name in UNCHECKED:
            continue
        for m in re.finditer(pattern, text, re.IGNORECASE):
            a, b = m.span()
            value = m.group(1) if grouped else m.group()
            if name == "NAME_IN_QUERY" and (value[0] not in C.SURNAMES or value[-1] in C.OFFICE_SUFFIXES):
                continue
            if not any(s <= a < e or s < b <= e for _, s, e, _ in taken):
                taken.append((name, a, b, value))
    return taken


def test_scan_matches_fold_on_small_input(spark):
    parts = ["010-1234-5678", "emp_id=AB12345", "c123456", "a.b@c.com", "M12345678", "account 12345678901", "dob 19900101",
             "서울시강남구 테헤란로 12", "  ", "ſelect", "xx", "é010-2222-3333", "name", "02 555 1234", "ab@cd.ef.gh", ",", "("]
    texts = [f"{a}{s}{b} {c}" for i, a in enumerate(parts) for b in parts[i % 3::3] for c in parts[i % 5::5] for s in (" ", "")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("hits", pii.scan_text(F.col("t")))
    for row in df.collect():
        got = [(h["pii_type"], h["match_start"], h["match_end"], h["original_value"]) for h in row["hits"]]
        assert not {g[0] for g in got} & UNCHECKED
        assert got == fold(row["t"]), row["t"]


def test_hit_repeated_on_a_line_counts_once(spark):
    df = spark.createDataFrame([("phone 010-1234-5678 공일공-일이삼사-오육칠팔 010-1234-5678",)], "raw_line string")
    hits = pii.scan_pii(df, "raw_line").first()["pii_hits"]
    assert [(h["original_value"], h["match_start"]) for h in hits] == [("010-1234-5678", 6)]


def test_masked_text_is_not_found_again(spark):
    df = spark.createDataFrame([("phone 010-****-5678 mail 4111-****-****-1111 80****-*******",)], "raw_line string")
    assert pii.scan_pii(df, "raw_line").first()["pii_hits"] == []


def test_timestamps(spark):
    got = column(spark, [
        "2024-03-01 10:22:01,000", "15/Jan/2024:14:23:01 +0900", "2024-01-15T14:23:01.123Z", "2024-01-15T14:23:01Z",
        "2023-02-29 00:00:00 then 2024/02/29  01:00:00", "Feb 29 01:01:01", "Mar  3 01:01:01", "1900-01-01 00:00:01", "none",
    ], lambda t: parse_timestamp(t, 2024).cast("string"))
    assert got == [
        None, "2024-01-15 14:23:01", None, "2024-01-15 14:23:01", "2024-02-29 01:00:00", None, "2024-03-03 01:01:01",
        "2024-01-01 00:00:01", None]


def test_user_and_bulk(spark):
    assert column(spark, ["user_id=8215", "user=hong", "user=null", "employee-no: e123", "[admin01] did select"],
                  extract.user_id) == [None, "hong", None, "e123", "admin01"]
    assert column(spark, ["SELECT id FROM t LIMIT 1000", "SELECT id FROM t LIMIT 999", "select * from t", "select * from t where a=1",
                          "limit 99999999999999999999"], lambda t: extract.bulk_flag(t, 1000)) == [True, False, True, False, True]


def test_exposure(spark):
    rows = [("SELECT name, phone FROM members   Rows_sent: 150", ""), ("SELECT * FROM customers", "returned 3,200 rows"),
            ("SELECT id FROM orders WHERE phone='1'", ""), ("조회 SELECT a.name AS x FROM t", "1,847건 반환")]
    df = exposure.estimate_exposure(spark.createDataFrame(rows, "query_text string, raw_line string"))
    got = [(r.exposure_type, r.result_row_count, r.pii_select_count, r.effective_exposure) for r in df.collect()]
    assert got == [("PARTIAL_EXPOSURE", 150, 2, 300), ("FULL_EXPOSURE", 3200, 5, 16000), ("SEARCH_ONLY", None, 0, None),
                   ("PARTIAL_EXPOSURE", 1847, 1, 1847)]


def lines(spark, texts, name="a.log"):
    return spark.createDataFrame([(name, i + 1, t) for i, t in enumerate(texts)], "source_file string, line_no long, raw_line string")


def test_oracle_single_line_records_flip_the_state(spark):
    both = "ACTION : x RETURNCODE: 0"
    blocks = parse.parse_oracle(lines(spark, [both, "a", both, both, "DB USER : \"B\"", "RETURNCODE: 1", "ACTION : y"]), P)
    # a line with both marks opens, the next one closes; the last block never closes
    assert [(r.line_no, r.raw_line.count("\n")) for r in blocks.orderBy("line_no").collect()] == [(3, 2), (6, 2)]


def test_web_line_without_layout_keeps_text(spark):
    rows = parse.parse_web(lines(spark, ["free text", "", '1.2.3.4 - - [15/Jan/2024:14:23:01 +0900] "GET /a?x=1 HTTP/1.1" 200 5']), P)
    got = [(r.line_no, r.query_text, r.target, r.user_id) for r in rows.orderBy("line_no").collect()]
    assert got == [(1, "free text", None, None), (3, "GET /a?x=1 x=1", "/a", None)]


def test_detect_counts_blank_lines_out(spark):
    texts = [""] * 1200 + ['1.1.1.1 - u [15/Jan/2024:14:23:01 +0900] "GET / HTTP/1.1" 200 1'] * 3
    found = parse.detect_format(lines(spark, texts)).first()
    assert (found["format"], found["family"]) == ("apache_combined", "web")
