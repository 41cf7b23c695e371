"""Text work that runs once a row, and gates and cheaper flags that change no result."""

import pytest
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions.regex import IGNORE_CASE, extracted, folded, matches, strip
from gazeledger.operators import exposure, parse, pii
from gazeledger.operators.filters import has_trigger_keyword
from gazeledger.params import AuditParams

ROWS = ["Rows_sent: 7", "ROWS PROCESSED : 7", "rowsAffected=7", "7건 조회", "결과: 7 건", "returned 7 row", "7 rows fetched",
        "findAll took 7 results", "totalRows=7", "fetchSize: 7", "7 row in set", "x rows = 7", "row affected: 7"]
LINES = ["Jan 2 03:04:05 host app", "2024-01-02T03:04:05 x", '1.2.3.4 - u [02/Jan/2024:03:04:05 +0900] "GET', "2024-01-02 03:04:05,123 WARN x",
         "DB USER : x", "2024-01-02T03:04:05.1Z 7 Init", "LoginName a, b", "2024-01-02 03:04:05 LOG: duration: 1", '2024-01-02 03:04:05 UTC,"a","b","', "a,b,c,d"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_every_pattern_stands_at_most_once_for_each_alphabet(spark):
    rows = spark.createDataFrame([("SELECT * FROM t", "x")], "query_text string, raw_line string")
    text = plan(exposure.estimate_exposure(rows))
    for pattern in (r"rows?\s+affected\s*[=:]", r"rows?\s+in\s+set", r"\bWHERE\b(.*?)"):
        assert 1 <= text.count(pattern) <= 2, pattern


@pytest.mark.parametrize("blank", ["", "é "])
def test_every_row_count_and_format_passes_its_gate(spark, blank):
    texts = spark.createDataFrame([(i, blank + t, t) for i, t in enumerate(ROWS)], "i int, t string, own string")
    got = texts.select("i", "t", exposure.result_rows(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [7] * len(ROWS), got
    assert all(texts.where(F.col("i") == i).select(F.col("own").rlike(IGNORE_CASE + p)).first()[0] for i, p in enumerate(C.ROW_COUNT_PATTERNS))
    files = spark.createDataFrame([(str(i), 1, t + blank) for i, t in enumerate(LINES)], "source_file string, line_no bigint, raw_line string")
    votes = {r["source_file"]: r for r in files.groupBy("source_file").agg(*parse._votes()).collect()}
    for i, (name, _, weight, _) in enumerate(C.FORMAT_SIGNATURES):
        assert votes[str(i)][name] == weight, name


def test_letters_beyond_ascii_fold_as_before(spark):
    texts = spark.createDataFrame([("K", "k"), ("ſ", "s"), ("K", "k"), (None, "k")], "t string, p string").coalesce(1)
    assert [r[0] for r in texts.select(F.when(F.col("p") == "k", matches(F.col("t"), "k")).otherwise(matches(F.col("t"), "s"))).collect()] == [True, True, True, None]
    assert texts.select(extracted(F.col("t"), "(K)")).collect()[2][0] == "K"
    blanks = spark.createDataFrame([(" \t\x0b\f\r\na b\x1c ",), (" é ",), ("",)], "t string")
    assert [r[0] for r in blanks.select(strip(F.col("t"))).collect()] == ["a b\x1c", "é", ""]


def test_scan_needs_hold(spark):
    text = "name='홍길동' 서울시강남구 테헤란로 12 M12345678 c123456 800101-1234567"
    hits = spark.createDataFrame([(text,)], "t string").select(F.inline(pii.scan_text(F.col("t")))).collect()
    assert {"NAME_IN_QUERY", "ADDRESS", "PASSPORT", "EMP_ID_STANDALONE"} <= {h["pii_type"] for h in hits}


def test_keywords_are_sought_in_one_lower_case_text(spark):
    rows = spark.createDataFrame([("x SELECT", True), ("no sign", False), (None, None), ("\u212aim ADDR", True), ("전화", True)], "t string, want boolean")
    gate = has_trigger_keyword(F.col("t")).alias("g")
    assert plan(rows.select(gate)).count("lower(t") == 1
    assert all(r[0] == r[1] for r in rows.select(gate, "want").collect())


def test_texts_that_hold_nothing_skip_the_gate_and_no_match_is_lost(spark):
    """Every match of every type, with odd digits, blanks and neighbours, lies in a text that passes the first test."""
    values = ["800101-1234560", "8001011234560", "010-1234-5678", "02 123 4567", "٠10", "account 1234567890", "계좌 : 1234567890123",
              "4111-1111 11111111", "M12345678", "mA1234567", "a@b.co", "x_y%@z-1.info", "name='홍길동'", "이름:김가", "ſeoul name=김가나",
              "서울시강남구 테헤란로 12", "서울시 강남동 ٣", "emp_id=1234", "user_id : ab-٠١٢٣", "사번 12345", "c123456", "birth=1999.01.02", "dob 19990102",
              "10.2.3.4", "1.2.3.٤", "fe80::1", "a:b:c:d:e", "1:2:3:4:5:6:7:8", "::1", "0:0:0:0:0:0:0:1", "공일공-일이삼사-오육칠팔"]
    texts = [a + v + b for v in values for a, b in (("", ""), ("é ", " é"), ("a.b.c. ", ". d. e."), ("\n", "\n"), ("client ", ", K"), ("가", "나"))]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", pii.may_hold(F.col("t")).alias("may"), F.array(*[F.size(pii.type_spans(F.col("t"), n)) for n in pii.RULES]).alias("n"),
        F.array(*[pii._possible(n, F.struct(
            F.lit(99).alias("digits"), F.lit(True).alias("in_a_row"), pii._hangul(F.col("t")).alias("hangul"), folded(F.col("t")).alias("lower")))
            for n in pii.RULES]).alias("possible")).collect()
    assert [r["t"] for r in found if sum(r["n"]) and not r["may"]] == []
    assert [(r["t"], n) for r in found for n, k, p in zip(pii.RULES, r["n"], r["possible"]) if k and not p] == []
    assert all(any(r["n"][i] for r in found) for i in range(len(pii.RULES)))
    plainer = spark.createDataFrame([("client: the ip of é. 12:30 costs 100, or 3. 4.",)], "t string")
    assert not plainer.select(pii.may_hold(F.col("t"))).first()[0]
    scan = pii.scan_pii(plainer, "t").select("pii_hits")
    assert r"\d(?:\d{3}|\.\d)" in plan(scan) and scan.first()[0] == []


def test_ordered_passes_work_the_lines_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    block = ["ACTION : \"READ\"", "DB USER : \"U%d\"", "SQL TEXT : SELECT A%s", "  FROM T", "RETURNCODE: 0", "plain user=w%d"]
    rows = [("ora.log", i * 10 + j, t % (i if "%d" in t else "B" * 3000 * (i == 2)) if "%" in t else t) for i in range(4) for j, t in enumerate(block)]
    lines = spark.createDataFrame(rows, "source_file string, line_no bigint, raw_line string").withColumn("raw_line", told.asNondeterministic()("raw_line"))
    got = parse.parse_oracle(lines, AuditParams(part_bytes=1000)).select("line_no", "user_id", "query_text", F.col("extra")["part"].alias("part")).collect()
    assert seen.value == len(rows)
    assert {r["line_no"] for r in got} == {4, 14, 24, 34} and {r["user_id"] for r in got} == {"U0", "U1", "U2", "U3"}
    assert [r["query_text"] for r in got if r["line_no"] == 4] == ["SELECT A\n  FROM T"]
    assert {r["part"] for r in got if r["line_no"] != 24} == {None} and any(r["part"] for r in got if r["line_no"] == 24)
