"""Lines are worked out once a pass, and passes over the input do not grow with the families in it."""

import pytest
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.operators import ordered, parse
from gazeledger.params import AuditParams
from gazeledger.sources import records

BLOCK = ['ACTION : "READ"', 'DB USER : "U7"', "SQL TEXT : SELECT A", "  FROM T", "RETURNCODE: 0"]
WEB = '10.0.0.1 - kim [02/Jan/2024:03:04:05 +0900] "GET /a?b=1 HTTP/1.1" 200 1'
APP = "2024-01-02 03:04:05,123 WARN  [pool-1] com.shop.Svc - user=kim query=SELECT name FROM t"
SCHEMA = "source_file string, line_no bigint, raw_line string"


def made_of(read):
    lines = read.select("source_file", "line_no", F.concat("raw_line", F.lit("~made~")).alias("raw_line"))
    return parse.skip_blank(lines)._jdf.queryExecution().optimizedPlan().toString().count("~made~")


def test_a_filter_does_not_make_its_lines_again(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x")], SCHEMA).write.parquet(str(tmp_path / "t"))
    assert made_of(spark.read.parquet(str(tmp_path / "t"))) == 1


@pytest.mark.parametrize("families", [1, 3])
def test_auto_reads_the_lines_twice_whatever_is_in_them(spark, families):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = [("ora.log", i, t) for i, t in enumerate(BLOCK * 3)]
    if families > 1:
        rows += [("web.log", i, WEB) for i in range(4)] + [("app.log", i, APP) for i in range(4)] + [("free.txt", 0, "note")]
    lines = spark.createDataFrame(rows, SCHEMA).withColumn("raw_line", told.asNondeterministic()("raw_line"))
    got = parse.parse(lines, AuditParams()).groupBy("source_file").count().collect()
    assert seen.value == 2 * len(rows)
    assert {r["source_file"]: r["count"] for r in got} == (
        {"ora.log": 3} if families == 1 else {"ora.log": 3, "web.log": 4, "app.log": 4, "free.txt": 1})


def test_blocks_that_never_close_and_long_ones(spark):
    """The last block of a.log is open; b.log has a longest line that makes every block a candidate, and one long block."""
    rows = [("a.log", i, t) for i, t in enumerate([*BLOCK, "plain user=kim", *BLOCK[:3], "  more"])]
    rows += [("b.log", i, t) for i, t in enumerate([*BLOCK, *BLOCK[:3], *[f"  AND {'x' * 90} = {n}" for n in range(40)], BLOCK[4]])]
    got = parse.parse_db(spark.createDataFrame(rows, SCHEMA), AuditParams(part_bytes=1000, chunk_lines=4)).select(
        "source_file", "line_no", "user_id", F.col("extra")["db_type"].alias("kind"), F.col("extra")["part"].alias("part")).collect()
    assert sorted((r["line_no"], r["kind"]) for r in got if r["source_file"] == "a.log") == [(4, "oracle"), (5, "generic")]
    blocks = [r for r in got if r["source_file"] == "b.log"]
    assert {(r["line_no"], r["user_id"], r["kind"]) for r in blocks} == {(4, "U7", "oracle"), (48, "U7", "oracle")}
    assert sum(r["part"] is None for r in blocks) == 2 and sum(r["part"] is not None for r in blocks) >= 3


def test_votes_are_those_of_the_plain_patterns(spark):
    """Lines with and without a line end or letters beyond ASCII inside; no pattern is tried at every character for its ``^``."""
    from test_text_cost import LINES

    texts = [a + t + b for t in LINES for a in ("", "x\n", "é", "é\n") for b in ("", "\n", " ſ\u212a")]
    rows = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], SCHEMA)
    plain = [F.avg(F.col("raw_line").rlike("(?imuUd)" + p).cast("int")).alias(f"p_{n}") * w for n, p, w, _ in C.FORMAT_SIGNATURES]
    plain = [p.alias(f"p_{n}") for p, (n, *_) in zip(plain, C.FORMAT_SIGNATURES)]
    votes = rows.groupBy("source_file").agg(*parse._votes(), *plain)
    for n, *_ in C.FORMAT_SIGNATURES:
        assert votes.where(F.col(n) != F.col(f"p_{n}")).count() == 0, n
    text = votes._jdf.queryExecution().optimizedPlan().toString()
    assert "(?id)^" in text


def test_more_lines_give_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 100, raising=False)
    lines = spark.range(3000).selectExpr("'a' as source_file", "id as line_no", "if(id % 7 = 0, 'START', 'more') || id as raw_line")
    got = records.multiline_records(lines, r"\ASTART", AuditParams(chunk_lines=50))
    assert got.rdd.getNumPartitions() == 30
    rows = got.orderBy("start_line_no").collect()
    assert [r["start_line_no"] for r in rows] == list(range(0, 3000, 7))
    assert rows[-1]["record"] == "\n".join(("START" if i % 7 == 0 else "more") + str(i) for i in range(2996, 3000))
    log = lines.selectExpr("source_file", "line_no", "element_at(array('ACTION : A', 'DB USER : U7', 'RETURNCODE: 0'), cast(line_no % 3 + 1 as int)) as raw_line")
    events = parse.parse_oracle(log, AuditParams(chunk_lines=50)).select("line_no", "user_id").orderBy("line_no").collect()
    assert [tuple(r) for r in events] == [(i, "U7") for i in range(2, 3000, 3)]
