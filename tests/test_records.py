"""Records of several lines: bounded parts, nothing lost, no recursion in the matcher."""

from __future__ import annotations

import random
import re
from dataclasses import replace

from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.operators import filters, parse
from gazeledger.params import AuditParams
from gazeledger.sources import records

P = AuditParams(year_hint=2024)
SMALL = replace(P, part_bytes=80, chunk_lines=7)


def lines(spark, texts, name="a.log"):
    return spark.createDataFrame([(name, i + 1, t) for i, t in enumerate(texts)], "source_file string, line_no long, raw_line string")


def records_of(texts, pattern):
    out, start = [], 1
    for i, t in enumerate(texts, 1):
        if re.search(pattern, t) or not out:
            out.append([i if out else start, []])
        out[-1][1].append(t)
    return [(s, "\n".join(t)) for s, t in out]


def test_records_come_whole_in_bounded_parts(spark):
    rng = random.Random(3)
    texts = [rng.choice(["START ", " ", "x", ""]) + "y" * rng.choice([0, 3, 30, 200]) for _ in range(300)]
    got = records.multiline_records(lines(spark, texts), r"\ASTART", SMALL).collect()
    joined = {}
    for r in sorted(got, key=lambda r: (r["start_line_no"], r["part"])):
        joined.setdefault(r["start_line_no"], []).append(r["record"])
        assert len(r["record"]) <= 80 + 206
    assert sorted((k, "\n".join(v)) for k, v in joined.items()) == records_of(texts, r"\ASTART")
    assert max(map(len, joined.values())) > 3


def test_file_without_a_start(spark):
    """Some 40 MB that never open a record."""
    many = spark.range(400_000).select(
        F.lit("big.log").alias("source_file"), (F.col("id") + 1).alias("line_no"), F.concat(F.lit("z" * 90), F.col("id")).alias("raw_line"))
    got = records.multiline_records(many, r"\ASTART", P).select("part", F.octet_length("record").alias("n"), F.size(F.split("record", "\n")).alias("lines"))
    row = got.agg(F.max("n").alias("n"), F.sum("lines").alias("lines"), F.count("*").alias("parts")).first()
    assert row["lines"] == 400_000 and row["n"] <= P.part_bytes + 100 and row["parts"] > 30


def block(rng):
    """A random audit block; marks, colons and values may stand on lines of their own."""
    def field(name, value):
        gap = rng.choice([" ", "  ", "\n", " \n  "])
        return f"{name}{rng.choice(['', ' ', chr(10)])}:{gap}{value}".split("\n")

    out = ["AUDIT TRAIL"]
    parts = [field("DB USER", '"KIM"'), field("OS USERNAME", "os1"), field("ACTION", "SELECT"), field("OBJ NAME", "MEMBERS"),
             field("TIMESTAMP", "2024-03-01 10:00:00"), field("SQL TEXT", "SELECT a,") + [f"   c{i}{'x' * rng.randint(0, 30)}," for i in range(rng.randint(0, 20))] + ["  d FROM t"]]
    rng.shuffle(parts)
    for p in parts[: rng.randint(2, 6)]:
        out += p + [f"note {rng.randint(0, 99)} " + "n" * rng.randint(0, 40) for _ in range(rng.randint(0, 3))]
    return [x for x in out if x.strip()] + ["RETURNCODE : 0"]


def test_long_blocks_have_the_fields_of_the_whole_text(spark):
    rng = random.Random(5)
    blocks = [block(rng) for _ in range(60)]
    texts = [x for b in blocks for x in b]
    small = parse.parse_oracle(lines(spark, texts), SMALL).collect()
    ends, at = {}, 0
    for b in blocks:
        at += len(b)
        ends[at] = "\n".join(b)
    flags = re.IGNORECASE
    by_line = {}
    for r in small:
        by_line.setdefault(r["line_no"], []).append(r)
    assert set(by_line) == set(ends)
    several = 0
    for line, text in ends.items():
        rows = sorted(by_line[line], key=lambda r: int(r["extra"].get("part", 0)))
        several += len(rows) > 1
        assert "\n".join(r["raw_line"] for r in rows) == text
        assert ["part" in r["extra"] for r in rows] == [False] + [True] * (len(rows) - 1)

        def want(name, text=text):
            m = re.search(C.ORACLE_FIELDS[name], text, flags)
            return m and m[1].strip() or None

        for r in rows:
            assert r["user_id"] == (want("db_user") or want("os_user")), text
            assert (r["action"], r["target"]) == (want("action"), want("object"))
        sql = want("sql")
        if sql:
            pieces = [r["query_text"] for r in rows if r["query_text"] != r["raw_line"] or r["query_text"].strip() in sql]
            assert re.sub(r"\s+", "", "".join(pieces)).startswith(re.sub(r"\s+", "", sql)), (text, pieces)
    assert several > 30
    assert filters.counter_eligible(parse.parse_oracle(lines(spark, texts), SMALL)).count() <= len(blocks)
    whole = {r["line_no"]: r for r in parse.parse_oracle(lines(spark, texts), P).collect()}
    for line, text in ends.items():
        assert whole[line]["raw_line"] == text
        m = re.search(C.ORACLE_FIELDS["sql"], text, flags)
        assert whole[line]["query_text"] == (m[1].strip() if m else text)


def test_block_of_a_hundred_thousand_sql_lines(spark):
    """The matcher once recursed per line and ended the JVM at 3 000."""
    n = 100_000
    head = spark.createDataFrame([("o.log", 1, "AUDIT TRAIL"), ("o.log", 2, 'DB USER : "LEE"'), ("o.log", 3, "SQL TEXT : SELECT name FROM t WHERE id IN (")], "source_file string, line_no long, raw_line string")
    body = spark.range(n).select(F.lit("o.log").alias("source_file"), (F.col("id") + 4).alias("line_no"), F.concat(F.lit("   "), F.col("id"), F.lit(",")).alias("raw_line"))
    tail = spark.createDataFrame([("o.log", n + 4, "   0)"), ("o.log", n + 5, "RETURNCODE : 0")], head.schema)
    for params in (P, replace(P, part_bytes=100_000)):
        rows = parse.parse_oracle(head.union(body).union(tail), params).select(
            "user_id", "line_no", F.octet_length("raw_line").alias("size"), F.size(F.split("query_text", ",")).alias("values"), "extra").collect()
        assert {(r["user_id"], r["line_no"]) for r in rows} == {("LEE", n + 5)}
        assert max(r["size"] for r in rows) <= params.part_bytes + 100
        assert sum(r["values"] for r in rows) >= n + 1
        assert sum("part" not in r["extra"] for r in rows) == 1
