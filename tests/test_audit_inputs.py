"""What an audit reads: XML among other logs, one pass of statistics, counts of lines."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gazeledger.params import AuditParams
from gazeledger.plans import audit
from gazeledger.sources import text, xml

PG = "2024-03-05 10:00:0{} UTC [7]: [1-1] user=kim,db=hr LOG:  statement: SELECT name FROM person -- 010-1234-567{}\n"
XML = """<?xml version="1.0"?>
<log xmlns:a="http://a.b/c"><info>made by hand</info>
0 rows 10
 <a:event stamp="2024-03-05 11:00:00" user="lee"><query>SELECT phone FROM person</query><client ip="10.0.0.7">office</client></a:event>
 <a:event stamp="2024-03-05 11:00:01" user="lee"><query>010-9876-5432</query><note>z</note><amount>5</amount></a:event>
 <a:event broken <query>x</query></a:event>
</log>
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "pg.log").write_text("\n# note\n" + "".join(PG.format(n, n) for n in range(6)))
    (tmp_path / "audit.xml").write_text(XML)
    (tmp_path / "flat.xml").write_text("<only>2024-03-05 12:00:00 user=park 010-2222-3333</only>\n")
    return tmp_path


def test_tag_and_schema_come_from_the_files(spark, folder):
    (tag, schema, files), = xml.describe_xml(spark, [str(folder / "audit.xml"), str(folder / "flat.xml")])
    assert tag == "a:event" and files == [str(folder / "audit.xml")]
    assert schema.names == ["_stamp", "_user", "query", "client", "note", "amount"]
    assert schema["client"].dataType.names[0] == "_ip" and {f.dataType.simpleString() for f in schema if f.name != "client"} == {"string"}


def test_lines_stand_in_document_order(spark, folder):
    lines, left = xml.read_xml_logs(spark, [str(folder / "audit.xml"), str(folder / "flat.xml")])
    got = [r["raw_line"] for r in lines.orderBy("line_no").collect()]
    assert left == [str(folder / "flat.xml")]
    assert got[1:3] == ['<log xmlns:a="http://a.b/c"><info>made by hand</info>', "0 rows 10"] and "" not in got
    at = got.index("a:event  query=SELECT phone FROM person  client=office  ip=10.0.0.7")
    assert got[at - 1] == "a:event  stamp=2024-03-05 11:00:00  user=lee"
    assert got[at + 1 : at + 3] == ["query  SELECT phone FROM person", "client  ip=10.0.0.7  office"]
    assert any("broken" in line for line in got)


def test_one_audit_of_xml_and_text(spark, folder):
    result = audit.run_audit(spark, [f"{folder}/*"], date(2024, 3, 5), date(2024, 3, 5), AuditParams())
    found = result.findings.where("category = 'PII_EXPOSURE'").select(F.col("details.original_value").alias("v")).collect()
    values = {r["v"] for r in found}
    assert values >= {f"010-1234-567{n}" for n in range(6)} | {"010-9876-5432", "010-2222-3333"}
    records = xml.read_xml_logs(spark, [str(folder / "audit.xml")])[0].count()
    m = result.metrics
    assert m["total_lines"] == 8 + 1 + records
    assert m["skipped_lines"] == m["total_lines"] - m["parsed_events"] == 1  # the empty line
    assert m["total_events"] <= m["parsed_events"]


def test_no_input(spark, tmp_path):
    result = audit.run_audit(spark, [f"{tmp_path}/none*"], date(2024, 3, 5), date(2024, 3, 5))
    assert result.metrics == {"total_events": 0, "total_lines": 0, "parsed_events": 0, "skipped_lines": 0}


def test_text_is_read_once_for_statistics_and_once_for_lines(spark, folder):
    lines, files = text.scan_logs(spark, [f"{folder}/pg.log"])
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    assert [tuple(r) for r in files.collect()] == [(str(folder / "pg.log"), 8, "UTF-8")]
