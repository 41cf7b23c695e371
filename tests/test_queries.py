"""Every registered query with SQL against DuckDB on the smallest tables; history, reports and the whole run."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from gazeledger.params import AuditParams

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


def normal(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


@needs_data
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_overrides_ignore_unknown_names():
    p = AuditParams().with_overrides({"max_queries_per_day": 7, "weight_bulk_export": 0.05})
    assert p.max_queries_per_day == 7


def test_whole_run_with_history(spark, tmp_path):
    from gazeledger.plans.audit import run_audit

    log = tmp_path / "free.txt"
    log.write_text("".join(
        f"[2024-03-{d:02d} 22:00:0{i}] user=kim 이름=홍길동 phone=010-1234-567{i}\n" for d in (1, 8) for i in range(8)), encoding="utf-8")
    history = str(tmp_path / "history")
    common = dict(params=AuditParams(), log_format="auto", history_folder=history, today=date(2024, 3, 9))
    first = run_audit(spark, [str(log)], "2024-03-01", "2024-03-07", **common)
    second = run_audit(spark, [str(tmp_path / "*.txt"), str(tmp_path / "none.log")], "2024-03-08", "2024-03-14", **common)
    assert first.week.count() == 0
    assert [r["user_id"] for r in second.week.collect()] == ["kim"]
    row = second.summary.first()
    assert (row["total_events"], row["after_hours_count"], row["pii_types"]) == (8, 8, ["NAME_IN_QUERY", "PHONE"])
    shown = second.reports["pii_detail"].first()
    assert "*" in shown["value"]
    item = second.justification.first()
    assert item["reasons"] and item["questions"] and len(item["key_findings"]) == 5
    for name, table in second.reports.items():
        assert table.count() >= 1, name
    assert second.metrics == {"total_events": 8, "total_lines": 16}
    assert second.reports["comparison"].where(F.col("week_trend") != "-").count() == 1
