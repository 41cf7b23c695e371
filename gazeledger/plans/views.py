"""Log views derived from the ``events`` table; the same SQL text runs in Spark and in the checker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeledger.functions.regex import once

# structured events for the counters
ACCESS_LOG = """
select event_id as line_no, 'events' as source_file, ts, 'u' || cast(user_id as string) as user_id,
 't' || regexp_extract(props,'([0-9]+)',1) as target,
 event_type in ('purchase','signup') as has_pii, event_type = 'error' as is_bulk,
 case event_type when 'view' then 'FULL_EXPOSURE' when 'purchase' then 'PARTIAL_EXPOSURE'
                 when 'click' then 'SEARCH_ONLY' else 'NONE' end as exposure_type,
 case when event_id % 5 = 0 then null else cast(floor(value*10) as bigint) end as result_row_count,
 case when event_type in ('view','purchase') and event_id % 5 <> 0
      then cast(floor(value*10) as bigint) * (case event_type when 'view' then 5 else 2 end) end as effective_exposure
from events"""

# PostgreSQL server lines
RAW_LOG = """
select event_id as line_no, 'pg.log' as source_file,
 substr(cast(ts as string),1,19) || ' UTC [' || cast(1000+event_id%7 as string) || '] u' || cast(user_id as string)
 || '@custdb LOG:  statement: ' ||
 case event_type when 'click' then 'SELECT name, phone FROM customers WHERE id=' || cast(event_id as string)
      when 'view' then 'SELECT * FROM members WHERE id>0'
      when 'purchase' then 'SELECT id FROM orders WHERE phone=''010-1234-' || cast(1000+event_id%9000 as string) || ''''
      when 'signup' then 'INSERT INTO audit VALUES (''공일공-일이삼사-오육칠팔'')'
      else 'SELECT id FROM t LIMIT 5000' end
 || ' rows=' || cast(cast(floor(value*100) as bigint) as string) as raw_line
from events"""

# combined web lines
WEB_LOG = """
select event_id as line_no, 'web.log' as source_file, '10.0.' || cast(event_id%200 as string) || '.7 - u' ||
 cast(user_id as string) || ' [' || substr(cast(ts as string),9,2) || '/Jan/2024:' || substr(cast(ts as string),12,8) ||
 ' +0900] "GET /api/' || event_type || '?k=' || regexp_extract(props,'([0-9]+)',1) || ' HTTP/1.1" 200 ' ||
 cast(event_id as string) as raw_line from events"""

# MySQL general log
MYSQL_LOG = """
select event_id as line_no, 'my.log' as source_file, substr(cast(ts as string),1,10) || 'T' || substr(cast(ts as string),12,8)
 || '.000000Z ' || cast(event_id%8 as string) ||
 case when event_id % 16 < 8 then ' Connect u' || cast(user_id as string) || '@host on db'
      else ' Query SELECT id FROM t' || cast(event_id%5 as string) || ' WHERE k=' || cast(event_id as string) end as raw_line
from events"""

# spoken digits
HANGUL_LOG = """
select event_id as line_no, 'call ' || translate('010-' || cast(1000+event_id%9000 as string) || '-' ||
 cast(1000+(event_id*7)%9000 as string), '0123456789', '공일이삼사오육칠팔구') as raw_line from events"""

# application lines: one layout per remainder of the event number
APP_LOG = """
select event_id as line_no, 'app.log' as source_file,
 case event_id % 6
  when 0 then substr(cast(ts as string),1,19) || ',123 WARN  [pool-' || cast(event_id%4 as string) || '] com.shop.Svc - user=u'
       || cast(user_id as string) || 'x query=SELECT name FROM members from 10.1.2.' || cast(event_id%250 as string)
  when 1 then substr(cast(ts as string),1,19) || '.001 - auth.svc - WARNING - user=u' || cast(user_id as string) || 'x update done'
  when 2 then 'Jan ' || substr(cast(ts as string),9,2) || ' ' || substr(cast(ts as string),12,8) || ' host' || cast(event_id%3 as string)
       || ' sshd[' || cast(event_id%900 as string) || ']: login user=u' || cast(user_id as string) || 'x from 10.9.8.7'
  when 3 then substr(cast(ts as string),1,19) || ' plain delete by user=u' || cast(user_id as string) || 'x'
  when 4 then 'no stamp, user=u' || cast(user_id as string) || 'x get'
  else case when event_id % 12 = 5 then '# comment ' || cast(event_id as string) else '   ' end end as raw_line
from events"""

# free-form lines
FREE_LOG = """
select event_id as line_no, 'free.txt' as source_file,
 case when event_id % 10 = 9 then '# note' when event_id % 10 = 8 then '  '
      when event_id % 10 = 7 then '  접근 ' || cast(event_id as string) || ' memo '
      else '  [' || substr(cast(ts as string),1,19) || '] user=u' || cast(user_id as string) || 'x ' || event_type ||
           ' select FROM t' || cast(event_id%5 as string) || ' at 10.2.' || cast(event_id%200 as string) || '.9 ' end as raw_line
from events"""

# Oracle audit blocks of six lines, with ordinary lines between some of them and an unfinished one per 50
ORACLE_LOG = """
select e.event_id * 10 + n.i as line_no, 'ora.log' as source_file,
 case n.i
  when 0 then case when e.event_id % 4 = 0 then 'plain line user=w' || cast(e.user_id as string) || 'x' else '  ' end
  when 1 then 'ACTION : "' || upper(e.event_type) || '"'
  when 2 then 'DB USER : "U' || cast(e.user_id as string) || '"'
  when 3 then 'OBJ NAME : "T' || regexp_extract(e.props,'([0-9]+)',1) || '"'
  when 4 then 'TIMESTAMP : ' || substr(cast(e.ts as string),1,19)
  when 5 then 'SQL TEXT : SELECT CUST_NAME FROM CUSTOMERS WHERE ID=' || cast(e.event_id as string)
  when 6 then '  AND ROWNUM <= ' || cast(e.event_id % 2000 as string)
  else case when e.event_id % 50 = 7 then 'no code' else 'RETURNCODE: 0' end end as raw_line
from events e cross join (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4
 union all select 5 union all select 6 union all select 7) n"""

# PostgreSQL csvlog
PG_CSV_LOG = """
select event_id as line_no, 'pg.csv' as source_file,
 case when event_id % 9 = 8 then 'not csv' else
 substr(cast(ts as string),1,19) || '.123 UTC,"u' || cast(user_id as string) || '","custdb","app","10.3.' ||
 cast(event_id%200 as string) || '.4",1,"statement: SELECT name FROM members LIMIT ' || cast(event_id%3000 as string) || '",x' end as raw_line
from events"""

# lines with one planted value of every kind
PII_LOG = """
select event_id as line_no, 'pii.log' as source_file, event_type, event_id % 11 as kind,
 'name phone=' || case event_id % 11
  when 0 then '010-' || cast(1000+event_id%9000 as string) || '-' || cast(1000+(event_id*7)%9000 as string)
  when 1 then '계좌: ' || cast(20000000000 + event_id as string)
  when 2 then 'M' || cast(10000000 + event_id % 90000000 as string)
  when 3 then 'mail kim' || cast(event_id as string) || '@corp.co.kr'
  when 4 then '이름=' || case when event_id % 2 = 0 then '홍길동' else '개발팀' end
  when 5 then '서울시강남구 테헤란로 ' || cast(event_id as string)
  when 6 then 'emp_id=AB' || cast(100000 + event_id % 900000 as string)
  when 7 then 'badge c' || cast(100000 + event_id % 900000 as string)
  when 8 then 'birth=19' || cast(50 + event_id % 50 as string) || '-0' || cast(1 + event_id % 9 as string) || '-1' || cast(event_id % 10 as string)
  when 9 then 'host ' || cast(event_id % 300 as string) || '.1.2.' || cast(event_id % 256 as string)
  else 'fe80::' || cast(1 + event_id % 9000 as string) || ' end' end || ' ok' as raw_line
from events"""

# resident numbers: even lines carry the right check digit, odd ones a wrong one
_RRN_HEAD = """'8' || cast(event_id%10 as string) || '0' || cast(1+event_id%9 as string) || '1' || cast(event_id%10 as string)
 || cast(1+event_id%4 as string) || lpad(cast(event_id%100000 as string),5,'0')"""
_RRN_SUM = " + ".join(f"cast(substr(head,{i},1) as int)*{w}" for i, w in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], 1))
RRN_LOG = f"""
select line_no, 'rrn.log' as source_file, '주민 ' || substr(head,1,6) || '-' || substr(head,7,6) ||
 cast(((11 - total % 11) % 10 + line_no % 2) % 10 as string) || ' 확인' as raw_line
from (select line_no, head, {_RRN_SUM} as total
 from (select event_id as line_no, {_RRN_HEAD} as head from events) a) b"""

# the same instant in the layouts that a log may use
STAMP_LOG = """
select event_id as line_no, case event_id % 9
 when 0 then 'at ' || substr(cast(ts as string),1,19) || ' x'
 when 1 then substr(cast(ts as string),1,10) || 'T' || substr(cast(ts as string),12,8) || ' x'
 when 2 then substr(cast(ts as string),1,10) || 'T' || substr(cast(ts as string),12,8) || 'Z'
 when 3 then substr(cast(ts as string),1,19) || ',123 x'
 when 4 then 'h [' || substr(cast(ts as string),9,2) || '/Jan/2024:' || substr(cast(ts as string),12,8) || ' +0900]'
 when 5 then 'Jan ' || substr(cast(ts as string),9,2) || ' ' || substr(cast(ts as string),12,8) || ' host'
 when 6 then '2024/01/' || substr(cast(ts as string),9,2) || ' ' || substr(cast(ts as string),12,8)
 when 7 then '2024-13-01 00:00:00 then ' || substr(cast(ts as string),1,19)
 else substr(cast(ts as string),1,10) || 'T' || substr(cast(ts as string),12,8) || '.5Z' end as raw_line
from events"""

# statements with row limits in every dialect
LIMIT_LOG = """
select event_id as line_no, case event_id % 6
 when 0 then 'select a from t limit ' || cast(event_id % 2000 as string)
 when 1 then 'SELECT a FROM t WHERE ROWNUM <= ' || cast(event_id % 2000 as string)
 when 2 then 'SELECT a FROM t FETCH FIRST ' || cast(event_id % 2000 as string) || ' ROWS ONLY'
 when 3 then 'SELECT TOP ' || cast(event_id % 2000 as string) || ' a FROM t'
 when 4 then 'SELECT * FROM t' || cast(event_id % 7 as string) || ' ;'
 else 'SELECT * FROM t WHERE k = ' || cast(event_id as string) end as sql, event_id % 2000 as n, event_id % 6 as kind
from events"""

VIEWS = {
    "rrn_log": RRN_LOG,
    "stamp_log": STAMP_LOG,
    "limit_log": LIMIT_LOG,
    "access_log": ACCESS_LOG,
    "raw_log": RAW_LOG,
    "web_log": WEB_LOG,
    "mysql_log": MYSQL_LOG,
    "hangul_log": HANGUL_LOG,
    "app_log": APP_LOG,
    "free_log": FREE_LOG,
    "oracle_log": ORACLE_LOG,
    "pg_csv_log": PG_CSV_LOG,
    "pii_log": PII_LOG,
}


# Rows of a table that one task of text work takes. Splits follow the bytes of the packed table, row groups may be few, and a
# packed row is a tenth of the line made from it, so neither bounds a task.
TASK_ROWS = 50_000
KEYS = {"events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for text work, in tasks of bounded rows, on an input that comes in fewer splits than that takes, or in
    splits of which few hold all row groups.

    Rows are dealt by ``keys``, which must tell them apart, so that no task has to sort them first.
    """
    splits = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = splits.agg(F.sum("n"), F.max("n")).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // TASK_ROWS))
    uneven = (largest or 0) > 2 * -(-(rows or 0) // tasks)
    return df.repartition(tasks, *keys) if uneven or df._jdf.rdd().getNumPartitions() < tasks else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose whole texts are to be scanned."""
    return spread(table(spark, sf_dir, name), *KEYS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = table(spark, sf_dir, "events") if name == "access_log" else texts(spark, sf_dir, "events")
    rows = spark.sql(VIEWS[name].replace("from events", "from {events}"), events=source)
    # filters on a line must not make it again
    return rows.withColumn("raw_line", once(F.col("raw_line"))) if "raw_line" in rows.columns else rows


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views for the checker."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
