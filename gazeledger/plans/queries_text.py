"""Registered queries: parsing (P), text gates (F), personal data (D), SQL exposure (Q) on derived logs and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions import extract
from gazeledger.functions.pii_values import mask_by_type
from gazeledger.functions.timestamps import parse_timestamp
from gazeledger.operators import access, exposure, filters, parse, pii, risk
from gazeledger.operators.filters import has_number_shape, has_trigger_keyword
from gazeledger.params import AuditParams
from gazeledger.plans.queries_access import P, _us
from gazeledger.plans.queries_risk import R, _x100, summary_ctes
from gazeledger.plans.registry import query
from gazeledger.plans.views import table, texts, view, with_views
from gazeledger.session import materialise

SEC = "epoch_us(date_trunc('second', ts))"


def event_rows(df: DataFrame, *names: str) -> DataFrame:
    """Chosen event columns, time as microseconds."""
    cols = {"ts_us": _us().alias("ts_us")}
    return df.select(*[cols.get(n, F.col(n)) for n in ("line_no", *names)])


# --- parsers ------------------------------------------------------------------------


@query("parse_mysql", """select line_no, cast(null as bigint) as ts_us, user_id, 'QUERY' as action, target, query_text, thread from (
 select event_id as line_no, event_id % 16 < 8 as conn, 't' || cast(event_id%5 as varchar) as target, cast(event_id%8 as varchar) as thread,
  'SELECT id FROM t' || cast(event_id%5 as varchar) || ' WHERE k=' || cast(event_id as varchar) as query_text,
  last_value(case when event_id % 16 < 8 then 'u' || cast(user_id as varchar) end ignore nulls) over (
   partition by event_id % 8 order by event_id rows unbounded preceding) as user_id from events) where not conn""")
def parse_mysql(spark, sf):
    rows = parse.parse_mysql(view(spark, sf, "mysql_log"), P)
    return event_rows(rows.withColumn("thread", F.col("extra")["thread_id"]),
                      "ts_us", "user_id", "action", "target", "query_text", "thread")


@query("mysql_thread_user", """select user_id, count(*) as n from (
 select event_id % 16 < 8 as conn, last_value(case when event_id % 16 < 8 then 'u' || cast(user_id as varchar) end ignore nulls) over (
   partition by event_id % 8 order by event_id rows unbounded preceding) as user_id from events) where not conn group by 1""")
def mysql_thread_user(spark, sf):
    rows = parse.parse_db(view(spark, sf, "mysql_log"), P)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


ORACLE_EXPECTED = f"""select case when event_id % 50 = 7 then event_id + 1 else event_id end * 10 + 7 as line_no,
 {SEC} as ts_us, 'U' || cast(user_id as varchar) as user_id, upper(event_type) as action,
 'T' || regexp_extract(props,'([0-9]+)',1) as target,
 'SELECT CUST_NAME FROM CUSTOMERS WHERE ID=' || cast(event_id as varchar) || chr(10) || '  AND ROWNUM <= ' || cast(event_id%2000 as varchar) as query_text,
 event_id % 2000 >= 1000 as is_bulk
from events where event_id % 50 <> 8 and (event_id % 50 <> 7 or event_id + 1 in (select event_id from events))"""


@query("parse_oracle_blocks", ORACLE_EXPECTED)
def parse_oracle_blocks(spark, sf):
    rows = parse.parse_oracle(view(spark, sf, "oracle_log"), P)
    return event_rows(rows, "ts_us", "user_id", "action", "target", "query_text", "is_bulk")


@query("parse_oracle_mixed", """select 'block' as kind, count(*) as n from events
 where event_id % 50 <> 8 and (event_id % 50 <> 7 or event_id + 1 in (select event_id from events))
union all select 'plain', count(*) from events where event_id % 4 = 0 and event_id % 50 <> 8""")
def parse_oracle_mixed(spark, sf):
    rows = parse.parse_db(view(spark, sf, "oracle_log"), P)
    kind = F.when(F.col("extra")["db_type"] == "oracle", "block").otherwise("plain")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


RAW_SQL = """case event_type when 'click' then 'SELECT name, phone FROM customers WHERE id=' || cast(event_id as varchar)
 when 'view' then 'SELECT * FROM members WHERE id>0'
 when 'purchase' then 'SELECT id FROM orders WHERE phone=''010-1234-' || cast(1000+event_id%9000 as varchar) || ''''
 when 'signup' then 'INSERT INTO audit VALUES (''공일공-일이삼사-오육칠팔'')' else 'SELECT id FROM t LIMIT 5000' end
 || ' rows=' || cast(cast(floor(value*100) as bigint) as varchar)"""


@query("parse_postgres", f"""select event_id as line_no, {SEC} as ts_us, 'u' || cast(user_id as varchar) as user_id,
 cast(null as varchar) as ip_address, case when event_type = 'signup' then 'INSERT' else 'SELECT' end as action, 'custdb' as target,
 {RAW_SQL} as query_text, event_type = 'error' as is_bulk from events""")
def parse_postgres(spark, sf):
    rows = parse.parse_postgres(view(spark, sf, "raw_log"), P)
    return event_rows(rows, "ts_us", "user_id", "ip_address", "action", "target", "query_text", "is_bulk")


@query("parse_postgres_csv", f"""select event_id as line_no, {SEC} + 123000 as ts_us, 'u' || cast(user_id as varchar) as user_id,
 '10.3.' || cast(event_id%200 as varchar) || '.4' as ip_address, 'SELECT' as action, 'custdb' as target,
 'SELECT name FROM members LIMIT ' || cast(event_id%3000 as varchar) as query_text, event_id % 3000 >= 1000 as is_bulk
 from events where event_id % 9 <> 8""")
def parse_postgres_csv(spark, sf):
    rows = parse.parse_postgres_csv(view(spark, sf, "pg_csv_log"), P)
    return event_rows(rows, "ts_us", "user_id", "ip_address", "action", "target", "query_text", "is_bulk")


FREE_LINE = "event_id % 10 < 7"


@query("parse_db_generic", f"""select event_id as line_no, case when {FREE_LINE} then {SEC} end as ts_us,
 case when {FREE_LINE} then 'u' || cast(user_id as varchar) || 'x' end as user_id,
 case when {FREE_LINE} then '10.2.' || cast(event_id%200 as varchar) || '.9' end as ip_address,
 case when {FREE_LINE} then 'SELECT' end as action, case when {FREE_LINE} then 't' || cast(event_id%5 as varchar) end as target
 from events where event_id % 10 <> 8""")
def parse_db_generic(spark, sf):
    rows = parse.parse_db(view(spark, sf, "free_log"), P)
    return event_rows(rows, "ts_us", "user_id", "ip_address", "action", "target")


@query("parse_web", f"""select event_id as line_no, {SEC} as ts_us, 'u' || cast(user_id as varchar) as user_id,
 '10.0.' || cast(event_id%200 as varchar) || '.7' as ip_address, 'GET' as action, '/api/' || event_type as target,
 'GET /api/' || event_type || '?k=' || regexp_extract(props,'([0-9]+)',1) || ' k=' || regexp_extract(props,'([0-9]+)',1) as query_text,
 '200' as status from events""")
def parse_web(spark, sf):
    rows = parse.parse_web(view(spark, sf, "web_log"), P)
    return event_rows(rows.withColumn("status", F.col("extra")["status_code"]),
                      "ts_us", "user_id", "ip_address", "action", "target", "query_text", "status")


APP_USER = "'u' || cast(user_id as varchar) || 'x'"
APP_PARTS = {
    "parse_log4j": (0, f"""cast(null as bigint) as ts_us, {APP_USER} as user_id, '10.1.2.' || cast(event_id%250 as varchar) as ip_address,
 'QUERY' as action, cast(null as varchar) as target, 'WARN' as level, 'com.shop.Svc' as place"""),
    "parse_pylog": (1, f"""{SEC} + 1000 as ts_us, {APP_USER} as user_id, cast(null as varchar) as ip_address, 'UPDATE' as action,
 cast(null as varchar) as target, 'WARNING' as level, 'auth.svc' as place"""),
    "parse_syslog": (2, f"""{SEC} as ts_us, {APP_USER} as user_id, '10.9.8.7' as ip_address, 'LOGIN' as action,
 'host' || cast(event_id%3 as varchar) as target, cast(null as varchar) as level, 'sshd' as place"""),
}
APP_FIELDS = ("ts_us", "user_id", "ip_address", "action", "target", "level", "place")


def _app(spark, sf):
    extra = F.col("extra")
    return parse.parse_app(view(spark, sf, "app_log"), P).withColumns({
        "level": extra["level"],
        "place": F.coalesce(extra["logger"], extra["module"], extra["process"]),
    })


def _app_part(name: str) -> None:
    rest, fields = APP_PARTS[name]
    mark = {"parse_log4j": "logger", "parse_pylog": "module", "parse_syslog": "process"}[name]

    @query(name, f"select event_id as line_no, {fields} from events where event_id % 6 = {rest}")
    def run(spark, sf):
        return event_rows(_app(spark, sf).where(F.col("extra")[mark].isNotNull()), *APP_FIELDS)


for _name in APP_PARTS:
    _app_part(_name)


@query("parse_app", f"""select event_id as line_no, case event_id % 6 when 1 then {SEC} + 1000 when 2 then {SEC} when 3 then {SEC} end as ts_us,
 {APP_USER} as user_id, case event_id % 6 when 0 then 'QUERY' when 1 then 'UPDATE' when 2 then 'LOGIN' when 3 then 'DELETE' end as action
 from events where event_id % 6 <> 5""")
def parse_app(spark, sf):
    return event_rows(_app(spark, sf), "ts_us", "user_id", "action")


@query("parse_generic", f"""select event_id as line_no, case when {FREE_LINE} then {SEC} end as ts_us,
 case when {FREE_LINE} then {APP_USER} end as user_id,
 case when {FREE_LINE} then '10.2.' || cast(event_id%200 as varchar) || '.9' end as ip_address,
 case when {FREE_LINE} then 'SELECT' end as action,
 case when {FREE_LINE} then '[' || substr(cast(ts as varchar),1,19) || '] user=' || {APP_USER} || ' ' || event_type ||
  ' select FROM t' || cast(event_id%5 as varchar) || ' at 10.2.' || cast(event_id%200 as varchar) || '.9'
  else '접근 ' || cast(event_id as varchar) || ' memo' end as query_text
 from events where event_id % 10 not in (8, 9)""")
def parse_generic(spark, sf):
    rows = parse.parse_generic(view(spark, sf, "free_log"), P)
    return event_rows(rows, "ts_us", "user_id", "ip_address", "action", "query_text")


LOGS = ("raw_log", "web_log", "mysql_log", "oracle_log", "app_log", "free_log", "pg_csv_log")
LOG_COLS = "line_no, source_file, raw_line"


def _all_logs(spark, sf):
    return reduce(DataFrame.unionByName, [view(spark, sf, n).select("line_no", "source_file", "raw_line") for n in LOGS])


def _detect_sql() -> str:
    union = " union all ".join(f"select {LOG_COLS} from {n}" for n in LOGS)
    quote = lambda t: t.replace("'", "''")
    scores = ", ".join(
        f"avg(case when regexp_matches(raw_line, '(?im){quote(p)}') then 1.0 else 0.0 end) * {w} as s{i}"
        for i, (_, p, w, _) in enumerate(C.FORMAT_SIGNATURES))
    best = f"greatest({', '.join(f's{i}' for i in range(len(C.FORMAT_SIGNATURES)))})"
    pick = " ".join(
        f"when s{i} = {best} then '{'generic' if f == 'generic' else n}'" for i, (n, _, _, f) in enumerate(C.FORMAT_SIGNATURES))
    family = " ".join(f"when s{i} = {best} then '{f}'" for i, (_, _, _, f) in enumerate(C.FORMAT_SIGNATURES))
    return f"""{with_views(*LOGS)}, lines as ({union}),
first as (select * from (select *, row_number() over (partition by source_file order by line_no) as rn from lines where trim(raw_line) <> '') where rn <= 100),
scored as (select source_file, {scores} from first group by 1)
select source_file, case when {best} = 0 then 'generic' {pick} end as format, case when {best} = 0 then 'generic' {family} end as family,
 cast(floor({best} * 1000 + 0.5) as bigint) as score_x1000 from scored"""


@query("format_detect", _detect_sql())
def format_detect(spark, sf):
    """The rule that looks at the first hundred lines of a file."""
    found = parse.detect_format(_all_logs(spark, sf), 100)
    return found.select("source_file", "format", "family", F.floor(F.col("score") * 1000 + 0.5).cast("bigint").alias("score_x1000"))


@query("format_detect_whole", _detect_sql().replace("where rn <= 100", ""))
def format_detect_whole(spark, sf):
    found = parse.detect_format(_all_logs(spark, sf))
    return found.select("source_file", "format", "family", F.floor(F.col("score") * 1000 + 0.5).cast("bigint").alias("score_x1000"))


@query("parse_auto", """select 'pg.log' as source_file, count(*) as n from events union all select 'web.log', count(*) from events
union all select 'my.log', count(*) from events where event_id % 16 >= 8
union all select 'app.log', count(*) from events where event_id % 6 <> 5
union all select 'free.txt', count(*) from events where event_id % 10 not in (8, 9)
union all select 'pg.csv', count(*) from events
union all select 'ora.log', count(*) from events where event_id % 50 <> 8 and (event_id % 50 <> 7 or event_id + 1 in (select event_id from events)) having count(*) > 0
""".replace("union all select 'ora.log', count(*)", "union all select 'ora.log', count(*) + (select count(*) from events where event_id % 4 = 0 and event_id % 50 <> 8)"))
def parse_auto(spark, sf):
    return parse.parse(_all_logs(spark, sf), P).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query("skip_lines", """select count(*) as total_lines, count(*) filter (where event_id % 6 <> 5) as total_events,
 count(*) filter (where event_id % 6 = 5) as skipped_lines from events""")
def skip_lines(spark, sf):
    lines = view(spark, sf, "app_log")
    return parse.parse_counts(lines, parse.parse_app(lines, P))


@query("run_metrics", """select count(*) as total_lines, count(*) filter (where event_id % 10 not in (8, 9)) as total_events,
 count(*) filter (where event_id % 10 in (8, 9)) as skipped_lines from events""")
def run_metrics(spark, sf):
    lines = view(spark, sf, "free_log")
    return parse.parse_counts(lines, parse.parse_generic(lines, P))


# --- field extraction -----------------------------------------------------------------


@query("extract_user_id", f"""select event_id as line_no, case when event_id % 6 <> 5 then {APP_USER} end as user_id from events""")
def extract_user_id(spark, sf):
    return view(spark, sf, "app_log").select("line_no", extract.user_id(F.col("raw_line")).alias("user_id"))


@query("extract_ip", r"""select doc_id, nullif(regexp_extract(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), '') as ip from documents""")
def extract_ip(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", extract.ip_address(F.col("text")).alias("ip"))


@query("extract_action", f"""select doc_id, upper(nullif(regexp_extract(text, '(?i){C.ACTION_PATTERN}', 1), '')) as action from documents""")
def extract_action(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", extract.action(F.col("text")).alias("action"))


@query("extract_table", f"""{with_views('raw_log')} select line_no,
 nullif(regexp_extract(raw_line, '(?i){C.TABLE_PATTERN}', 1), '') as tbl from raw_log""")
def extract_table(spark, sf):
    return view(spark, sf, "raw_log").select("line_no", extract.table_name(F.col("raw_line")).alias("tbl"))


@query("parse_timestamp", f"""select event_id as line_no, case when event_id % 9 in (3, 8) then null else {SEC} end as ts_us from events""")
def timestamps(spark, sf):
    rows = view(spark, sf, "stamp_log").withColumn("ts", parse_timestamp(F.col("raw_line"), 2024))
    return rows.select("line_no", _us().alias("ts_us"))


@query("parse_timestamp_lenient", f"""select event_id as line_no, {SEC} + case event_id % 9 when 3 then 123000 when 8 then 500000 else 0 end as ts_us from events""")
def timestamps_lenient(spark, sf):
    rows = view(spark, sf, "stamp_log").withColumn("ts", parse_timestamp(F.col("raw_line"), 2024, "lenient"))
    return rows.select("line_no", _us().alias("ts_us"))


@query("query_fingerprint", rf"""select 'u' || cast(user_id as varchar) as user_id,
 substr(md5(upper(trim(regexp_replace(regexp_replace(regexp_replace(sql, '''[^'']*''', '?', 'g'), '\b\d+\b', '?', 'g'), '\s+', ' ', 'g')))),1,12) as fingerprint,
 count(*) as n from (select user_id, {RAW_SQL} as sql from events) group by 1, 2""")
def query_fingerprint(spark, sf):
    rows = parse.parse_postgres(view(spark, sf, "raw_log"), P)
    return rows.groupBy("user_id", extract.query_fingerprint(F.col("query_text")).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("n"))


@query("bulk_flag", f"""{with_views('limit_log')} select line_no, case when kind < 4 then n >= 1000 else kind = 4 end as is_bulk from limit_log""")
def bulk_flag(spark, sf):
    return view(spark, sf, "limit_log").select("line_no", extract.bulk_flag(F.col("sql"), 1000).alias("is_bulk"))


# --- text gates -----------------------------------------------------------------------

_WORDS = "|".join(C.TRIGGER_KEYWORDS)


@query("quick_filter", f"select doc_id, regexp_matches(lower(text), '{_WORDS}') as passes from documents")
def quick_filter(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", has_trigger_keyword(F.col("text")).alias("passes"))


_SHAPES_SQL = (
    r"\b0(?:1[016-9]|2|[3-9]\d)[ \t]{0,2}-?[ \t]{0,2}\d{3,4}[ \t]{0,2}-?[ \t]{0,2}\d{4}\b"
    r"|(?:^|[^0-9])\d{6}[ \t]{0,2}-?[ \t]{0,2}[1-9]\d{6}(?:$|[^0-9])"
    r"|\b(?:\d{4}[-\s]?){3}\d{4}\b"
    r"|(?:^|[^0-9])(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)(?:$|[^0-9])"
)


@query("number_gate", f"select doc_id, regexp_matches(text, '{_SHAPES_SQL}') as passes from documents")
def number_gate(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", has_number_shape(F.col("text")).alias("passes"))


# --- personal data --------------------------------------------------------------------


def _hits(spark, sf, name, pii_type):
    return pii.hits_of_type(view(spark, sf, name), pii_type, "raw_line", ["line_no"]).select("line_no", "value", "masked")


@query("pii_rrn", f"""{with_views('rrn_log')} select line_no, substr(raw_line, 4, 14) as value, substr(raw_line, 4, 2) || '****-*******' as masked
 from rrn_log where line_no % 2 = 0""")
def pii_rrn(spark, sf):
    return _hits(spark, sf, "rrn_log", "RRN")


def _planted(kind: int, value: str, masked: str, where: str = "true") -> str:
    return f"select event_id as line_no, {value} as value, {masked} as masked from events where event_id % 11 = {kind} and {where}"


E = "cast({0} as varchar)".format
PHONE = f"'010-' || {E('1000+event_id%9000')} || '-' || {E('1000+(event_id*7)%9000')}"
ACCOUNT = E("20000000000 + event_id")
PASSPORT = f"'M' || {E('10000000 + event_id % 90000000')}"
MAIL = f"'kim' || {E('event_id')} || '@corp.co.kr'"
EMP_KEY = f"'AB' || {E('100000 + event_id % 900000')}"
EMP_ONE = f"'c' || {E('100000 + event_id % 900000')}"
BIRTH = f"'19' || {E('50 + event_id % 50')} || '-0' || {E('1 + event_id % 9')} || '-1' || {E('event_id % 10')}"
IP = f"{E('event_id % 300')} || '.1.2.' || {E('event_id % 256')}"
ADDRESS = f"'서울시강남구 테헤란로 ' || {E('event_id')}"
PLANTED = {
    "pii_phone": ("PHONE", 0, PHONE, f"'010-****-' || {E('1000+(event_id*7)%9000')}", "true"),
    "pii_account": ("ACCOUNT_NO", 1, ACCOUNT, f"substr({ACCOUNT},1,3) || '*****' || substr({ACCOUNT},9,3)", "true"),
    "pii_passport": ("PASSPORT", 2, PASSPORT, f"substr({PASSPORT},1,2) || '*****' || substr({PASSPORT},8,2)", "true"),
    "pii_email_planted": ("EMAIL", 3, MAIL, f"'ki' || repeat('*', length({E('event_id')}) + 1) || '@corp.co.kr'", "true"),
    "pii_name": ("NAME_IN_QUERY", 4, "'홍길동'", "'홍**'", "event_id % 2 = 0"),
    "pii_address": ("ADDRESS", 5, ADDRESS,
                    f"'서울' || repeat('*', length({ADDRESS}) - 4) || right({ADDRESS}, 2)", "true"),
    "pii_emp_keyword": ("EMP_ID_IN_QUERY", 6, EMP_KEY, f"'A******' || right({EMP_KEY}, 1)", "true"),
    "pii_emp_standalone": ("EMP_ID_STANDALONE", 7, EMP_ONE, f"'c*****' || right({EMP_ONE}, 1)", "true"),
    "pii_birthdate": ("BIRTHDATE", 8, BIRTH, f"'19' || {E('50 + event_id % 50')} || '-**-**'", "true"),
    "pii_ip_planted": ("IP_ADDRESS", 9, IP, f"{E('event_id % 300')} || '.1.2.' || repeat('*', length({E('event_id % 256')}))",
                       "event_id % 300 not in (0, 127, 255) and event_id % 300 <= 255"),
}


def _planted_hits(spark, sf, name: str, pii_type: str):
    hits = _hits(spark, sf, "pii_log", pii_type)
    return hits.where(~F.col("value").contains("::")) if name == "pii_ip_planted" else hits  # pii_ipv6 has the others


def _planted_query(name: str) -> None:
    pii_type, kind, value, masked, where = PLANTED[name]

    @query(name, _planted(kind, value, masked, where))
    def run(spark, sf):
        return _planted_hits(spark, sf, name, pii_type)


for _name in PLANTED:
    _planted_query(_name)


@query("pii_ipv6", f"select event_id as line_no, 'fe80::' || {E('1 + event_id % 9000')} as value, 'fe80::****:****' as masked from events where event_id % 11 = 10")
def pii_ipv6(spark, sf):
    return _hits(spark, sf, "pii_log", "IP_ADDRESS").where(F.col("value").contains(":"))


LUHN_SQL = " + ".join(
    f"(case when {i % 2} = 0 then (case when d[{i + 1}] > 4 then d[{i + 1}] * 2 - 9 else d[{i + 1}] * 2 end) else d[{i + 1}] end)" for i in range(16))


@query("pii_card", rf"""WITH c as (select doc_id, unnest(regexp_extract_all(text, '\b(?:\d{{4}}[-\s]?){{3}}\d{{4}}\b')) as value from documents),
v as (select doc_id, value, list_transform(string_split(regexp_replace(value, '[-\s]', '', 'g'), ''), lambda x: cast(x as integer)) as d from c)
select doc_id, value, count(*) as n from v where ({LUHN_SQL}) % 10 = 0 group by 1, 2""")
def pii_card(spark, sf):
    hits = pii.hits_of_type(texts(spark, sf, "documents"), "CREDIT_CARD", "text", ["doc_id"])
    return hits.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("pii_email", r"""select doc_id, value, count(*) as n from (
 select doc_id, unnest(regexp_extract_all(text, '(?i)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b')) as value from documents) group by 1, 2""")
def pii_email(spark, sf):
    hits = pii.hits_of_type(texts(spark, sf, "documents"), "EMAIL", "text", ["doc_id"])
    return hits.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


# IPv4: digit groups that are no octet are blanked in every dotted run, then four in a row are taken
IPV4_SQL = r"""WITH runs as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)+')) as run from documents),
clean as (select doc_id, array_to_string(list_transform(string_split(run, '.'),
  lambda g: case when regexp_full_match(g, '25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9]') then g else 'x' end), '.') as run from runs),
ips as (select doc_id, unnest(regexp_extract_all(run, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) as value from clean)
select doc_id, value, count(*) as n from ips
where not regexp_matches(value, '^(127|0|255)\.') and not regexp_matches(value, '^169\.254\.') group by 1, 2"""


@query("pii_ip", IPV4_SQL)
def pii_ip(spark, sf):
    hits = pii.hits_of_type(texts(spark, sf, "documents"), "IP_ADDRESS", "text", ["doc_id"])
    return hits.where(~F.col("value").contains(":")).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("hangul_digits", f"select event_id as line_no, 'call 010-' || {E('1000+event_id%9000')} || '-' || {E('1000+(event_id*7)%9000')} as plain from events")
def hangul_digits(spark, sf):
    return view(spark, sf, "hangul_log").select("line_no", pii.spoken_digits(F.col("raw_line")).alias("plain"))


def _scan_sql() -> str:
    parts = [
        f"select event_id as line_no, '{t}' as pii_type, {v} as original_value, {m} as redacted_value from events where event_id % 11 = {k} and {w}"
        for t, k, v, m, w in PLANTED.values()]
    parts.append(f"select event_id, 'IP_ADDRESS', 'fe80::' || {E('1 + event_id % 9000')}, 'fe80::****:****' from events where event_id % 11 = 10")
    return " union all ".join(parts)


@query("overlap_resolve", _scan_sql())
def overlap_resolve(spark, sf):
    scanned = pii.scan_pii(view(spark, sf, "pii_log"), "raw_line")
    return scanned.select("line_no", F.inline("pii_hits")).select("line_no", "pii_type", "original_value", "redacted_value")


@query("dual_scan_dedup", f"""{with_views('hangul_log')} select line_no, 'PHONE' as pii_type, {PHONE.replace('event_id', 'line_no')} as original_value,
 cast(length(raw_line) + length(' client ') as bigint) as match_start from hangul_log""")
def dual_scan_dedup(spark, sf):
    """Spoken and written form of one number on one line: a single hit."""
    lines = view(spark, sf, "hangul_log")
    both = lines.withColumn("raw_line", F.concat("raw_line", F.lit(" client "), F.substring(pii.spoken_digits(F.col("raw_line")), 6, 13)))
    hits = pii.scan_pii(both, "raw_line").select("line_no", F.inline("pii_hits"))
    # the written form is met first, in the text as it stands
    return hits.select("line_no", "pii_type", "original_value", F.col("match_start").cast("bigint").alias("match_start"))


@query("mask_value", f"""select pii_type, redacted_value, count(*) as n from ({_scan_sql()}) group by 1, 2""")
def mask_values(spark, sf):
    hits = pii.scan_pii(view(spark, sf, "pii_log"), "raw_line").select(F.inline("pii_hits"))
    return hits.groupBy("pii_type", mask_by_type(F.col("original_value"), F.col("pii_type")).alias("redacted_value")).agg(
        F.count(F.lit(1)).alias("n"))


@query("pii_scan_documents")
def pii_scan_documents(spark, sf):
    """Hits per document and type over the whole texts."""
    scanned = pii.scan_pii(texts(spark, sf, "documents"), "text")
    hits = scanned.select("doc_id", F.inline("pii_hits"))
    return hits.groupBy("doc_id", "pii_type").agg(F.count(F.lit(1)).alias("hits"), F.min("match_start").alias("first_start"))


@query("pii_scan_pages")
def pii_scan_pages(spark, sf):
    hits = pii.scan_pii(texts(spark, sf, "pages"), "html").select("page_id", F.inline("pii_hits"))
    return hits.groupBy("pii_type").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("page_id").alias("pages"))


@query("pii_scan_conversations")
def pii_scan_conversations(spark, sf):
    hits = pii.scan_pii(texts(spark, sf, "conversations"), "text").select("conv_id", F.inline("pii_hits"))
    return hits.groupBy("pii_type").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("conv_id").alias("conversations"))


# --- the PostgreSQL log end to end ------------------------------------------------------


def raw_events(spark, sf, params: AuditParams = R) -> DataFrame:
    """Parsed, scanned and estimated events of the PostgreSQL log."""
    events = parse.parse_postgres(view(spark, sf, "raw_log"), params)
    return exposure.estimate_exposure(pii.scan_pii(events))


RAW_PHONE = f"case event_type when 'purchase' then '010-1234-' || {E('1000+event_id%9000')} else '010-1234-5678' end"
RAW_PII = "event_type in ('purchase', 'signup')"
# where the match starts in the statement, as written or with its spoken digits rewritten
RAW_START = "case event_type when 'purchase' then length('SELECT id FROM orders WHERE phone=''') else length('INSERT INTO audit VALUES (''') end"


@query("pii_findings", f"""select substr(sha256('pg.log' || {E('event_id')} || 'PHONE' || cast({RAW_START} as varchar)),1,12) as finding_id,
 'u' || cast(user_id as varchar) as user_id, {SEC} as ts_us, 'HIGH' as severity, {RAW_PHONE} as original_value,
 'pg.log:' || {E('event_id')} as raw_reference, cast(7 as bigint) as score from events where {RAW_PII}""")
def pii_findings(spark, sf):
    rows = pii.pii_findings(raw_events(spark, sf), R)
    return rows.select(
        "finding_id", "user_id", _us().alias("ts_us"), "severity", F.col("details.original_value").alias("original_value"),
        "raw_reference", F.col("score").cast("bigint").alias("score"))


@query("evidence_snippet", f"""select event_id as line_no,
 substr(sql, 1, {RAW_START}) || '[PHONE:' || {RAW_PHONE} || ']' || substr(sql, {RAW_START} + 14) as evidence
 from (select *, {RAW_SQL} as sql from events) where {RAW_PII}""")
def evidence_snippet(spark, sf):
    rows = pii.pii_findings(raw_events(spark, sf), R)
    return rows.select(F.element_at(F.split("raw_reference", ":"), -1).cast("bigint").alias("line_no"), "evidence")


@query("severity_escalate", f"""{with_views('access_log')} select line_no,
 case when effective_exposure >= 20000 then 'CRITICAL' when effective_exposure >= 5000 then 'HIGH' else 'MEDIUM' end as severity from access_log""")
def severity_escalate(spark, sf):
    return view(spark, sf, "access_log").select(
        "line_no", pii.escalated_severity(F.lit("MEDIUM"), F.col("effective_exposure"), R).alias("severity"))


@query("severity_score", """select event_type, cast(case event_type when 'view' then 10 when 'click' then 7 when 'purchase' then 4 when 'signup' then 1 else 0 end as bigint) as score,
 count(*) as n from events group by 1, 2""")
def severity_score(spark, sf):
    level = (
        F.when(F.col("event_type") == "view", "CRITICAL").when(F.col("event_type") == "click", "HIGH")
        .when(F.col("event_type") == "purchase", "MEDIUM").when(F.col("event_type") == "signup", "LOW").otherwise("NONE"))
    return table(spark, sf, "events").groupBy(
        "event_type", pii.severity_score(level).cast("bigint").alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("pii_types_per_user", f"select 'u' || cast(user_id as varchar) as user_id, 'PHONE' as pii_types from events where {RAW_PII} group by 1")
def pii_types_per_user(spark, sf):
    rows = pii.pii_types_per_user(raw_events(spark, sf))
    return rows.select("user_id", F.array_join("pii_types", ",").alias("pii_types"))


@query("event_max_severity", f"select event_id as line_no, {RAW_PII} as has_pii, case when {RAW_PII} then 'HIGH' end as max_severity from events")
def event_max_severity(spark, sf):
    return raw_events(spark, sf).select(
        "line_no", (F.size("pii_hits") > 0).alias("has_pii"), pii.event_severity(F.col("pii_hits")).alias("max_severity"))


@query("pii_type_users", f"select 'PHONE' as pii_type, count(distinct user_id) as users from events where {RAW_PII}")
def pii_type_users(spark, sf):
    return risk.pii_type_users(pii.pii_types_per_user(raw_events(spark, sf)))


# --- SQL exposure -----------------------------------------------------------------------


def sql_log(spark, sf) -> DataFrame:
    return parse.parse_postgres(view(spark, sf, "raw_log"), P)


ROWS = "cast(floor(value*100) as bigint)"
COUNT = "case event_type when 'view' then 5 when 'click' then 2 else 0 end"


@query("select_star", "select event_id as line_no, event_type = 'view' as star from events")
def select_star(spark, sf):
    return sql_log(spark, sf).select("line_no", exposure.select_star(F.col("query_text")).alias("star"))


@query("sensitive_table", "select event_id as line_no, event_type in ('view', 'click') as sensitive from events")
def sensitive_table(spark, sf):
    return sql_log(spark, sf).select("line_no", exposure.sensitive_table(F.col("query_text")).alias("sensitive"))


@query("select_list", """select event_id as line_no, 'name, max), ' || event_type as items from events""")
def select_list(spark, sf):
    """Select lists with nested brackets built around the event type."""
    sql = F.concat(F.lit("SELECT name, max(a, (b)), "), F.col("event_type"), F.lit(" FROM t"))
    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), exposure.select_list(sql).alias("items"))


@query("where_clause", f"""select event_id as line_no, case event_type when 'click' then 'id=' || {E('event_id')} || ' rows=' || cast({ROWS} as varchar)
 when 'view' then 'id>0 rows=' || cast({ROWS} as varchar)
 when 'purchase' then 'phone=''010-1234-' || {E('1000+event_id%9000')} || ''' rows=' || cast({ROWS} as varchar) else '' end as clause from events""")
def where_clause(spark, sf):
    return sql_log(spark, sf).select("line_no", exposure.where_clause(F.col("query_text")).alias("clause"))


@query("pii_columns", f"""select event_id as line_no, case event_type when 'click' then 'name,phone' else '' end as select_fields,
 case event_type when 'purchase' then 'phone=''010-1234-' || {E('1000+event_id%9000')} || ''' rows=' || cast({ROWS} as varchar) else '' end as where_fields from events""")
def pii_columns(spark, sf):
    rows = exposure.estimate_exposure(sql_log(spark, sf))
    return rows.select("line_no", F.array_join("pii_select_fields", ",").alias("select_fields"),
                       F.array_join("pii_where_fields", ",").alias("where_fields"))


@query("result_rows", f"select event_id as line_no, {ROWS} as n from events")
def result_rows(spark, sf):
    return sql_log(spark, sf).select("line_no", exposure.result_rows(F.concat_ws(" ", "raw_line", "query_text")).alias("n"))


@query("pii_select_count", f"select event_id as line_no, cast({COUNT} as bigint) as n, event_type in ('view', 'click') as has_select_pii from events")
def pii_select_count(spark, sf):
    rows = exposure.estimate_exposure(sql_log(spark, sf))
    return rows.select("line_no", F.col("pii_select_count").cast("bigint").alias("n"),
                       exposure.has_select_pii(F.col("is_select_star"), F.col("pii_select_fields")).alias("has_select_pii"))


@query("exposure_type", """select event_id as line_no, case event_type when 'view' then 'FULL_EXPOSURE' when 'click' then 'PARTIAL_EXPOSURE'
 when 'purchase' then 'SEARCH_ONLY' else 'NONE' end as exposure_type from events""")
def exposure_type(spark, sf):
    return exposure.estimate_exposure(sql_log(spark, sf)).select("line_no", "exposure_type")


@query("effective_exposure", f"select event_id as line_no, case when {COUNT} > 0 then {ROWS} * {COUNT} end as effective_exposure from events")
def effective_exposure(spark, sf):
    return exposure.estimate_exposure(sql_log(spark, sf)).select("line_no", "effective_exposure")


@query("event_exposure_display", f"""select event_id as line_no, case when event_type in ('view', 'click') then format('{{:,}}', {ROWS} * {COUNT}) || '건'
 when event_type = 'purchase' then '검색조건(phone=''010-1234-' || {E('1000+event_id%9000')} || ''' rows=' || cast({ROWS} as varchar) || ')' else '검색조건(-)' end as shown,
 case when event_type in ('view', 'click') then '노출 필드 ' || cast({COUNT} as varchar) || '개 × ' || format('{{:,}}', {ROWS}) || '건 = ' || format('{{:,}}', {ROWS} * {COUNT}) || '건'
  else '노출 필드 0개 (건수 미상)' end as summary from events""")
def event_exposure_display(spark, sf):
    rows = exposure.estimate_exposure(sql_log(spark, sf))
    return rows.select(
        "line_no",
        exposure.event_exposure_display(
            F.col("exposure_type"), F.col("pii_where_fields"), F.col("pii_select_count"), F.col("effective_exposure")).alias("shown"),
        exposure.exposure_summary(F.col("pii_select_count"), F.col("result_row_count"), F.col("effective_exposure")).alias("summary"),
    )


@query("exposure_rollup_sql", f"""select 'u' || cast(user_id as varchar) as user_id,
 cast(coalesce(sum({ROWS} * {COUNT}) filter (where {COUNT} > 0), 0) as bigint) as total_pii_records_exposed,
 coalesce(max({ROWS} * {COUNT}) filter (where {COUNT} > 0), 0) as max_single_query_exposure,
 cast(0 as bigint) as unknown_exposure_query_count, count(*) filter (where {COUNT} > 0) as select_pii_query_count,
 count(*) filter (where event_type = 'purchase') as search_only_query_count from events group by 1""")
def exposure_rollup_sql(spark, sf):
    return exposure.exposure_rollup(exposure.estimate_exposure(sql_log(spark, sf)))


# --- flagship ---------------------------------------------------------------------------

# the PostgreSQL log as the structured events it must parse into
RAW_AS_ACCESS = f"""select event_id as line_no, 'pg.log' as source_file, date_trunc('second', ts) as ts, 'u' || cast(user_id as varchar) as user_id,
 'custdb' as target, {RAW_PII} as has_pii, event_type = 'error' as is_bulk,
 case event_type when 'view' then 'FULL_EXPOSURE' when 'click' then 'PARTIAL_EXPOSURE' when 'purchase' then 'SEARCH_ONLY' else 'NONE' end as exposure_type,
 {ROWS} as result_row_count, case when {COUNT} > 0 then {ROWS} * {COUNT} end as effective_exposure from events"""


@query("risk_table", f"""WITH access_log AS ({RAW_AS_ACCESS}), {summary_ctes(R)}
select user_id, total_events, pii_event_count, total_pii_records_exposed, max_single_query_exposure, max_queries_per_hour, max_queries_per_day,
 peak_hour, peak_day, after_hours_count, bulk_export_count, flagged_event_count, critical_finding_count, high_finding_count,
 cast(floor(risk_score * 100 + 0.5) as bigint) as risk_score_x100, risk_level from summary""")
def risk_table(spark, sf):
    """Lines to ranked users: parse, scan, estimate, count, raise findings, score."""
    events = materialise(raw_events(spark, sf).drop("raw_line"), "events")
    events = events.withColumn("raw_line", F.col("query_text"))
    seen = filters.counter_eligible(events).select(
        "user_id", "ts", "source_file", "line_no", "target", (F.size("pii_hits") > 0).alias("has_pii"), "is_bulk",
        "effective_exposure", "result_row_count", "pii_select_fields", "pii_select_count", "is_select_star")
    found = pii.pii_findings(events, R).unionByName(access.access_findings(seen, R, surge=False))
    users = risk.user_summary(events, found, access.user_access_stats(seen, R), R)
    return risk.rank_users(users).select(
        "user_id", "total_events", "pii_event_count", "total_pii_records_exposed", "max_single_query_exposure",
        "max_queries_per_hour", "max_queries_per_day", "peak_hour", "peak_day", "after_hours_count", "bulk_export_count",
        "flagged_event_count", "critical_finding_count", "high_finding_count", _x100("risk_score"), "risk_level")
