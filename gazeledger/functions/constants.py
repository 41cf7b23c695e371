"""Fixed values shared by the operators: patterns, word lists, labels."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Personal-data patterns, in priority order.
# (type, pattern, severity, value is group 1)
# ---------------------------------------------------------------------------
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)"

PII_RULES: list[tuple[str, str, str, bool]] = [
    ("RRN", r"(?<!\d)\d{6}[ \t]{0,2}-?[ \t]{0,2}[1-9]\d{6}(?!\d)", "CRITICAL", False),
    (
        "PHONE",
        r"\b0(?:1[016-9]|2|[3-9]\d)[ \t]{0,2}-?[ \t]{0,2}\d{3,4}[ \t]{0,2}-?[ \t]{0,2}\d{4}\b",
        "HIGH",
        False,
    ),
    (
        "ACCOUNT_NO",
        r"(?:계좌|account|acct|bankno|bank_no|account_no)[^\d]{0,15}(\d{10,14})",
        "CRITICAL",
        True,
    ),
    ("CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "CRITICAL", False),
    ("PASSPORT", r"\b[A-Z][A-Z0-9]\d{7}\b", "HIGH", False),
    ("EMAIL", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", "MEDIUM", False),
    (
        "NAME_IN_QUERY",
        r"(?:name|이름|성명|고객명|사용자명|담당자명?|접속자명?|수검자명?|"
        r"cust_name|customer_name|user_name|username|realname)\s*[=:,]\s*['\"]?([가-힣]{2,4})['\"]?",
        "HIGH",
        True,
    ),
    (
        "ADDRESS",
        r"[가-힣]{2,6}(?:시|도|군|구)\s*[가-힣]{2,6}(?:동|읍|면|로|길)\s*\d+",
        "MEDIUM",
        False,
    ),
    (
        "EMP_ID_IN_QUERY",
        r"(?:emp_id|사원번호|사번|employee_id|직원번호|empno|emp_no|"
        r"사원\s*id|staff_id|staff_no|사원코드|직원코드|empid|user_id|userid)"
        r"\s*[=:\s,]\s*['\"]?([A-Za-z]{0,3}[-]?\d{4,10})['\"]?",
        "MEDIUM",
        True,
    ),
    ("EMP_ID_STANDALONE", r"\b([A-Za-z]\d{6})\b", "MEDIUM", True),
    (
        "BIRTHDATE",
        r"(?:birth|생년월일|dob|birthday)\s*[=:'\"\s]+(\d{4}[-./]\d{2}[-./]\d{2}|\d{8})",
        "HIGH",
        True,
    ),
    (
        "IP_ADDRESS",
        r"(?<!\d)(?:"
        + _OCTET + r"(?:\." + _OCTET + r"){3}"
        + r"|(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}"
        + r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
        + r")(?!\d)",
        "LOW",
        False,
    ),
]

# Second-chance gate for free-form lines: phone, resident, card or IPv4 shape.
NUMBER_SHAPES = (
    r"\b0(?:1[016-9]|2|[3-9]\d)[ \t]{0,2}-?[ \t]{0,2}\d{3,4}[ \t]{0,2}-?[ \t]{0,2}\d{4}\b"
    r"|(?<!\d)\d{6}[ \t]{0,2}-?[ \t]{0,2}[1-9]\d{6}(?!\d)"
    r"|\b(?:\d{4}[-\s]?){3}\d{4}\b"
    r"|(?<!\d)(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\d)"
)

# Keywords that let a line into the scan.
TRIGGER_KEYWORDS = [
    "select", "query", "insert", "update", "where", "name", "phone", "이름", "전화", "주민", "계좌", "주소", "address",
    "ssn", "rrn", "birth", "생년", "고객", "customer", "account", "acct", "card", "email", "passport", "여권", "사원번호",
    "empno", "cust", "member", "회원", "개인", "personal", "ip", "addr", "client", "remote", "src_ip", "접속", "사번",
    "staff", "emp_id", "emp_no", "employee", "연락처", "성명", "담당자", "사용자", "접속자", "수검자", "직원", "사원", "userid",
    "user_id", "jumin", "resno", "rno", "주민번호",
]

# Surnames a name must start with, office suffixes it must not end with.
SURNAMES = (
    "김이박최정강조윤장임한오서신권황안송류홍전고문손양배백허유남심노하곽성차주우구나민진지엄채원천방공현"
    "함변염여추도석선설소왕용은음예봉탁편반위연옥표어제모마길라경부태형기목피화"
)
OFFICE_SUFFIXES = "처팀실청"

# Spoken digits and the digits they stand for.
SPOKEN_DIGITS = "영공일이삼사오육칠팔구"
SPOKEN_VALUES = "00123456789"

# Weights of the resident-number checksum.
RRN_WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]

# ---------------------------------------------------------------------------
# Log-format signatures (name, pattern, weight, parser family), in tie order.
# ---------------------------------------------------------------------------
FORMAT_SIGNATURES: list[tuple[str, str, int, str]] = [
    (
        "syslog_rfc3164",
        r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+",
        4, "app",
    ),
    ("syslog_rfc5424", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 4, "app"),
    ("apache_combined", r'^\S+ \S+ \S+ \[[\w:/]+\s[+\-]\d{4}\] "', 8, "web"),
    (
        "log4j_standard",
        r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}[,\.]\d{3}\s+(DEBUG|INFO|WARN|ERROR|FATAL)",
        7, "app",
    ),
    ("oracle_audit", r"(?:ACTION\s*:|DB USER\s*:|AUDIT\s+TYPE\s*:|SESSIONID\s*:)", 10, "db"),
    (
        "mysql_general",
        r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s+\d+\s+(?:Query|Connect|Quit|Init)",
        9, "db",
    ),
    ("mssql_audit", r"(?:LoginName|DatabaseName|ObjectName|StatementText).*,", 9, "db"),
    (
        "postgresql",
        r"^\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}.*(?:LOG|ERROR|WARNING|NOTICE|FATAL|PANIC):"
        r"\s{1,3}(?:statement:|duration:|execute|AUDIT:)",
        9, "db",
    ),
    (
        "postgresql_csv",
        r'^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[.\d]* \w+,"[^"]*","[^"]*","',
        8, "db",
    ),
    ("csv_generic", r"^[^,\n]+,[^,\n]+,[^,\n]+,", 2, "generic"),
]

# User patterns in the order they are tried.
USER_PATTERNS = [
    r"\buser(?:id|name)?[=:\s]+['\"]?(\w[\w.\-@]{1,30})['\"]?",
    r"\bemployee[_\-]?(?:id|no)?[=:\s]+['\"]?(\w{3,15})['\"]?",
    r"\bemp(?:no|_?id)?[=:\s]+['\"]?(\w{3,15})['\"]?",
    r"\b사원번호[=:\s]+([\w\d]{3,15})",
    r"\bDB USER\s*:\s*(\w+)",
    r"\bloginid[=:\s]+['\"]?(\w[\w.\-]{1,30})['\"]?",
    r"\baccount[=:\s]+['\"]?(\w[\w.\-@]{1,30})['\"]?",
    r"\[(\w{3,20})\].*(?:query|select|access)",
]
NOT_USERS = ["none", "null", "na", "n/a", "-"]

# First dotted quad, first verb, first table of a line.
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
ACTION_PATTERN = (
    r"\b(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|EXEC|CALL|GET|POST|PUT|PATCH|LOGIN|LOGOUT|QUERY)\b"
)
TABLE_PATTERN = r"\b(?:FROM|JOIN|INTO)\s+([`\"]?[\w.]+[`\"]?)"

# Bulk-read markers.
BULK_PATTERNS = [
    r"\bLIMIT\s+(\d+)",
    r"\bROWNUM\s*<=?\s*(\d+)",
    r"\bFETCH\s+FIRST\s+(\d+)\s+ROWS",
    r"\bTOP\s+(\d+)\b",
]
BULK_STAR_PATTERN = r"\bSELECT\s+\*\s+FROM\s+\w+\s*(?:;|$)"

# Line layouts of the log families (anchored at the line start).
MYSQL_LINE = (
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\d+)\s+(Query|Connect|Quit|Init DB|Field List)\s*(.*)"
)
MYSQL_CONNECT = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\d+)\s+Connect\s+(\w+)@"
PG_LINE = (
    r"(\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s+UTC|\s+[+-]\d{2}:?\d{2})?)"
    r"(?:[^\[]*\[(\d+)\])?"
    r"(?:[^@]*?(\w[\w.]+)@(\w+))?"
    r"\s+(?:LOG|ERROR|WARNING|NOTICE|FATAL|PANIC|DEBUG|INFO):\s+(.*)"
)
PG_DURATION = r"duration:\s+[\d.]+\s+ms\s+(?:statement|execute(?:\s+\S+)?):\s+(.*)"
PG_STATEMENT = r"(?:statement|execute(?:\s+\S+)?|query):\s+(.*)"
PG_AUDIT = r'AUDIT:\s+\w+,\d+,\d+,(\w+),(\w+),+,"([^"]*)"'
PG_CSV = (
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?\s*\w*),"
    r'"([^"]*)","([^"]*)","[^"]*","([^"]*)",'
)
PG_CSV_MESSAGE = r'(?:^|,)"((?:statement|execute|duration|AUDIT)[^"]*)"'
WEB_LINE = (
    r'(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"(\w+)\s+([^\s"]+)[^"]*"\s+(\d{3})\s+(\S+)'
)
LOG4J_LINE = (
    r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[,\.]\d+)\s+(DEBUG|INFO|WARN|ERROR|FATAL)\s+"
    r"(?:\[([^\]]+)\]\s+)?(\S+)\s+-\s+(.*)"
)
PYLOG_LINE = (
    r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[,\.]\d+)\s+-\s+(\S+)\s+-\s+"
    r"(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+-\s+(.*)"
)
SYSLOG_LINE = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)"
STAMPED_LINE = r"(\d{4}[-/]\d{2}[-/]\d{2}[\sT]\d{2}:\d{2}:\d{2}[^\s]*)\s+(.*)"

# Oracle audit blocks.
ORACLE_START = r"(?:AUDIT TRAIL|ACTION\s*:|DB USER\s*:|Audit record)"
ORACLE_END = r"RETURNCODE\s*:\s*(\d+)"
ORACLE_FIELDS = {
    "db_user": r'DB USER\s*:\s*"?([^"\n]+)"?',
    "os_user": r'OS USERNAME\s*:\s*"?([^"\n]+)"?',
    "action": r'\bACTION\s*:\s*"?([^"\n]+)"?',
    "object": r'OBJ\s*NAME\s*:\s*"?([^"\n]+)"?',
    "stamp": r"TIMESTAMP\s*:\s*([^\n]+)",
    # possessive, so that the matcher goes on line by line instead of recursing
    "sql": r"SQL TEXT\s*:\s*([^\n]+(?:\n\s+[^\n]+)*+)",
}

ORACLE_FIELD_LINES = 3  # a field's name, colon and value may stand on lines of their own

# ---------------------------------------------------------------------------
# Returned-row-count patterns in the order they are tried.
# ---------------------------------------------------------------------------
ROW_COUNT_PATTERNS = [
    r"Rows_sent\s*:\s*(\d+)",
    r"ROWS[\s_]PROCESSED\s*:\s*(\d+)",
    r"Rows(?:Affected|Count)\s*[=:]\s*(\d+)",
    r"([\d,]+)\s*건\s*(?:반환|조회|검색|출력)",
    r"(?:반환|조회결과|결과)\s*:?\s*([\d,]+)\s*건",
    r"returned\s+([\d,]+)\s+rows?",
    r"([\d,]+)\s+rows?\s+(?:returned|sent|affected|fetched)",
    r"(?:selectList|executeQuery|findAll)\D{0,30}([\d,]+)\s*results?",
    r"(?:total|result)(?:Count|Size|Rows)\s*[=:]\s*([\d,]+)",
    r"fetch(?:Size|Count)\s*[=:]\s*([\d,]+)",
    r"([\d,]+)\s+rows?\s+in\s+set",
    r"\brows\s*=\s*([\d,]+)",
    r"rows?\s+affected\s*[=:]\s*([\d,]+)",
]

# Column-name keywords of personal data.
PII_COLUMN_KEYWORDS = [
    "주민번호", "주민등록번호", "rrn", "ssn", "resident", "jumin", "rno", "이름", "성명", "고객명", "cust_name", "customer_name",
    "name", "성함", "nm", "전화", "전화번호", "phone", "mobile", "tel", "휴대폰", "휴대전화", "cellphone", "hp_no", "cell_no",
    "phone_no", "tel_no", "주소", "address", "addr", "거주지", "home_addr", "road_addr", "email", "이메일", "mail",
    "e_mail", "계좌", "계좌번호", "account_no", "bankno", "bank_no", "card", "카드번호", "신용카드", "card_no", "credit",
    "생년월일", "생년", "birthday", "birth_date", "birthdate", "dob", "birth", "여권", "여권번호", "passport", "사원번호", "사번",
    "emp_id", "employee_id", "empno", "staff_id", "staff_no",
]

# Tables whose star select counts as wide exposure.
SENSITIVE_TABLES = [
    "customers", "members", "personal_info", "personal", "고객", "회원", "개인정보", "cust", "member", "employee", "사원",
    "직원", "accounts", "user_info",
]

# ---------------------------------------------------------------------------
# Ordered levels, categories and display labels.
# ---------------------------------------------------------------------------
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_SCORES = {"CRITICAL": 10.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 1.0}
MISUSE_CATEGORIES = ["PII_EXPOSURE", "AFTER_HOURS", "PII_RECORD_EXPOSURE"]
EXCESS_CATEGORIES = ["EXCESSIVE_ACCESS", "BULK_EXPORT"]
LEVEL_LABELS = {"CRITICAL": "최고위험", "HIGH": "고위험", "MEDIUM": "중위험", "LOW": "저위험"}
CATEGORY_LABELS = {
    "PII_EXPOSURE": "개인정보 노출",
    "AFTER_HOURS": "업무외시간 조회",
    "BULK_EXPORT": "대량 조회",
    "EXCESSIVE_ACCESS": "과다조회",
    "PII_RECORD_EXPOSURE": "단일 대량 개인정보 노출",
}
DETAIL_CATEGORY_LABELS = {
    "PII_EXPOSURE": "PII 오남용",
    "PII_RECORD_EXPOSURE": "PII 레코드 노출",
    "EXCESSIVE_ACCESS": "과다조회",
    "AFTER_HOURS": "업무외시간조회",
    "BULK_EXPORT": "대량조회",
}
DETAIL_EXPOSURE_LABELS = {
    "FULL_EXPOSURE": "전체컬럼노출",
    "PARTIAL_EXPOSURE": "PII컬럼직접출력",
    "SEARCH_ONLY": "검색조건만사용",
    "NONE": "없음",
}
KEY_EXPOSURE_LABELS = {
    "FULL_EXPOSURE": "전체컬럼 노출(SELECT*)",
    "PARTIAL_EXPOSURE": "PII컬럼 직접 출력",
    "SEARCH_ONLY": "검색조건만 사용",
}
FIELD_LABELS = {
    "name": "이름", "cust_name": "고객명", "customer_name": "고객명",
    "phone": "전화번호", "tel": "전화번호",
    "email": "이메일", "mail": "이메일",
    "address": "주소", "addr": "주소",
    "rrn": "주민등록번호", "ssn": "주민등록번호", "jumin": "주민등록번호",
    "birthdate": "생년월일", "birth": "생년월일", "dob": "생년월일",
    "account": "계좌번호", "account_no": "계좌번호", "bankno": "계좌번호",
    "card": "카드번호", "card_no": "카드번호",
    "passport": "여권번호",
    "gender": "성별", "sex": "성별",
    "nationality": "국적",
    "salary": "급여", "income": "소득",
}
UNKNOWN_USER = "UNKNOWN"
UNKNOWN_TIME = "알 수 없음"
