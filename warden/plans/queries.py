"""Registered queries over the statement log, and their DuckDB SQL.

Each query applies operators of this package to whole tables. The SQL is
written independently, against the same tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import families, lexed, native_lex
from ..functions.lexer import KEYWORDS
from ..functions.text import byte_range, ip_address, split_list, statement_text, utf8_cut, utf8_prefix
from ..operators import audit, decide, gates, learn, rate, shaping
from ..operators.decide import Policy
from ..settings import Settings
from ..sources import statements as src

QUIET = dict(enable_quiet_hours=True, quiet_hours_timezone="Europe/Istanbul")
SESSION = dict(enable_ip_blocking=True, blocked_ips="10.0.0.4, ::ffff:10.0.3.3", enable_application_blocking=True, blocked_applications="BADAPP", enable_role_ip_binding=True, role_ip_bindings="app_2@10.0.2.2, app_3@10.0.3.3")
WORDS = "pg_sleep, union select"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def log(spark: SparkSession, sf_dir: str, texts: bool = False, by: str = "event_id") -> DataFrame:
    return src.from_events(spark, sf_dir, texts, by)


def policy(spark: SparkSession) -> Policy:
    """The seeded policy tables, fingerprints included."""
    approvals = spark.sql(src.APPROVALS_SQL)
    keys = {"INSERT" if t.startswith("INSERT") else "SELECT" for t, *_ in src.FINGERPRINT_SEEDS}
    rows = [(t, "INSERT" if t.startswith("INSERT") else "SELECT", h, a, d) for t, h, a, d in src.FINGERPRINT_SEEDS]
    values = ", ".join(f"('{t}', '{c}', {h}, {str(a).lower()}, {str(d).lower()})" for t, c, h, a, d in rows)
    seeds = spark.sql(f"SELECT * FROM (VALUES {values}) AS t(canonical, command_type, hit_count, is_approved, auto_approval_disabled)")
    roles = spark.range(12).select(F.format_string("app_%d", "id").alias("role_name")).crossJoin(spark.range(1, 4).select(F.col("id").alias("db_oid")))
    digest = native_lex.fingerprint(F.col("canonical"), F.lit(src.SYSTEM_IDENTIFIER), F.col("db_oid"), F.lit(src.EXTENSION_OID))
    known = seeds.crossJoin(roles).select(digest.alias("fingerprint"), "role_name", "command_type", "hit_count", "is_approved", "auto_approval_disabled")  # five seeds, 36 roles
    rules = ((r"delete\s+from", ("app_1",)), (r"t[0-4]\s+where\s+id\s*=\s*7", None))
    assert keys
    return Policy(approvals, known, rules, src.SYSTEM_IDENTIFIER, src.EXTENSION_OID)


# --- DuckDB parts

LOG = "stmts AS (" + src.STATEMENTS_SQL.replace("{events}", "events") + ")"
_KEYS = ", ".join(f"'{k}'" for k in sorted(KEYWORDS))
_PATTERN = native_lex.PATTERN.replace("'", "''")
_DROP = r"^(\s+|--.*|/\*(?:.|\n)*)$"
TOKENS = rf"""raw AS (SELECT *, list_filter(regexp_extract_all(query_text, '{_PATTERN}'), lambda t: NOT regexp_matches(t, '{_DROP}')) AS r FROM stmts),
 toks AS (SELECT * EXCLUDE (r), r[1:coalesce(list_max(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] <> ';' THEN i ELSE 0 END)), 0)] AS t FROM raw)"""
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{UP}', '{LOW}')"


def _kind(x: str) -> str:
    return (
        f"CASE WHEN starts_with({x}, '''') THEN 'str' WHEN starts_with({x}, '\"') THEN 'ident' WHEN regexp_matches({x}, '^\\$[0-9]') THEN 'param' "
        f"WHEN regexp_matches({x}, '^[0-9]') THEN CASE WHEN NOT contains({x}, '.') AND length({x}) <= 10 AND try_cast({x} AS BIGINT) <= 2147483647 THEN 'int' ELSE 'num' END "
        f"WHEN regexp_matches({x}, '^[A-Za-z_]') THEN CASE WHEN {_low(x)} IN ({_KEYS}) THEN 'keyword' ELSE 'ident' END ELSE 'op' END"
    )


def _written(x: str) -> str:
    k = _kind(x)
    return (
        f"CASE ({k}) WHEN 'str' THEN '?str' WHEN 'int' THEN '?int' WHEN 'num' THEN '?num' WHEN 'keyword' THEN translate({x}, '{LOW}', '{UP}') "
        f"WHEN 'ident' THEN CASE WHEN starts_with({x}, '\"') THEN {x} ELSE '\"' || {_low(x)} || '\"' END ELSE CASE WHEN {x} = '!=' THEN '<>' ELSE {x} END END"
    )


CANON = f"canon AS (SELECT *, array_to_string(list_transform(t, lambda x: {_written('x')}), ' ') AS canonical FROM toks)"


def _hex(x: str, n: int) -> str:
    return f"lpad(hex(CAST({x} AS BIGINT)), {n}, '0')"


def _digest(text: str, db: str) -> str:
    blob = "".join(f"\\x{b:02X}" for b in native_lex.DOMAIN + b"\0installation\0")
    return f"sha256('{blob}'::BLOB || unhex({_hex(str(src.SYSTEM_IDENTIFIER), 16)}) || unhex({_hex(db, 8)}) || unhex({_hex(str(src.EXTENSION_OID), 8)}) || encode({text}))"


PRINTS = f"prints AS (SELECT *, {_digest('canonical', 'db_oid')} AS fingerprint FROM canon)"
BASE = f"WITH {LOG}"
LEXED = f"WITH {LOG}, {TOKENS}, {CANON}"
PRINTED = f"{LEXED}, {PRINTS}"
BARE = f"CASE WHEN starts_with(x, '\"') THEN regexp_replace({_low('substr(x, 2)')}, '\\s|\"', '', 'g') ELSE {_low('x')} END"
WORDS_SQL = f"' ' || array_to_string(list_transform(t, lambda x: CASE WHEN ({_kind('x')}) IN ('str', 'int', 'num') THEN '?' ELSE {BARE} END), ' ') || ' '"
KEYWORD_SQL = f"CASE WHEN contains({WORDS_SQL}, ' pg_sleep ') THEN 'pg_sleep' WHEN contains({WORDS_SQL}, ' union select ') THEN 'union select' END"
_LIT = lambda x: f"({_kind(x)}) IN ('str', 'int', 'num')"
_VAL = lambda x: f"regexp_replace(regexp_replace({x}, '^''', ''), '''$', '')"
TAUT_SQL = f"len(list_filter(range(1, len(t) - 2), lambda i: {_low('t[i]')} = 'or' AND {_LIT('t[i+1]')} AND t[i+2] = '=' AND {_LIT('t[i+3]')} AND {_VAL('t[i+1]')} = {_VAL('t[i+3]')})) > 0"
IP_SQL = "CASE WHEN client_addr IN ('10.0.0.4', '10.0.3.3') THEN 'Connection from blocked IP address ''' || client_addr || ''' is not allowed.' END"
APP_SQL = f"CASE WHEN {_low('application_name')} = 'badapp' THEN 'Connections from application ''' || application_name || ''' are not allowed.' END"
BIND_SQL = "CASE WHEN (role_name = 'app_2' AND coalesce(client_addr <> '10.0.2.2', true)) OR (role_name = 'app_3' AND coalesce(client_addr <> '10.0.3.3', true)) THEN 'Role ''' || role_name || ''' is not allowed to connect from IP ''' || coalesce(client_addr, '[local]') || '''.' END"
REGEX_SQL = r"(regexp_matches(query_text, '(?i)delete\s+from') AND role_name <> 'app_1') OR regexp_matches(query_text, '(?i)t[0-4]\s+where\s+id\s*=\s*7')"
MINUTE = "CAST(extract(hour FROM (decided_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul') * 60 + extract(minute FROM (decided_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul') AS INTEGER)"
APPROVALS = f"approvals AS ({src.APPROVALS_SQL})"

# --- shaping


@query(f"""{BASE}, tags AS (SELECT *, CASE WHEN stmt_id % 41 = 0 THEN 'START TRANSACTION' WHEN stmt_id % 43 = 0 THEN 'SELECT INTO' WHEN stmt_id % 47 = 0 THEN 'FROB X' ELSE upper(split_part(query_text, ' ', 1)) || ' 1' END AS tag FROM stmts)
SELECT family, count(*) AS n, string_agg(DISTINCT command_type, ',' ORDER BY command_type) AS commands FROM (SELECT *, CASE WHEN tag = 'START TRANSACTION' THEN 'BEGIN' WHEN tag = 'SELECT INTO' THEN 'CREATE' WHEN split_part(tag, ' ', 1) IN ('SELECT','INSERT','UPDATE','DELETE') THEN split_part(tag, ' ', 1) ELSE 'OTHER' END AS family FROM tags) GROUP BY family""")
def family_counts(spark, sf_dir):
    i = F.col("stmt_id")
    tag = F.when(i % 41 == 0, "START TRANSACTION").when(i % 43 == 0, "SELECT INTO").when(i % 47 == 0, "FROB X").otherwise(F.concat(F.upper(F.split_part("query_text", F.lit(" "), F.lit(1))), F.lit(" 1")))
    rows = log(spark, sf_dir).withColumn("family", families.family(tag))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("command_type")), ",").alias("commands"))


def _inner():
    i = F.col("stmt_id")
    return F.when(i % 5 == 0, F.array(F.lit("INSERT"), F.lit("UPDATE"), F.lit("INSERT"))).when(i % 5 == 1, F.array(F.lit("DELETE"))).otherwise(F.array().cast("array<string>"))


@query(f"""{BASE}, f AS (SELECT stmt_id, command_type, CASE stmt_id % 5 WHEN 0 THEN ['INSERT', 'UPDATE'] WHEN 1 THEN ['DELETE'] ELSE [] END AS fam FROM stmts)
SELECT stmt_id, 0 AS inspection_no, command_type AS family FROM f UNION ALL SELECT stmt_id, CAST(i AS INTEGER), fam[i] FROM f, unnest(range(1, len(fam) + 1)) AS u(i)""")
def cte_fanout(spark, sf_dir):
    return families.fan_out(log(spark, sf_dir).withColumn("cte_families", _inner())).select("stmt_id", "inspection_no", "family")


@query(f"""{BASE}, parts AS (SELECT txn_id AS message_id, command_type AS family, action FROM stmts, (VALUES ('SELECT'), ('DELETE')) AS a(action))
SELECT message_id, action, count(*) FILTER (WHERE family IN ('INSERT','UPDATE','DELETE','MERGE')) AS n_writes, count(*) FILTER (WHERE family = action) AS n_same,
 CASE WHEN (action = 'DELETE' AND n_writes = 1) OR (action = 'SELECT' AND n_writes = 0 AND n_same = 1) THEN 'span' ELSE '0A000' END AS verdict FROM parts GROUP BY message_id, action""")
def rule_action_span(spark, sf_dir):
    actions = F.explode(F.array(F.lit("SELECT"), F.lit("DELETE")))
    return families.rule_action_span(log(spark, sf_dir).select(F.col("txn_id").alias("message_id"), F.col("command_type").alias("family"), actions.alias("action")))


@query(f"""{BASE} SELECT stmt_id, trim(chr(9) || ' ' || query_text || chr(10), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS statement FROM stmts""")
def statement_texts(spark, sf_dir):
    return log(spark, sf_dir).select("stmt_id", statement_text(F.concat(F.lit("\t "), F.col("query_text"), F.lit("\n"))).alias("statement"))


@query(f"{LEXED} SELECT stmt_id, canonical FROM canon")
def canonical_text(spark, sf_dir):
    return decide.fingerprinted(log(spark, sf_dir, texts=True), policy(spark)).select("stmt_id", "canonical")


@query(f"{PRINTED} SELECT stmt_id, fingerprint FROM prints")
def fingerprint_hex(spark, sf_dir):
    return decide.fingerprinted(log(spark, sf_dir, texts=True), policy(spark)).select("stmt_id", "fingerprint")


@query(f"{LEXED} SELECT kind, count(*) AS n, count(DISTINCT x) AS n_distinct FROM (SELECT x, {_kind('x')} AS kind FROM (SELECT unnest(t) AS x FROM canon)) GROUP BY kind")
def token_kinds(spark, sf_dir):
    t = log(spark, sf_dir, texts=True).select(F.explode(native_lex.tokens(F.col("query_text"))).alias("x"))
    return t.groupBy(native_lex.kind(F.col("x")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("x").alias("n_distinct"))


@query(f"""SELECT doc_id, CASE WHEN strlen(text) <= 511 THEN text ELSE left(text, CAST(list_max(list_filter(range(120, 512), lambda i: strlen(left(text, i)) <= 511)) AS BIGINT)) END AS prefix, strlen(text) > 511 AS truncated FROM documents""")
def utf8_truncate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", utf8_prefix(F.col("text"), 511).alias("prefix"), utf8_cut(F.col("text"), 511).alias("truncated"))


@query(f"""{BASE} SELECT role_name, count(DISTINCT v) AS n FROM (SELECT role_name, unnest(list_filter(list_transform(string_split(' a , ' || role_name || ',, b,' || application_name, ','), lambda x: trim(x)), lambda x: x <> '')) AS v FROM stmts) GROUP BY role_name""")
def parsed_lists(spark, sf_dir):
    text = F.concat(F.lit(" a , "), F.col("role_name"), F.lit(",, b,"), F.col("application_name"))
    return log(spark, sf_dir).select("role_name", F.explode(split_list(text)).alias("v")).groupBy("role_name").agg(F.countDistinct("v").alias("n"))


@query(f"{BASE} SELECT stmt_id, client_addr AS ip FROM stmts")
def normalized_ip(spark, sf_dir):
    shown = F.when(F.col("stmt_id") % 3 == 0, F.concat(F.lit("::FFFF:"), F.col("client_addr"))).when(F.col("stmt_id") % 3 == 1, F.concat(F.col("client_addr"), F.lit("%eth0"))).otherwise(F.col("client_addr"))
    return log(spark, sf_dir).select("stmt_id", ip_address(shown).alias("ip"))


@query(f"""{BASE} SELECT stmt_id, CASE stmt_id % 6 WHEN 0 THEN '2001:db8::' || (1 + stmt_id % 9) WHEN 1 THEN '10.1.2.' || (stmt_id % 200) WHEN 2 THEN 'fe80::' || (1 + stmt_id % 9) || ':0:0:1' WHEN 3 THEN '2001:db8:0:1:1:1:1:' || (1 + stmt_id % 9) WHEN 4 THEN '10.0.' || (stmt_id % 99) || '.7' END AS ip FROM stmts""")
def normalized_ip_mixed(spark, sf_dir):
    """Long and short IPv6 forms, zones, mapped addresses and what is no address, by value."""
    i, kind = F.col("stmt_id"), F.col("stmt_id") % 6
    digit, octet = (1 + i % 9).cast("string"), lambda n: (i % n).cast("string")
    shown = (
        F.when(kind == 0, F.concat(F.lit("2001:0DB8:0:0:0::000"), digit)).when(kind == 1, F.concat(F.lit("0:0:0:0:0:ffff:10.1.2."), octet(200)))
        .when(kind == 2, F.concat(F.lit(" fe80:0:0:0:"), digit, F.lit("::1%eth0"))).when(kind == 3, F.concat(F.lit("2001:db8:0000:1:01:001:0001:"), digit))
        .when(kind == 4, F.concat(F.lit("10.0."), octet(99), F.lit(".7"))).otherwise(F.lit("[local]"))
    )
    return log(spark, sf_dir).select("stmt_id", ip_address(shown).alias("ip"))


@query(f"""{BASE}, p AS (SELECT stmt_id, CASE stmt_id % 3 WHEN 0 THEN '[[:digit:]]+ or' WHEN 1 THEN 'public.t' || (stmt_id % 5) ELSE '[[:space:]]+set[[:space:]]' END AS pattern FROM stmts)
SELECT stmt_id, CASE stmt_id % 3 WHEN 0 THEN regexp_matches(query_text, '(?i)[0-9]+ or') WHEN 1 THEN regexp_matches(query_text, '(?i)public.t' || (stmt_id % 5)) ELSE regexp_matches(query_text, '(?i)[ \t\n\r\f\v]+set[ \t\n\r\f\v]') END AS hit FROM stmts JOIN p USING (stmt_id)""")
def java_patterns(spark, sf_dir):
    """Patterns of a table in the other dialect, matched row by row."""
    i = F.col("stmt_id")
    pattern = F.when(i % 3 == 0, F.lit("[[:digit:]]+ or")).when(i % 3 == 1, F.concat(F.lit("public.t"), (i % 5).cast("string"))).otherwise(F.lit("[[:space:]]+set[[:space:]]"))
    return log(spark, sf_dir).withColumn("_p", gates.java_pattern_column(pattern)).select("stmt_id", F.expr("query_text rlike _p").alias("hit"))


@query(f"""{LEXED} SELECT stmt_id, 'v3: ' || canonical AS normalized_query, CASE WHEN stmt_id % 2 = 0 THEN query_text ELSE left(repeat(query_text, 20), 511) END AS sample_query FROM canon""")
def stored_samples(spark, sf_dir):
    """What a learned fingerprint's row says of its first statement; every other one is long."""
    rows = decide.fingerprinted(log(spark, sf_dir, texts=True), policy(spark))
    text = F.when(F.col("stmt_id") % 2 == 0, F.col("query_text")).otherwise(F.repeat("query_text", 20))
    return rows.select("stmt_id", learn.normalized_query(F.col("canonical")).alias("normalized_query"), learn.learn_sample(text).alias("sample_query"))


# --- gates


def _reasons(spark, sf_dir, column):
    return log(spark, sf_dir).select("stmt_id", column.alias("reason")).where("reason is not null")


@query(f"{BASE} SELECT stmt_id, {IP_SQL} AS reason FROM stmts WHERE reason IS NOT NULL")
def ip_blocked(spark, sf_dir):
    return _reasons(spark, sf_dir, gates.ip_reason(Settings(**SESSION), F.col("client_addr")))


@query(f"{BASE} SELECT stmt_id, {APP_SQL} AS reason FROM stmts WHERE reason IS NOT NULL")
def app_blocked(spark, sf_dir):
    return _reasons(spark, sf_dir, gates.app_reason(Settings(**SESSION), F.col("application_name")))


@query(f"{BASE} SELECT stmt_id, {BIND_SQL} AS reason FROM stmts WHERE reason IS NOT NULL")
def role_ip_binding(spark, sf_dir):
    return _reasons(spark, sf_dir, gates.binding_reason(Settings(**SESSION), F.col("role_name"), F.col("client_addr")))


@query(f"{BASE} SELECT stmt_id, 'Blocked during quiet hours (08:30 - 17:00).' AS reason FROM stmts WHERE {MINUTE} >= 510 AND {MINUTE} < 1020")
def quiet_hours(spark, sf_dir):
    return _reasons(spark, sf_dir, gates.quiet_reason(Settings(quiet_hours_start="08:30", quiet_hours_end="17:00", **QUIET), F.col("decided_at")))


@query(f"{BASE} SELECT stmt_id, 'Blocked during quiet hours (22:00 - 06:00).' AS reason FROM stmts WHERE {MINUTE} >= 1320 OR {MINUTE} < 360")
def quiet_hours_midnight(spark, sf_dir):
    return _reasons(spark, sf_dir, gates.quiet_reason(Settings(quiet_hours_start="22:00", quiet_hours_end="06:00", **QUIET), F.col("decided_at")))


@query(f"{LEXED} SELECT stmt_id, {KEYWORD_SQL} AS keyword FROM canon WHERE keyword IS NOT NULL")
def keyword_hits(spark, sf_dir):
    words = Settings(blacklisted_keywords=WORDS).keywords
    near = lexed.with_tokens(log(spark, sf_dir, texts=True).where(native_lex.near_keyword(F.col("query_text"), words)))
    return near.select("stmt_id", lexed.keyword_hit(F.col("query_text"), words, F.col("_tokens")).alias("keyword")).where("keyword is not null")


@query(f"{LEXED} SELECT stmt_id FROM canon WHERE {TAUT_SQL}")
def tautology_hits(spark, sf_dir):
    near = lexed.with_tokens(log(spark, sf_dir, texts=True).where(native_lex.near_tautology(F.col("query_text"))))
    return near.where(lexed.tautology(F.col("query_text"), F.col("_tokens"))).select("stmt_id")


def _rules(spark):
    rules = src.raw_sql(spark, src.RULES_SQL)
    java = F.concat(F.lit("(?i)"), F.col("pattern"))
    return rules.select(java.alias("pattern"), "is_active", F.when(F.col("exempt").isNotNull(), F.array("exempt")).alias("allowed_roles"))


@query(f"{BASE} SELECT stmt_id FROM stmts WHERE {REGEX_SQL}")
def regex_semi_join(spark, sf_dir):
    return gates.regex_blocked(log(spark, sf_dir), _rules(spark)).select("stmt_id")


@query(f"""SELECT pattern, CASE WHEN regexp_matches(pattern, '\\(\\?[^)]*\\{{[^}}]*\\}}[^)]*\\)') OR regexp_matches(pattern, '[*+]\\+|\\*\\*|\\+\\*') THEN true ELSE false END AS refused
FROM (VALUES ('a+'), ('a++'), ('(?:x{{3}})'), ('b**c'), ('x+*'), ('delete\\s+from'), ('(?i)ok')) AS t(pattern)""")
def regex_validation(spark, sf_dir):
    patterns = ["a+", "a++", "(?:x{3})", "b**c", "x+*", r"delete\s+from", "(?i)ok"]
    return spark.createDataFrame([(p,) for p in patterns], "pattern string").select("pattern", gates.pattern_refused(F.col("pattern")).alias("refused"))


# --- rates


def _rate_sql(keys: str, window: int, limit: str, where: str = "true", name: str = "exceeded") -> str:
    return f"""WITH RECURSIVE {LOG},
 a AS (SELECT stmt_id, concat_ws('/', {keys}) AS k, epoch_us(decided_at) AS us, row_number() OVER (PARTITION BY concat_ws('/', {keys}) ORDER BY decided_at, stmt_id) AS rn FROM stmts WHERE {where}),
 w AS (SELECT stmt_id, k, us, rn, us AS ws, CAST(1 AS BIGINT) AS n FROM a WHERE rn = 1
   UNION ALL SELECT a.stmt_id, a.k, a.us, a.rn, CASE WHEN a.us - w.ws >= {window * 1_000_000} THEN a.us ELSE w.ws END, CASE WHEN a.us - w.ws >= {window * 1_000_000} THEN 1 ELSE w.n + 1 END FROM w JOIN a ON a.k = w.k AND a.rn = w.rn + 1)
SELECT stmt_id, n, n > {limit} AS {name} FROM w"""


@query(_rate_sql("db_oid, role_oid", 86400, "10"))
def rate_global(spark, sf_dir):
    rows = rate.rate_windows(log(spark, sf_dir).select("stmt_id", "db_oid", "role_oid", "decided_at"), rate.KEYS, "decided_at", "stmt_id", 86400)
    return rows.select("stmt_id", "n", (F.col("n") > 10).alias("exceeded"))


@query(_rate_sql("db_oid, role_oid, command_type", 86400, "3", "command_type = 'SELECT'"))
def rate_command(spark, sf_dir):
    selects = log(spark, sf_dir).where("command_type = 'SELECT'").select("stmt_id", "db_oid", "role_oid", "command_type", "decided_at")
    rows = rate.rate_windows(selects, [*rate.KEYS, "command_type"], "decided_at", "stmt_id", 86400)
    return rows.select("stmt_id", "n", (F.col("n") > 3).alias("exceeded"))


@query(_rate_sql("db_oid, role_oid", 86400, "10").replace("SELECT stmt_id, n, n > 10 AS exceeded FROM w", "SELECT count(*) FILTER (WHERE n > 10) AS n_refused, count(*) AS n FROM w"))
def rate_refusals(spark, sf_dir):
    rows = rate.rate_reasons(log(spark, sf_dir), Settings(enable_rate_limiting=True, rate_limit_count=10, rate_limit_seconds=86400))
    return rows.agg(F.count_if(F.col("rate_reason").isNotNull()).alias("n_refused"), F.count("*").alias("n"))


# --- decisions


def _settings(mode):
    return Settings(mode=mode, blacklisted_keywords=WORDS, **SESSION)


GATE_SQL = f"coalesce({IP_SQL}, {APP_SQL}, {BIND_SQL}, 'Blocked due to blacklisted keyword ''' || ({KEYWORD_SQL}) || '''.', CASE WHEN {TAUT_SQL} THEN '{gates.TAUTOLOGY_REASON}' END, CASE WHEN {REGEX_SQL} THEN '{gates.REGEX_REASON}' END)"
STATE_SQL = f"CASE WHEN coalesce({IP_SQL}, {APP_SQL}, {BIND_SQL}) IS NULL AND ({KEYWORD_SQL}) IS NOT NULL THEN '42000' ELSE '42501' END"


def _seed_sql() -> str:
    rows = [(t, "INSERT" if t.startswith("INSERT") else "SELECT", h, a, d) for t, h, a, d in src.FINGERPRINT_SEEDS]
    values = ", ".join(f"('{t}', '{c}', {h}, {a}, {d})" for t, c, h, a, d in rows)
    return f"seeds AS (SELECT {_digest('canonical', 'db_oid')} AS fingerprint, 'app_' || r AS role_name, command_type, is_approved FROM (VALUES {values}) AS t(canonical, command_type, hit_count, is_approved, auto_approval_disabled), range(12) AS u(r), range(1, 4) AS v(db_oid))"


def _decide_sql(mode: str, tail: str) -> str:
    no_row = {"learn": ("ALLOWED (LEARN MODE - AUTO)", "'Command type auto-approved in learn mode'"), "permissive": ("ALLOWED (PERMISSIVE - UNAPPROVED)", "'No rule for command type'"), "enforce": ("BLOCKED", "'No rule found for command ''' || command_type || ''' for role ''' || role_name || ''''")}[mode]
    denied = {"learn": ("ALLOWED (LEARN MODE - PENDING)", "'Command type approval pending but allowed in learn mode'"), "permissive": ("ALLOWED (PERMISSIVE - PENDING)", "'Command type approval pending'"), "enforce": ("BLOCKED", "'BLOCKED - Approval for command ''' || command_type || ''' is pending for role ''' || role_name || ''''")}[mode]
    other = "false" if mode == "enforce" else "command_type = 'OTHER'"
    stop = "(staged AND NOT coalesce(fp, false))" if mode == "enforce" else "false"
    extra = {"enforce": "CAST(NULL AS VARCHAR)", "permissive": "CASE WHEN staged AND NOT coalesce(fp, false) THEN 'ALLOWED (PERMISSIVE - FINGERPRINT)' END",
             "learn": "CASE WHEN staged AND fp IS NULL AND row_number() OVER (PARTITION BY fingerprint, role_name, command_type, staged AND fp IS NULL ORDER BY stmt_id) = 1 THEN 'LEARNED (FINGERPRINT AUTO)' END"}[mode]
    return f"""{PRINTED}, {APPROVALS}, {_seed_sql()},
 g0 AS (SELECT *, {GATE_SQL} AS gate, {STATE_SQL} AS state FROM prints),
 g AS (SELECT p.*, a.is_approved AS cmd, s.is_approved AS fp FROM g0 p
   LEFT JOIN approvals a ON a.role_name = p.role_name AND a.command_type = p.command_type LEFT JOIN seeds s ON s.fingerprint = p.fingerprint AND s.role_name = p.role_name AND s.command_type = p.command_type),
 c AS (SELECT *, CASE WHEN gate IS NOT NULL THEN 'BLOCKED' WHEN {other} THEN 'ALLOWED (OTHER)' WHEN cmd IS NULL THEN '{no_row[0]}' WHEN NOT cmd THEN '{denied[0]}' ELSE 'ALLOWED' END AS act,
   CASE WHEN gate IS NOT NULL THEN gate WHEN {other} THEN 'Uncommon utility command - automatically allowed in non-enforce mode' WHEN cmd IS NULL THEN {no_row[1]} WHEN NOT cmd THEN {denied[1]} ELSE 'Approved command type' END AS why FROM g),
 s1 AS (SELECT *, gate IS NULL AND NOT ({other}) AND act <> 'BLOCKED' AS staged FROM c),
 d AS (SELECT stmt_id, decided_at, role_name, database_name, query_text, application_name, client_addr, command_type, CASE WHEN {stop} THEN 'BLOCKED' ELSE act END AS action,
   CASE WHEN {stop} THEN 'Fingerprint ''' || fingerprint || ''' for role ''' || role_name || ''' is pending approval.' ELSE why END AS reason, {extra} AS fingerprint_action, gate, state FROM s1),
 decided AS (SELECT *, CASE WHEN action = 'BLOCKED' THEN CASE WHEN gate IS NULL THEN '42501' ELSE state END END AS sqlstate,
   CASE WHEN action = 'BLOCKED' THEN 'blocked' WHEN starts_with(action, 'ALLOWED (PERMISSIVE') THEN 'would_block' WHEN starts_with(action, 'ALLOWED (LEARN') OR starts_with(action, 'LEARNED') THEN 'learn' WHEN starts_with(action, 'ALLOWED (OTHER)') THEN 'unchecked' ELSE 'allowed' END AS decision FROM d)
{tail}"""


_DECIDED = "SELECT stmt_id, decision, action, reason, sqlstate, fingerprint_action FROM decided"


def _decided(spark, sf_dir, mode):
    return decide.decide(log(spark, sf_dir, texts=True), _settings(mode), policy(spark))


def _shown(df):
    return df.select("stmt_id", "decision", "action", "reason", "sqlstate", "fingerprint_action")


@query(_decide_sql("learn", _DECIDED))
def decide_learn(spark, sf_dir):
    return _shown(_decided(spark, sf_dir, "learn"))


@query(_decide_sql("permissive", _DECIDED))
def decide_permissive(spark, sf_dir):
    return _shown(_decided(spark, sf_dir, "permissive"))


@query(_decide_sql("enforce", _DECIDED))
def decide_enforce(spark, sf_dir):
    return _shown(_decided(spark, sf_dir, "enforce"))


@query(_decide_sql("learn", """, rows_ AS (SELECT stmt_id, 0 AS row_no, fingerprint_action AS action, 'Learn mode - new fingerprint observed; approval awaits threshold' AS reason, decision AS d FROM decided WHERE fingerprint_action IS NOT NULL
 UNION ALL SELECT stmt_id, 1, action, reason, decision FROM decided WHERE decision <> 'blocked')
SELECT stmt_id, row_no, action, reason, CASE WHEN row_no = 0 THEN 'learn' ELSE d END AS decision FROM rows_ WHERE d <> 'blocked'"""))
def activity_rows(spark, sf_dir):
    return decide.activity_rows(_decided(spark, sf_dir, "learn")).select("stmt_id", "row_no", "action", "reason", "decision")


@query(_decide_sql("enforce", "SELECT stmt_id, decided_at AS blocked_at, role_name, database_name, query_text, false AS query_truncated, application_name, client_addr, command_type, reason, decision FROM decided WHERE decision = 'blocked'"))
def blocked_rows(spark, sf_dir):
    return decide.blocked_rows(_decided(spark, sf_dir, "enforce"))


@query(_decide_sql("enforce", "SELECT role_name, decision, count(*) AS n, count(DISTINCT command_type) AS n_commands FROM decided GROUP BY role_name, decision"))
def decision_report(spark, sf_dir):
    return _decided(spark, sf_dir, "enforce").groupBy("role_name", "decision").agg(F.count("*").alias("n"), F.countDistinct("command_type").alias("n_commands"))


@query(_decide_sql("enforce", """SELECT stmt_id, '{"event":"query_block","role":"' || role_name || '","database":"' || database_name || '","command":"' || command_type || '","reason":"' || reason || '","application":"' || application_name || '","client_ip":"' || coalesce(client_addr, 'unknown') || '"}' AS payload FROM decided WHERE decision = 'blocked'"""))
def syslog_payload(spark, sf_dir):
    return decide.block_payload(decide.blocked_rows(_decided(spark, sf_dir, "enforce")))


@query(_decide_sql("enforce", """SELECT stmt_id, '{"event":"query_block","block_id":' || stmt_id || ',"command":"' || command_type || '"}' AS payload FROM decided WHERE decision = 'blocked'"""))
def alert_payload(spark, sf_dir):
    return decide.notify_payload(decide.blocked_rows(_decided(spark, sf_dir, "enforce")))


@query(_decide_sql("enforce", "SELECT stmt_id, decided_at AS blocked_at, role_name, reason FROM decided WHERE decision = 'blocked' ORDER BY decided_at DESC, stmt_id DESC LIMIT 10"))
def recent_blocked(spark, sf_dir):
    return audit.recent_blocked(decide.blocked_rows(_decided(spark, sf_dir, "enforce"))).select("stmt_id", "blocked_at", "role_name", "reason")


@query(f"{BASE} SELECT stmt_id, '[POLICY][QUIET_HOURS][user=' || role_name || '][db=' || database_name || '][cmd=' || command_type || '] Blocked during 22:00-06:00 window' AS line FROM stmts")
def quiet_hours_lines(spark, sf_dir):
    return decide.quiet_hours_line(log(spark, sf_dir), Settings(quiet_hours_start="22:00", quiet_hours_end="06:00", **QUIET))


# --- learning


def observations(spark, sf_dir, by="user_id"):
    """``by``: how the rows are dealt out; by user where transactions are used, for these are numbered by user."""
    rows = decide.fingerprinted(log(spark, sf_dir, texts=True, by=by), policy(spark)).where("canonical_sqlstate is null")
    return rows.select(F.col("stmt_id").alias("position"), "txn_id", "committed", "fingerprint", "role_name", "role_oid", "command_type", F.lit(1).cast("long").alias("hits"), F.lit(5).alias("learn_threshold"), (F.col("stmt_id") % 4).cast("long").alias("policy_epoch"))


OBS = f"{PRINTED}, obs AS (SELECT stmt_id AS position, txn_id, committed, fingerprint, role_name, role_oid, command_type, 1 AS hits, 5 AS learn_threshold, stmt_id % 4 AS policy_epoch FROM prints)"


@query(f"{OBS} SELECT txn_id, fingerprint, role_name, command_type, learn_threshold, policy_epoch, CAST(least(sum(hits), 2147483647) AS BIGINT) AS hits, min(position) AS position FROM obs WHERE committed GROUP BY ALL")
def learn_commits(spark, sf_dir):
    return learn.merged(learn.committed(observations(spark, sf_dir)))


@query(f"""{OBS}, big AS (SELECT * EXCLUDE (txn_id), role_oid % 3 AS txn_id FROM obs), f AS (SELECT txn_id, fingerprint, role_name, command_type, min(position) AS p FROM big GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY p, fingerprint, role_name, command_type) <= 12 AS kept FROM f) SELECT big.position, r.kept FROM big JOIN r USING (txn_id, fingerprint, role_name, command_type)""")
def learn_capacity(spark, sf_dir):
    return learn.capped(observations(spark, sf_dir, by="event_id").withColumn("txn_id", F.col("role_oid") % 3), 12).select("position", "kept")


@query(f"""{OBS}, w AS (SELECT *, sum(hits) OVER (PARTITION BY fingerprint, role_name, command_type ORDER BY position ROWS UNBOUNDED PRECEDING) AS total FROM obs WHERE committed)
SELECT fingerprint, role_name, command_type, position, CAST(total AS BIGINT) AS total FROM w WHERE total = 5""")
def threshold_cross(spark, sf_dir):
    return learn.threshold_crossings(learn.committed(observations(spark, sf_dir)), 5)


@query(f"""{OBS}, {_seed_sql().replace('SELECT ' + _digest('canonical', 'db_oid'), 'SELECT hit_count, auto_approval_disabled, ' + _digest('canonical', 'db_oid'))},
 e AS (SELECT fingerprint, role_name, command_type, sum(hits) AS h, max(learn_threshold) AS th FROM obs WHERE committed GROUP BY ALL)
SELECT fingerprint, role_name, command_type, CAST(least(coalesce(hit_count, 0) + coalesce(h, 0), 2147483647) AS INTEGER) AS hit_count,
 coalesce(is_approved, false) OR coalesce(th > 0 AND NOT coalesce(auto_approval_disabled, false) AND coalesce(hit_count, 0) + coalesce(h, 0) >= th, false) AS is_approved, coalesce(auto_approval_disabled, false) AS auto_approval_disabled
FROM seeds FULL JOIN e USING (fingerprint, role_name, command_type)""")
def hits_upsert(spark, sf_dir):
    return learn.upsert_hits(policy(spark).fingerprints, learn.committed(observations(spark, sf_dir)))


@query(f"""{BASE}, {APPROVALS} SELECT role_name, command_type, is_approved FROM approvals UNION ALL
SELECT DISTINCT role_name, command_type, true FROM stmts s WHERE committed AND NOT EXISTS (SELECT 1 FROM approvals a WHERE a.role_name = s.role_name AND a.command_type = s.command_type)""")
def learned_approvals(spark, sf_dir):
    events = learn.committed(log(spark, sf_dir)).select("role_name", "command_type", F.col("stmt_id").alias("position"))
    return learn.learned_approvals(policy(spark).approvals, events)


_HISTORY = [(1, "approvals", "UPDATE", "administrator", 2, "app_0", "SELECT", "app_0", "SELECT"), (2, "approvals", "DELETE", "administrator", 3, "app_1", "INSERT", None, None), (3, "approvals", "INSERT", "learn", 9, None, None, "app_2", "SELECT"), (4, "fingerprints", "TRUNCATE", "administrator", 9, None, None, None, None), (5, "approvals", "INSERT", "administrator", 4, None, None, "app_5", "UPDATE")]
_HISTORY_COLS = "change_id, policy_table, operation, source, policy_epoch, old_role_name, old_command_type, new_role_name, new_command_type"
_HISTORY_SQL = "history AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _HISTORY) + f") AS t({_HISTORY_COLS}))"


def _history(spark):
    rows = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}L" for v in r) + ")" for r in _HISTORY)
    return spark.sql(f"SELECT *, CAST(NULL AS STRING) AS old_fingerprint, CAST(NULL AS STRING) AS new_fingerprint FROM (VALUES {rows}) AS t({_HISTORY_COLS})")


@query(f"""{BASE}, {_HISTORY_SQL}, e AS (SELECT stmt_id, role_name, command_type, CASE WHEN stmt_id % 10 = 0 THEN 'fingerprints' ELSE 'approvals' END AS policy_table, stmt_id % 5 AS policy_epoch FROM stmts)
SELECT stmt_id FROM e WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.policy_table = e.policy_table AND source = 'administrator' AND h.policy_epoch > e.policy_epoch AND (operation = 'TRUNCATE' OR (old_role_name = role_name AND old_command_type = command_type) OR (new_role_name = role_name AND new_command_type = command_type)))""")
def stale_barrier(spark, sf_dir):
    events = log(spark, sf_dir).select("stmt_id", "role_name", "command_type", F.lit(None).cast("string").alias("fingerprint"), F.when(F.col("stmt_id") % 10 == 0, "fingerprints").otherwise("approvals").alias("policy_table"), (F.col("stmt_id") % 5).alias("policy_epoch"))
    return learn.stale(events, _history(spark)).select("stmt_id")


@query(f"{BASE} SELECT stmt_id FROM stmts WHERE role_oid NOT IN (103, 105)")
def role_identity(spark, sf_dir):
    roles = spark.range(12).select(F.format_string("app_%d", "id").alias("role_name"), F.when(F.col("id") == 3, 999).otherwise(100 + F.col("id")).alias("role_oid")).where("role_name <> 'app_5'")
    return learn.same_role(log(spark, sf_dir), roles).select("stmt_id")


@query(f"""{BASE}, {APPROVALS}, n AS (SELECT role_name, command_type, CASE WHEN role_name = 'app_4' THEN NOT is_approved ELSE is_approved END AS is_approved FROM approvals WHERE role_name <> 'app_7' UNION ALL SELECT DISTINCT role_name, 'COPY', true FROM stmts WHERE role_oid > 109)
SELECT role_name, command_type, a.is_approved AS old_is_approved, n.is_approved AS new_is_approved, CASE WHEN a.is_approved IS NULL THEN 'INSERT' WHEN n.is_approved IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM approvals a FULL JOIN n USING (role_name, command_type) WHERE a.is_approved IS DISTINCT FROM n.is_approved""")
def history_diff(spark, sf_dir):
    old = policy(spark).approvals
    new = old.where("role_name <> 'app_7'").withColumn("is_approved", F.when(F.col("role_name") == "app_4", ~F.col("is_approved")).otherwise(F.col("is_approved")))
    new = new.unionByName(log(spark, sf_dir).where("role_oid > 109").select("role_name", F.lit("COPY").alias("command_type"), F.lit(True).alias("is_approved")).distinct())
    return learn.history_diff(old, new, ["role_name", "command_type"], ["is_approved"])


@query(f"{BASE} SELECT stmt_id, CASE WHEN stmt_id % 3 <> 0 AND (stmt_id % 5 = 0) = (stmt_id % 7 = 0) THEN stmt_id % 2 <> 0 ELSE stmt_id % 7 = 0 END AS auto_approval_disabled FROM stmts")
def manual_denial(spark, sf_dir):
    i = F.col("stmt_id")
    updates = log(spark, sf_dir).select("stmt_id", (i % 3 != 0).alias("names_is_approved"), (i % 5 == 0).alias("old_auto_approval_disabled"), (i % 7 == 0).alias("new_auto_approval_disabled"), (i % 2 == 0).alias("new_is_approved"))
    return learn.manual_denial(updates).select("stmt_id", F.col("new_auto_approval_disabled").alias("auto_approval_disabled"))


@query(f"{BASE} SELECT policy_table, txn_id, min(stmt_id) AS first_change, row_number() OVER (PARTITION BY policy_table ORDER BY min(stmt_id)) AS policy_epoch FROM (SELECT *, command_type AS policy_table FROM stmts WHERE committed AND role_oid % 2 = 0) GROUP BY policy_table, txn_id")
def epoch_advance(spark, sf_dir):
    changes = log(spark, sf_dir).select(F.col("command_type").alias("policy_table"), "txn_id", "committed", F.col("stmt_id").alias("change_id"), F.when(F.col("role_oid") % 2 == 0, "administrator").otherwise("learn").alias("source"))
    return learn.epoch_advance(changes)


@query(f"{BASE} SELECT role_name, command_type, max(stmt_id) AS change_id, arg_max(txn_id, stmt_id) AS txn_id FROM stmts GROUP BY role_name, command_type")
def latest_decision(spark, sf_dir):
    return learn.latest_decision(log(spark, sf_dir).select("role_name", "command_type", F.col("stmt_id").alias("change_id"), "txn_id"), ["role_name", "command_type"])


_DEFAULTS = "(VALUES (1, 'd1', 'a'), (2, 'd2', 'b'), (3, 'd3', 'c'), (4, 'd4', 'd')) AS d(id, installation_default, pattern)"
_LOADED = "(VALUES (9, 'd1', 'x'), (2, 'zz', 'y'), (7, NULL, 'c')) AS l(id, installation_default, pattern)"


@query(f"SELECT id, installation_default, pattern FROM {_DEFAULTS} WHERE NOT EXISTS (SELECT 1 FROM {_LOADED} WHERE l.installation_default = d.installation_default OR l.id = d.id OR l.pattern = d.pattern)")
def default_displacement(spark, sf_dir):
    from ..operators import policy as policy_ops

    return policy_ops.displace_defaults(spark.sql(f"SELECT * FROM {_DEFAULTS}"), spark.sql(f"SELECT * FROM {_LOADED}"))


# --- audit

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@query(f"{BASE} SELECT stmt_id FROM stmts WHERE decided_at >= {_NOW} - INTERVAL 10 DAY")
def prune_age(spark, sf_dir):
    return audit.prune_age(log(spark, sf_dir), "decided_at", _now(), 10).select("stmt_id")


@query(f"{BASE} SELECT stmt_id FROM stmts ORDER BY decided_at DESC, stmt_id DESC LIMIT 500")
def prune_rows(spark, sf_dir):
    return audit.prune_rows(log(spark, sf_dir), "decided_at", "stmt_id", 500).select("stmt_id")


@query(f"{BASE} SELECT decided_at, stmt_id FROM stmts ORDER BY decided_at DESC, stmt_id DESC LIMIT 1 OFFSET 500")
def newest_cutoff(spark, sf_dir):
    return audit.newest_cutoff(log(spark, sf_dir), "decided_at", "stmt_id", 500)


@query(f"{BASE}, k AS (SELECT count(*) AS a, count(*) FILTER (WHERE decided_at >= {_NOW} - INTERVAL 10 DAY) AS b FROM stmts) SELECT a - b AS deleted_by_age, b - least(b, 500) AS deleted_by_rows, least(b, 500) AS rows_left FROM k")
def retention_status(spark, sf_dir):
    return audit.retention_counts(log(spark, sf_dir), "decided_at", "stmt_id", _now(), 10, 500)


@query(f"{BASE} SELECT stmt_id, decided_at FROM stmts ORDER BY decided_at, stmt_id LIMIT 1000")
def oldest_batch(spark, sf_dir):
    return audit.oldest_batch(log(spark, sf_dir), "decided_at", "stmt_id").select("stmt_id", "decided_at")


@query(f"{BASE} SELECT stmt_id AS position, CASE WHEN stmt_id >= 900 THEN 'not_yet_published' WHEN stmt_id < 388 THEN 'overwritten' ELSE 'ready' END AS state, CASE WHEN stmt_id < 388 THEN 388 END AS retained_from FROM stmts")
def ring_gap(spark, sf_dir):
    return audit.ring_read(log(spark, sf_dir).select(F.col("stmt_id").alias("position")), 900, 512)


_CASES = [(1, "missing", None, None, None, 7, 1, 10, 50), (2, "invalid", None, None, None, 7, 1, 10, 50), (3, "uninitialized", None, None, None, 7, 1, 10, 50), (4, "ready", 7, 1, 20, 7, 1, 10, 50), (5, "ready", 6, 1, 20, 7, 1, 10, 50), (6, "ready", 7, 2, 20, 7, 1, 10, 50), (7, "ready", 7, 1, 60, 7, 1, 10, 50), (8, "ready", 7, 1, 4, 7, 1, 10, 50), (9, "ready", 7, 1, 4, 7, None, 10, 50)]
_CASE_COLS = "case_id, stored_kind, generation, extension_oid, next_position, ring_generation, ring_extension_oid, ring_oldest, ring_write"
_CASE_ROWS = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _CASES) + f") AS t({_CASE_COLS})"


@query("SELECT * FROM (VALUES (1, 'unavailable', NULL, 0), (2, 'invalid', NULL, 0), (3, 'resume', 10, 0), (4, 'resume', 20, 0), (5, 'resume', 10, 0), (6, 'resume', 10, 0), (7, 'ahead', 60, 0), (8, 'resume', 10, 6), (9, 'extension_gone', NULL, 0)) AS t(case_id, state, resume_at, gap)")
def checkpoint_resume(spark, sf_dir):
    return audit.checkpoint_resume(spark.sql(f"SELECT * FROM {_CASE_ROWS}"))


@query(f"{BASE} SELECT count(*) AS write_position, greatest(count(*) - 1024, 0) AS slot_overwrites, 1024 AS capacity, count(*) FILTER (WHERE stmt_id % 3 = 0) AS approval_events, count(*) FILTER (WHERE stmt_id % 3 = 1) AS blocked_query_events, count(*) FILTER (WHERE stmt_id % 3 = 2) AS fingerprint_events, 0 AS learn_observations_dropped FROM stmts")
def queue_statistics(spark, sf_dir):
    kind = F.when(F.col("stmt_id") % 3 == 0, "approval").when(F.col("stmt_id") % 3 == 1, "blocked").otherwise("fingerprint")
    return audit.queue_statistics(log(spark, sf_dir).select(kind.alias("event_type")), 1024)


@query(f"{BASE} SELECT quantile_cont((stmt_id * 7919 % 2000) / 1000.0, 0.5) AS p50, quantile_cont((stmt_id * 7919 % 2000) / 1000.0, 0.99) AS p99 FROM stmts")
def lag_percentiles(spark, sf_dir):
    later = F.expr("decided_at + make_dt_interval(0, 0, 0, cast((stmt_id * 7919 % 2000) / 1000.0 AS DECIMAL(18, 6)))")
    return audit.lag_percentiles(log(spark, sf_dir).select("decided_at", later.alias("recorded_at")), "decided_at", "recorded_at")


@query(f"{BASE} SELECT database_name, count(*) AS published, count(*) FILTER (WHERE stmt_id % 9 > 1) AS written, count(*) FILTER (WHERE stmt_id % 9 = 0) AS skipped, count(*) FILTER (WHERE stmt_id % 9 = 1) AS rejected, true AS balanced FROM stmts GROUP BY database_name")
def audit_reconcile(spark, sf_dir):
    k = F.col("stmt_id") % 9
    counts = log(spark, sf_dir).groupBy("database_name").agg(F.count("*").alias("published"), F.count_if(k > 1).alias("written"), F.count_if(k == 0).alias("skipped"), F.count_if(k == 1).alias("rejected"))
    return audit.audit_reconcile(counts)


@query(f"WITH {APPROVALS} SELECT command_type, count(*) AS n, count(*) FILTER (WHERE NOT is_approved) AS n_pending FROM approvals GROUP BY command_type")
def approval_summary(spark, sf_dir):
    return audit.approval_summary(policy(spark).approvals)


@query(f"{BASE} SELECT role_name, string_agg(DISTINCT command_type, ',' ORDER BY command_type) AS commands, count(*) AS n FROM stmts GROUP BY role_name")
def role_summary(spark, sf_dir):
    return audit.role_summary(log(spark, sf_dir))


@query("SELECT o, w FROM (SELECT db_oid AS o, db_oid <= 20 AS w FROM (SELECT c_custkey AS db_oid, c_custkey % 7 <> 0 AS connectable, c_custkey % 11 = 0 AS is_template FROM customer WHERE c_custkey <= 40) WHERE connectable AND NOT is_template ORDER BY w, o LIMIT 32)".replace("SELECT o, w FROM", "SELECT o AS db_oid, w AS wrapped FROM"))
def keyset_page(spark, sf_dir):
    k = F.col("c_custkey")
    dbs = spark.read.parquet(f"{sf_dir}/customer.parquet").where(k <= 40).select(k.alias("db_oid"), (k % 7 != 0).alias("connectable"), (k % 11 == 0).alias("is_template"), F.lit("UTF8").alias("encoding"))
    return audit.keyset_page(dbs, 20)


@query(f"WITH {APPROVALS} SELECT role_name, command_type, is_approved FROM approvals WHERE role_name = 'app_4'")
def row_visibility(spark, sf_dir):
    return audit.visible(policy(spark).approvals, "app_4", ["readers"])


@query(f"{BASE} SELECT role_name, CAST(i - 1 AS BIGINT) AS row_no, ids[i] AS ids, commands[i] AS commands FROM (SELECT role_name, list(stmt_id ORDER BY stmt_id) AS ids, list(command_type ORDER BY stmt_id) AS commands FROM stmts WHERE stmt_id < 256 GROUP BY role_name), unnest(range(1, len(ids) + 1)) AS u(i)")
def zip_arrays(spark, sf_dir):
    rows = log(spark, sf_dir).where("stmt_id < 256").groupBy("role_name").agg(F.array_sort(F.collect_list(F.struct("stmt_id", "command_type"))).alias("m"))
    return audit.zipped(rows.select("role_name", F.col("m.stmt_id").alias("ids"), F.col("m.command_type").alias("commands")), "role_name", ["ids", "commands"])


# zip_arrays and keyset_page over whole tables; the two keep the id ranges of their SQL


@query(f"{BASE} SELECT role_name, CAST((n - 1) // 256 AS BIGINT) AS batch_no, CAST((n - 1) % 256 AS BIGINT) AS row_no, stmt_id AS ids, command_type AS commands FROM (SELECT *, row_number() OVER (PARTITION BY role_name ORDER BY stmt_id) AS n FROM stmts)")
def zip_arrays_whole(spark, sf_dir):
    rows = audit.batched(log(spark, sf_dir).select("role_name", "stmt_id", "command_type"), "role_name", "stmt_id")
    rows = rows.groupBy("role_name", "batch_no").agg(F.array_sort(F.collect_list(F.struct("stmt_id", "command_type"))).alias("m"))
    out = audit.zipped(rows.select(F.struct("role_name", "batch_no").alias("key"), F.col("m.stmt_id").alias("ids"), F.col("m.command_type").alias("commands")), "key", ["ids", "commands"])
    return out.select("key.role_name", "key.batch_no", "row_no", "ids", "commands")


@query("SELECT c_custkey AS db_oid, c_custkey <= 20 AS wrapped FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 ORDER BY wrapped, db_oid LIMIT 32")
def keyset_page_whole(spark, sf_dir):
    k = F.col("c_custkey")
    dbs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("db_oid"), (k % 7 != 0).alias("connectable"), (k % 11 == 0).alias("is_template"), F.lit("UTF8").alias("encoding"))
    return audit.keyset_page(dbs, 20)


@query(f"{BASE} SELECT stmt_id, row_number() OVER (ORDER BY decided_at, stmt_id) AS log_id FROM stmts")
def queue_order(spark, sf_dir):
    return audit.numbered(log(spark, sf_dir).select("stmt_id", "decided_at"), ["decided_at", "stmt_id"]).select("stmt_id", "log_id")


# --- shaping across rows, and what is inspected at all


@query(f"""{BASE}, r AS (SELECT stmt_id, query_text, CASE stmt_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 4000 END AS loc, CASE stmt_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 6 ELSE -2 END AS len FROM stmts)
SELECT stmt_id, CASE WHEN loc < 0 THEN query_text WHEN len < 0 OR loc > strlen(query_text) OR loc + len > strlen(query_text) THEN NULL WHEN len = 0 THEN substr(query_text, loc + 1) ELSE substr(query_text, loc + 1, len) END AS statement,
 CASE WHEN loc >= 0 AND (len < 0 OR loc > strlen(query_text) OR loc + len > strlen(query_text)) THEN 'XX000' END AS sqlstate FROM r""")
def statement_range(spark, sf_dir):
    i = F.col("stmt_id")
    loc = F.when(i % 4 == 0, -1).when(i % 4 == 1, 3).when(i % 4 == 2, 5).otherwise(4000)
    size = F.when(i % 3 == 0, 0).when(i % 3 == 1, 6).otherwise(-2)
    text, state = byte_range(F.col("query_text"), F.col("loc"), F.col("len"))
    return log(spark, sf_dir).select("stmt_id", "query_text", loc.alias("loc"), size.alias("len")).select("stmt_id", text.alias("statement"), state.alias("sqlstate"))


@query(f"""{BASE}, r AS (SELECT stmt_id, db_oid AS session_id, role_name AS source_text, stmt_id % 5 = 0 AS is_utility, CASE WHEN stmt_id % 5 = 0 THEN stmt_id % 100 WHEN stmt_id % 7 = 0 THEN 1 END AS location FROM stmts),
 w AS (SELECT *, last_value(CASE WHEN is_utility THEN location END IGNORE NULLS) OVER (PARTITION BY session_id, source_text ORDER BY stmt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM r)
SELECT stmt_id, CASE WHEN NOT is_utility AND location IS NULL THEN up ELSE location END AS location, NOT is_utility AND location IS NULL AND up IS NOT NULL AS inherited FROM w""")
def enclosing_span(spark, sf_dir):
    i = F.col("stmt_id")
    at = F.when(i % 5 == 0, i % 100).when(i % 7 == 0, 1)
    rows = log(spark, sf_dir).select("stmt_id", F.col("db_oid").alias("session_id"), F.col("role_name").alias("source_text"), (i % 5 == 0).alias("is_utility"), at.alias("location"), at.alias("length"))
    return shaping.enclosing_span(rows).select("stmt_id", "location", "inherited")


@query(f"{BASE} SELECT stmt_id, CASE stmt_id % 5 WHEN 0 THEN 'extension_created' WHEN 1 THEN 'trigger_changed' WHEN 2 THEN 'membership_changed' END AS change FROM stmts WHERE stmt_id % 5 < 3")
def catalog_changes(spark, sf_dir):
    i = F.col("stmt_id") % 5
    rows = log(spark, sf_dir).select("stmt_id", F.when(i == 0, "create").when(i == 1, "drop").when(i == 2, "alter").otherwise("create").alias("access"), F.when(i == 1, "trigger").when(i > 2, "table").otherwise("extension").alias("class"))
    return shaping.catalog_changes(rows).select("stmt_id", "change")


@query(f"{BASE} SELECT fault, count(*) AS n FROM (SELECT CASE WHEN client_addr IS NULL THEN 'address' WHEN stmt_id % 13 = 0 THEN 'number' WHEN length(query_text) > 60 THEN 'length' END AS fault FROM stmts) GROUP BY fault")
def poison_isolation(spark, sf_dir):
    number = F.when(F.col("stmt_id") % 13 == 0, "x").otherwise(F.col("stmt_id").cast("string"))
    checks = {"address": F.col("client_addr").isNotNull(), "number": number.try_cast("bigint").isNotNull(), "length": F.length("query_text") <= 60}
    return shaping.quarantined(log(spark, sf_dir), checks).groupBy("fault").agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT verdict, count(*) AS n FROM (SELECT CASE db_oid WHEN 1 THEN 'inspect' WHEN 2 THEN 'refuse' ELSE 'skip' END AS verdict FROM stmts) GROUP BY verdict")
def installation_state(spark, sf_dir):
    there = spark.sql("SELECT * FROM (VALUES (1L, 'active'), (2L, 'unavailable')) AS t(db_oid, state)")
    return shaping.installation_state(log(spark, sf_dir), there, "enforce").groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT stmt_id FROM stmts WHERE stmt_id % 6 NOT IN (1, 2) AND stmt_id % 11 <> 0 AND stmt_id % 17 <> 0")
def inspected_statements(spark, sf_dir):
    i = F.col("stmt_id")
    kind = F.when(i % 6 == 1, "parallel worker").when(i % 6 == 2, "logical replication").when(i % 6 == 3, "job worker").otherwise("client")
    rows = log(spark, sf_dir).withColumns({"backend_kind": kind, "is_superuser": i % 11 == 0, "family": F.when(i % 17 == 0, "ROLLBACK").otherwise(F.col("command_type"))})
    return gates.inspected(rows, Settings()).select("stmt_id")


@query(f"{BASE} SELECT stmt_id, CASE WHEN stmt_id % 3 = 0 AND command_type IN ('SELECT','INSERT','UPDATE','DELETE') THEN command_type WHEN stmt_id % 3 = 0 THEN 'OTHER' ELSE 'OTHER' END AS family FROM stmts")
def planned_family(spark, sf_dir):
    kind = F.when(F.col("stmt_id") % 3 == 0, F.col("command_type")).otherwise(F.lit("UTILITY"))
    return log(spark, sf_dir).select("stmt_id", families.planned_family(kind).alias("family"))


@query("""SELECT action, CASE WHEN starts_with(action, 'ALLOWED (PERMISSIVE') THEN 'would_block' WHEN starts_with(action, 'ALLOWED (LEARN') OR starts_with(action, 'LEARNED') THEN 'learn' WHEN starts_with(action, 'ALLOWED (OTHER)') THEN 'unchecked' ELSE 'allowed' END AS decision
FROM (VALUES ('ALLOWED'), ('ALLOWED (OTHER)'), ('ALLOWED (LEARN MODE - AUTO)'), ('LEARNED (FINGERPRINT AUTO)'), ('ALLOWED (PERMISSIVE - PENDING)')) AS t(action)""")
def decision_class(spark, sf_dir):
    actions = ["ALLOWED", "ALLOWED (OTHER)", "ALLOWED (LEARN MODE - AUTO)", "LEARNED (FINGERPRINT AUTO)", "ALLOWED (PERMISSIVE - PENDING)"]
    return spark.createDataFrame([(a,) for a in actions], "action string").select("action", decide.decision_class(F.col("action")).alias("decision"))


assert reduce(lambda a, b: a and b in QUERIES, ORACLE_SQL, True)
