"""The gates a statement passes, as columns: null where it passes, else the reason it is refused.

Policy sides are small tables an administrator writes; they are broadcast only
when Spark's own size check allows it, and joined by key or by rule otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexed, native_lex
from ..functions.text import ip_address, lower_ascii
from ..settings import Settings, ascii_lower, items, minute_of_day, normal_ip, role_ip

#: The texts of refusals, here and below.
NO_SOURCE = "executable plan has no SQL source text for policy inspection"
UNKNOWN_WRITE = "data-modifying CTE is of no known write command"
UNAVAILABLE = "policy catalog is unavailable"
TAUTOLOGY_REASON = "Query matched default injection pattern."
REGEX_REASON = "Query blocked by security regex pattern."


def _none() -> Column:
    return F.lit(None).cast("string")


def ip_reason(s: Settings, ip: Column, value: Column | None = None) -> Column:
    """Connections from a blocked address (by value; sockets never match). ``value``, here and below: ``ip_address`` as a column of its own."""
    blocked = [normal_ip(x) for x in items(s.blocked_ips)]
    if not (s.enable_ip_blocking and blocked):
        return _none()
    return F.when((ip_address(ip) if value is None else value).isin(blocked), F.format_string("Connection from blocked IP address '%s' is not allowed.", ip))


def app_reason(s: Settings, app: Column) -> Column:
    """Connections of a blocked application (ASCII case does not count)."""
    blocked = items(s.blocked_applications)
    if not (s.enable_application_blocking and blocked):
        return _none()
    return F.when(lower_ascii(app).isin([ascii_lower(x) for x in blocked]), F.format_string("Connections from application '%s' are not allowed.", app))


def binding_reason(s: Settings, role: Column, ip: Column, value: Column | None = None) -> Column:
    """Roles with bound addresses, from another one or from none."""
    pairs = [role_ip(x) for x in items(s.role_ip_bindings)]
    if not (s.enable_role_ip_binding and pairs):
        return _none()
    bound = role.isin(sorted({r for r, _ in pairs}))
    fits = F.coalesce(F.concat_ws("@", ip_address(ip) if value is None else value, role).isin([f"{a}@{r}" for r, a in pairs]), F.lit(False))
    return F.when(bound & ~fits, F.format_string("Role '%s' is not allowed to connect from IP '%s'.", role, F.coalesce(ip, F.lit("[local]"))))


def quiet_reason(s: Settings, at: Column, server_zone: str = "UTC") -> Column:
    """Statements in quiet hours: [start, end) within a day, else from start on or before end; equal bounds are all day."""
    if not s.enable_quiet_hours:
        return _none()
    start, end = minute_of_day(s.quiet_hours_start), minute_of_day(s.quiet_hours_end)
    if start is None or end is None:
        return F.lit("Quiet hours are enabled but quiet_hours_start and quiet_hours_end are not both set; the statement is refused.")
    local = F.convert_timezone(F.lit("UTC"), F.lit(s.quiet_hours_timezone or server_zone), at)
    minute = F.hour(local) * 60 + F.minute(local)
    inside = (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)
    return F.when(inside, F.lit(f"Blocked during quiet hours ({s.quiet_hours_start} - {s.quiet_hours_end})."))


def keyword_reason(s: Settings, text: Column, tokens: Column) -> Column:
    if not (s.enable_keyword_scan and s.keywords):
        return _none()
    return F.concat(F.lit("Blocked due to blacklisted keyword '"), lexed.keyword_hit(text, s.keywords, tokens), F.lit("'."))


def near(s: Settings, text: Column) -> Column:
    """Whether the keyword or tautology gate could find something in a text's tokens; the gates find nothing in others."""
    words = native_lex.near_keyword(text, s.keywords) if s.enable_keyword_scan else F.lit(False)
    return words | (native_lex.near_tautology(text) if s.enable_builtin_injection_check else F.lit(False))


def tautology_reason(s: Settings, text: Column, tokens: Column) -> Column:
    return F.when(lexed.tautology(text, tokens), F.lit(TAUTOLOGY_REASON)) if s.enable_builtin_injection_check else _none()


#: What stands for a PostgreSQL mark in Java's dialect: POSIX classes and word ends.
_JAVA = (
    *((f"[:{name.lower()}:]", f"\\p{{{name}}}") for name in ("Alpha", "Digit", "Alnum", "Upper", "Lower", "Space", "Punct", "XDigit", "Blank", "Cntrl", "Print", "Graph")),
    ("\\m", "\\b(?=\\w)"), ("\\M", "\\b(?<=\\w)"), ("\\y", "\\b"), ("\\Y", "\\B"),
)


def java_pattern(pattern: str) -> str:
    """A PostgreSQL regular expression in Java's dialect, without regard to case."""
    return "(?i)" + reduce(lambda p, x: p.replace(*x), _JAVA, pattern)


def java_pattern_column(pattern: Column) -> Column:
    """``java_pattern`` over a table of rules."""
    return F.concat(F.lit("(?i)"), reduce(lambda p, x: F.replace(p, F.lit(x[0]), F.lit(x[1])), _JAVA, pattern))


def rule_fault(pattern: str, spark: SparkSession | None = None) -> str | None:
    """Why a rule may not be stored: nested repetition, doubled quantifiers, or no regular expression of the dialect it runs in."""
    if re.search(r"\(\?[^)]*\{[^}]*\}[^)]*\)", pattern) or re.search(r"[*+]\+|\*\*|\+\*", pattern):
        return "pattern could take exponential time"
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a rule is compiled where it runs, which takes a session")
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except (IllegalArgumentException, Py4JJavaError) as e:
        return f"invalid pattern: {e}"
    return None


def pattern_refused(pattern: Column) -> Column:
    """The part of ``rule_fault`` that needs no compiling, for a table of candidates."""
    return pattern.rlike(r"\(\?[^)]*\{[^}]*\}[^)]*\)") | pattern.rlike(r"[*+]\+|\*\*|\+\*")


def regex_blocked(statements: DataFrame, rules: DataFrame) -> DataFrame:
    """Statements that an active rule matches whose role is not exempt: a semi-join on the pattern.

    ``rules`` has pattern (Java dialect), is_active and allowed_roles (the exempt ones, or null).
    """
    active = rules.where("is_active").select(F.col("pattern").alias("_pattern"), F.col("allowed_roles").alias("_exempt"))
    bare = F.filter("_exempt", lambda x: x.isNotNull())
    exempt = F.coalesce(F.array_contains(bare, F.col("role_name")), F.lit(False))
    return statements.join(active, F.expr("query_text rlike _pattern") & ~exempt, "left_semi")


#: Rules that are merged into the plan; a longer list is joined.
MAX_MERGED = 100


def regex_reason_column(rules: list[tuple[str, list[str] | None]], text: Column, role: Column) -> Column:
    """The same for ``MAX_MERGED`` rules at most, merged into the plan: no join, and evaluation stops at the first hit."""
    if not rules:
        return _none()
    if len(rules) > MAX_MERGED:
        raise ValueError(f"{len(rules)} rules are too many for one expression; join them (regex_blocked)")
    hit = reduce(lambda a, b: a | b, [text.rlike(java_pattern(p)) & (~role.isin(exempt) if exempt else F.lit(True)) for p, exempt in rules])
    return F.when(hit, F.lit(REGEX_REASON))


def inspected(statements: DataFrame, s: Settings) -> DataFrame:
    """Statements that are inspected at all: not blank ones, those of exempt workers, the filter's own, roll-backs, or bypassing superusers.

    A statement without any text is a plan without a source, which is refused later.

    Uses the columns backend_kind, is_internal, is_superuser and family where they are there.
    """
    if not s.enabled:
        return statements.where(F.lit(False))
    out = statements.where(F.col("query_text").isNull() | (F.btrim("query_text", F.lit(" \t\n\r\x0b\x0c")) != ""))
    have = set(statements.columns)
    if "backend_kind" in have:
        out = out.where(~F.coalesce(F.col("backend_kind").isin("parallel worker", "logical replication", "own worker"), F.lit(False)))
    if "is_internal" in have:
        out = out.where(~F.coalesce("is_internal", F.lit(False)))
    if "is_superuser" in have and s.allow_superuser_auth_bypass:
        out = out.where(~F.coalesce("is_superuser", F.lit(False)))
    if "family" in have:
        out = out.where(F.coalesce(F.col("family") != "ROLLBACK", F.lit(True)))
    return out
