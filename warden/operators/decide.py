"""The decision: gates in order, then command approval, then fingerprint approval, in one of three modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import families, lexed, native_lex
from ..functions.text import ip_address, utf8_cut, utf8_prefix
from ..settings import Settings
from . import gates, rate, shaping

QUERY_BYTES = 2047
SAMPLE_BYTES = 511


@dataclass(frozen=True)
class Policy:
    """The tables a decision reads: one snapshot for a batch."""

    approvals: DataFrame  # role_name, command_type, is_approved
    fingerprints: DataFrame | None = None  # fingerprint, role_name, command_type, is_approved
    rules: tuple[tuple[str, tuple[str, ...] | None], ...] = ()  # (pattern, exempt roles)
    system_identifier: int = 0
    extension_oid: int = 0
    rule_table: DataFrame | None = None  # pattern (Java dialect), is_active, allowed_roles: more rules than are merged into the plan


def decision_class(action: Column) -> Column:
    """What an action's text counts as in the audit table."""
    return (
        F.when(action.startswith("ALLOWED (PERMISSIVE"), "would_block").when(action.startswith("ALLOWED (LEARN") | action.startswith("LEARNED"), "learn")
        .when(action.startswith("ALLOWED (OTHER)"), "unchecked").otherwise("allowed")
    )


def fingerprinted(statements: DataFrame, policy: Policy) -> DataFrame:
    """Statements with their canonical text and fingerprint; both are null, and canonical_sqlstate is set, where the text has no single reading."""
    if "_tokens" not in statements.columns:
        statements = lexed.with_tokens(statements)
    return statements.withColumnRenamed("_canonical", "canonical").drop("_tokens").withColumn("fingerprint", _digest(F.col("canonical"), policy))


def _digest(canonical: Column, policy: Policy) -> Column:
    return native_lex.fingerprint(canonical, F.lit(policy.system_identifier), F.col("db_oid"), F.lit(policy.extension_oid))


def gate_reasons(statements: DataFrame, s: Settings, policy: Policy, server_zone: str = "UTC", staged: Column | None = None, prints: bool = True) -> DataFrame:
    """Statements with gate_reason and sqlstate of the first gate that refuses; the order is part of the semantics.

    A text is read where a gate that no earlier one forestalls could find
    something in its tokens (_need), and where ``staged`` is true and no gate
    that needs no tokens refuses: for the fingerprint (``prints``), or only to
    know whether it has a single reading.
    """
    c = F.col
    rules = gates.regex_reason_column([(p, list(x) if x else None) for p, x in policy.rules] if s.enable_regex_scan else [], c("query_text"), c("role_name"))
    if s.enable_regex_scan and policy.rule_table is not None:
        hit = gates.regex_blocked(statements.select("stmt_id", "query_text", "role_name"), policy.rule_table).select(c("stmt_id").alias("_hit")).distinct()
        statements = statements.join(hit, c("stmt_id") == c("_hit"), "left")
        rules = F.coalesce(rules, F.when(c("_hit").isNotNull(), F.lit(gates.REGEX_REASON)))
    source = F.when(c("query_text").isNull(), F.lit(gates.NO_SOURCE))
    if "cte_families" in statements.columns:
        source = F.coalesce(source, F.when(families.unknown_inner(c("cte_families")), F.lit(gates.UNKNOWN_WRITE)))
    session = F.coalesce(gates.ip_reason(s, c("client_addr"), c("_ip")), gates.app_reason(s, c("application_name")), gates.binding_reason(s, c("role_name"), c("client_addr"), c("_ip")))
    # each reason is a column of its own, so that it is worked out once
    first = lambda *steps: F.coalesce(*[F.when(c(reason).isNotNull(), F.struct(c(reason).alias("reason"), F.lit(state).alias("sqlstate"))) for reason, state in steps])
    out = statements.withColumn("_ip", ip_address(c("client_addr"))).withColumns({"_source": source, "_session": session, "_quiet": gates.quiet_reason(s, c("decided_at"), server_zone)})
    out = out.withColumn("_early", first(("_source", "0A000"), ("_session", "42501"), ("_quiet", "42501"))).drop("_ip", "_source", "_session", "_quiet")
    out = out.withColumn("_rule", F.when(c("_early").isNull(), rules))
    later = c("_early").isNull() & c("_rule").isNull() & (F.lit(False) if staged is None else F.coalesce(staged, F.lit(False)))
    out = out.withColumns({"_later": later, "_need": c("_early").isNull() & F.coalesce(gates.near(s, c("query_text")), F.lit(False)) | (later if prints else F.lit(False))})
    out = lexed.with_tokens(out, need=c("_need"), state=c("_later"))
    scans = {"_keyword": gates.keyword_reason(s, c("query_text"), c("_tokens")), "_tautology": gates.tautology_reason(s, c("query_text"), c("_tokens"))}
    out = out.withColumns({k: F.when(c("_need"), x) for k, x in scans.items()})
    out = out.withColumn("_gate", F.coalesce("_early", first(("_keyword", "42000"), ("_tautology", "42501"), ("_rule", "42501")))).drop(*scans)
    return out.withColumns({"gate_reason": c("_gate.reason"), "gate_sqlstate": c("_gate.sqlstate")}).drop("_early", "_rule", "_later", "_gate", "_hit", "_tokens")


def decide(statements: DataFrame, s: Settings, policy: Policy, server_zone: str = "UTC", rates: DataFrame | None = None, installed: DataFrame | None = None) -> DataFrame:
    """Every inspected statement with decision, action, reason, sqlstate, fingerprint, and fingerprint_action for a second audit row.

    Approvals and fingerprints are left-joined by key. Where they are small
    Spark broadcasts them; else both sides are shuffled by key. A statement with
    ``cte_families`` is inspected once for itself and once for each distinct
    write inside (``inspection_no``). ``rates``: windows that earlier statements
    left open (``rate.STATE``); rows then carry theirs. ``installed`` (db_oid,
    state): databases without it are not inspected; where its catalog is
    unavailable, enforce mode refuses (55000) and the others stop.
    """
    c = F.col
    rows = gates.inspected(statements, s)
    if installed is not None:
        rows = shaping.installation_state(rows, installed, s.mode).where("verdict in ('inspect', 'refuse')")
    if "cte_families" in rows.columns:
        rows = families.fan_out(rows.drop("family")).withColumn("command_type", c("family")).drop("family")
    if s.mode != "learn":
        return _shown(_judged(rows, s, policy, server_zone, rates, installed), policy)
    # the first observation of a key that has no row in the snapshot; keys are looked up, not statements. The statements that are shown meet
    # them before their own texts are looked at: narrow, and as they are dealt already
    firsts = _judged(rows, s, policy, server_zone, rates, installed).where("_staged").groupBy("fingerprint", "role_name", c("command_type").alias("_command")).agg(F.min("stmt_id").alias("_first"))
    if policy.fingerprints is not None:
        known = policy.fingerprints.where("is_approved is not null").select(c("fingerprint").alias("_ff"), c("role_name").alias("_fr"), c("command_type").alias("_fc"))
        firsts = firsts.join(known, (c("fingerprint") == c("_ff")) & (c("role_name") == c("_fr")) & (c("_command") == c("_fc")), "left_anti")
    firsts = firsts.groupBy("_first").agg(F.collect_set("_command").alias("_commands"))
    rows = _judged(rows.join(firsts, c("stmt_id") == c("_first"), "left").drop("_first"), s, policy, server_zone, rates, installed, prints=False)
    return _shown(rows, policy)


def _judged(rows: DataFrame, s: Settings, policy: Policy, server_zone: str, rates: DataFrame | None, installed: DataFrame | None, prints: bool = True) -> DataFrame:
    """Inspections with action, reason, gate_sqlstate, fingerprint_action, _staged, and, unless no ``prints`` are wanted, the fingerprint that was looked up."""
    c = F.col
    approvals = policy.approvals.select(c("role_name").alias("_ar"), c("command_type").alias("_ac"), c("is_approved").alias("_approved"))
    rows = rows.join(approvals, (c("role_name") == c("_ar")) & (c("command_type") == c("_ac")), "left").drop("_ar", "_ac")
    other = (c("command_type") == "OTHER") & F.lit(s.mode != "enforce")
    staged = F.lit(s.enable_fingerprint_learning) & ~other & c("role_name").isNotNull() & (c("_approved") if s.mode == "enforce" else F.lit(True))
    rows = gate_reasons(rows, s, policy, server_zone, staged, prints)
    if installed is not None:
        lost = c("verdict") == "refuse"
        rows = rows.withColumns({"gate_reason": F.when(lost, F.lit(gates.UNAVAILABLE)).otherwise(c("gate_reason")), "gate_sqlstate": F.when(lost, F.lit("55000")).otherwise(c("gate_sqlstate"))}).drop("verdict")
    if rate.limited(s):
        open_ = rate.rate_reasons(rows.where("gate_reason is null and role_name is not null"), s, rates)
        rest = rows.where("gate_reason is not null or role_name is null")
        rows = open_.unionByName(rest.withColumn("rate_reason", F.lit(None).cast("string")), allowMissingColumns=True)
        rows = rows.withColumns({"gate_sqlstate": F.coalesce("gate_sqlstate", F.when(c("rate_reason").isNotNull(), "53400")), "gate_reason": F.coalesce("gate_reason", "rate_reason")}).drop("rate_reason")
    rows = rows.withColumn("fingerprint", _digest(c("_canonical"), policy))
    if policy.fingerprints is not None and s.mode != "learn":
        known = policy.fingerprints.select(c("fingerprint").alias("_ff"), c("role_name").alias("_fr"), c("command_type").alias("_fc"), c("is_approved").alias("_fp"))
        rows = rows.join(known, (c("fingerprint") == c("_ff")) & (c("role_name") == c("_fr")) & (c("command_type") == c("_fc")), "left")
    else:
        rows = rows.withColumn("_fp", F.lit(None).cast("boolean"))
    role, command = F.coalesce(c("role_name"), F.lit("unknown")), c("command_type")
    gated, nobody = c("gate_reason").isNotNull(), c("role_name").isNull()
    none, pending = c("_approved").isNull(), ~c("_approved")
    quote = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    allowed = {
        "learn": (("ALLOWED (LEARN MODE - AUTO)", "Command type auto-approved in learn mode"), ("ALLOWED (LEARN MODE - PENDING)", "Command type approval pending but allowed in learn mode")),
        "permissive": (("ALLOWED (PERMISSIVE - UNAPPROVED)", "No rule for command type"), ("ALLOWED (PERMISSIVE - PENDING)", "Command type approval pending")),
        "enforce": (("BLOCKED", quote("No rule found for command '", command, "' for role '", role, "'")), ("BLOCKED", quote("BLOCKED - Approval for command '", command, "' is pending for role '", role, "'"))),
    }[s.mode]
    pick = lambda k: F.when(none, allowed[0][k]).when(pending, allowed[1][k])
    action = F.when(gated, "BLOCKED").when(other, "ALLOWED (OTHER)").when(nobody, "ALLOWED").otherwise(F.coalesce(pick(0), F.lit("ALLOWED")))
    reason = F.when(gated, c("gate_reason")).when(other, "Uncommon utility command - automatically allowed in non-enforce mode").when(nobody, "Role unknown").otherwise(F.coalesce(pick(1), F.lit("Approved command type")))
    rows = rows.withColumns({"action": action, "reason": reason})
    # an allowed command whose text has no single reading has no fingerprint to look up and is refused in every mode
    refused = F.lit(s.enable_fingerprint_learning) & ~gated & ~other & ~nobody & (c("action") != "BLOCKED") & c("canonical_sqlstate").isNotNull()
    rows = rows.withColumn("_stop", refused).withColumns({
        "reason": F.when(c("_stop"), lexed.refusal()).otherwise(c("reason")), "action": F.when(c("_stop"), "BLOCKED").otherwise(c("action")),
        "gate_sqlstate": F.when(c("_stop"), c("canonical_sqlstate")).otherwise(c("gate_sqlstate")),
    }).drop("_stop")
    # the fingerprint stage: of allowed commands, unless nothing is known to look up
    rows = rows.withColumn("_staged", F.lit(s.enable_fingerprint_learning) & ~gated & ~other & ~nobody & (c("action") != "BLOCKED") & ~F.coalesce(c("_fp"), F.lit(False)))
    if s.mode == "enforce":
        pending_text = quote("Fingerprint '", c("fingerprint"), "' for role '", role, "' is pending approval.")
        rows = rows.withColumns({"reason": F.when(c("_staged"), pending_text).otherwise(c("reason")), "action": F.when(c("_staged"), "BLOCKED").otherwise(c("action"))})
        rows = rows.withColumn("fingerprint_action", F.lit(None).cast("string"))
    elif s.mode == "permissive":
        rows = rows.withColumn("fingerprint_action", F.when(c("_staged"), "ALLOWED (PERMISSIVE - FINGERPRINT)"))
    elif "_commands" in rows.columns:
        rows = rows.withColumn("fingerprint_action", F.when(F.array_contains("_commands", command), "LEARNED (FINGERPRINT AUTO)")).drop("_commands")
    return rows.drop("_approved", "_ff", "_fr", "_fc", "_fp", "gate_reason")


def _shown(rows: DataFrame, policy: Policy) -> DataFrame:
    """Judged rows with decision and sqlstate, and every text's canonical form and fingerprint: those that no step above read are read here, if the columns are asked for."""
    c = F.col
    decision = F.when(c("action") == "BLOCKED", "blocked").otherwise(decision_class(c("action")))
    rows = rows.withColumns({"decision": decision, "sqlstate": F.when(c("action") == "BLOCKED", F.coalesce("gate_sqlstate", F.lit("42501")))})
    rows = rows.withColumnRenamed("_canonical", "_looked").drop("gate_sqlstate", "canonical_sqlstate", "_staged")
    rows = lexed.with_tokens(rows, need=~c("_need")).withColumn("canonical", F.coalesce("_looked", "_canonical"))
    return rows.withColumn("fingerprint", _digest(c("canonical"), policy)).drop("_looked", "_need", "_tokens", "_canonical", "canonical_sqlstate")


def activity_rows(decided: DataFrame) -> DataFrame:
    """Audit rows of allowed statements: the fingerprint's, then the command's (row_no orders them)."""
    c = F.col
    base = decided.where("decision <> 'blocked'")
    extra = F.when(c("fingerprint_action").isNotNull(), F.struct(F.lit(0).alias("row_no"), c("fingerprint_action").alias("action"),
        F.when(c("fingerprint_action").startswith("LEARNED"), "Learn mode - new fingerprint observed; approval awaits threshold").otherwise("Fingerprint pending approval").alias("reason")))
    every = F.array_compact(F.array(extra, F.struct(F.lit(1).alias("row_no"), c("action").alias("action"), c("reason").alias("reason"))))
    rows = base.select("*", F.explode(every).alias("_row"))
    return rows.select(
        "stmt_id", c("_row.row_no").alias("row_no"), c("decided_at").alias("log_time"), "role_name", "database_name", utf8_prefix(c("query_text"), QUERY_BYTES).alias("query_text"),
        utf8_cut(c("query_text"), QUERY_BYTES).alias("query_truncated"), "application_name", c("client_addr").alias("client_ip"), "command_type",
        c("_row.action").alias("action"), c("_row.reason").alias("reason"), decision_class(c("_row.action")).alias("decision"),
    )


def blocked_rows(decided: DataFrame) -> DataFrame:
    """Audit rows of refused statements, one each."""
    c = F.col
    return decided.where("decision = 'blocked'").select(
        "stmt_id", c("decided_at").alias("blocked_at"), "role_name", "database_name", utf8_prefix(c("query_text"), QUERY_BYTES).alias("query_text"),
        utf8_cut(c("query_text"), QUERY_BYTES).alias("query_truncated"), "application_name", "client_addr", "command_type", "reason", "decision",
    )


def block_payload(blocked: DataFrame) -> DataFrame:
    """(stmt_id, payload): what is told of a refusal with full context; keys in a fixed order, no statement text."""
    u = lambda x: F.coalesce(F.col(x), F.lit("unknown")).alias
    body = F.struct(F.lit("query_block").alias("event"), u("role_name")("role"), u("database_name")("database"), F.col("command_type").alias("command"), "reason", u("application_name")("application"), u("client_addr")("client_ip"))
    return blocked.select("stmt_id", F.to_json(body).alias("payload"))


def notify_payload(blocked: DataFrame, id_col: str = "stmt_id") -> DataFrame:
    """(id, payload): event, row and command only, since anyone may listen."""
    return blocked.select(id_col, F.to_json(F.struct(F.lit("query_block").alias("event"), F.col(id_col).alias("block_id"), F.col("command_type").alias("command"))).alias("payload"))


def quiet_hours_line(statements: DataFrame, s: Settings) -> DataFrame:
    return statements.select("stmt_id", F.format_string(f"[POLICY][QUIET_HOURS][user=%s][db=%s][cmd=%s] Blocked during {s.quiet_hours_start}-{s.quiet_hours_end} window", F.coalesce("role_name", F.lit("unknown")), F.coalesce("database_name", F.lit("unknown")), "command_type").alias("line"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
