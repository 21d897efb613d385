"""Learning: committed observations, thresholds, stale events, and policy history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf8_cut, utf8_prefix
from ..settings import Settings

MAX_HITS = 2147483647
TXN_CAP = 1024
KEY = ["fingerprint", "role_name", "command_type"]


def committed(observations: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Observations of committed transactions; ``outcomes`` (txn_id, committed), or the column of that name."""
    if outcomes is None:
        return observations.where("committed")
    return observations.drop("committed").join(outcomes.where("committed").select("txn_id"), "txn_id", "left_semi")


def merged(observations: DataFrame) -> DataFrame:
    """Within a transaction: hits of one key, threshold and epoch added up (saturating), at the first one's position."""
    return observations.groupBy("txn_id", *KEY, "learn_threshold", "policy_epoch").agg(
        F.least(F.sum("hits"), F.lit(MAX_HITS)).cast("long").alias("hits"), F.min("position").alias("position")
    )


def capped(observations: DataFrame, cap: int = TXN_CAP) -> DataFrame:
    """Observations with kept: a transaction's distinct keys up to ``cap``, by first position; the others are counted as dropped."""
    firsts = observations.groupBy("txn_id", *KEY).agg(F.min("position").alias("_first"))
    ranked = firsts.withColumn("kept", F.row_number().over(Window.partitionBy("txn_id").orderBy("_first", *KEY)) <= cap).drop("_first")
    return observations.join(ranked, ["txn_id", *KEY])


#: What a fingerprint's row tells of the statements seen, beside its counts.
SEEN = ("normalized_query", "sample_query", "first_seen_at", "last_seen_at")


#: Positions that are summed up by themselves.
REACH = 65536


def _own_thresholds(events: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, _hits, _margin): all hits, and the most by which hits up to an event exceed that event's own threshold.

    The events are read once. Ranges of ``reach`` positions are summed up by
    themselves and what comes before each is added, so no task sorts a whole key.
    Events of one position count together; those without any count for no threshold.
    """
    c = F.col
    if "position" not in events.columns:
        events = events.groupBy(*KEY, "learn_threshold").agg(F.sum("hits").alias("hits")).withColumn("position", F.lit(0))
    placed = F.when(c("position").isNotNull(), c("hits"))
    rows = events.select(*KEY, "position", "hits", "learn_threshold", placed.alias("_placed"), F.floor(c("position") / reach).alias("_range"))
    inside = Window.partitionBy(*KEY, "_range").orderBy("position").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.when(c("position").isNotNull() & (c("learn_threshold") > 0), F.sum("_placed").over(inside) - c("learn_threshold"))
    sums = rows.withColumn("_over", over).groupBy(*KEY, "_range").agg(F.sum("hits").alias("_n"), F.sum("_placed").alias("_p"), F.max("_over").alias("_over"))
    before = F.coalesce(F.sum("_p").over(Window.partitionBy(*KEY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_over", before + c("_over"))
    return sums.groupBy(*KEY).agg(F.least(F.sum("_n"), F.lit(MAX_HITS)).alias("_hits"), F.max("_over").alias("_margin"))


def upsert_hits(table: DataFrame, events: DataFrame) -> DataFrame:
    """The fingerprint table after the events (key, hits, learn_threshold, position): counts saturate, and an event whose own threshold is reached approves unless denied.

    With ``seen_at``, ``normalized_query`` and ``sample_query`` in the events the
    table's columns of ``SEEN`` are kept up, too: texts are the first event's.
    """
    both = table.join(_own_thresholds(events), KEY, "full_outer")
    old = F.coalesce("hit_count", F.lit(0)).cast("long")
    total = F.least(old + F.coalesce("_hits", F.lit(0)), F.lit(MAX_HITS)).cast("int")
    denied = F.coalesce("auto_approval_disabled", F.lit(False))
    reached = ~denied & F.coalesce(old + F.col("_margin") >= 0, F.lit(False))
    out = [total.alias("hit_count"), (F.coalesce("is_approved", F.lit(False)) | reached).alias("is_approved"), denied.alias("auto_approval_disabled")]
    if "seen_at" not in events.columns:
        return both.select(*KEY, *out)
    text = lambda name: F.min_by(name, "position").alias(f"_{name}")
    seen = events.groupBy(*KEY).agg(text("normalized_query"), text("sample_query"), F.min("seen_at").alias("_first"), F.max("seen_at").alias("_until"))
    had = [c if c in table.columns else None for c in SEEN]
    was = [F.lit(None) if c is None else F.col(c) for c in had]
    now = [F.coalesce(was[0], F.col("_normalized_query")), F.coalesce(was[1], F.col("_sample_query")), F.coalesce(was[2], F.col("_first")), F.coalesce(F.col("_until"), was[3])]
    return both.join(seen, KEY, "left").select(*KEY, *out, *[c.alias(name) for c, name in zip(now, SEEN, strict=True)])


def normalized_query(canonical: Column) -> Column:
    """The canonical text as it is stored: with its version, and in 1,023 bytes."""
    return utf8_prefix(F.concat(F.lit("v3: "), canonical), 1023)


def learn_sample(text: Column) -> Column:
    """A learned statement's sample: 512 bytes and an ellipsis, in 511 bytes."""
    return utf8_prefix(F.when(utf8_cut(text, 512), F.concat(utf8_prefix(text, 512), F.lit("..."))).otherwise(text), 511)


def observed(decided: DataFrame, s: Settings, fingerprints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What decided statements teach: commands (role_name, command_type, position) and fingerprint hits.

    Only learn mode teaches, and only statements that were allowed, of known
    roles and commands, in committed transactions; approved fingerprints are not
    counted any more. Hits are merged by transaction and capped.
    """
    rows = committed(decided.where(F.lit(s.mode == "learn")).where("decision <> 'blocked' and command_type <> 'OTHER' and role_name is not null")).withColumn("position", F.col("stmt_id"))
    commands = rows.where("action = 'ALLOWED (LEARN MODE - AUTO)'").select("role_name", "command_type", "position")
    hits = rows.where(F.lit(s.enable_fingerprint_learning)).where("fingerprint is not null")
    if fingerprints is not None:
        hits = hits.join(fingerprints.where("is_approved").select(*KEY), KEY, "left_anti")
    told = ["seen_at", "normalized_query", "sample_query"]
    hits = hits.select("txn_id", *KEY, "position", F.col("decided_at").alias(told[0]), normalized_query(F.col("canonical")).alias(told[1]), learn_sample(F.col("query_text")).alias(told[2]))
    once = hits.groupBy("txn_id", *KEY).agg(F.count("position").alias("hits"), F.min("position").alias("position"), F.max(told[0]).alias(told[0]), *[F.min_by(c, "position").alias(c) for c in told[1:]])
    once = once.withColumns({"learn_threshold": F.lit(s.fingerprint_learn_threshold), "policy_epoch": F.lit(0).cast("long")})
    return commands, capped(once).where("kept").drop("kept")


def threshold_crossings(events: DataFrame, threshold: int) -> DataFrame:
    """(key, position, total): the event at which a key's running hits reach the threshold."""
    w = Window.partitionBy(*KEY).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = events.withColumn("total", F.sum("hits").over(w))
    return running.where((F.col("total") >= threshold) & (F.col("total") - F.col("hits") < threshold)).select(*KEY, "position", "total")


def learned_approvals(table: DataFrame, events: DataFrame) -> DataFrame:
    """The approval table after learned commands: rows that are there stay, new ones are inserted once."""
    new = events.groupBy("role_name", "command_type").agg(F.min("position").alias("_p")).join(table, ["role_name", "command_type"], "left_anti")
    return table.select("role_name", "command_type", "is_approved").unionByName(new.select("role_name", "command_type", F.lit(True).alias("is_approved")))


def stale(events: DataFrame, history: DataFrame) -> DataFrame:
    """Events that survive: an administrator's later change to the same key, or a truncation, discards them (equal epochs apply)."""
    e, h = events.alias("e"), history.where("source = 'administrator'").alias("h")
    same = lambda side: (F.col(f"h.{side}_role_name") == F.col("e.role_name")) & (F.col(f"h.{side}_command_type") == F.col("e.command_type")) & F.col(f"h.{side}_fingerprint").eqNullSafe(F.col("e.fingerprint"))
    # truncations by table need no key; the rest is an equi-join by table and key, each side of a change once
    cut = h.where("operation = 'TRUNCATE'").groupBy("policy_table").agg(F.max("policy_epoch").alias("cut_epoch")).alias("c")
    out = e.join(cut, (F.col("e.policy_table") == F.col("c.policy_table")) & (F.col("c.cut_epoch") > F.col("e.policy_epoch")), "left_anti")
    for side in ("old", "new"):
        changed = h.where(f"operation <> 'TRUNCATE' and {side}_role_name is not null")
        out = out.alias("e").join(changed, (F.col("e.policy_table") == F.col("h.policy_table")) & same(side) & (F.col("h.policy_epoch") > F.col("e.policy_epoch")), "left_anti")
    return out


def same_role(events: DataFrame, roles: DataFrame) -> DataFrame:
    """Events whose role name still has the OID it was observed with; ``roles`` has role_name, role_oid."""
    now = roles.select(F.col("role_name").alias("_r"), F.col("role_oid").alias("_o"))
    return events.join(now, (F.col("role_name") == F.col("_r")) & (F.col("role_oid") == F.col("_o")), "left_semi")


def history_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, operation, old_*, new_*): what changed between two snapshots."""
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_was"))
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_is"))
    both = o.join(n, keys, "full_outer")
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    op = F.when(F.col("_was").isNull(), "INSERT").when(F.col("_is").isNull(), "DELETE").when(changed, "UPDATE")
    return both.withColumn("operation", op).where("operation is not null").drop("_was", "_is")


def manual_denial(updates: DataFrame) -> DataFrame:
    """An administrator's update that names is_approved and leaves auto_approval_disabled sets the latter to its opposite."""
    named = F.col("names_is_approved") & F.col("old_auto_approval_disabled").eqNullSafe(F.col("new_auto_approval_disabled"))
    return updates.withColumn("new_auto_approval_disabled", F.when(named, ~F.col("new_is_approved")).otherwise(F.col("new_auto_approval_disabled")))


def epoch_advance(changes: DataFrame) -> DataFrame:
    """Each committed administrator transaction's epoch by table (the first is 1)."""
    firsts = changes.where("source = 'administrator' and committed").groupBy("policy_table", "txn_id").agg(F.min("change_id").alias("first_change"))
    return firsts.withColumn("policy_epoch", F.row_number().over(Window.partitionBy("policy_table").orderBy("first_change")).cast("long"))


def latest_decision(history: DataFrame, keys: list[str]) -> DataFrame:
    """The last history row of each key."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), "change_id").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
