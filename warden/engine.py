"""The surface for users: one object with the policy store, decisions, learning, audit and reports."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, decide, gates, learn
from .operators.policy import PolicyStore
from .settings import Settings

VERSION = "0.1.0"


@dataclass
class Engine:
    spark: SparkSession
    store: PolicyStore
    settings: Settings = field(default_factory=Settings)
    system_identifier: int = 0
    extension_oid: int = 0

    def status(self) -> str:
        return "disabled" if not self.settings.enabled else f"running in {self.settings.mode} mode"

    def version(self) -> DataFrame:
        return audit.one_row(self.spark, library_version=VERSION, running_version=VERSION)

    def configure(self, **changes) -> None:
        self.settings = replace(self.settings, **changes)

    def policy(self) -> decide.Policy:
        """The policy's newest snapshot; rules are read whole up to ``gates.MAX_MERGED``, more of them stay a table."""
        table = self.store.read("regex_rules").where("is_active and action = 'BLOCK'")
        rows = table.orderBy("id").limit(gates.MAX_MERGED + 1).collect()
        few = len(rows) <= gates.MAX_MERGED
        rules = tuple((r["pattern"], tuple(r["allowed_roles"]) if r["allowed_roles"] else None) for r in rows) if few else ()
        joined = None if few else table.withColumn("pattern", gates.java_pattern_column(F.col("pattern")))
        return decide.Policy(self.store.read("command_approvals"), self.store.read("query_fingerprints"), rules, self.system_identifier, self.extension_oid, joined)

    def decide(self, statements: DataFrame) -> DataFrame:
        return decide.decide(statements, self.settings, self.policy())

    def learn(self, statements: DataFrame, history: DataFrame | None = None, roles: DataFrame | None = None) -> None:
        """What decided statements teach goes into the policy (learn mode only); approvals that are there stay.

        ``history``: administrators' changes, which discard what was observed
        before them; ``roles``: today's OIDs, which discard what was observed of
        another role of the same name. The tables' snapshots follow each other:
        an interrupted call leaves each table whole, the second one unchanged.
        """
        if self.settings.mode != "learn":
            return
        if roles is not None:
            statements = learn.same_role(statements, roles)
        commands, hits = learn.observed(self.decide(statements), self.settings, self.store.read("query_fingerprints"))
        if history is not None:
            epoch = F.lit(0).cast("long")
            commands = learn.stale(commands.withColumns({"policy_table": F.lit("command_approvals"), "policy_epoch": epoch, "fingerprint": F.lit(None).cast("string")}), history)
            hits = learn.stale(hits.withColumn("policy_table", F.lit("query_fingerprints")), history)
        self.store.write("command_approvals", learn.learned_approvals(self.store.read("command_approvals"), commands))
        self.store.write("query_fingerprints", learn.upsert_hits(self.store.read("query_fingerprints"), hits))

    def clear_approval_cache(self) -> str:
        """Every decision reads the newest snapshot, so there is nothing to drop but what the session cached."""
        self.spark.catalog.clearCache()
        return "cleared"

    def policy_epoch(self, history: DataFrame, kind: str) -> DataFrame:
        """One row (kind, epoch): the newest epoch of a policy table's changes, 0 without any."""
        table = {"approvals": "command_approvals", "fingerprints": "query_fingerprints"}[kind]
        return history.where(F.col("policy_table") == table).agg(F.lit(kind).alias("kind"), F.coalesce(F.max("policy_epoch"), F.lit(0).cast("long")).alias("epoch"))

    def queue_statistics(self, events: DataFrame) -> DataFrame:
        return audit.queue_statistics(events, self.settings.activity_queue_size)

    def cleanup_activity_log(self, rows: DataFrame, now=None) -> DataFrame:
        """Rows that stay: by age, then by number."""
        now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
        aged = audit.prune_age(rows, "log_time", now, self.settings.activity_log_retention_days)
        return audit.prune_rows(aged, "log_time", "stmt_id", self.settings.activity_log_max_rows)

    def cleanup_blocked_queries(self, rows: DataFrame, days: int | None = None, now=None) -> DataFrame:
        """Rows that stay: by age (the setting's unless given; 0 days keep all)."""
        now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
        return audit.prune_age(rows, "blocked_at", now, self.settings.retention_days if days is None else days)

    def cleanup_all_logs(self, activity: DataFrame, blocked: DataFrame, activity_days: int = 30, blocked_days: int = 90, now=None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Both tables' rows that stay by age, and one row (activity_deleted, blocked_deleted)."""
        now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
        left = audit.prune_age(activity, "log_time", now, activity_days), audit.prune_age(blocked, "blocked_at", now, blocked_days)
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        counts = n(activity, "a").crossJoin(n(left[0], "b")).crossJoin(n(blocked, "c")).crossJoin(n(left[1], "d"))  # one row each
        return *left, counts.select((F.col("a") - F.col("b")).alias("activity_deleted"), (F.col("c") - F.col("d")).alias("blocked_deleted"))

    def truncate_logs(self, activity: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both tables without rows; superusers only."""
        self.store._guard()
        return activity.limit(0), blocked.limit(0)
