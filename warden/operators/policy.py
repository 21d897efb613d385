"""Administration of the policy tables: every change is a new snapshot, built from the old one.

Parquet tables have no UPDATE or DELETE, so a store keeps numbered snapshot
folders; the newest one with a complete write is the table. Only superusers may
change policy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from .gates import rule_fault

TABLES = {"command_approvals": schema.COMMAND_APPROVALS, "query_fingerprints": schema.QUERY_FINGERPRINTS, "regex_rules": schema.REGEX_RULES}


class NotAllowed(PermissionError):
    """A change by a session that is no superuser (42501)."""

    sqlstate = "42501"


def displace_defaults(defaults: DataFrame, loaded: DataFrame) -> DataFrame:
    """Default rules that no loaded rule displaces, by key, id or pattern: one anti-join for each, so all are equi-joins."""
    out = defaults
    for col in ("installation_default", "id", "pattern"):
        out = out.join(loaded.select(F.col(col).alias(f"_{col}")).distinct(), F.col(col) == F.col(f"_{col}"), "left_anti")
    return out


def upsert(table: DataFrame, keys: dict[str, object], values: dict[str, object]) -> DataFrame:
    """The table with one row changed, or added if it is not there."""
    same = F.lit(True)
    for k, v in keys.items():
        same = same & (F.col(k) == v)
    spark = table.sparkSession
    row = spark.range(1).select(*[F.lit({**keys, **values}.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema])
    return table.where(~F.coalesce(same, F.lit(False))).unionByName(row)


def update(table: DataFrame, keys: dict[str, object], values: dict[str, object]) -> DataFrame:
    """The table with the rows of a key changed; no row, no change."""
    same = F.lit(True)
    for k, v in keys.items():
        same = same & (F.col(k) == v)
    return table.withColumns({c: F.when(same, F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


@dataclass
class PolicyStore:
    """Policy tables as snapshot folders under ``path`` (a folder all executors share)."""

    spark: SparkSession
    path: str
    superuser: bool = False
    versions: dict[str, int] = field(default_factory=dict)

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self, name: str) -> int:
        """The newest complete snapshot, 0 without any."""
        fs, p = self._folder(name)
        if not fs.exists(p):
            return 0
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=0)

    def read(self, name: str) -> DataFrame:
        n = self.version(name)
        want: T.StructType = TABLES[name]
        return self.spark.read.schema(want).parquet(f"{self.path}/{name}/v={n}") if n else self.spark.createDataFrame([], want)

    def write(self, name: str, table: DataFrame) -> int:
        self._guard()
        n = self.version(name) + 1
        cells = [(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]]
        table.select(*cells).write.parquet(f"{self.path}/{name}/v={n}")
        return n

    def _guard(self) -> None:
        if not self.superuser:
            raise NotAllowed("only a superuser session may change policy")

    def approve_command(self, role: str, command: str) -> int:
        return self.write("command_approvals", upsert(self.read("command_approvals"), {"role_name": role, "command_type": command}, {"is_approved": True}))

    def revoke_command(self, role: str, command: str) -> int:
        return self.write("command_approvals", upsert(self.read("command_approvals"), {"role_name": role, "command_type": command}, {"is_approved": False}))

    def _fingerprint(self, fingerprint: str, role: str, command: str, approved: bool) -> int:
        key = {"fingerprint": fingerprint, "role_name": role, "command_type": command}
        return self.write("query_fingerprints", update(self.read("query_fingerprints"), key, {"is_approved": approved, "auto_approval_disabled": not approved}))

    def approve_fingerprint(self, fingerprint: str, role: str, command: str) -> int:
        return self._fingerprint(fingerprint, role, command, True)

    def block_fingerprint(self, fingerprint: str, role: str, command: str) -> int:
        return self._fingerprint(fingerprint, role, command, False)

    def add_regex_rule(self, pattern: str, description: str | None = None) -> int:
        """The new rule's id."""
        self._guard()
        if fault := rule_fault(pattern, self.spark):
            raise ValueError(fault)
        rules = self.read("regex_rules")
        new = (rules.agg(F.max("id")).first()[0] or 0) + 1
        self.write("regex_rules", upsert(rules, {"id": new}, {"pattern": pattern, "description": description, "action": "BLOCK", "is_active": True}))
        return new

    def delete_regex_rule(self, rule_id: int) -> int:
        return self.write("regex_rules", self.read("regex_rules").where(F.col("id") != rule_id))

    def toggle_regex_rule(self, rule_id: int, active: bool) -> int:
        return self.write("regex_rules", update(self.read("regex_rules"), {"id": rule_id}, {"is_active": active}))

    def dump(self, path: str) -> None:
        """A copy of every policy table, for ``restore``."""
        for name in TABLES:
            self.read(name).write.mode("overwrite").parquet(f"{path}/{name}")

    def restore(self, path: str) -> None:
        for name, want in TABLES.items():
            self.write(name, self.spark.read.schema(want).parquet(f"{path}/{name}"))
