"""Fixed schemas of the policy and audit tables, and the check that guards them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()), "DECIMAL(20-0)": T.DecimalType(20, 0),
}


def _struct(columns: str) -> T.StructType:
    """A schema out of ``name TYPE, ...``; made without a session, so that modules import before there is one."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


STATEMENTS = _struct(
    "stmt_id BIGINT, decided_at TIMESTAMP_NTZ, db_oid BIGINT, database_name STRING, role_oid BIGINT, role_name STRING, command_type STRING, "
    "client_addr STRING, application_name STRING, query_text STRING, txn_id BIGINT, committed BOOLEAN"
)
COMMAND_APPROVALS = _struct("role_name STRING, command_type STRING, is_approved BOOLEAN")
QUERY_FINGERPRINTS = _struct(
    "fingerprint STRING, role_name STRING, command_type STRING, hit_count INT, is_approved BOOLEAN, auto_approval_disabled BOOLEAN, "
    "normalized_query STRING, sample_query STRING, first_seen_at TIMESTAMP_NTZ, last_seen_at TIMESTAMP_NTZ"
)
REGEX_RULES = _struct("id INT, pattern STRING, description STRING, action STRING, is_active BOOLEAN, allowed_roles ARRAY<STRING>, installation_default STRING")
ROLE_IP_BINDINGS = _struct("role_name STRING, ip STRING")
ACTIVITY_LOG = _struct(
    "log_time TIMESTAMP_NTZ, role_name STRING, database_name STRING, query_text STRING, query_truncated BOOLEAN, application_name STRING, client_ip STRING, "
    "command_type STRING, action STRING, reason STRING, decision STRING"
)
BLOCKED_QUERIES = _struct(
    "blocked_at TIMESTAMP_NTZ, role_name STRING, database_name STRING, query_text STRING, query_truncated BOOLEAN, application_name STRING, client_addr STRING, "
    "command_type STRING, reason STRING, decision STRING"
)
POLICY_HISTORY = _struct(
    "system_identifier DECIMAL(20-0), database_oid BIGINT, extension_oid BIGINT, change_id BIGINT, policy_epoch BIGINT, policy_table STRING, operation STRING, source STRING, "
    "old_role_name STRING, old_command_type STRING, old_fingerprint STRING, new_role_name STRING, new_command_type STRING, new_fingerprint STRING"
)
POLICY_EPOCH = _struct("kind STRING, epoch BIGINT")
CONSUMER_CHECKPOINT = _struct("initialized BOOLEAN, ring_generation DECIMAL(20-0), extension_oid BIGINT, next_position DECIMAL(20-0)")
RETENTION_STATUS = _struct("runs BIGINT, failures BIGINT, last_activity_deleted BIGINT, last_blocked_deleted BIGINT, total_activity_deleted BIGINT, total_blocked_deleted BIGINT")


class SchemaError(ValueError):
    """A table lacks a column or has it in another type."""


def schema_faults(df: DataFrame, want: T.StructType) -> list[str]:
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {'missing' if f.name not in have else have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in want if have.get(f.name) != f.dataType]


def require_schema(df: DataFrame, want: T.StructType, mode: str = "enforce") -> DataFrame | None:
    """``df``; on a mismatch an error in enforce mode, else None (policy unavailable)."""
    faults = schema_faults(df, want)
    if not faults:
        return df
    if mode == "enforce":
        raise SchemaError("; ".join(faults))
    return None
