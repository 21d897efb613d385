"""Settings: defaults, ranges, validation, and resolution by scope."""

from __future__ import annotations

import dataclasses
import ipaddress
import re
import zoneinfo
from collections.abc import Iterable
from dataclasses import dataclass

MODES = ("learn", "permissive", "enforce")
#: Least and greatest of each number.
RANGES = {
    "retention_days": (0, 3650), "rate_limit_count": (0, 1_000_000), "rate_limit_seconds": (1, 86_400), "command_limit_seconds": (0, 86_400),
    "select_limit_count": (0, 1_000_000), "insert_limit_count": (0, 1_000_000), "update_limit_count": (0, 1_000_000), "delete_limit_count": (0, 1_000_000),
    "fingerprint_learn_threshold": (1, 1000), "activity_log_retention_days": (1, 3650), "activity_queue_size": (64, 262_144), "regex_timeout_ms": (1, 60_000),
    "activity_log_max_rows": (1000, 100_000_000), "activity_log_prune_interval_seconds": (5, 86_400),
}
LIMITED = ("SELECT", "INSERT", "UPDATE", "DELETE")


@dataclass(frozen=True)
class Settings:
    mode: str = "learn"
    enabled: bool = True
    retention_days: int = 30
    enable_keyword_scan: bool = True
    enable_builtin_injection_check: bool = True
    enable_regex_scan: bool = True
    enable_quiet_hours: bool = False
    quiet_hours_log: bool = True
    enable_rate_limiting: bool = False
    rate_limit_count: int = 100
    rate_limit_seconds: int = 60
    command_limit_seconds: int = 60
    select_limit_count: int = 0
    insert_limit_count: int = 0
    update_limit_count: int = 0
    delete_limit_count: int = 0
    quiet_hours_start: str = ""
    quiet_hours_end: str = ""
    quiet_hours_timezone: str = ""
    blacklisted_keywords: str = ""
    enable_application_blocking: bool = False
    blocked_applications: str = ""
    enable_ip_blocking: bool = False
    blocked_ips: str = ""
    enable_role_ip_binding: bool = False
    role_ip_bindings: str = ""
    allow_superuser_auth_bypass: bool = True
    enable_fingerprint_learning: bool = True
    fingerprint_learn_threshold: int = 5
    enable_alert_notifications: bool = False
    alert_channel: str = ""
    syslog_alerts: bool = False
    activity_log_retention_days: int = 30
    launcher_database: str = ""
    activity_queue_size: int = 4096
    regex_timeout_ms: int = 100
    activity_log_max_rows: int = 1_000_000
    activity_log_prune_interval_seconds: int = 300
    enable_activity_logging: bool = True

    def __post_init__(self) -> None:
        if faults := self.faults():
            raise ValueError("; ".join(faults))

    def faults(self) -> list[str]:
        out = [] if self.mode in MODES else [f"mode: {self.mode!r}"]
        out += [f"{k}: {getattr(self, k)} is not in {a}..{b}" for k, (a, b) in RANGES.items() if not a <= getattr(self, k) <= b]
        out += [f"{k}: {v!r} is not HH:MM" for k in ("quiet_hours_start", "quiet_hours_end") if (v := getattr(self, k)) and minute_of_day(v) is None]
        if self.quiet_hours_timezone and not valid_zone(self.quiet_hours_timezone):
            out.append(f"quiet_hours_timezone: {self.quiet_hours_timezone!r} is unknown")
        if len(self.blacklisted_keywords.encode()) > 2048:
            out.append("blacklisted_keywords: over 2048 bytes")
        out += [f"blocked_ips: {x!r}" for x in items(self.blocked_ips) if normal_ip(x) is None]
        out += [f"role_ip_bindings: {x!r}" for x in items(self.role_ip_bindings) if role_ip(x) is None]
        return out

    def command_limit(self, command: str) -> int:
        return getattr(self, f"{command.lower()}_limit_count") if command in LIMITED else 0

    @property
    def keywords(self) -> list[str]:
        return [ascii_lower(x) for x in items(self.blacklisted_keywords)]

    @property
    def channel(self) -> str:
        return self.alert_channel or "statement_alerts"


def ascii_lower(x: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def items(value: str) -> list[str]:
    """A comma-separated list without blanks and empty entries."""
    return [x for part in value.split(",") if (x := part.strip())]


def minute_of_day(value: str) -> int | None:
    m = re.fullmatch(r"\s*\+?(\d{1,2})\s*:\s*\+?(\d{1,2})\s*(?::.*)?", value)
    return int(m[1]) * 60 + int(m[2]) if m and int(m[1]) < 24 and int(m[2]) < 60 else None


def valid_zone(name: str) -> bool:
    try:
        zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return False
    return True


def normal_ip(text: str | None) -> str | None:
    """The address by value: zone cut off, an IPv4-mapped IPv6 address as IPv4; None for what is none."""
    if text is None:
        return None
    try:
        ip = ipaddress.ip_address(text.split("%", 1)[0].strip())
    except ValueError:
        return None
    return str(getattr(ip, "ipv4_mapped", None) or ip)


def role_ip(entry: str) -> tuple[str, str] | None:
    role, at, ip = entry.partition("@")
    found = normal_ip(ip) if at and role.strip() else None
    return (role.strip(), found) if found else None


def resolve(base: Settings, rows: Iterable[tuple[str | None, str | None, str, str]], database: str, role: str) -> Settings:
    """Settings of a role in a database: server, database, role, then role-in-database entries (scope_db, scope_role, key, value)."""
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Settings)}
    found: dict[str, tuple[int, object]] = {}
    for scope_db, scope_role, key, value in rows:
        if scope_db in (None, database) and scope_role in (None, role) and key in kinds:
            rank = (scope_db is not None) + 2 * (scope_role is not None)
            kind = kinds[key]
            parsed = value.lower() in ("on", "true", "1", "yes") if kind is bool else kind(value)
            if key not in found or rank >= found[key][0]:
                found[key] = (rank, parsed)
    return dataclasses.replace(base, **{k: v for k, (_, v) in found.items()})
