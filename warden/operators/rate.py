"""Fixed-window rate limits.

A key's window opens with its first counted attempt after the last one ended;
every attempt in it counts, refused ones too, and those over the limit are
exceeded. The window's start depends on all that came before, so no window frame
expresses it. Rows are dealt by key, sorted by time, and folded as they stream
by: a task holds one counter at a time, whatever the key's rows, and the fold
jumps from window start to window start by binary search in each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import LIMITED, Settings


def fold(at: np.ndarray, window: int, start: int | None, count: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Window starts and counts of a key's sorted attempts, going on from (start, count)."""
    starts, counts = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    i = 0
    while i < len(at):
        if start is None or at[i] - start >= window:
            start, count = int(at[i]), 0
        j = int(np.searchsorted(at, start + window, "left"))
        j = max(j, i + 1)
        starts[i:j] = start
        counts[i:j] = count + np.arange(1, j - i + 1)
        count += j - i
        i = j
    return starts, counts, start, count


def rate_windows(attempts: DataFrame, keys: list[str], time_col: str, order_col: str, window_seconds: int, state: DataFrame | None = None) -> DataFrame:
    """All columns, with window_start (microseconds) and n, the attempt's number in its window.

    ``state`` (keys, start, count): the windows that earlier attempts left open.
    """
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    rows = attempts.withColumns({"_at": at, "_start": F.lit(None).cast("long"), "_count": F.lit(None).cast("long")})
    if state is not None:  # a row before all attempts of its key
        rows = rows.unionByName(state.select(*keys, F.lit(-(2**63)).alias("_at"), F.col("start").alias("_start"), F.col("count").alias("_count")), allowMissingColumns=True)
    rows = rows.withColumn("_key", F.to_json(F.struct(*keys)))
    dealt = rows.repartition(*keys).sortWithinPartitions("_key", "_at", order_col)
    window = window_seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, count = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = pc.dictionary_encode(b.column(b.schema.get_field_index("_key")))
            ids = codes.indices.to_numpy()
            times, begun, had = (b.column(b.schema.get_field_index(c)) for c in ("_at", "_start", "_count"))
            times, real = times.to_numpy(zero_copy_only=False), begun.is_null()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), b.num_rows]
            s, n = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            for a, e in zip(edges, edges[1:], strict=False):
                own = codes.dictionary[int(ids[a])].as_py()
                if own != key:
                    key, start, count = own, None, 0
                if not real[a].as_py():
                    start, count, a = begun[a].as_py(), had[a].as_py(), a + 1
                s[a:e], n[a:e], start, count = fold(times[a:e], window, start, count)
            names = [x for x in b.schema.names if x not in ("_key", "_at", "_start", "_count")]
            kept = [b.column(b.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s), pa.array(n)], names=[*names, "window_start", "n"]).filter(real)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema), "window_start long", "n long"])
    return dealt.mapInArrow(run, schema)


KEYS = ["db_oid", "role_oid"]


#: Open windows, as a stream keeps them from batch to batch; command_type is null for the global counter.
STATE = "db_oid long, role_oid long, command_type string, start long, count long"
_WINDOW = "struct<start:bigint,count:bigint>"


def limited(s: Settings) -> bool:
    return s.enable_rate_limiting or any(s.command_limit(x) for x in LIMITED)


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.struct(F.col("window_start").alias("start"), F.col("n").alias("count"))).drop("window_start", "n")


def global_limit(statements: DataFrame, s: Settings, state: DataFrame | None = None) -> DataFrame:
    """Every attempt with rate_exceeded by (database, role), and its window in rate_global."""
    if not s.enable_rate_limiting or s.rate_limit_count <= 0:
        return statements.withColumns({"rate_global": F.lit(None).cast(_WINDOW), "rate_exceeded": F.lit(False)})
    before = None if state is None else state.where("command_type is null")
    out = rate_windows(statements, KEYS, "decided_at", "stmt_id", s.rate_limit_seconds, before)
    return _counted(out, "rate_global").withColumn("rate_exceeded", F.col("rate_global.count") > s.rate_limit_count)


def command_limit(statements: DataFrame, s: Settings, state: DataFrame | None = None) -> DataFrame:
    """Every attempt with command_exceeded by (database, role, command), and its window in rate_command; commands without a limit never exceed it."""
    limits = {c: s.command_limit(c) for c in LIMITED if s.command_limit(c) > 0}
    none = {"rate_command": F.lit(None).cast(_WINDOW), "command_exceeded": F.lit(False)}
    if not limits or s.command_limit_seconds <= 0:
        return statements.withColumns(none)
    counts = F.col("command_type").isin(list(limits))
    before = None if state is None else state.where("command_type is not null")
    counted = rate_windows(statements.where(counts), [*KEYS, "command_type"], "decided_at", "stmt_id", s.command_limit_seconds, before)
    limit = F.coalesce(*[F.when(F.col("command_type") == c, F.lit(n)) for c, n in limits.items()])
    counted = _counted(counted, "rate_command").withColumn("command_exceeded", F.col("rate_command.count") > limit)
    return counted.unionByName(statements.where(~F.coalesce(counts, F.lit(False))).withColumns(none))


def next_state(decided: DataFrame, state: DataFrame) -> DataFrame:
    """``STATE`` after decided rows that carry rate_global and rate_command: each key's last window."""
    last = lambda x: F.max(x)  # noqa: E731  (windows follow each other, and counts rise in them)
    one = decided.where("rate_global is not null").groupBy(*KEYS).agg(last("rate_global").alias("w")).select(*KEYS, F.lit(None).cast("string").alias("command_type"), "w")
    two = decided.where("rate_command is not null").groupBy(*KEYS, "command_type").agg(last("rate_command").alias("w")).select(*KEYS, "command_type", "w")
    every = one.unionByName(two).unionByName(state.select(*KEYS, "command_type", F.struct("start", "count").alias("w")))
    return every.groupBy(*KEYS, "command_type").agg(last("w").alias("w")).select(*KEYS, "command_type", "w.start", "w.count")


def rate_reasons(statements: DataFrame, s: Settings, state: DataFrame | None = None) -> DataFrame:
    """Attempts with rate_reason (and their windows, if a state is given); the command counters do not see what the global one refuses."""
    both = global_limit(statements, s, state)
    within = command_limit(both.where("not rate_exceeded"), s, state)
    refused = both.where("rate_exceeded").withColumns({"rate_command": F.lit(None).cast(_WINDOW), "command_exceeded": F.lit(False)})
    every = within.unionByName(refused)
    if state is None:
        every = every.drop("rate_global", "rate_command")
    reason = F.when(F.col("rate_exceeded"), F.format_string("Rate limit exceeded for role '%s'.", "role_name")).when(
        F.col("command_exceeded"), F.format_string("Rate limit for command '%s' exceeded for role '%s'", "command_type", "role_name")
    )
    return every.withColumn("rate_reason", reason).drop("rate_exceeded", "command_exceeded")
