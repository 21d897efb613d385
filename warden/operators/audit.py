"""Rings and checkpoints, retention, statistics and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ring_read(positions: DataFrame, head: int, capacity: int, pos_col: str = "position") -> DataFrame:
    """(position, state, retained_from): what a read at each position of a ring gives."""
    oldest = max(0, head - capacity)
    p = F.col(pos_col)
    state = F.when(p >= head, "not_yet_published").when(p < oldest, "overwritten").otherwise("ready")
    return positions.select(p, state.alias("state"), F.when(state == "overwritten", F.lit(oldest)).alias("retained_from"))


def checkpoint_resume(cases: DataFrame) -> DataFrame:
    """Where a consumer goes on: state, next_position and the reported gap.

    Cases: stored_kind (missing, invalid, uninitialized, ready), generation,
    extension_oid, next_position; ring_generation, ring_extension_oid (null:
    gone), ring_oldest, ring_write.
    """
    c = F.col
    fresh = (c("stored_kind") == "uninitialized") | (c("generation") != c("ring_generation")) | (c("extension_oid") != c("ring_extension_oid"))
    state = (
        F.when(c("ring_extension_oid").isNull(), "extension_gone").when(c("stored_kind") == "missing", "unavailable").when(c("stored_kind") == "invalid", "invalid")
        .when(fresh, "resume").when(c("next_position") > c("ring_write"), "ahead").otherwise("resume")
    )
    behind = ~fresh & (c("next_position") < c("ring_oldest"))
    at = F.when(fresh | behind, c("ring_oldest")).otherwise(c("next_position"))
    gap = F.when((state == "resume") & behind, c("ring_oldest") - c("next_position")).otherwise(F.lit(0))
    return cases.select("case_id", state.alias("state"), F.when(state == "resume", at).when(state == "ahead", c("next_position")).alias("resume_at"), gap.cast("long").alias("gap"))


def queue_statistics(events: DataFrame, capacity: int, dropped: int = 0) -> DataFrame:
    """One row: write position, overwrites, published by kind; ``events`` has event_type."""
    n = F.count("event_type")
    kinds = {"approval_events": "approval", "blocked_query_events": "blocked", "fingerprint_events": "fingerprint"}
    return events.agg(
        n.alias("write_position"), F.greatest(n - capacity, F.lit(0)).alias("slot_overwrites"), F.lit(capacity).cast("long").alias("capacity"),
        *[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()], F.lit(dropped).cast("long").alias("learn_observations_dropped"),
    )


def prune_age(rows: DataFrame, time_col: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; 0 days keep all."""
    return rows if days == 0 else rows.where(F.col(time_col) >= now - F.expr(f"INTERVAL '{days}' DAY"))


def newest_cutoff(rows: DataFrame, time_col: str, id_col: str, keep: int) -> DataFrame:
    """The first row past the newest ``keep`` (none if there are fewer): a bounded sort."""
    return rows.select(time_col, id_col).orderBy(F.desc(time_col), F.desc(id_col)).offset(keep).limit(1)


def prune_rows(rows: DataFrame, time_col: str, id_col: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows by (time, id): everything up to the cutoff goes."""
    cut = newest_cutoff(rows, time_col, id_col, keep).select(F.struct(F.col(time_col).alias("t"), F.col(id_col).alias("i")).alias("_cut"))
    return rows.join(F.broadcast(cut), F.struct(F.col(time_col).alias("t"), F.col(id_col).alias("i")) <= F.col("_cut"), "left_anti")  # one row


def retention_counts(rows: DataFrame, time_col: str, id_col: str, now: Column, days: int, keep: int) -> DataFrame:
    """One row: deleted by age, deleted by number, left."""
    aged = prune_age(rows, time_col, now, days)
    left = prune_rows(aged, time_col, id_col, keep)
    a, b, c = (x.agg(F.count("*").alias(n)) for x, n in ((rows, "a"), (aged, "b"), (left, "c")))
    return a.crossJoin(b).crossJoin(c).select((F.col("a") - F.col("b")).alias("deleted_by_age"), (F.col("b") - F.col("c")).alias("deleted_by_rows"), F.col("c").alias("rows_left"))  # one row each


def oldest_batch(rows: DataFrame, time_col: str, id_col: str, size: int = 1000) -> DataFrame:
    return rows.orderBy(time_col, id_col).limit(size)


def recent_blocked(blocked: DataFrame, n: int = 10) -> DataFrame:
    return blocked.orderBy(F.desc("blocked_at"), F.desc("stmt_id")).limit(n)


def keyset_page(databases: DataFrame, cursor: int, size: int = 32) -> DataFrame:
    """The next databases by OID after the cursor, going on from the start once, at most ``size``."""
    usable = databases.where("connectable and not is_template and encoding = 'UTF8'").select("db_oid", (F.col("db_oid") <= cursor).alias("wrapped"))
    return usable.orderBy("wrapped", "db_oid").limit(size)


def lag_percentiles(rows: DataFrame, from_col: str, to_col: str) -> DataFrame:
    """Exact 50th and 99th percentile of the seconds between two times."""
    lag = (F.unix_micros(F.col(to_col).cast("timestamp")) - F.unix_micros(F.col(from_col).cast("timestamp"))) / 1_000_000.0
    return rows.agg(F.percentile(lag, F.lit(0.5)).alias("p50"), F.percentile(lag, F.lit(0.99)).alias("p99"))


def audit_reconcile(counts: DataFrame) -> DataFrame:
    """Whether what was published was written, skipped or rejected."""
    return counts.withColumn("balanced", F.col("published") == F.col("written") + F.col("skipped") + F.col("rejected"))


def approval_summary(approvals: DataFrame) -> DataFrame:
    return approvals.groupBy("command_type").agg(F.count("*").alias("n"), F.count_if(~F.col("is_approved")).alias("n_pending"))


def role_summary(decided: DataFrame) -> DataFrame:
    """Each role's distinct commands in order, as one text."""
    return decided.groupBy("role_name").agg(F.array_join(F.array_sort(F.collect_set("command_type")), ",").alias("commands"), F.count("*").alias("n"))


def visible(policy: DataFrame, role: str, memberships: list[str]) -> DataFrame:
    """Policy rows a role may read: its own, or all for members of pg_read_all_data."""
    return policy if "pg_read_all_data" in memberships else policy.where(F.col("role_name") == role)


def zipped(record: DataFrame, id_col: str, arrays: list[str]) -> DataFrame:
    """Parallel arrays as rows, in order."""
    return record.select(id_col, F.posexplode(F.arrays_zip(*arrays)).alias("row_no", "_z")).select(id_col, F.col("row_no").cast("long").alias("row_no"), *[F.col(f"_z.{a}").alias(a) for a in arrays])


def batched(rows: DataFrame, key: str, id_col: str, size: int = 256, reach: int = 65536) -> DataFrame:
    """Rows with batch_no: each key's rows in order of a whole-number id, ``size`` to a batch.

    Ranges of ``reach`` ids are numbered by themselves and their counts added up, so no task sorts a whole key.
    """
    dealt = rows.withColumn("_range", F.floor(F.col(id_col) / reach))
    counts = dealt.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_k").orderBy("_r")) - F.col("_n")).drop("_n")
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_range").orderBy(id_col)))
    found = inside.join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col("_range").eqNullSafe(F.col("_r")))
    return found.withColumn("batch_no", F.floor((F.col("_before") + F.col("_in") - 1) / size)).drop("_range", "_k", "_r", "_before", "_in")


def policy_digest(policy: DataFrame) -> DataFrame:
    """One row: an order-free digest of a policy table's rows, equal before and after a move."""
    row = F.sha2(F.to_json(F.struct(*sorted(policy.columns)), {"ignoreNullFields": "false"}), 256)
    wide = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(8)]
    return policy.agg(F.count(F.lit(1)).alias("n"), *wide).select("n", F.sha2(F.concat_ws(",", "n", *[F.col(f"s{k}").cast("string") for k in range(8)]), 256).alias("digest"))


def next_retention(last: dt.datetime | None, started: dt.datetime, interval_s: int, batch_full: bool, first_delay_s: int = 5) -> dt.datetime:
    """When retention runs next: soon after the start, at once while batches are full, else after the interval (5 s at least)."""
    if last is None:
        return started + dt.timedelta(seconds=first_delay_s)
    return last if batch_full else last + dt.timedelta(seconds=max(5, interval_s))


def maintenance_allowed(unread: Column, capacity: int) -> Column:
    return unread < capacity / 4


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def numbered(rows: DataFrame, order: list[str], id_col: str = "log_id") -> DataFrame:
    """Rows with ids in order, range by range: counts of ranges are added up, so no task sorts everything."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_.join(before, F.col("_part") == F.col("_p")).withColumn(id_col, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_p", "_before")
