"""Statement shaping across rows: spans taken over from the enclosing utility, catalog changes, and faulty records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enclosing_span(rows: DataFrame, session: str = "session_id", source: str = "source_text", order: str = "stmt_id") -> DataFrame:
    """Plans without a span take the span of the last utility before them in their session whose source text is the same.

    ``rows`` has is_utility, location and length.
    """
    before = Window.partitionBy(session, source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("is_utility"), F.struct("location", "length"))
    taken = F.last(own, ignorenulls=True).over(before)
    use = ~F.col("is_utility") & F.col("location").isNull()
    return rows.withColumn("_from", taken).withColumns(
        {"inherited": use & F.col("_from").isNotNull(), "location": F.when(use, F.col("_from.location")).otherwise(F.col("location")), "length": F.when(use, F.col("_from.length")).otherwise(F.col("length"))}
    ).drop("_from")


def catalog_changes(accesses: DataFrame) -> DataFrame:
    """Changes that invalidate a policy snapshot: created extensions, changed or dropped policy triggers, changed membership."""
    kind = F.when((F.col("access") == "create") & (F.col("class") == "extension"), "extension_created")
    kind = kind.when(F.col("access").isin("alter", "drop") & (F.col("class") == "trigger"), "trigger_changed")
    kind = kind.when((F.col("access") == "alter") & (F.col("class") == "extension"), "membership_changed")
    return accesses.withColumn("change", kind).where("change is not null")


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with fault: the name of the first check that does not hold, null for good ones. A failing row never stops its batch."""
    steps = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return rows.withColumn("fault", reduce(lambda a, b: F.coalesce(a, b), steps))


def installation_state(rows: DataFrame, installed: DataFrame, mode: str) -> DataFrame:
    """Rows with verdict: inspect, skip (not installed, or being installed) or, where the catalog is unavailable, refuse (enforce) or stop."""
    there = installed.select(F.col("db_oid").alias("_db"), F.col("state").alias("_state"))
    lost = "refuse" if mode == "enforce" else "stop"
    verdict = F.when(F.col("_state") == "active", "inspect").when(F.col("_state") == "unavailable", lost).otherwise("skip")
    return rows.join(there, F.col("db_oid") == F.col("_db"), "left").withColumn("verdict", verdict).drop("_db", "_state")
