"""Command families: tags, fallbacks, and statements that write inside a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The families that are named after a tag's first word.
FAMILIES = (
    "SELECT INSERT UPDATE DELETE MERGE CREATE ALTER DROP TRUNCATE COMMENT GRANT REVOKE VACUUM ANALYZE REINDEX CLUSTER REFRESH COPY LOCK "
    "BEGIN COMMIT ROLLBACK SAVEPOINT RELEASE PREPARE EXECUTE DEALLOCATE SET SHOW RESET EXPLAIN LISTEN NOTIFY UNLISTEN CHECKPOINT DISCARD LOAD"
).split()
PLANNED = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE")
WRITES = ("INSERT", "UPDATE", "DELETE", "MERGE")


def family(tag: Column) -> Column:
    """The family of a command tag."""
    word = F.split_part(tag, F.lit(" "), F.lit(1))
    return F.when(tag == "START TRANSACTION", "BEGIN").when(tag == "SELECT INTO", "CREATE").when(word.isin(FAMILIES), word).otherwise("OTHER")


def planned_family(kind: Column) -> Column:
    """The family of a planned statement without a tag."""
    return F.when(kind.isin(*PLANNED), kind).otherwise("OTHER")


def fan_out(statements: DataFrame, outer: str = "command_type", inner: str = "cte_families") -> DataFrame:
    """One inspection for the outer family, then one for each distinct write family inside, in order (``inspection_no`` from 0)."""
    every = F.concat(F.array(F.col(outer)), F.array_distinct(F.coalesce(F.col(inner), F.array().cast("array<string>"))))
    return statements.select("*", F.posexplode(every).alias("inspection_no", "family"))


def unknown_inner(inner: Column) -> Column:
    """Whether a write inside is of no known family: such a statement is refused (0A000)."""
    return F.coalesce(F.exists(inner, lambda x: ~x.isin(*WRITES)), F.lit(False))


def rule_action_span(parts: DataFrame, message: str = "message_id") -> DataFrame:
    """One row for each (message, action): which statement of the message a rewrite rule's action stands for.

    ``parts`` has message, family and action. A write action needs exactly one
    write statement; a read action needs no write and exactly one of its family.
    """
    writes = F.count_if(F.col("family").isin(*WRITES))
    same = F.count_if(F.col("family") == F.col("action"))
    n = parts.groupBy(message, "action").agg(writes.alias("n_writes"), same.alias("n_same"))
    ok = F.when(F.col("action").isin(*WRITES), F.col("n_writes") == 1).otherwise((F.col("n_writes") == 0) & (F.col("n_same") == 1))
    return n.withColumn("verdict", F.when(ok, "span").otherwise("0A000"))
