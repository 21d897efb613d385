"""The statement log: from the events table, and from parquet in its own schema; policy seeds for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import STATEMENTS, require_schema

#: ANSI SQL over ``events``; runs as it is on Spark and DuckDB.
STATEMENTS_SQL = """
SELECT event_id AS stmt_id, ts AS decided_at,
  1 + user_id % 5 % 3 AS db_oid, concat('db', cast(user_id % 5 % 3 AS VARCHAR(10))) AS database_name,
  100 + user_id % 12 AS role_oid, concat('app_', cast(user_id % 12 AS VARCHAR(10))) AS role_name,
  CASE WHEN event_id % 50 = 7 THEN 'OTHER' WHEN event_type IN ('click','view') THEN 'SELECT' WHEN event_type='purchase' THEN 'INSERT' WHEN event_type='signup' THEN 'UPDATE' ELSE 'DELETE' END AS command_type,
  CASE WHEN user_id % 17 = 0 THEN NULL ELSE concat('10.0.', cast(user_id % 4 AS VARCHAR(10)), '.', cast(user_id % 250 AS VARCHAR(10))) END AS client_addr,
  CASE user_id % 4 WHEN 0 THEN 'psql' WHEN 1 THEN 'ETL' WHEN 2 THEN 'badApp' ELSE 'web' END AS application_name,
  CASE WHEN event_id % 50 = 7 THEN concat('CALL p', cast(user_id % 5 AS VARCHAR(10)), '(', cast(event_id AS VARCHAR(20)), ')')
    WHEN event_type='click' THEN concat('SELECT v FROM public.t', cast(user_id % 5 AS VARCHAR(10)), ' WHERE id = ', cast(event_id AS VARCHAR(20)), CASE WHEN event_id % 97 = 3 THEN ' OR 1 = 1' ELSE '' END)
    WHEN event_type='view' THEN concat('select V from public.t', cast(user_id % 5 AS VARCHAR(10)), ' /* n */ where id=', cast(event_id AS VARCHAR(20)), CASE WHEN event_id % 89 = 3 THEN ' -- or 1=1' ELSE '' END)
    WHEN event_type='purchase' THEN concat('INSERT INTO public.o VALUES (', cast(event_id AS VARCHAR(20)), ', ''k', cast(event_id % 7 AS VARCHAR(10)), ''');')
    WHEN event_type='signup' THEN concat('UPDATE public.u SET n = ''it''''s'' WHERE id = -', cast(event_id AS VARCHAR(20)), CASE WHEN event_id % 83 = 3 THEN ' AND pg_sleep(1) IS NULL' ELSE '' END)
    ELSE concat('DELETE FROM public.e WHERE x != 1.5 AND id = ', cast(event_id AS VARCHAR(20))) END AS query_text,
  user_id * 1000000 + rn - rn % 4 AS txn_id, (user_id + rn - rn % 4) % 11 <> 0 AS committed
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM {events}) AS e
"""
APPROVALS_SQL = """
SELECT * FROM (VALUES ('app_0','SELECT',true),('app_1','SELECT',true),('app_2','SELECT',true),('app_3','SELECT',true),('app_4','SELECT',true),('app_5','SELECT',true),
 ('app_6','SELECT',true),('app_7','SELECT',true),('app_0','INSERT',true),('app_1','INSERT',true),('app_2','INSERT',true),('app_3','INSERT',true),
 ('app_4','UPDATE',false),('app_5','DELETE',false),('app_0','OTHER',true)) AS t(role_name, command_type, is_approved)"""
#: Canonical texts with policy rows: (text, hits, approved, denied).
FINGERPRINT_SEEDS = (
    ('SELECT "v" FROM "public" . "t0" WHERE "id" = ?int', 2, True, False),
    ('SELECT "v" FROM "public" . "t1" WHERE "id" = ?int', 1, True, False),
    ('SELECT "v" FROM "public" . "t2" WHERE "id" = ?int', 1, False, False),
    ('SELECT "v" FROM "public" . "t3" WHERE "id" = ?int', 1, False, True),
    ('INSERT INTO "public" . "o" VALUES ( ?int , ?str )', 1, True, False),
)
RULES_SQL = r"""
SELECT * FROM (VALUES (1, 'delete\s+from', true, 'app_1'), (2, 't[0-4]\s+where\s+id\s*=\s*7', true, NULL), (3, 'insert', false, NULL)) AS t(id, pattern, is_active, exempt)"""
BINDINGS_SQL = "SELECT * FROM (VALUES ('app_2','10.0.2.2'),('app_3','10.0.3.3')) AS t(role_name, ip)"
SYSTEM_IDENTIFIER, EXTENSION_OID = 7_300_000_000_000_000_001, 16_400


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key (none: evenly) over ``spark.sql.shuffle.partitions`` tasks: a row group of a file is one task's, and reading texts takes far longer than a shuffle of the rows.

    The number is named, for Spark would merge tasks by the few bytes of their
    rows into hardly more than it has cores, and the last of them would run alone.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by)


def from_events(spark: SparkSession, sf_dir: str, texts: bool = False, by: str = "event_id") -> DataFrame:
    """The statement log that the events table stands for; ``texts``: its texts will be read, so it is ``spread`` by event, or by user where transactions are used."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(STATEMENTS_SQL, events=spread(events, by) if texts else events)


def from_parquet(spark: SparkSession, path: str, texts: bool = False) -> DataFrame:
    """A stored statement log, ``spread`` if its texts will be read (not needed for files of many small row groups)."""
    rows = spark.read.parquet(path)
    return require_schema(spread(rows, "stmt_id") if texts else rows, STATEMENTS)


def stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A directory of parquet files in the log's schema, as a stream."""
    reader = spark.readStream.schema(STATEMENTS)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def raw_sql(spark: SparkSession, text: str) -> DataFrame:
    """A seed's SQL: backslashes in its literals are plain characters, as in DuckDB."""
    return spark.sql(text.replace("\\", "\\\\"))
