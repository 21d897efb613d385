"""The statement log as a stream: decisions per micro-batch, audit sinks, keyed rate counters, and their accounting.

Each micro-batch is decided against one snapshot of the policy, read at its
start; learned policy authorizes from the next batch on. Files of the batch
before are never written twice: a batch's rows go to a folder of its id, so a
repeated batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import decide, learn, rate
from ..operators.decide import Policy
from ..schema import QUERY_FINGERPRINTS
from ..settings import Settings


def _carried(spark: SparkSession, out: str, name: str, batch_id: int) -> DataFrame | None:
    """What the batch before left (None for the first one)."""
    path = f"{out}/state/{name}/batch={batch_id - 1}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def decide_stream(
    statements: DataFrame, settings: Settings, policy: Callable[[SparkSession], Policy], out: str, checkpoint: str, dead_letter: bool = True, every: str | None = None, keep_learning: bool = False
) -> StreamingQuery:
    """Decides every micro-batch and writes ``activity``, ``blocked`` and ``malformed`` under ``out``, by batch id.

    Open rate windows, and with ``keep_learning`` the policy that learn mode has
    grown, go on from batch to batch in ``state``: each batch reads what the one
    before it wrote and writes its own, so a repeated batch changes nothing.
    ``every``: polls at that interval; else what is there is read once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        good, bad = well_formed(df)
        now, rates = policy(spark), None
        if keep_learning:
            approvals, prints = _carried(spark, out, "approvals", batch_id), _carried(spark, out, "fingerprints", batch_id)
            now = replace(now, approvals=now.approvals if approvals is None else approvals, fingerprints=now.fingerprints if prints is None else prints)
        if rate.limited(settings):
            rates = _carried(spark, out, "rates", batch_id)
            rates = spark.createDataFrame([], rate.STATE) if rates is None else rates
        decided = decide.decide(good, settings, now, rates=rates).persist()
        try:
            if rates is not None:
                rate.next_state(decided, rates).write.mode("overwrite").parquet(f"{out}/state/rates/batch={batch_id}")
            if keep_learning:
                table = spark.createDataFrame([], QUERY_FINGERPRINTS) if now.fingerprints is None else now.fingerprints
                commands, hits = learn.observed(decided, settings, table)
                learn.learned_approvals(now.approvals, commands).write.mode("overwrite").parquet(f"{out}/state/approvals/batch={batch_id}")
                learn.upsert_hits(table, hits).write.mode("overwrite").parquet(f"{out}/state/fingerprints/batch={batch_id}")
            if settings.enable_activity_logging:
                decide.activity_rows(decided).write.mode("overwrite").parquet(f"{out}/activity/batch={batch_id}")
            decide.blocked_rows(decided).write.mode("overwrite").parquet(f"{out}/blocked/batch={batch_id}")
            if dead_letter:
                bad.write.mode("overwrite").parquet(f"{out}/malformed/batch={batch_id}")
        finally:
            decided.unpersist()

    when = {"processingTime": every} if every else {"availableNow": True}
    return statements.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**when).start()


def well_formed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the others (counted and kept, never decided)."""
    ok = F.col("stmt_id").isNotNull() & F.col("db_oid").isNotNull() & F.col("command_type").isNotNull() & F.col("query_text").isNotNull() & F.col("decided_at").isNotNull()
    return rows.where(ok), rows.where(~ok)


class RateCounter(StatefulProcessor):
    """One fixed-window counter for each key, as in the batch operator."""

    def __init__(self, window_seconds: int, limit: int):
        self.window, self.limit = window_seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, count long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        start, count = self.state.get() if self.state.exists() else (None, 0)
        every = pd.concat(list(rows)).sort_values(["at", "stmt_id"])
        out = []
        for at in every["at"].tolist():
            if start is None or at - start >= self.window:
                start, count = at, 0
            count = min(count + 1, 2**63 - 1)
            out.append(count)
        self.state.update((start, count))
        yield pd.DataFrame({"stmt_id": every["stmt_id"].to_numpy(), "n": out, "exceeded": [n > self.limit for n in out]})

    def close(self) -> None:
        pass


def rate_stream(statements: DataFrame, keys: list[str], window_seconds: int, limit: int) -> DataFrame:
    """(stmt_id, n, exceeded) as a stream, with its counters in the state store (RocksDB)."""
    rows = statements.withColumn("at", F.unix_micros(F.col("decided_at").cast("timestamp"))).select("stmt_id", "at", *keys)
    return rows.groupBy(*keys).transformWithStateInPandas(RateCounter(window_seconds, limit), "stmt_id long, n long, exceeded boolean", outputMode="Append", timeMode="None")


def gap(oldest: int, next_position: int) -> int:
    """Positions that were overwritten before they were read."""
    return max(0, oldest - next_position)


class Consumer:
    """Start, pause, resume and state of a stream; a restart goes on from its checkpoint."""

    def __init__(self, start: Callable[[], StreamingQuery]):
        self._start, self._query, self.incarnation, self.paused = start, None, 0, False

    def run(self) -> StreamingQuery:
        self._query, self.paused = self._start(), False
        self.incarnation += 1
        return self._query

    def pause(self) -> str:
        if self._query is not None:
            self._query.stop()
        self.paused = True
        return self.status()

    def resume(self) -> str:
        if self.paused or self._query is None:
            self.run()
        return self.status()

    def status(self) -> str:
        if self.paused:
            return f"paused incarnation={self.incarnation}"
        if self._query is None or not self._query.isActive:
            return "stopped"
        return f"running incarnation={self.incarnation}"
