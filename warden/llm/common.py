"""What the operators of this subpackage share: words, columns, shared tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _alnum_table() -> bytes:
    """Byte map: A-Z to lower case, other word bytes as they are, the rest to a blank."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


ALNUM = _alnum_table()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z lower-cased text, as UTF-8.

    All bytes of a multi-byte character are over 0x7F, so mapping bytes is exact.
    """
    return text.encode().translate(ALNUM).split() if text else []


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Texts can be long, so Arrow batches of them hold few rows, unless the session sets a number itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so extra columns (whatever their names) never meet ours."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in cols])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only on a local master that sets none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="warden-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it goes with the innermost ``scratch``, if there is one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if open_ := getattr(_scopes, "open", None):
        open_[-1].add(path)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives lost executors.

    The write's shuffle files go when it has ended: nothing reads them again.
    (The switch for that belongs to the session; other queries of it would lose
    theirs at their own ends, too, and only while this write runs.)
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at the end, but for those given to what it yields."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    own: set[str] = set()
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    _scopes.open.append(own)
    try:
        yield keep
    finally:
        _scopes.open.pop()
        if _scopes.open:
            _scopes.open[-1] |= own & kept
        for path in own - kept:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to some batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema
    )


def fold_of(id_col: Column) -> Column:
    """crc32(id as text) mod 3; 1 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3
