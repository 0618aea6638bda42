"""Shared helpers of the training-data operators: the shared scratch folder and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, and U+0009 to U+000D. ``bytes.split()`` splits at the same six.
SPACE = " \t\n\x0b\x0c\r"
#: ASCII capitals and the letters they become; other letters keep their case.
BATCH_BYTES = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and everything runs on one machine (tests) a temporary folder is taken and set. A path
    without a scheme is one of the default file system, as for Spark.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalake-")
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Scratch:
    """A folder of one run below the shared root. Tables written there cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/stratalake/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write df as Parquet and read it back."""
        df.write.mode("overwrite").parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables or file folders that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def slices(it: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, as texts may be very long; Spark itself bounds a batch's bytes."""
    for batch in it:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_lock = threading.Lock()
#: By session: how many are within lean() now, and the settings as they were before the first.
_within: dict[object, list] = {}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within this, Arrow batches hold BATCH_BYTES at most, as each task has some of them outside the heap, and a query's
    shuffle files go when it ends, not when the driver next collects garbage. The session's own settings come back when
    the last of its threads leaves."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), CLEANUP: "true"}
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        own = _within.setdefault(key, [0, {k: spark.conf.get(k) for k in wanted}])
        own[0] += 1
        for k, v in wanted.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            own[0] -= 1
            if not own[0]:
                for k, v in _within.pop(key)[1].items():
                    spark.conf.set(k, v)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; ``file:`` with one or three slashes, and what Arrow knows besides."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


def utf8(column: str | Column) -> Column:
    """The bytes of a text, so that Python gets them without decoding."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def crc_mod(column: str | Column, mod: int) -> Column:
    """crc32 of the value as text, modulo mod; a null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % mod


def batches(schema: pa.Schema, rows: list[tuple], size: int = 20_000):
    """Record batches of tuples."""
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def with_extra(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of df apart from those an operator sets itself; names compare without case, as Spark's do."""
    low = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in low]


def least(rows: DataFrame, group: str, n: int, parts: int = 64) -> DataFrame:
    """(group, bound): the n-th least distinct hash ``u`` of each group, or its last if there are fewer.

    Each task keeps the n least of its own, and so does each of ``parts`` ranges of hashes after it: no more than
    n * parts numbers of a group meet.
    """

    def keep(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in it:
            names, u = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            own: dict[str, list[int]] = {}
            for i, k in enumerate(names):
                own.setdefault(k, []).append(i)
            for k, at in own.items():
                found[k] = np.unique(np.concatenate([found.get(k, u[:0]), u[at]]))[:n]
        for k, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.string()), pa.array(v, pa.int64())], names=[group, "u"])

    schema = f"`{group}` string, u long"
    kept = rows.select(group, "u").mapInArrow(keep, schema).repartition(parts, "u").mapInArrow(keep, schema)
    ranked = kept.groupBy(group).agg(F.sort_array(F.collect_list("u")).alias("u"))
    return ranked.select(group, F.get("u", F.least(F.lit(n), F.size("u")) - 1).alias("bound"))
