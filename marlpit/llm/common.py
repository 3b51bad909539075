"""What the operators of this subpackage share: stored intermediate tables, pieces of Arrow batches and word classes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines see. Where that setting is unset: a temporary folder in local mode, else an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\[]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = _OWN_DIR.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="marlpit-"))
    return f"{root.rstrip('/')}/marlpit-{context.applicationId}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Holds one SQL setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def store(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: cuts lineage, and survives lost executors.

    The shuffle files of the write are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlpit_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by store() that nothing reads any more."""
    jvm, path = df.sparkSession._jvm, df._marlpit_path
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored; results that still are to be computed read them, so call it when they are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def own_name(key: str, others: list[str]) -> None:
    """A key column can't have the name of a column that is added to it."""
    if key in others:
        raise ValueError(f"the key column {key} has the name of a result; rename it first")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows`, for work whose memory grows with the rows at hand. Spark bounds a batch's bytes itself."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def parts(spark: SparkSession) -> int:
    """How many partitions a CPU-bound stage over few bytes gets; Spark would merge them by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
