"""Structured Streaming: incremental upserts, turn queues, replay-safe sinks; and event-time windows as an extension."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.mutations import upsert


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(path)


def turn_queue(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, turn, turn_seq, dirty_through): durable numbers for new turns, one cursor a conversation.

    A turn that has its number is a replay and gives nothing, so a restarted stream numbers nothing twice. A turn that arrives
    late, below others, gets the next number. Null turns and conversations give nothing. State is, for each conversation, the
    last number and the runs of turns that have one, as a few bounds: one run if turns come without gaps.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        runs, seq = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        starts = [a for a, _ in runs]
        new = []
        for turn in sorted({int(t) for df in frames for t in df[order]}):
            i = bisect_right(starts, turn) - 1
            if i < 0 or runs[i][1] < turn:
                new.append(turn)
        if new:
            for turn in new:
                i = bisect_right(starts, turn)
                if i and runs[i - 1][1] == turn - 1:
                    runs[i - 1][1] = turn
                else:
                    runs.insert(i, [turn, turn])
                    starts.insert(i, turn)
                    i += 1
                if i < len(runs) and runs[i][0] == turn + 1:
                    runs[i - 1][1] = runs[i][1]
                    del runs[i], starts[i]
            yield pd.DataFrame({conversation: key[0], order: new, "turn_seq": range(seq + 1, seq + 1 + len(new)), "dirty_through": seq + len(new)})
        state.update((json.dumps(runs), seq + len(new)))

    return turns.select(conversation, order).dropna().groupBy(conversation).applyInPandasWithState(step, f"{conversation} long, {order} long, turn_seq long, dirty_through long", "runs string, seq long", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key in a table of generations under `path`.

    Generation n + 1 comes from n and batch n; a batch that is replayed writes the same generation again.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch
        if n:
            new = upsert(spark.read.parquet(f"{path}/generation={n - 1}").drop("generation"), batch, key, version)
        else:
            new = upsert(batch.limit(0), batch, key, version)
        new.write.mode("overwrite").parquet(f"{path}/generation={n}")

    return write


def outbox_sink(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that delivers each outbox row once: rows delivered by other batches are left out, a replayed batch overwrites its own."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fresh = batch.dropDuplicates(key)
        if hadoop.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(hadoop):
            done = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != n)
            fresh = fresh.join(done.select(*key).distinct(), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


BUCKETS = 64


def _touched(batch: DataFrame, key: list[str], buckets: int) -> tuple[DataFrame, list[int]]:
    """batch with its keys' bucket, and the buckets that occur: at most `buckets`."""
    placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    return placed, sorted(r[0] for r in placed.select("bucket").distinct().collect())


def _there(spark: SparkSession, path: str, schema: str, touched: list[int]) -> DataFrame:
    """Rows of the touched buckets; none if nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def bucket_upsert_sink(path: str, key: list[str], version: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key in a table under `path`, partitioned by a bucket of the key.

    A batch reads and rewrites the buckets of its keys alone, so what it costs doesn't grow with the table's age. A row replaces one of an equal or
    smaller version, so a batch that is replayed, or was cut short while buckets were moved into place, ends in the same table.
    """

    def write(batch: DataFrame, n: int) -> None:
        placed, touched = _touched(batch, key, buckets)
        if touched:
            before = _there(batch.sparkSession, path, _ddl(batch, "bucket int"), touched)
            new = upsert(before, placed, key, version)
            new.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write


def bucket_outbox_sink(path: str, key: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that delivers each outbox row once, partitioned by a bucket of the key and the batch.

    Rows that other batches delivered are left out, for which a batch reads the keys in its own buckets; a batch that is replayed overwrites its own
    partitions, and gives the same rows, since later batches aren't there yet.
    """

    def write(batch: DataFrame, n: int) -> None:
        placed, touched = _touched(batch.dropDuplicates(key), key, buckets)
        if touched:
            done = _there(batch.sparkSession, path, _ddl(batch.select(*key), "bucket int", "batch long"), touched).where(F.col("batch") != n)
            fresh = placed.join(done.select(*key), key, "left_anti").withColumn("batch", F.lit(n).cast("long"))
            fresh.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    return write


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Processes all that is there and stops."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, minutes: int = 60, late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Extension: counts and sums in tumbling event-time windows with a watermark; on batches and streams alike."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", late) if events.isStreaming else at
    out = at.groupBy(F.window("ts", f"{minutes} minutes"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, hours: int = 24, step: int = 12, late: str = "1 day") -> DataFrame:
    """Extension: sliding windows."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", late) if events.isStreaming else at
    return at.groupBy(F.window("ts", f"{hours} hours", f"{step} hours")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", by: str = "user_id") -> DataFrame:
    """Extension: sessions that end after a gap."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", late) if events.isStreaming else at
    out = at.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Extension: rows once each, within the watermark on streams."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else at.dropDuplicates([key])
