"""Changes to tables as functions from old rows and changes to new rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def classify(current: DataFrame, incoming: DataFrame, key: str, content_hash: str, versions: list[str] = ()) -> DataFrame:
    """(key, change): new, changed (content or a version differs), unchanged or removed, by a full outer join of narrow columns."""
    a = current.select(key, F.col(content_hash).alias("_h"), *[F.col(v).alias(f"_{v}") for v in versions])
    b = incoming.select(key, content_hash, *versions, F.lit(True).alias("_in"))
    same = reduce(lambda x, y: x & y, [F.col("_h").eqNullSafe(F.col(content_hash)), *[F.col(f"_{v}").eqNullSafe(F.col(v)) for v in versions]])
    both = a.withColumn("_old", F.lit(True)).join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_in").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row with the largest version of each key; on equal versions the change wins."""
    both = current.withColumn("_s", F.lit(0)).unionByName(changes.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(version), F.desc("_s")))
    return both.withColumn("_n", place).where("_n = 1").drop("_n", "_s")


def insert_missing(current: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """current, and the first new row of each key that it lacks."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(order))
    fresh = rows.join(current.select(*key).distinct(), key, "left_anti").withColumn("_n", place).where("_n = 1").drop("_n")
    return current.unionByName(fresh, allowMissingColumns=True)


def replace(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """current without the keys of rows, and rows: a store that deletes ids before it appends."""
    return current.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the keys that go."""
    ids = gone.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def prune(vectors: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows whose key is kept; an empty keep set empties the table."""
    return vectors.join(keep.select(key).distinct(), key, "left_semi")


def guarded_prune(rows: DataFrame, canonical: DataFrame, ready: Column, key: str) -> DataFrame:
    """Rows that the canonical set has; all rows while that set is empty or any of its documents is not ready."""
    guard = canonical.agg((F.coalesce(F.min(F.when(ready, 1).otherwise(0)), F.lit(0)) == 1).alias("_ok"))
    marked = rows.join(canonical.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").join(F.broadcast(guard))
    return marked.where(F.col("_in") | ~F.col("_ok")).drop("_in", "_ok")


def stale_search_rows(index: DataFrame, source: DataFrame, key: str, text: str) -> DataFrame:
    """Index rows without a source row, or with another text (null-safe)."""
    both = index.join(source.select(F.col(key), F.col(text).alias("_t"), F.lit(True).alias("_in")), key, "left")
    return both.where(F.col("_in").isNull() | ~F.col(text).eqNullSafe(F.col("_t"))).drop("_t", "_in")


def missing_search_rows(index: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return source.join(index.select(key).distinct(), key, "left_anti")


def stale_parts(current: dict[str, Column], built: dict[str, Column]) -> Column:
    """Names of the versions that differ from those a card was built with."""
    return F.array_compact(F.array(*[F.when(~current[n].eqNullSafe(built[n]), n) for n in current]))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One SHA-256 for a table's content, whatever the order of its rows: a sum of row hashes, without gathering rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*"), *[part(i) for i in range(4)]), 256).alias("fingerprint"), F.count("*").alias("rows"))


def migrate(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """rows with the columns that are missing, as nulls of their type."""
    return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in rows.columns])
