"""Neighbours and running totals of long sequences, without one task for each.

A sequence is cut into spans of its order's numbers. Windows run within a span; what crosses from one span to the next comes from one row for
each span. A sequence that holds a third of all rows so is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 1024


def _cut(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_span", F.floor(F.col(order) / F.lit(width)))


def running(rows: DataFrame, by: list[str], order: str, amount: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the sum of `amount` up to each row, in the order of a whole number that is unique in a sequence. Null amounts count as 0; keys are not null."""
    cut = _cut(rows.withColumn("_a", F.coalesce(amount, F.lit(0))), order, width)
    sums = cut.groupBy(*by, "_span").agg(F.sum("_a").alias("_t"))
    before = sums.select(*by, "_span", F.coalesce(F.sum("_t").over(W.partitionBy(*by).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.sum("_a").over(W.partitionBy(*by, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("_here", here).join(before, [*by, "_span"]).withColumn(name, F.col("_before") + F.col("_here")).select(*rows.columns, name)


def beside(rows: DataFrame, by: list[str], order: str, value: Column, name: str, ahead: bool = True, width: int = WIDTH) -> DataFrame:
    """rows with the value of the next row of their sequence (or, if not ahead, of the one before); null at its end. Order and keys as in running()."""
    cut = _cut(rows.withColumn("_v", F.struct(value.alias("x"))), order, width)
    pick, move = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    ends = cut.groupBy(*by, "_span").agg(pick("_v", order).alias("_end"))
    ends = ends.select(*by, "_span", move("_end").over(W.partitionBy(*by).orderBy("_span")).alias("_across"))
    here = move("_v").over(W.partitionBy(*by, "_span").orderBy(order))
    return cut.withColumn("_here", here).join(ends, [*by, "_span"]).withColumn(name, F.coalesce("_here", "_across")["x"]).select(*rows.columns, name)
