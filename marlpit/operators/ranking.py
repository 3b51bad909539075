"""Places over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RANGES = 256


def global_rank(rows: DataFrame, lead: str, order: list[Column | str], name: str = "place", ranges: int = RANGES) -> DataFrame:
    """rows with their place, from 1, in the order of the number `lead` (null last) and then `order`.

    The table is cut into ranges of `lead` at approximate quantiles, which only balance the work; a row's place is its place in its range
    after the rows of the ranges before. Rows of one value of `lead` share a range. Only one row for each range is gathered.
    """
    cuts = rows.agg(F.coalesce(F.percentile_approx(F.col(lead).cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges), F.array().cast("array<double>")).alias("_cuts"))
    value = F.col(lead).cast("double")
    cut = F.when(value.isNull(), ranges).otherwise(F.size(F.filter("_cuts", lambda c: c < value)))
    dealt = rows.join(F.broadcast(cuts)).withColumn("_range", cut).drop("_cuts")  # one row
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # ranges + 1 rows at most
    before = sizes.select(F.col("_range").alias("_of"), (F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(F.col(lead).asc_nulls_last(), *order))
    return dealt.join(F.broadcast(before), F.col("_range") == F.col("_of")).withColumn(name, (within + F.col("_before")).cast("int")).drop("_range", "_of", "_before")
