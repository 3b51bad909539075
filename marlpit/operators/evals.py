"""Retrieval metrics, percentiles, samples and answer scores."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lexical import words_of


def first_relevant(run: DataFrame, relevant: DataFrame, query: str = "query_id", key: str = "id") -> DataFrame:
    """(query, first): the best rank of a relevant row; queries without one are absent."""
    return run.join(relevant.select(query, key).distinct(), [query, key], "left_semi").groupBy(query).agg(F.min("rank").alias("first"))


def ranking_metrics(run: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", key: str = "id") -> DataFrame:
    """hit, recall, mrr and ndcg at k with binary relevance, for each query with relevant rows; rounded to 6 digits."""
    wanted = relevant.select(query, key).distinct()
    found = run.where(F.col("rank") <= k).join(wanted, [query, key], "left_semi").groupBy(query)
    found = found.agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    both = wanted.groupBy(query).agg(F.count("*").alias("n")).join(found, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(query, F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"), F.round(zero(F.col("hits") / F.greatest("n", F.lit(1))), 6).alias("recall"), F.round(zero(1.0 / F.col("first")), 6).alias("mrr"), F.round(zero(F.col("dcg")) / best, 6).alias("ndcg"))


def mean_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = [c for c in ("hit", "recall", "mrr", "ndcg") if c in metrics.columns]
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def _ranked(df: DataFrame, by: str, value: str) -> DataFrame:
    """Each value with its place in its group and the group's size; no group is gathered into one row."""
    return df.select(by, value, F.row_number().over(W.partitionBy(by).orderBy(value)).alias("i"), F.count("*").over(W.partitionBy(by)).alias("n"))


def _at(place: Column, value: str) -> Column:
    return F.max(F.when(F.col("i") == place, F.col(value)))


def percentiles_nearest(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p * n)."""
    return _ranked(df, by, value).groupBy(by).agg(*[_at(F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)), value).alias(name) for name, p in shares.items()])


def percentiles_rounded(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The value at index (n - 1) * p, rounded half to even, and the interpolated median."""
    at = [_at(F.bround((F.col("n") - 1) * F.lit(p)).cast("long") + 1, value).alias(name) for name, p in shares.items()]
    middle = F.avg(F.when(F.col("i").isin(0) | (F.col("i") == F.floor((F.col("n") + 1) / 2)) | (F.col("i") == F.floor(F.col("n") / 2) + 1), F.col(value)))
    return _ranked(df, by, value).groupBy(by).agg(*at, F.round(middle, 6).alias("median"))


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, upper median, mean and most."""
    ranked = _ranked(df, by, value)
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("least"), _at(F.floor(F.col("n") / 2) + 1, value).alias("upper_median"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"))


def token_f1(pairs: DataFrame, key: str) -> DataFrame:
    """Multiset token recall and F1 of a prediction against a reference."""
    side = lambda c: pairs.select(key, F.explode(words_of(F.col(c))).alias("t")).groupBy(key, "t").agg(F.count("*").alias(c[0]))
    common = side("prediction").join(side("reference"), [key, "t"]).groupBy(key).agg(F.sum(F.least("p", "r")).alias("both"))
    sized = pairs.select(key, F.size(words_of(F.col("prediction"))).alias("np"), F.size(words_of(F.col("reference"))).alias("nr")).join(common, key, "left")
    both = F.coalesce("both", F.lit(0))
    return sized.select(key, F.round(F.when(F.col("nr") > 0, both / F.col("nr")).otherwise(0.0), 6).alias("recall"), F.round(F.when(F.col("np") + F.col("nr") > 0, 2.0 * both / (F.col("np") + F.col("nr"))).otherwise(0.0), 6).alias("f1"))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(pairs: DataFrame, key: str) -> DataFrame:
    """ROUGE-L F1 of word sequences."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            n = common_length(list(x), list(y)) if len(x) and len(y) else 0
            return round(2 * n / (len(x) + len(y)), 6) if n else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.select(key, score(words_of(F.col("prediction")), words_of(F.col("reference"))).alias("rouge_l"))


def best_reference(scored: DataFrame, key: str, score: str) -> DataFrame:
    return scored.groupBy(key).agg(F.max(score).alias(score))


def _by_hash(key: str) -> list[Column]:
    return [F.sha2(F.col(key).cast("string"), 256), F.col(key)]


def stratified(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """The first n rows of each stratum by the SHA-256 of the key."""
    place = F.row_number().over(W.partitionBy(*strata).orderBy(*_by_hash(key)))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def balanced(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """n rows dealt in turn from the strata, each in the order of its keys' SHA-256."""
    place = F.row_number().over(W.partitionBy(*strata).orderBy(*_by_hash(key)))
    return df.withColumn("_n", place).where(F.col("_n") <= n).orderBy("_n", *strata).limit(n).drop("_n")


def candidate_recall(run: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", key: str = "id") -> DataFrame:
    """Share of relevant rows among the first k."""
    return relevant.join(run, [query, key]).agg(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias("recall"))
