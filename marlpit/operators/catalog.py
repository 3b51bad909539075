"""Document cards, catalog ranking and fuzzy names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed, text


def keywords(docs: DataFrame, key: str = "doc_id", column: str = "text", most: int = 18) -> DataFrame:
    """(key, keywords): the most frequent words of 3 to 40 characters, ties in alphabetical order."""
    words = F.regexp_extract_all(F.lower(column), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))
    counted = docs.select(key, F.explode(words).alias("w")).where((F.length("w") <= 40) & ~F.col("w").isin(fixed.KEYWORD_STOPWORDS)).groupBy(key, "w").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "w"))).where(F.col("r") <= most)
    top = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("keywords"))
    return docs.select(key).join(top, key, "left").select(key, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def importance(tags: Column, kind: Column, n_words: Column) -> Column:
    """0.45, and 0.35 for tags, 0.25 for plans and papers, 0.1 for long texts; at most 1."""
    extra = F.when(F.size(tags) > 0, 0.35).otherwise(0.0) + F.when(kind.isin("project_plan", "research_paper", "technical_plan"), 0.25).otherwise(0.0) + F.when(n_words > 500, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.45) + extra)


def cards(docs: DataFrame, filename: Column, key: str = "doc_id", column: str = "text") -> DataFrame:
    """A card for each document: title, type, language, summary, tags, keywords, importance."""
    body, name = F.col(column), F.col("filename")
    # few bytes, much work: dealt once by key, on which the counts of keywords and the join stay in place
    dealt = docs.withColumn("filename", filename).select(key, "filename", column).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    made = dealt.select(key, "filename", text.title_guess(body, F.regexp_replace(name, r"\.[^.]+$", "")).alias("title"), text.card_language(body).alias("language"), text.summary(body).alias("summary"), text.haystack(name, body).alias("_h"), F.size(F.split(body, r"\s+")).alias("n_words"))
    made = made.select(key, "filename", "title", "language", "summary", text.topic_tags(F.col("_h.cased")).alias("topic_tags"), text.project_tags(F.col("_h.cased")).alias("project_tags"), "n_words", "_h")
    made = made.withColumn("doc_type", text.doc_type_of(name, F.col("_h.low"), F.col("topic_tags"))).drop("_h")
    made = made.withColumn("importance", importance(F.col("topic_tags"), F.col("doc_type"), F.col("n_words")))
    return made.join(keywords(dealt, key, column), key)


EXACT = 0.98


def similarity(query: str, name: str) -> float:
    """0.82 if the query is part of the name, else the ratio of matching blocks; without case and outer white space."""
    a, b = query.lower().strip(), name.lower().strip()
    return 0.82 if a in b else SequenceMatcher(None, a, b).ratio()


def _bound(query: str, name: str) -> float:
    """What similarity() is at most, rounded like scores."""
    a, b = query.lower().strip(), name.lower().strip()
    if a in b:
        return 1.0
    both = SequenceMatcher(None, a, b)
    return round(min(both.real_quick_ratio(), both.quick_ratio()), 6)


def fuzzy_names(names: DataFrame, queries: DataFrame, name: str, query: str, key: str, least: float = 0.45, most: int = 5, sure: float = 0.96, path: str | None = None) -> DataFrame:
    """(query, key, score, rank, resolved): names (or, if given, paths) equal to the query, at EXACT; if there are none, names at least `least` similar.

    A single name at `sure` or more resolves the query. Every name is scored with every query. Only the ratio of matching blocks is
    left out where its upper bounds, by lengths and by common characters, are under `least`. Null names and queries match nothing.
    """

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(similarity(x, y), 6) if _bound(x, y) >= least else -1.0 for x, y in zip(a, b, strict=True)], dtype="float64")

    asked = queries.where(F.col(query).isNotNull()).select(query).distinct()
    equal = (F.col(name) == F.col(query)) | (F.coalesce(F.col("_path") == F.col(query), F.lit(False)) if path else F.lit(False))
    kept = names.where(F.col(name).isNotNull()).select(key, name, *([F.col(path).alias("_path")] if path else []))
    dealt = kept.repartition(names.sparkSession.sparkContext.defaultParallelism)
    scored = dealt.crossJoin(asked).withColumn("_equal", equal).withColumn("score", F.when(F.col("_equal"), EXACT).otherwise(score(F.col(query), F.col(name)))).where(F.col("score") >= least)
    scored = scored.withColumn("_any", F.max("_equal").over(W.partitionBy(query))).where(F.col("_equal") | ~F.col("_any"))
    w = W.partitionBy(query).orderBy(F.desc("score"), key)
    sures = F.sum(F.when(F.col("score") >= sure, 1).otherwise(0)).over(W.partitionBy(query))
    ranked = scored.withColumns({"rank": F.row_number().over(w), "resolved": (sures == 1) & (F.col("score") >= sure)})
    return ranked.where(F.col("rank") <= most).select(query, key, "score", "rank", "resolved")


def catalog_scores(cards_: DataFrame, files: DataFrame) -> DataFrame:
    """Cards and files in one list by id: 1/(60 + rank) with 0.15 and a share of importance for cards, 0.05 for files. Equal ids add up."""
    a = cards_.select("id", (1.0 / (fixed.RRF_K + F.col("rank")) + 0.15 + 0.05 * F.col("importance")).alias("s"))
    b = files.select("id", (1.0 / (fixed.RRF_K + F.col("rank")) + 0.05).alias("s"))
    return a.unionByName(b).groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"))
