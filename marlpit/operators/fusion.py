"""Rank fusion, hybrid merging, boosts and reranking."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.text import overlap_ratio, search_tokens


def with_rank(df: DataFrame, by: str, key: str, partition: list[str] | None = None, ascending: bool = False, name: str = "rank") -> DataFrame:
    order = [F.asc(by) if ascending else F.desc(by), F.asc(key)]
    return df.withColumn(name, F.row_number().over(W.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)))


def rrf_term(rank: Column, k: int = fixed.RRF_K) -> Column:
    """1 / (k + rank); 0 where there is no rank."""
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def fuse(rankings: DataFrame, query: str = "query_id", key: str = "id", ranking: str = "ranking", position: str = "position", k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of any number of rankings: (query, key, score, rank).

    A key counts once in a ranking, at its first position; ranks are positions among the ranking's distinct keys. Ties
    go to what was seen first: ranking by ranking, each in its order.
    """
    once = rankings.groupBy(query, ranking, key).agg(F.min(position).alias("p"))
    ranked = once.withColumn("r", F.row_number().over(W.partitionBy(query, ranking).orderBy("p", key)))
    scored = ranked.groupBy(query, key).agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"), F.min(F.struct(ranking, "r")).alias("seen"))
    order = W.partitionBy(query).orderBy(F.desc("score"), "seen")
    return scored.select(query, key, "score", F.row_number().over(order).alias("rank"))


def merge_channels(vector: DataFrame, lexical: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join of a vector ranking (key, vector_rank) and a lexical one (key, lexical_rank), with the fused score and both channels' flags."""
    both = vector.join(lexical, key, "full_outer")
    score = rrf_term(F.col("vector_rank")) + rrf_term(F.col("lexical_rank"))
    channels = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("lexical_rank").isNotNull(), "lexical")))
    return both.withColumn("rrf", score).withColumn("channels", channels)


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def boost(query: Column, haystack: Column, content: Column, kind: Column, channels: Column, lexical_rank: Column, explains: Column, visual: Column) -> Column:
    """Small additions to a fused score: shared tokens, explanatory content, artifacts asked for, both channels, first lexical hit."""
    q, h = search_tokens(query, 24), search_tokens(haystack, 24)
    low, asked = F.lower(content), F.lower(query)
    when = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)
    return (
        overlap_ratio(q, h) * 0.012
        + when(explains & _any(low, fixed.EXPLANATORY_CONTENT), 0.028)
        - when(explains & _any(low, fixed.CLOSING_CONTENT), 0.012)
        + when(visual & kind.isin("figure", "table"), 0.02)
        + when((kind == "figure") & _any(asked, fixed.FIGURE_WORDS), 0.018)
        + when((kind == "table") & _any(asked, fixed.TABLE_WORDS), 0.014)
        + when(F.size(channels) > 1, 0.004)
        + when(lexical_rank == 1, 0.002)
    )


def rerank_each(candidates: DataFrame, k: int, first: int, query: str = "query_id", base: str = "score", place: str = "place", cosine: str = "cosine", key: str = "id", weight: float = 0.35, also: tuple[str, ...] = ()) -> DataFrame:
    """rerank() for the ranked list of each query, ties in the order of `place`: (query, key, columns of `also`, rerank_score, rank)."""
    n = F.count("*").over(W.partitionBy(query))
    changes, head = n > k, F.col(place) <= first
    scored = candidates.withColumns({"rerank_score": F.round(F.when(changes & head, F.col(base) + weight * F.coalesce(cosine, F.lit(0.0))).otherwise(F.col(base)), 6), "_changes": changes, "_head": head})
    within = F.row_number().over(W.partitionBy(query, "_head").orderBy(F.desc("rerank_score"), place))
    kept = scored.withColumn("_in", within).where(~F.col("_changes") | ~F.col("_head") | (F.col("_in") <= k))
    order = W.partitionBy(query).orderBy(F.when(F.col("_changes"), F.lit(0)).otherwise(F.col(place)), F.desc("rerank_score"), F.desc("_head"), place)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, *also, "rerank_score", "rank")


#: What cross_rerank() has loaded in this Python worker, by name.
_MODELS: dict[str, Callable] = {}


def _cut(query: str, text: str, most: int) -> tuple[str, str]:
    """Both texts within `most` words together, words taken from the end of the longer one."""
    q, t = query.split(), text.split()
    kept = min(len(q), max(most // 2, most - len(t)))
    return " ".join(q[:kept]), " ".join(t[: most - kept])


def cross_rerank(candidates: DataFrame, model: str, load: Callable[[], Callable], k: int, first: int = 20, most_words: int = 512, batch: int = 64, query: str = "query_id", asked: str = "text", content: str = "content", base: str = "score", place: str = "place", key: str = "id") -> DataFrame:
    """(query, key, rerank_score, backend, rank): each query's k best by a model that reads question and text together.

    `load` gives a function from a list of pairs to their scores; each Python worker calls it once for each name `model`. The first candidates by `place` are
    scored, in batches, and the k best of them ordered with the others, which keep their own score. If the model can't be loaded, or fails on a
    pair of a query, that query keeps the order that it had (backend `base`). Null texts count as empty.
    """
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (query, key, base, place)}
    head = F.coalesce(F.col(place) <= first, F.lit(False))
    text = lambda c: F.when(head, F.coalesce(c, F.lit("")))
    read = candidates.select(query, key, base, place, head.alias("_head"), text(asked).alias("_q"), text(content).alias("_t"))  # the others come along, else they would be found again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[float | None] = []
            mine = rows.filter(rows.column(4))
            pairs = [_cut(q, t, most_words) for q, t in zip(mine.column(5).to_pylist(), mine.column(6).to_pylist(), strict=True)]
            for i in range(0, len(pairs), batch):
                part = pairs[i : i + batch]
                try:
                    if model not in _MODELS:
                        _MODELS[model] = load()
                    out += [float(x) for x in _MODELS[model](part)]
                except Exception as e:  # noqa: BLE001 - a model of the user's: its failure gives the order without it
                    logging.getLogger(__name__).warning("%s failed: %s", model, e)
                    out += [None] * (i + len(part) - len(out))
            scores = iter(out)
            each = pa.array([next(scores) if h else None for h in rows.column(4).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], each], [query, key, base, place, "_head", "_s"])

    parts = candidates.sparkSession.sparkContext.defaultParallelism
    told = read.repartition(parts, query, key).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", _head boolean, _s double")
    sound = F.min(F.when(F.col("_head"), F.col("_s").isNotNull().cast("int")).otherwise(1)).over(W.partitionBy(query)) == 1
    told = told.withColumn("_sound", sound).withColumn("rerank_score", F.round(F.when(F.col("_sound") & F.col("_head"), F.col("_s")).otherwise(F.col(base)), 6))
    within = F.row_number().over(W.partitionBy(query, "_head").orderBy(F.desc("rerank_score"), place))
    kept = told.withColumn("_in", within).where(~F.col("_sound") | ~F.col("_head") | (F.col("_in") <= k))
    order = W.partitionBy(query).orderBy(F.when(F.col("_sound"), F.lit(0)).otherwise(F.col(place)), F.desc("rerank_score"), F.desc("_head"), place)
    backend = F.when(~F.col("_sound"), "base").when(F.col("_head"), "cross_encoder").otherwise("first_stage_tail")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, "rerank_score", backend.alias("backend"), "rank")


def rerank(candidates: DataFrame, k: int, first: int, base: str = "score", cosine: str = "cosine", key: str = "id", weight: float = 0.35) -> DataFrame:
    """Adds weight * cosine to the first candidates and orders them anew; of the rest, tail rows come in by their own score.

    With at most k candidates the order stays. Scores are rounded to 6 digits.
    """
    ranked = with_rank(candidates, base, key, name="base_rank").withColumn("n", F.count("*").over(W.partitionBy(F.lit(0))))
    new = F.when((F.col("n") > k) & (F.col("base_rank") <= first), F.col(base) + weight * F.col(cosine)).otherwise(F.col(base))
    scored = ranked.withColumn("rerank_score", F.round(new, 6)).withColumn("head", F.col("base_rank") <= first)
    within = F.row_number().over(W.partitionBy("head").orderBy(F.desc("rerank_score"), key))
    kept = scored.withColumn("place", within).where((F.col("n") <= k) | ~F.col("head") | (F.col("place") <= k))
    order = W.partitionBy(F.lit(0)).orderBy(F.when(F.col("n") <= k, F.col("base_rank")).otherwise(0), F.desc("rerank_score"), key)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rerank_score", "rank")
