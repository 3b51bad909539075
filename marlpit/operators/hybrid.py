"""Two-stage hybrid search: cards choose documents, channels rank their chunks, ranks are fused, boosted and cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.text import search_tokens
from ..functions.vectors import cosine, squared_distance
from . import fusion, lexical, vector


def choose_documents(cards: DataFrame, query: DataFrame, k: int, key: str = "document_id") -> DataFrame:
    """The nearest documents by their cards' vectors, in the number that k results ask for."""
    n = vector.adaptive_k(k)["documents"]
    return vector.nearest(cards, query, key, "embedding", n, None, 5).select(key)


def search(chunks: DataFrame, vectors: DataFrame, cards: DataFrame, query: DataFrame, terms: DataFrame, k: int = 5, scope: DataFrame | None = None) -> DataFrame:
    """(id, score, vector_rank, lexical_rank, rank) for one query.

    Vectors are ranked among the chosen documents within the scope. Words are ranked in the scope alone. chunks: id, document_id,
    content; vectors: id, document_id, embedding. search_each() takes many queries, falls back to unscoped vectors, boosts and reranks.
    """
    limits = vector.adaptive_k(k)
    within = cards if scope is None else cards.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    chosen = choose_documents(within, query, k)
    near = vectors.join(F.broadcast(chosen), "document_id", "left_semi")  # at most max(2k, 8) rows
    v = fusion.with_rank(vector.nearest(near, query, "id", "embedding", limits["text"], None, 5), "distance", "id", ascending=True, name="vector_rank").select("id", "vector_rank")
    spoken = chunks if scope is None else chunks.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    ranked = lexical.top(lexical.bm25(chunks, terms, "id", {"content": 1.0}).join(spoken.select("id"), "id", "left_semi"), limits["lexical"], "id")
    lex = ranked.select("id", F.col("rank").alias("lexical_rank"))
    both = fusion.merge_channels(v, lex).withColumn("score", F.round(F.col("rrf") + F.when(F.size("channels") > 1, 0.004).otherwise(0.0) + F.when(F.col("lexical_rank") == 1, 0.002).otherwise(0.0), 9))
    return fusion.with_rank(both, "score", "id").where(F.col("rank") <= k).select("id", "score", "vector_rank", "lexical_rank", "rank")


def _any(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])


def meets_topics(asked: Column, tags: Column, shown: Column) -> Column:
    """Whether a card has all topics that a question asks for, as a tag or in its text."""
    low, text = F.replace(F.lower(asked), F.lit("-"), F.lit(" ")), F.lower(F.coalesce(shown, F.lit("")))
    return reduce(lambda a, b: a & b, [~_any(low, fixed.TOPIC_ASKED[t]) | F.coalesce(F.array_contains(tags, t), F.lit(False)) | _any(text, fixed.TOPIC_SHOWN[t]) for t in fixed.TOPIC_ASKED])


def select_documents(cards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, document_id): the nearest cards' documents that meet the question's topics; where none of a query's cards meets them, the nearest."""
    limits = vector.adaptive_k(k)
    near = vector.nearest_each(cards, queries, "document_id", "embedding", limits["cards"])
    told = near.join(queries.select("query_id", "text"), "query_id").join(cards.select("document_id", F.col("topic_tags").alias("_tags"), F.col("text").alias("_shown")), "document_id")
    fits = told.withColumn("_fits", meets_topics(F.coalesce("text", F.lit("")), F.col("_tags"), F.col("_shown")))
    kept = fits.withColumn("_some", F.max("_fits").over(W.partitionBy("query_id"))).where(F.col("_fits") | ~F.col("_some"))
    return kept.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= limits["documents"]).select("query_id", "document_id")


def search_each(chunks: DataFrame, cards: DataFrame, queries: DataFrame, k: int = 5, scope: DataFrame | None = None, rerank: bool = True, visual: bool = False, first: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, vector_rank, lexical_rank, place), and with `rerank` rerank_score and rank: the k best chunks of each query.

    chunks: id, document_id, kind (text, table, figure), content, embedding; cards: document_id, embedding, topic_tags, text; queries:
    query_id, text, q; scope: (query_id, document_id). With a scope, a query without documents in it gets nothing, and vectors and words are
    ranked in it. Without one, vectors are ranked in the documents that select_documents() finds, or in all if there are no cards; words in all.
    Ranks of both are fused, small boosts added, and the first candidates reordered by their cosine. A chunk without a vector is found by words.
    vectors (id, embedding): a table of the chunks' vectors, if it is another; chunks' contents then don't travel to meet them.
    """
    limits = vector.adaptive_k(k, visual, rerank)
    places = {m: i for i, m in enumerate(fixed.MODALITIES)}
    if scope is not None:
        chosen = scope.select("query_id", "document_id").distinct()
        queries = queries.join(chosen.select("query_id").distinct(), "query_id", "left_semi")
        free = queries.where("false")
    else:
        chosen = select_documents(cards, queries, k)
        free = queries.join(chosen.select("query_id").distinct(), "query_id", "left_anti")
    placed = chunks if vectors is None else chunks.select("id", "document_id", "kind").join(vectors.select("id", "embedding"), "id")
    of_kind = placed.where(F.col("kind").isin(*fixed.MODALITIES))
    distance = F.round(squared_distance(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>")), 6)
    inside = of_kind.where("embedding IS NOT NULL").join(chosen, "document_id").join(queries.select("query_id", "q"), "query_id").select("query_id", "id", "kind", distance.alias("distance")).where("distance IS NOT NULL")
    most = max(limits[m] for m in fixed.MODALITIES)
    outside = vector.nearest_each(of_kind, free, "id", "embedding", most, by="kind").select("query_id", "id", "kind", F.col("score").alias("distance"))
    near = vector.merge_modalities(inside.unionByName(outside).withColumnRenamed("kind", "modality"), {m: limits[m] for m in fixed.MODALITIES}, "id", "query_id")
    kind = F.coalesce(*[F.when(F.col("modality") == m, i) for m, i in places.items()])
    v = near.withColumn("vector_rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", kind, "id"))).select("query_id", "id", "vector_rank")

    scored = lexical.bm25(chunks, queries.select("query_id", search_tokens(F.col("text"), 10).alias("terms")), "id", {"content": 1.0})
    if scope is not None:
        scored = scored.join(chunks.select("id", "document_id"), "id").join(chosen, ["query_id", "document_id"], "left_semi").drop("document_id")
    spoken = lexical.top(scored, limits["lexical"], "id").select("query_id", "id", F.col("rank").alias("lexical_rank"))

    both = v.join(spoken, ["query_id", "id"], "full_outer")
    most = queries.count() * (limits["lexical"] + sum(limits[m] for m in fixed.MODALITIES))
    told = lexical.beside(both, chunks.select("id", "kind", "content", *(["embedding"] if vectors is None else [])), "id", most).join(queries.select("query_id", "text", "q"), "query_id")
    told = told if vectors is None else told.join(vectors.select("id", "embedding"), "id", "left")
    channels = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("lexical_rank").isNotNull(), "lexical")))
    asked, content = F.coalesce("text", F.lit("")), F.coalesce("content", F.lit(""))
    extra = fusion.boost(asked, content, content, F.col("kind"), channels, F.col("lexical_rank"), _any(F.lower(asked), fixed.BOOST_EXPLAIN_MARKERS), F.lit(visual))
    told = told.withColumn("score", F.round(fusion.rrf_term(F.col("vector_rank")) + fusion.rrf_term(F.col("lexical_rank")) + extra, 9))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), "lexical_rank", "id")
    ranked = told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limits["candidates"])
    cos = F.when(F.col("embedding").isNotNull(), F.round(cosine(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>")), 6))
    ranked = ranked.select("query_id", "id", "score", "vector_rank", "lexical_rank", "place", cos.alias("cosine"))
    if not rerank:
        return ranked.drop("cosine")
    return fusion.rerank_each(ranked, k, first, also=("score", "vector_rank", "lexical_rank", "place"))
