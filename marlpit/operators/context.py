"""Context assembly: neighbours, quotas, budgets and interleaving."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1, doc: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """Chunks of a hit's document within `window` places, not itself, on its page and in its section where the hit has them.

    Each hit is spread over the indices it may touch, so the join is on equal keys.
    """
    wanted = hits.select(F.col(doc), F.col(index).alias("hit_index"), F.col("page_number").alias("hit_page"), F.col("section").alias("hit_section"))
    spread = F.filter(F.sequence(F.lit(-window), F.lit(window)), lambda o: o != 0)
    wanted = wanted.withColumn("offset", F.explode(spread)).withColumn(index, F.col("hit_index") + F.col("offset"))
    found = wanted.join(chunks, [doc, index])
    same_page = F.col("hit_page").isNull() | F.coalesce(F.col("page_number") == F.col("hit_page"), F.lit(False))
    same_section = F.col("hit_section").isNull() | F.coalesce(F.col("section") == F.col("hit_section"), F.lit(False))
    return found.where(same_page & same_section).drop("hit_page", "hit_section")


def parents(hits: DataFrame, parent_texts: DataFrame, key: str = "parent_id") -> DataFrame:
    """Each parent passage once, at the rank of its first hit."""
    return hits.groupBy(key).agg(F.min("rank").alias("rank")).join(parent_texts, key)


def quota(ranked: DataFrame, doc: str, n: int, exempt: Column | None = None, rank: str = "rank") -> DataFrame:
    """At most n rows of each document in ranked order; exempt rows pass and don't count."""
    free = F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)
    place = F.row_number().over(W.partitionBy(doc, "_free").orderBy(rank))
    return ranked.withColumn("_free", free).withColumn("_n", place).where(F.col("_free") | (F.col("_n") <= n)).drop("_free", "_n")


def fill(rows: DataFrame, group: str, rank: str, size: str, budget: int, most: int, least_cut: int = 300) -> DataFrame:
    """Greedy fill in rank order that skips what would overflow and goes on; the first block, if too large, is cut to the budget, but to no less than `least_cut`.

    Adds used_size and place. A group is one context's candidates and small by nature; its rows reach Python once.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        used, keep, sizes = 0, [], []
        for i, n in zip(df.index, df[size], strict=True):
            if len(keep) == most:
                break
            if used + n > budget:
                if used:
                    continue
                n = min(n, max(budget, least_cut))
            used += n
            keep.append(i)
            sizes.append(n)
        return df.loc[keep].assign(used_size=sizes, place=range(1, len(keep) + 1))

    def groups(df: pd.DataFrame) -> pd.DataFrame:
        return run(df.sort_values(rank, kind="stable"))

    return rows.groupBy(group).applyInPandas(groups, f"{fields}, used_size long, place long")


def interleave(ranked: DataFrame, doc: str, rank: str = "rank", partition: str | None = None) -> DataFrame:
    """Round robin over documents: by the place within a document, then by which document came first."""
    base = [partition] if partition else []
    placed = ranked.withColumns({"_n": F.row_number().over(W.partitionBy(*base, doc).orderBy(rank)), "_first": F.min(rank).over(W.partitionBy(*base, doc))})
    order = W.partitionBy(*(base or [F.lit(0)])).orderBy("_n", "_first")
    return placed.withColumn("place", F.row_number().over(order)).drop("_n", "_first")


def reserve(ranked: DataFrame, required: DataFrame, doc: str, rank: str = "rank", partition: str | None = None) -> DataFrame:
    """The best row of each required document ahead of all others, which keep their order."""
    base = [partition] if partition else []
    marked = ranked.join(required.select(*base, doc).distinct().withColumn("_r", F.lit(1)), [*base, doc], "left")
    best = F.row_number().over(W.partitionBy(*base, doc).orderBy(rank))
    first = F.when(F.col("_r").isNotNull() & (F.col("_best") == 1), 0).otherwise(1)
    order = W.partitionBy(*(base or [F.lit(0)])).orderBy(first, rank)
    return marked.withColumn("_best", best).withColumn("place", F.row_number().over(order)).drop("_r", "_best")


def by_class(ranked: DataFrame, quotas: dict[str, int], kind: str = "kind", rank: str = "rank", partition: str | None = None, most: int = 8) -> DataFrame:
    """Tables and figures first up to their quotas, the rest backfilled in ranked order, `most` in all."""
    base = [partition] if partition else []
    n = F.row_number().over(W.partitionBy(*base, kind).orderBy(rank))
    classes = list(quotas)
    level = F.lit(len(classes))
    for i, c in reversed(list(enumerate(classes))):
        level = F.when((F.col(kind) == c) & (F.col("_n") <= quotas[c]), i).otherwise(level)
    order = W.partitionBy(*(base or [F.lit(0)])).orderBy("_level", rank)
    placed = ranked.withColumn("_n", n).withColumn("_level", level).withColumn("place", F.row_number().over(order))
    return placed.where(F.col("place") <= most).drop("_n", "_level")


def parent_quota(hits: DataFrame, parent: str, doc: str, per_doc: int = 4, most: int = 32, rank: str = "rank", partition: str | None = None) -> DataFrame:
    """Each parent at its first hit, at most `per_doc` of a document and `most` in all."""
    base = [partition] if partition else []
    once = hits.groupBy(*base, doc, parent).agg(F.min(rank).alias(rank))
    limited = once.withColumn("_n", F.row_number().over(W.partitionBy(*base, doc).orderBy(rank))).where(F.col("_n") <= per_doc)
    order = W.partitionBy(*(base or [F.lit(0)])).orderBy(rank)
    return limited.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_n")


def context_stats(sources: DataFrame, by: str) -> DataFrame:
    return sources.groupBy(by).agg(
        F.count("*").alias("sources"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("kind") == "table").alias("tables"),
        F.count_if(F.col("kind") == "figure").alias("figures"), F.sum(F.length("content")).alias("chars"),
    )


def canonical_identity() -> Column:
    """What a piece of evidence is, within its document: table, figure, parent or chunk, the first it has."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in ("table_id", "figure_id", "parent_id", "chunk_id")]
    return F.concat(F.col("document_id").cast("string"), F.lit("/"), F.coalesce(*parts))


def evidence_union(a: DataFrame, b: DataFrame, rank: str = "rank") -> DataFrame:
    """Both sets, each piece once: a's rows go before b's."""
    both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)), allowMissingColumns=True).withColumn("identity", canonical_identity())
    place = F.row_number().over(W.partitionBy("identity").orderBy("_s", rank))
    return both.where(F.col("identity").isNotNull()).withColumn("_n", place).where("_n = 1").drop("_n", "_s")


def new_evidence(found: DataFrame, known: DataFrame, rank: str = "rank") -> DataFrame:
    """Pieces of `found`, once each, that `known` lacks; pieces without an identity don't count."""
    fresh = found.withColumn("identity", canonical_identity()).where(F.col("identity").isNotNull())
    fresh = fresh.join(known.withColumn("identity", canonical_identity()).select("identity").distinct(), "identity", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy("identity").orderBy(rank))).where("_n = 1").drop("_n")
