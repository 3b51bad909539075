"""Exact vector search, filters, and merging of modalities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import squared_distance
from .ranking import global_rank


def record_filter(document_ids: list | None = None, file_ids: list | None = None, folder: str | None = None) -> Column:
    """Scope of a search: None leaves a field open, an empty list matches nothing; all given parts must hold."""
    test = F.lit(True)
    if document_ids is not None:
        test &= F.col("document_id").isin(list(document_ids)) if document_ids else F.lit(False)
    if file_ids is not None:
        test &= F.col("file_id").isin(list(file_ids)) if file_ids else F.lit(False)
    if folder is not None:
        test &= F.col("source_path").startswith(folder)
    return test


def nearest(rows: DataFrame, query: DataFrame, key: str, vector: str, k: int, where: Column | None = None, digits: int = 6) -> DataFrame:
    """The k rows at the least squared distance from the one query vector (column q), filtered first; ties to the smaller key. nearest_each() takes many queries."""
    kept = rows if where is None else rows.where(where)
    scored = kept.join(F.broadcast(query.limit(1))).select(key, F.round(squared_distance(F.col(vector), F.col("q")), digits).alias("distance"))
    return scored.orderBy("distance", key).limit(k)


#: Rows of a block of queries and of a block of vectors; a task holds one of each, and their products.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096


def nearest_each(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, metric: str = "l2", where: Column | None = None, digits: int = 6, by: str | None = None, own: bool = True) -> DataFrame:
    """(query_id, key, score, rank), or with `by` a rank within each of its values: the k best rows for each row (query_id, q) of queries.

    metric: `l2` (squared distance, least first), `cosine` or `dot` (largest first); scores are rounded to `digits`, ties go to the smaller key. A cosine
    of a zero vector is 0. Vectors that are null or of another length than the query's take no part. With `own` off, the row whose key
    is the query's id is left out.

    Each block of queries meets each block of rows in a task, which hands on its k best for each query (and value of `by`): vectors travel once
    for each block of queries, and no task holds more than two blocks.
    """
    kept = (rows if where is None else rows.where(where)).where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    kept = kept.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), (F.col(by).cast("string") if by else F.lit("")).alias("by"))
    asked = queries.where("q IS NOT NULL AND query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("v"))
    n_rows, n_asked = kept.count(), asked.count()
    if not n_rows or not n_asked:
        kind = f", {by} string" if by else ""
        return rows.sparkSession.createDataFrame([], f"query_id long, {key} long{kind}, score double, rank int")
    r_blocks, q_blocks = max(1, -(-n_rows // VECTOR_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = kept.withColumn("rb", F.pmod(F.xxhash64("key"), F.lit(r_blocks)).cast("int")).withColumn("qb", all_of(q_blocks))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("rb", all_of(r_blocks))
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(_best_of_blocks(k, metric, digits, own), "query_id long, key long, by string, score double")
    order = F.asc("score") if metric == "l2" else F.desc("score")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "by").orderBy(order, "key"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("key").alias(key), *([F.col("by").alias(by)] if by else []), "score", "rank")


def _best_of_blocks(k: int, metric: str, digits: int, own: bool):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "key": [], "by": [], "score": []}
        stacked = lambda t: _by_length(t.column("v"))
        asked = stacked(queries)
        for length, (at, x) in stacked(rows).items():
            if length not in asked:
                continue
            of, q = asked[length]
            keys, names = rows.column("key").to_numpy()[at], rows.column("by").to_numpy(zero_copy_only=False)[at]
            ids = queries.column("query_id").to_numpy()[of]
            score = q @ x.T
            if metric == "l2":
                score = np.maximum((q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * score, 0)
            elif metric == "cosine":
                size = np.sqrt((q**2).sum(axis=1)[:, None] * (x**2).sum(axis=1)[None])
                score = np.divide(score, size, out=np.zeros_like(score), where=size > 0)
            score = np.round(score, digits) + 0.0
            sign = 1 if metric == "l2" else -1
            for name in np.unique(names.astype(str)):
                mine = np.flatnonzero(names == name)
                for i, query in enumerate(ids):
                    these = mine if own else mine[keys[mine] != query]
                    best = these[np.lexsort((keys[these], sign * score[i, these]))[:k]]
                    out["query_id"] += [int(query)] * len(best)
                    out["key"] += keys[best].tolist()
                    out["by"] += [name] * len(best)
                    out["score"] += score[i, best].tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("by", pa.string()), ("score", pa.float64())]))

    return run


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length; those with a null component are left out."""
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(n))
        sound = ~np.isnan(x).any(axis=1)
        out[int(n)] = at[sound], x[sound]
    return out


def adaptive_k(k: int, visual: bool = False, rerank: bool = False) -> dict[str, int]:
    """How many candidates each channel brings for k results."""
    figures = max(4 * k, 12) if visual else max(2 * k, 10)
    return {"cards": max(4 * k, 20), "documents": max(2 * k, 8), "text": max(4 * k, 20), "table": figures, "figure": figures, "lexical": max(4 * k, 20), "candidates": max(4 * k, 24) if rerank else k}


def merge_modalities(scored: DataFrame, limits: dict[str, int], key: str = "vec_id", query: str | None = None) -> DataFrame:
    """The nearest rows of each modality (and query), to its limit."""
    place = F.row_number().over(W.partitionBy(*([query] if query else []), "modality").orderBy("distance", key))
    limit = F.coalesce(*[F.when(F.col("modality") == m, n) for m, n in limits.items()])
    most = max(limits.values())
    return scored.withColumn("_place", place).where(F.col("_place") <= most).where(F.col("_place") <= limit).drop("_place")


def visual_order(results: DataFrame, key: str = "id", visual: bool = True) -> DataFrame:
    """Figures first if the query is visual, then by distance; with the place."""
    first = F.when(F.lit(visual) & (F.col("kind") == "figure"), 0).otherwise(1)
    figures = results.where(first == 0).agg(F.count("*").alias("_figures"))  # one row
    heads = global_rank(results.where(first == 0), "distance", [key])
    rest = global_rank(results.where(first == 1), "distance", [key]).join(F.broadcast(figures)).withColumn("place", (F.col("place") + F.col("_figures")).cast("int")).drop("_figures")
    return heads.unionByName(rest)
