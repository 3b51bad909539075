"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it: a cell is an annulus of a pivot, cut by hash where it is large, and one row
of the index holds a cell's vectors sorted by distance. A query first searches its own cell, which gives a floor for its
k-th score. By the triangle inequality a vector x of an annulus [a, b] around p has |q - x| >= max(a - |q - p|, |q - p| - b, 0), so
its score is at most (|q|^2 + max |x|^2 - that^2) / 2; the query goes to all cells that this does not rule out, and
there expands runs of the sorted annulus until the bound falls below its floor. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import parts, store, table
from .cover import farthest_first, valid

#: At most PIVOTS * RINGS cells of CELL rows or, in small tables, of about SMALL * sqrt(n). Cells of over 2 * CELL rows are cut.
K, SAMPLE, PIVOTS, RINGS, CELL, SMALL, RUN = 5, 2048, 64, 64, 4096, 4, 512
SCALE = 256.0
MOST_LENGTHS = 256
MOST_SCORE = 2.0**62
NO_KEY = 2**63 - 1


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products, in floating point where that is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class Best:
    """The k best (score, key, row) of each of n queries; floor is the k-th score so far, or lower."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, np.iinfo(np.int64).min) if floor is None else floor.copy()
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def offer(self, which: np.ndarray, score: np.ndarray, keys: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        """Scores of queries `which` (by row) against vectors (by column); a query's own row is left out."""
        hits = (score >= self.floor[which][:, None]) & (rows[None, :] != own[which][:, None])
        for i in np.flatnonzero(hits.any(axis=1)):
            at = np.flatnonzero(hits[i])
            if len(at) > self.k:
                order = np.lexsort((rows[at], keys[at], -score[i, at]))[: self.k]
                at = at[order]
            q = which[i]
            new = self.found[q] + list(zip((-score[i, at]).tolist(), keys[at].tolist(), rows[at].tolist(), strict=True))
            self.found[q] = sorted(new)[: self.k]
            if len(self.found[q]) == self.k:
                self.floor[q] = max(self.floor[q], -self.found[q][-1][0])


def search_cell(best: Best, queries: np.ndarray, own: np.ndarray, to_pivot: np.ndarray, vectors: np.ndarray, keys: np.ndarray, rows: np.ndarray, gaps: np.ndarray) -> None:
    """Expands runs of a cell, sorted by distance, from those nearest to the queries' own distances; stops where bounds fall below floors."""
    norms, size = (vectors.astype(np.float64) ** 2).sum(axis=1), (queries.astype(np.float64) ** 2).sum(axis=1)
    starts = np.arange(0, len(vectors), RUN)
    low, high = gaps[starts], gaps[np.minimum(starts + RUN, len(gaps)) - 1]
    top = np.maximum.reduceat(norms, starts)
    bound = score_bound(size[:, None], to_pivot[:, None], low[None], high[None], top[None])
    for run in np.argsort(-bound.max(axis=0)):
        active = np.flatnonzero(bound[:, run] >= best.floor)
        if len(active):
            part = slice(starts[run], starts[run] + RUN)
            best.offer(active, scores(queries[active], vectors[part]), keys[part], rows[part], own)


def score_bound(size: np.ndarray, to_pivot: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The largest inner product that the annulus can hold; raised a little against rounding."""
    apart = np.maximum(0, np.maximum(low - to_pivot, to_pivot - high))
    apart = np.maximum(0, apart * (1 - 1e-9) - 1e-6)
    bound = (size + top - apart**2) / 2
    return bound + 1 + np.abs(bound) * 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def shape(n: int) -> tuple[int, int]:
    """Pivots and rings of each for n rows."""
    cells = -(-n // max(1, min(CELL, int(SMALL * n**0.5))))
    pivots = max(1, min(PIVOTS, int(np.ceil(cells**0.5))))
    return pivots, max(1, min(RINGS, -(-cells // pivots)))


def search(rows: DataFrame, queries: str, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, query_row, rank, key, score): the k best rows for each row where the SQL condition `queries` holds, all if there are fewer.

    Components become floor(scale * x). Ties go to the smaller key, null keys last. A query's own row is no candidate; other rows with its key are.
    Vectors that are null, empty or hold null or non-finite components take no part; those of different lengths don't meet, and
    there is an index for each length. Vectors so large that the score of a query and a candidate could leave 64 bits, and more than
    MOST_LENGTHS lengths, are refused with an error; a large vector that only meets small ones is not. The pivots are fitted on at most SAMPLE rows; every row is indexed. An empty table gives none.
    """
    spark, v = rows.sparkSession, F.col(vector)
    usable = valid_or_zero(v)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    base = rows.where(usable).select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.expr(f"coalesce({queries}, false)").alias("asks"), whole.alias("v"))
    base = store(base.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    lengths = base.groupBy("dim").agg(F.count("*").alias("n"), F.max(size).alias("most"), F.max(F.when(F.col("asks"), size)).alias("asked")).orderBy("dim").limit(MOST_LENGTHS + 1).collect()
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors have more than {MOST_LENGTHS} lengths")
    if any(r.most * (r.asked or 0.0) >= MOST_SCORE**2 and _largest(base.where(F.col("dim") == r.dim), size) >= MOST_SCORE for r in lengths):
        raise ValueError("components are so large that a score may not fit 64 bits")
    found = spark.createDataFrame([], "query_row long, query_id long, score long, key long")
    for r in lengths:
        found = found.union(_search_length(base.where(F.col("dim") == r.dim), r.dim, r.n, k))
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "query_row", "rank", F.nullif("key", F.lit(NO_KEY)).alias("key"), "score")


def _largest(base: DataFrame, size: Column) -> float:
    """What the score of a query and another row is at most, by the product of their norms: the two largest queries and rows decide."""
    norms = base.select("row", "asks", F.sqrt(size).alias("norm")).orderBy(F.desc("norm"))
    return max((q.norm * x.norm for q in norms.where("asks").limit(2).collect() for x in norms.limit(2).collect() if q.row != x.row), default=0.0)


def _search_length(base: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """(query_row, query_id, score, key): what the cells that each query visits offer, over rows (key, row, asks, v) of one length."""
    n_parts = parts(base.sparkSession)
    sample = base.orderBy(F.xxhash64("v", "key"), "row").select("v").limit(SAMPLE).collect()  # SAMPLE vectors at most
    out_schema = "query_row long, query_id long, score long, key long"
    points = np.array([r.v for r in sample], np.float64)
    most, per_pivot = shape(n)
    pivots = points[farthest_first(points, most)]
    gaps = np.stack([np.linalg.norm(points - p, axis=1) for p in pivots], axis=1)
    home = gaps.argmin(axis=1)
    edges = np.stack([np.quantile(gaps[home == p, p], np.arange(1, per_pivot) / per_pivot) if (home == p).any() else np.zeros(per_pivot - 1) for p in range(len(pivots))])

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)
        near = far.argmin(axis=1)
        gap = far[np.arange(len(x)), near]
        return near * per_pivot + (edges[near] < gap[:, None]).sum(axis=1), gap

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3)).astype(np.float64)
            cell, gap = cells(x) if len(x) else (np.array([], np.int64), np.array([]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap), pa.array((x**2).sum(axis=1))], ["key", "row", "asks", "v", "cell", "gap", "norm"])

    keyed = base.select("key", "row", "asks", "v").repartition(n_parts).mapInArrow(assign, "key long, row long, asks boolean, v array<long>, cell int, gap double, norm double")
    keyed = store(keyed, "keyed")
    stats = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.max("norm").alias("top")).collect()  # PIVOTS * RINGS rows at most
    pieces = np.ones(len(pivots) * per_pivot, np.int64)
    low, high, top = np.full(len(pieces), np.inf), np.full(len(pieces), -np.inf), np.full(len(pieces), -np.inf)
    for r in stats:
        pieces[r.cell], low[r.cell], high[r.cell], top[r.cell] = -(-r.n // (2 * CELL)), r.low, r.high, r.top
    used = np.flatnonzero(top > -np.inf)
    cut = F.element_at(F.array(*[F.lit(int(p)) for p in pieces]), F.col("cell") + 1)
    piece = F.pmod(F.xxhash64("row"), cut).cast("int")
    arrays = {"keys": np.int64, "rows": np.int64, "gaps": np.float64, "asks": np.bool_, "vectors": np.int64}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def row() -> pa.RecordBatch:
            parts_ = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = np.lexsort((parts_[1], parts_[2]))
            blobs = [pa.array([p[order].astype(t, copy=False).tobytes()], pa.binary()) for p, t in zip(parts_, arrays.values(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *blobs], ["cell", "piece", *arrays])

        for batch in batches:
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            bounds = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if s == e:
                    continue
                if (here := tuple(where[s].tolist())) != at:
                    if held:
                        yield row()
                    held, at = [], here
                part = batch.slice(s, e - s)
                held.append([*(part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)), _matrix(part.column(6))])
        if held:
            yield row()

    packed = keyed.withColumn("piece", piece).select("cell", "piece", "key", "row", "gap", "asks", "v")
    packed = packed.repartition(n_parts, "cell", "piece").sortWithinPartitions("cell", "piece")
    index_schema = "cell int, piece int, keys binary, rows binary, gaps binary, asks binary, vectors binary"
    index = store(packed.mapInArrow(build, index_schema), "index", {"parquet.block.row.count.limit": "4", "parquet.enable.dictionary": "false"})

    def unpack(batch: pa.RecordBatch, i: int, first: int) -> list[np.ndarray]:
        got = [np.frombuffer(batch.column(first + j)[i].as_py(), t) for j, t in enumerate(arrays.values())]
        return [*got[:4], got[4].reshape(-1, dim)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, rows_, gap, asks, x = unpack(batch, i, 2)
                if not asks.any():
                    continue
                q, own, ids, near = x[asks], rows_[asks], keys[asks], gap[asks]
                best = Best(len(q), k)
                search_cell(best, q, own, near, x, keys, rows_, gap)
                size = (q.astype(np.float64) ** 2).sum(axis=1)
                far = np.stack([np.linalg.norm(q - p, axis=1) for p in pivots], axis=1)
                for c in used.tolist():
                    go = score_bound(size, far[:, c // per_pivot], low[c], high[c], top[c]) >= best.floor
                    if go.any():
                        blobs = [pa.array([a[go].tobytes()] * int(pieces[c]), pa.binary()) for a in (ids, own, far[:, c // per_pivot], best.floor, q)]
                        yield pa.RecordBatch.from_arrays([pa.array([c] * int(pieces[c]), pa.int32()), pa.array(range(int(pieces[c])), pa.int32()), *blobs], ["cell", "piece", *arrays])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = at = None
        for batch in batches:
            for i in range(batch.num_rows):
                here, asking = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                if not asking:
                    held, at = unpack(batch, i, 3), here
                    continue
                if here != at:
                    continue  # no such piece
                ids, own, to_pivot, floor, q = (np.frombuffer(batch.column(3 + j)[i].as_py(), t) for j, t in enumerate((np.int64, np.int64, np.float64, np.int64, np.int64)))
                q = q.reshape(-1, dim)
                keys, rows_, gap, _, x = held
                best = Best(len(q), k, floor)
                search_cell(best, q, own, to_pivot, x, keys, rows_, gap)
                out = [(own[j], ids[j], -s, key_) for j, f in enumerate(best.found) for s, key_, _ in f]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["query_row", "query_id", "score", "key"])

    asked = store(index.mapInArrow(ask, index_schema), "asked")
    both = index.withColumn("asking", F.lit(False)).unionByName(asked.withColumn("asking", F.lit(True)))
    both = both.select("cell", "piece", "asking", *arrays).repartition(n_parts, "cell", "piece").sortWithinPartitions("cell", "piece", "asking")
    return both.mapInArrow(answer, out_schema)


def valid_or_zero(vector):
    """Like valid(), but zero vectors pass."""
    return valid(F.concat(vector, F.array(F.lit(1.0).cast("float")))) & F.coalesce(F.size(vector) > 0, F.lit(False))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("vec_id"), "score")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
