"""Connected components: tasks contract the edges they read to forests, as long as that makes them fewer; large-star and small-star rounds join what is left.

Spark packs a small table's files into few tasks, so forests that fit one task end there; those of a large table meet in the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, root) that connect what the pairs (a, b) connect."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        least = root.copy()
        np.minimum.at(least, rx, ry)
        np.minimum.at(least, ry, rx)
        least = np.minimum(least, least[root])
        while not np.array_equal(least, least[least]):
            least = least[least]
        if np.array_equal(least, root):
            break
        root = least
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


#: Edges that a task contracts at a time.
HELD = 1 << 22


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, root) that connect what a task's edges connect, in pieces of HELD edges and what was left of those before."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
        if sum(len(a) for a, _ in held) > HELD:
            forest = _forest(*(np.concatenate(c) for c in zip(*held, strict=True)))
            if len(forest[0]) > HELD // 2:  # nearly a forest before: hand it on
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest], ["a", "b"])
                forest = forest[0][:0], forest[1][:0]
            held = [forest]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _forest(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["a", "b"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a")).toDF("u", "v")


def _least(edges: DataFrame) -> DataFrame:
    return _both_ways(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _both_ways(edges).where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    # every edge here has a > b
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each component is one star: no node has two edges down, and none with one has any up."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").limit(1).count()


def _round(now: DataFrame) -> DataFrame:
    # plain tables: their exchanges, and so the edges of a hot node, can be split
    least = store(_least(now), "least")
    large = store(_large_star(now, least), "large")
    small = store(_small_least(large), "small")
    new = store(_small_star(large, small), "edges")
    for t in (now, least, large, small):
        discard(t)
    return new


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge list (a, b) reaches.

    Edges have no direction; loops, nulls and repeated edges are ignored. Every step is a written table, and the
    last is one star for each component. Only whole numbers are contracted, other nodes go through rounds alone. An empty list gives an
    empty table.
    """
    clean = edges.toDF("x", "y").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    contract = None
    if all(t == "bigint" for _, t in clean.dtypes):
        contract = lambda df: df.mapInArrow(_contract, "a long, b long")
    now = store(contract(clean) if contract else clean.distinct(), "edges")
    size = now.count()
    for _ in range(most_rounds):
        while contract:
            new = store(contract(now), "edges")
            discard(now)
            now, before, size = new, size, new.count()
            if size >= 0.9 * before:
                break
        if not size or _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        now = _round(now)
        size = now.count()
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
