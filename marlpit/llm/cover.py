"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared within a label only, as unit vectors, where cosine >= t is distance <= sqrt(2 - 2t). Equal vectors
become one node with a count. The upper levels of the tree are centres of a bounded sample in farthest-first order, whose prefixes
are nested nets; a label uses as many as its size asks for. Each vector has a home (its nearest centre) and visits only those
others that covering radii and bisectors can't rule out. Where a home's vectors and its visitors meet, a tree with levels of halving
radii is built over each and the two are traversed together: node pairs that are too far apart by their covering radii are
pruned, pairs that lie wholly within the threshold are counted at once, and the rest goes down to vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, slices, store, table
from .graph import components
from .simhash import _forest

THRESHOLD = 0.98
SAMPLE, CENTRES, HOME = 1024, 64, 4096
SLACK = 1e-9
PAIRS_AT_ONCE = 1 << 19


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def valid(vector: Column) -> Column:
    """True for vectors without null or non-finite components and not zero."""
    size = F.aggregate(vector, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & (size > 0), F.lit(False))


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """Indices of at most `most` points, each the farthest from those before it."""
    chosen, gap = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(most, len(points)) and gap.max() > 1e-6:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


class CoverTree:
    """Levels of nodes over points; a node's children follow each other, and so do its points. The first child has its parent's centre."""

    def __init__(self, points: np.ndarray, least: float):
        order = np.arange(len(points))
        levels = [(np.array([0]), np.array([0, len(points)]))]  # centre and first point of each node, by place in order
        children = []
        radius = 1.0
        while radius >= least:
            centres, bounds = levels[-1]
            new_centres, new_bounds, first_child, new_order = [], [0], [0], []
            for c, a, b in zip(centres, bounds[:-1], bounds[1:], strict=True):
                left = order[a:b]
                start = order[c]
                while len(left):
                    near = points[left] @ points[start] >= 1 - radius**2 / 2 if len(left) > 1 else np.array([True])
                    group = left[near]
                    group = np.concatenate(([start], group[group != start]))
                    new_centres.append(len(new_order))
                    new_order.extend(group.tolist())
                    new_bounds.append(len(new_order))
                    left = left[~near]
                    start = left[0] if len(left) else -1
                first_child.append(len(new_centres))
            order = np.array(new_order)
            levels.append((np.array(new_centres), np.array(new_bounds)))
            children.append(np.array(first_child))
            radius /= 2
        # orders change only within nodes, so the last one holds for all levels; centres are kept by point
        self.order, self.points, self.children = order, points[order], children
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        self.bounds = [b for _, b in levels]
        self.centres = [b[:-1] for b in self.bounds]  # nested: a node's centre is its first point
        self.radii = []
        for c, b in zip(self.centres, self.bounds, strict=True):
            gap = np.linalg.norm(self.points - np.repeat(self.points[c], np.diff(b), axis=0), axis=1)
            self.radii.append(np.maximum.reduceat(gap, b[:-1]))


def _product(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of left's run i and right's run j, for each (i, j); runs are given by their bounds."""
    n, m = left[i + 1] - left[i], right[j + 1] - right[j]
    total = n * m
    pair = np.repeat(np.arange(len(i)), total)
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return left[i[pair]] + at // m[pair], right[j[pair]] + at % m[pair]


class Links:
    """Counts and connections gathered from one traversal, by points of the two trees (one tree: the same arrays)."""

    def __init__(self, a: CoverTree, b: CoverTree, mult_a: np.ndarray, mult_b: np.ndarray):
        self.a, self.b, self.same = a, b, a is b
        self.mult_a, self.mult_b = mult_a[a.order], mult_b[b.order]
        self.sum_a, self.sum_b = (np.concatenate(([0], np.cumsum(m))) for m in (self.mult_a, self.mult_b))
        self.count_a, self.count_b = np.zeros(len(a.points) + 1, np.int64), np.zeros(len(b.points) + 1, np.int64)
        self.step_a, self.step_b = self.count_a.copy(), self.count_b.copy()  # differences, for whole runs
        self.x: list[np.ndarray] = []
        self.y: list[np.ndarray] = []

    def whole(self, i: np.ndarray, j: np.ndarray, level: int) -> None:
        """All members of nodes i and j link."""
        ba, bb = self.a.bounds[level], self.b.bounds[level]
        for i1, j1 in zip(i.tolist(), j.tolist(), strict=True):
            a0, a1, b0, b1 = ba[i1], ba[i1 + 1], bb[j1], bb[j1 + 1]
            self.step_a[a0] += self.sum_b[b1] - self.sum_b[b0]
            self.step_a[a1] -= self.sum_b[b1] - self.sum_b[b0]
            if not (self.same and i1 == j1):
                self.step_b[b0] += self.sum_a[a1] - self.sum_a[a0]
                self.step_b[b1] -= self.sum_a[a1] - self.sum_a[a0]
            else:
                self.count_a[a0:a1] -= self.mult_a[a0:a1]
            self.x += [np.full(b1 - b0, a0), np.arange(a0, a1)]
            self.y += [np.arange(b0, b1), np.full(a1 - a0, b0)]

    def single(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count_a, i, self.mult_b[j])
        np.add.at(self.count_b, j, self.mult_a[i])
        self.x.append(i)
        self.y.append(j)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts by the trees' own input order, and pairs (place in a, place in b) that connect what links."""
        ca, cb = self.count_a[:-1] + np.cumsum(self.step_a)[:-1], self.count_b[:-1] + np.cumsum(self.step_b)[:-1]
        if self.same:
            ca = cb = ca + cb
        counts = []
        for c, t in ((ca, self.a), (cb, self.b)):
            out = np.empty_like(c)
            out[t.order] = c
            counts.append(out)
        x, y = (np.concatenate(z) if z else np.array([], np.int64) for z in (self.x, self.y))
        return *counts, self.a.order[x], self.b.order[y]


def traverse(a: CoverTree, b: CoverTree, mult_a: np.ndarray, mult_b: np.ndarray, threshold: float) -> Links:
    """Exact links between the points of two trees of equal depth, or within one; equal points of one tree don't link themselves."""
    reach = (2 - 2 * threshold) ** 0.5
    links, i, j = Links(a, b, mult_a, mult_b), np.array([0]), np.array([0])
    for level in range(1, len(a.bounds)):
        kept_i, kept_j = [], []
        ca, cb = a.children[level - 1], b.children[level - 1]
        sizes = np.cumsum((ca[i + 1] - ca[i]) * (cb[j + 1] - cb[j]))
        cuts = np.searchsorted(sizes, np.arange(PAIRS_AT_ONCE, sizes[-1] if len(sizes) else 0, PAIRS_AT_ONCE))
        for block in np.split(np.arange(len(i)), np.unique(cuts)):
            for x, y in _near_children(a, b, level, i[block], j[block], reach):
                gap = np.linalg.norm(a.points[a.centres[level][x]] - b.points[b.centres[level][y]], axis=1)
                both = a.radii[level][x] + b.radii[level][y]
                inside = gap + both <= reach - SLACK
                if inside.any():
                    links.whole(x[inside], y[inside], level)
                open_ = ~inside & (gap <= both + reach + SLACK)
                kept_i.append(x[open_])
                kept_j.append(y[open_])
        i, j = (np.concatenate(k) if k else np.array([], np.int64) for k in (kept_i, kept_j))
    last = a.bounds[-1], b.bounds[-1]
    for x, y in _blocks(i, j, *last):
        if links.same:
            up = x < y
            x, y = x[up], y[up]
        near = np.einsum("ij,ij->i", a.points[x], b.points[y]) >= threshold
        links.single(x[near], y[near])
    return links


def _near_children(a: CoverTree, b: CoverTree, level: int, i: np.ndarray, j: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of children of the pairs (i, j); of a pair with many, those that a matrix product already rules out are left out."""
    ca, cb, same = a.children[level - 1], b.children[level - 1], a is b
    many = (ca[i + 1] - ca[i]) * (cb[j + 1] - cb[j]) >= 1 << 12
    for x, y in _blocks(i[~many], j[~many], ca, cb):
        up = x <= y if same else slice(None)
        yield x[up], y[up]
    for p, q in zip(i[many].tolist(), j[many].tolist(), strict=True):
        other = np.arange(cb[q], cb[q + 1])
        right, far = b.points[b.centres[level][other]], b.radii[level][other]
        step = max(1, PAIRS_AT_ONCE // len(other))
        for at in range(ca[p], ca[p + 1], step):
            own = np.arange(at, min(at + step, ca[p + 1]))
            square = 2 - 2 * (a.points[a.centres[level][own]] @ right.T)
            x, y = np.nonzero(square <= (a.radii[level][own][:, None] + far[None] + reach) ** 2 + 1e-6)
            x, y = own[x], other[y]
            up = x <= y if same else slice(None)
            yield x[up], y[up]


def _blocks(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_product in blocks of bounded size; a large run on the left is cut."""
    if not len(i):
        return
    n, m = left[i + 1] - left[i], right[j + 1] - right[j]
    big = n * m > PAIRS_AT_ONCE
    small = np.flatnonzero(~big)
    if len(small):
        groups = np.cumsum(n[small] * m[small]) // PAIRS_AT_ONCE
        for block in np.split(small, np.flatnonzero(np.diff(groups)) + 1):
            yield _product(i[block], j[block], left, right)
    for k in np.flatnonzero(big):
        step = max(1, PAIRS_AT_ONCE // int(m[k]))
        other = np.arange(right[j[k]], right[j[k] + 1])
        for at in range(left[i[k]], left[i[k] + 1], step):
            own = np.arange(at, min(at + step, left[i[k] + 1]))
            yield np.repeat(own, len(other)), np.tile(other, len(own))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _copies(home: np.ndarray, own_chunk: np.ndarray, chunks: np.ndarray, goes: np.ndarray) -> Iterator[tuple[np.ndarray, int | np.ndarray, int | np.ndarray, bool]]:
    """Rows with the home and chunk that they go to: all to their own, then the guests of each chunk."""
    yield np.arange(len(home)), home, own_chunk, False
    for h in range(goes.shape[1]):
        rows = np.flatnonzero(goes[:, h])
        for k in range(int(chunks[rows, h].max(initial=0))):
            yield rows[(chunks[rows, h] > k) & ((home[rows] != h) | (own_chunk[rows] < k))], h, k, True


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: key, n_links (rows of its label with cosine >= threshold, itself left out) and component (the smallest key reached).

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Vectors of
    different lengths don't link. Rows with equal vectors link; repeated keys are rows of their own. Null keys name a component only if it has no other.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("threshold must be at least 0.5 and below 1")
    n_parts = parts(rows.sparkSession)
    reach = (2 - 2 * threshold) ** 0.5
    base = rows.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(label).alias("label"))
    usable = F.col("label").isNotNull() & valid(F.col("v"))
    nodes = base.where(usable).groupBy("label", "v").agg(F.count("*").alias("mult"), F.min("key").alias("least"))
    nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "nodes")
    sample = nodes.orderBy(F.xxhash64("v", "label"), "node").select("dim", "v").limit(SAMPLE).collect()  # SAMPLE vectors at most
    centres = {}
    for d in {r.dim for r in sample}:
        points = unit(np.array([r.v for r in sample if r.dim == d], np.float64))
        centres[d] = points[farthest_first(points, CENTRES)]

    sizes = nodes.groupBy("label", "dim").agg(F.least(F.lit(CENTRES), F.ceil(F.count("*") / HOME)).cast("int").alias("used"))
    sizes = store(sizes, "sizes")  # a plain table, so that a hot label's vectors can be split
    placed = nodes.join(sizes, ["label", "dim"])

    def homes(v: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all centres in use, and the nearest; a length that the sample lacks has one centre, the first axis."""
        c = centres.get(v.shape[1], np.eye(1, v.shape[1]))
        gap = np.sqrt(np.maximum(0, 2 - 2 * unit(v) @ c.T))
        gap[np.arange(len(c))[None, :] >= np.maximum(1, used)[:, None]] = np.inf
        return gap, gap.argmin(axis=1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HOME):
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                gap, home = homes(_matrix(part.column(2)), part.column(3).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(home.astype(np.int32)), pa.array(gap[np.arange(len(home)), home])], ["label", "dim", "home", "gap"])

    kind = nodes.schema["label"].dataType.simpleString()
    found = placed.select("label", "dim", "v", "used").repartition(n_parts).mapInArrow(measure, f"label {kind}, dim int, home int, gap double")
    stats = found.groupBy("label", "dim", "home").agg(F.max("gap").alias("radius"), F.ceil(F.count("*") / (2 * HOME)).cast("int").alias("chunks"))
    stats = store(stats.groupBy("label", "dim").agg(F.collect_list(F.struct("home", "radius", "chunks")).alias("homes")).join(sizes, ["label", "dim"]), "homes")  # CENTRES entries at most

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HOME):
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                node, used = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
                gap, home = homes(_matrix(part.column(2)), used)
                known = part.column(6).to_pylist()
                width = gap.shape[1]
                radius, chunks = np.full(gap.shape, -np.inf), np.zeros(gap.shape, np.int64)
                for k, entries in enumerate(known):
                    for e in entries:
                        radius[k, e["home"]], chunks[k, e["home"]] = e["radius"], e["chunks"]
                c = centres.get(int(d), np.eye(1, int(d)))
                apart = np.linalg.norm(c[:, None] - c[None], axis=2)[home]
                own_gap = gap[np.arange(len(home)), home]
                with np.errstate(invalid="ignore", divide="ignore"):
                    bisector = (gap**2 - own_gap[:, None] ** 2) / (2 * apart)
                later = np.arange(width)[None, :] > home[:, None]
                goes = later & (gap <= radius + reach + SLACK) & (apart <= radius + radius[np.arange(len(home)), home][:, None] + reach + SLACK) & (bisector <= reach + 1e-6)
                own_chunk = ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.maximum(1, chunks[np.arange(len(home)), home])
                goes[np.arange(len(home)), home] = True
                waiting, size = [], 0
                for at, h, k, is_guest in _copies(home, own_chunk, chunks, goes):
                    waiting.append((at, np.broadcast_to(h, len(at)), np.broadcast_to(k, len(at)), np.full(len(at), is_guest)))
                    size += len(at)
                    if size >= HOME:  # copies are made as they leave, at most about two times HOME at once
                        yield placed_rows(part, waiting)
                        waiting, size = [], 0
                if size:
                    yield placed_rows(part, waiting)

    def placed_rows(part: pa.RecordBatch, waiting: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        at, to_home, to_chunk, guest = (np.concatenate(c) for c in zip(*waiting, strict=True))
        taken = part.take(pa.array(at))
        out = [taken.column(0), taken.column(1), pa.array(to_home.astype(np.int32)), pa.array(to_chunk.astype(np.int32)), pa.array(guest), taken.column(3), taken.column(4), taken.column(2)]
        return pa.RecordBatch.from_arrays(out, ["label", "dim", "home", "chunk", "guest", "node", "mult", "v"])

    v_kind = nodes.schema["v"].dataType.simpleString()
    joined = nodes.join(stats, ["label", "dim"]).select("label", "dim", "v", "node", "mult", "used", "homes").repartition(n_parts)
    met = joined.mapInArrow(visit, f"label {kind}, dim int, home int, chunk int, guest boolean, node long, mult long, v {v_kind}")
    place = ["label", "dim", "home", "chunk"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, tree = None, [], None

        def emit(links: Links, node_a: np.ndarray, node_b: np.ndarray) -> pa.RecordBatch:
            count_a, count_b, x, y = links.result()
            a, b = _forest(node_a[x], node_b[y]) if len(x) else (np.array([], np.int64),) * 2
            counts = [(node_a, count_a)] if links.same else [(node_a, count_a), (node_b, count_b)]
            who, n = (np.concatenate(c) for c in zip(*counts, strict=True))
            who, n = who[n > 0], n[n > 0]
            nothing = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(who), pa.array(a)]), pa.concat_arrays([pa.array(n), nothing]), pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(b)])], ["a", "n", "b"])

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal tree, own
            if own and tree is None:
                node, mult, v = (np.concatenate(c) for c in zip(*own, strict=True))
                tree = CoverTree(v, reach / 8), node, mult
                own = []
                yield emit(traverse(tree[0], tree[0], mult, mult, threshold), node, node)

        for batch in slices(batches, HOME):
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(s, e - s)
                if keys[s][:4] != current:
                    yield from ready()
                    current, own, tree = keys[s][:4], [], None
                node, mult = (part.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
                v = unit(_matrix(part.column(7)))
                if not keys[s][4]:
                    own.append((node, mult, v))
                else:
                    yield from ready()
                    if tree:
                        yield emit(traverse(CoverTree(v, reach / 8), tree[0], mult, tree[2], threshold), node, tree[1])
        yield from ready()

    dealt = met.repartition(n_parts, *place).sortWithinPartitions(*place, "guest", "node")
    links = store(dealt.mapInArrow(link, "a long, n long, b long"), "links")
    counts = links.where("n IS NOT NULL").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("n"))
    linked = store(components(links.where("b IS NOT NULL").select("a", "b")), "linked")
    groups = store(nodes.select("node", "least").join(linked, "node").groupBy("component").agg(F.min("least").alias("c")), "groups")
    labels = linked.join(groups, "component").select(F.col("node").alias("in_group"), "c")
    summed = nodes.join(counts, nodes.node == F.col("of"), "left").join(labels, nodes.node == F.col("in_group"), "left")
    summed = summed.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("c", "least").alias("component"))
    alone = base.where(~usable).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return base.where(usable).join(summed, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("key", "n_links", "component").union(alone)


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a
), c AS (SELECT a, min(b) AS low FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM n GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN k ON vec_id = k.a
"""
