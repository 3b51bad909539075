"""Near-duplicate documents by SimHash, at a Jaccard similarity of shingle sets; no pair at the threshold is left out.

1. Ball hashing: fingerprints of 64 bits within RADIUS bits meet at a common variant; the shingle sets of what meets
   are compared exactly, and those that are similar enough are merged into groups. These are the closest copies.
2. At a similarity of 0.8 two fingerprints differ in about ten bits, and balls of half of ten bits have 8 million
   variants. So a second step is complete by another bound: sets of similarity t share one of the first
   s - ceil(t s) + 1 of their s hashes in any common order. Texts of different groups that share such a hash meet, and
   a sketch (a bit for each value of the hashes, modulo its size, that occurs an odd number of times) rules a pair out where even the
   least possible difference of the sets is too large: two sketches never differ in more bits than the sets in hashes.
   First a spanning forest of the most similar pairs is compared exactly and merged; then all pairs that still are open.

A hash that many texts share is dealt to pairs of blocks of at most BLOCK texts, so no task holds all of them, and pairs
are made AT_ONCE at a time and leave a task only if the sketch leaves them open. A hash of n texts so makes n * n / (2 * BLOCK) copies of rows and
n * n / 2 comparisons of sketches. For the exact comparison, sets that pairs connect are cut into slots of about half of GROUP_BYTES, and two slots with
a pair meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, parts, slices, store
from .graph import components
from .simhash import RADIUS, _forest, fingerprint, links, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Hashes are counted in COUNTERS counters of which the HEAVY largest set the order of a text's hashes, common ones last.
COUNTERS, HEAVY = 1 << 20, 1 << 16
SKETCH, SKETCH_AT_ONCE, BLOCK, AT_ONCE, ROWS, GROUP_BYTES = (512, 16384), 16 << 20, 2048, 1 << 17, 1 << 15, 32 << 20


def _digest(text: str | Column) -> Column:
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def sketch(hashes: np.ndarray) -> bytes:
    """Which values of the hashes' upper halves, modulo the number of bits, occur an odd number of times; as many bits as hashes or up to twice as many, within SKETCH."""
    bits = min(max(1 << max(0, len(hashes) - 1).bit_length(), SKETCH[0]), SKETCH[1])
    counts = np.bincount(((hashes >> np.uint64(32)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of several sizes, a matrix for each size; a larger one folds onto half its size."""

    def __init__(self, rows: list[bytes]):
        self.bytes = np.array([len(x) for x in rows], np.int64)
        self.at, self.matrix = {}, {}
        for n in np.unique(self.bytes):
            small, large = np.flatnonzero(self.bytes == n), np.flatnonzero(self.bytes == 2 * n)
            parts_ = [np.frombuffer(b"".join(rows[i] for i in small), np.uint64).reshape(len(small), -1)]
            if len(large):
                both = np.frombuffer(b"".join(rows[i] for i in large), np.uint64).reshape(len(large), 2, -1)
                parts_.append(both[:, 0] ^ both[:, 1])
            place = np.full(len(rows), -1)
            place[np.concatenate((small, large))] = np.arange(len(small) + len(large))
            self.at[int(n)], self.matrix[int(n)] = place, np.concatenate(parts_)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits that differ, for pairs of rows; 0 where one sketch is more than twice as large as the other."""
        out, size = np.zeros(len(x), np.int64), np.minimum(self.bytes[x], self.bytes[y])
        size[np.maximum(self.bytes[x], self.bytes[y]) > 2 * size] = 0
        for n, matrix in self.matrix.items():
            which = np.flatnonzero(size == n)
            step = max(1, SKETCH_AT_ONCE // n)
            for i in range(0, len(which), step):
                w = which[i : i + step]
                out[w] = np.bitwise_count(matrix[self.at[n][x[w]]] ^ matrix[self.at[n][y[w]]]).sum(axis=1, dtype=np.int64)
        return out


def span(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) make a spanning forest of the least cost, as indices; by rounds of each tree's cheapest pair."""
    order = np.lexsort((b, a, cost))
    nodes, both = np.unique(np.concatenate((a[order], b[order])), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    tree, live, kept = np.arange(len(nodes)), np.arange(len(a)), [np.array([], np.int64)]
    while True:
        live = live[tree[x[live]] != tree[y[live]]]
        if not len(live):
            return order[np.concatenate(kept)]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, tree[x[live]], live)
        np.minimum.at(best, tree[y[live]], live)
        kept.append(np.unique(best[best < len(a)]))
        moved, root = _forest(tree[x[kept[-1]]], tree[y[kept[-1]]])
        to = np.arange(len(nodes))
        to[moved] = root
        tree = to[tree]


def _fingerprint_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = span(a, b, np.bitwise_count(a ^ b))
    return a[kept], b[kept]


def _weights(counted: DataFrame) -> np.ndarray:
    """A weight for each counter of hashes, larger for more common ones. It only sets an order, so that light counters need not be told apart."""
    found = counted.select(F.explode(F.arrays_zip("counter", "n")).alias("c")).groupBy("c.counter").agg(F.sum("c.n").alias("n"))
    weights = np.zeros(COUNTERS, np.int32)
    for r in found.orderBy(F.desc("n"), "counter").limit(HEAVY).collect():
        weights[r.counter] = min(r.n, 2**31 - 1)
    return weights


def _meetings(group: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group whose sizes allow the similarity, once each, in blocks of AT_ONCE."""
    order = np.lexsort((size, group))
    g, s = group[order], size[order]
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1])))
    rank = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(g))))
    wide = int(s.max(initial=0)) + 2
    stop = np.searchsorted(rank * wide + s, rank * wide + np.minimum(np.floor(s / similarity + 1e-6).astype(np.int64), wide - 1), side="right")
    n = np.maximum(stop - np.arange(len(g)) - 1, 0)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, AT_ONCE):  # places of all pairs in a row
        place = np.arange(at, min(at + AT_ONCE, total))
        row = np.searchsorted(ends, place, side="right")
        yield order[row], order[row + 1 + place - (ends[row] - n[row])]


def _open_pairs(group: np.ndarray, side: np.ndarray, node: np.ndarray, comp: np.ndarray, size: np.ndarray, sketches: Sketches, similarity: float, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of nodes of a group and of different components that sizes and sketches leave open; or a forest of the most similar ones.

    side: in groups of two blocks, which one a row is of; pairs of one block are left out there. -1: a group of one block.
    """
    held = np.array([], np.int64), np.array([], np.int64), np.array([])
    for x, y in _meetings(group, size, similarity):
        keep = (comp[x] != comp[y]) & ((side[x] < 0) | (side[x] != side[y]))
        x, y = x[keep], y[keep]
        differ = sketches.differ(x, y)
        both = size[x] + size[y]
        keep = (both - differ) * (1 + similarity) >= 2 * similarity * both - 1e-6
        x, y, cost = x[keep], y[keep], (differ / both)[keep]
        a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        if forest:
            a, b, cost = (np.concatenate(z) for z in zip(held, (a, b, cost), strict=True))
            kept = span(a, b, cost)
            held = a[kept], b[kept], cost[kept]
        elif len(a):
            pairs = np.unique(np.stack((a, b), axis=1), axis=0)
            yield pairs[:, 0], pairs[:, 1]
    if len(held[0]):
        yield held[:2]


def _prefixes(docs: DataFrame, text: str, width: int, similarity: float, weights: np.ndarray) -> DataFrame:
    """(digest, tokens, sketch) for each row with words: the hashes of which sets of that similarity share one."""
    known = docs.sparkSession.sparkContext.broadcast(weights)  # COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digest, tokens, sketches = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                h = np.unique(shingle_hashes(t or b"", width))
                if len(h):
                    order = np.lexsort((h, known.value[(h % COUNTERS).astype(np.int64)]))
                    digest.append(d)
                    tokens.append(h[order[: len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1]].view(np.int64))
                    sketches.append(sketch(h))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["digest", "tokens", "sketch"])

    return docs.select(_digest(text).alias("digest"), text).mapInArrow(run, "digest string, tokens array<long>, sketch binary")


def _dealt(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (token, left, right, side) with what is known of their nodes, sorted by group: a token's pieces meet two by two."""
    rows = shared.join(nodes, "node").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: F.struct(F.least("piece", j).alias("left"), F.greatest("piece", j).alias("right")))
    rows = rows.select("token", "node", "comp", "size", "sketch", "piece", F.explode(meets).alias("m"))
    rows = rows.select("token", "m.left", "m.right", F.when(F.col("m.left") == F.col("m.right"), -1).otherwise(F.col("piece")).alias("side"), "node", "comp", "size", "sketch")
    place = ["token", "left", "right"]
    return rows.repartition(parts(shared.sparkSession), *place).sortWithinPartitions(*place)


def _open(shared: DataFrame, nodes: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """(a, b) for shared (token, node, pieces) and nodes (node, comp, size, sketch)."""

    def work(rows: list[np.ndarray], sketches: list[bytes]) -> Iterator[pa.RecordBatch]:
        token, left, right, side, node, comp, size = rows
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        for a, b in _open_pairs(np.cumsum(new), side, node, comp, size, Sketches(sketches), similarity, forest):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        count, held = 0, []
        for batch in slices(batches, ROWS):
            waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)])
            held += batch.column(7).to_pylist()
            count += batch.num_rows
            if count >= ROWS:  # a group has at most about 2 * BLOCK rows, and the last one may go on
                rows = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from work([r[:cut] for r in rows], held[:cut])
                waiting, held, count = [[r[cut:] for r in rows]], held[cut:], len(rows[0]) - cut
        if count:
            yield from work([np.concatenate(c) for c in zip(*waiting, strict=True)], held)

    return _dealt(shared, nodes).mapInArrow(run, "a long, b long")


class _Verifier:
    """Compares shingle sets exactly. A set is made from its text when a pair first asks for it, and kept as a table."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, key: str, text: str, width: int, similarity: float):
        # rows are found by their key and 64 bits of their digest, so that few wanted ones are a small table that can be broadcast
        self.texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(_digest(text)).alias("mark"))
        self.nodes, self.width, self.similarity = nodes.select("node", F.col("least").alias("of_key"), F.xxhash64("digest").alias("of_mark")), width, similarity
        self.tables: list[DataFrame] = []

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that have the similarity."""
        width, similarity = self.width, self.similarity

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                raw = batch.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t or b"", width)).tobytes() for t in raw], pa.binary())], ["node", "hashes"])

        def same(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both >= similarity * (len(x) + len(y) - both) - 1e-9

        def compare_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held = None, {}
            for batch in slices(batches):
                of, a, b = (batch.column(i).to_pylist() for i in range(3))
                keep = []
                for i in range(batch.num_rows):
                    if of[i] != group:
                        group, held = of[i], {}
                    if b[i] is None:
                        held[a[i]] = batch.column(3)[i].as_py()
                    elif same(held[a[i]], held[b[i]]):
                        keep.append(i)
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        pairs = store(pairs.distinct(), "pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        for t in self.tables:
            wanted = wanted.join(t.select("node"), "node", "left_anti")
        wanted = store(wanted.join(self.nodes, "node"), "wanted")
        found = self.texts.join(wanted, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("mark") == F.col("of_mark"))).select("node", "text")
        self.tables.append(store(found.mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"]), "sets"))
        known = self.tables[0]
        for t in self.tables[1:]:
            known = known.union(t)
        # what the pairs connect is cut into slots of about half of GROUP_BYTES of sets, by hash; the pairs of two slots and the sets they need are a block,
        # which meets in one place. A group of at most two slots is one block, so that each of its sets travels once.
        of = store(components(pairs).toDF("node", "of"), "of")
        sizes = of.join(known.select("node", F.octet_length("hashes").alias("bytes")), "node").groupBy("of").agg(F.ceil(2 * F.sum("bytes") / GROUP_BYTES).cast("long").alias("slots")).withColumn("slots", F.when(F.col("slots") <= 2, 1).otherwise(F.col("slots")))
        slot = lambda node: F.pmod(F.xxhash64(node), "slots")
        placed = pairs.join(of, F.col("a") == F.col("node")).join(sizes, "of").withColumns({"_a": slot("a"), "_b": slot("b")})
        placed = store(placed.select(F.xxhash64("of", F.least("_a", "_b"), F.greatest("_a", "_b")).alias("block"), "of", "a", "b"), "placed")
        needs = placed.select("block", F.col("a").alias("node")).union(placed.select("block", "b")).distinct()
        rows = needs.join(known, "node").select("block", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")
        rows = rows.union(placed.select("block", "a", "b", F.lit(None).cast("binary")))
        rows = rows.repartition(parts(pairs.sparkSession), "block").sortWithinPartitions("block", F.col("b").asc_nulls_first())
        out = store(rows.mapInArrow(compare_together, "a long, b long"), "alike")
        for t in (pairs, wanted, of, placed):
            discard(t)
        return out

    def close(self) -> None:
        for t in self.tables:
            discard(t)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (key, digest) of docs, and nodes (digest, component, least) of their distinct texts; a component's texts are a group of near duplicates.

    Texts without words, null ones included, are alike only if they are equal as text; null counts as empty. Ties and repeated
    rows fall on one node; an empty table gives empty ones. Other columns, whatever their names, aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["key", "digest", "fp", "size", "set", "counter", "n"], [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        seen, key_type = np.zeros(COUNTERS, np.int64), pa.null()
        for batch in slices(batches):
            made = []
            for t in batch.column(2).cast(pa.binary()).to_pylist():
                h = np.unique(shingle_hashes(t or b"", width))
                np.add.at(seen, (h % COUNTERS).astype(np.int64), 1)
                made.append((int(np.array([fingerprint(h)], np.uint64).view(np.int64)[0]), len(h), md5(h.tobytes()).hexdigest() if len(h) else None, None, None))
            key_type = batch.column(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True))], names)
        mean = seen.mean()
        at = np.flatnonzero(seen > mean + 4 * mean**0.5 + 4)
        if len(at):  # one more row for the task's counters
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.nulls(1, pa.string()), *(pa.array([v], t) for v, t in zip((None, None, None, at.tolist(), seen[at].tolist()), types, strict=True))], names)

    source = docs.select(F.col(key).alias("key"), _digest(text).alias("digest"), F.col(text).alias("text"))
    signed = store(source.mapInArrow(sign, f"key {kind}, digest string, fp long, size long, set string, counter array<long>, n array<long>"), "signed")
    weights, rows = _weights(signed.where("counter IS NOT NULL")), signed.where("digest IS NOT NULL")
    nodes = rows.groupBy("digest").agg(F.min("key").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("set").alias("set"))
    nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # texts of one shingle set are alike; the first stands for them
    sets_ = store(nodes.where("set IS NOT NULL").groupBy("set").agg(F.min("node").alias("first")), "firsts")
    of_set = nodes.join(sets_, "set")
    sure = store(of_set.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")), "sure")
    full = store(of_set.where("node = first").select("node", "digest", "least", "fp", "size"), "full")
    check = _Verifier(docs, full, key, text, width, similarity)

    def merged(before: DataFrame, pairs: DataFrame) -> DataFrame:
        """All links so far."""
        alike = check.alike(pairs)
        out = store(before.union(alike), "sure")
        for t in (before, alike):
            discard(t)
        return out

    def grouped(sure: DataFrame) -> DataFrame:
        """(of, comp) of the nodes that aren't their own component."""
        return store(components(sure).toDF("of", "comp"), "groups")

    # 1. balls
    by_fp = store(full.groupBy("fp").agg(F.min("node").alias("first")), "by_fp")
    near = store(links(by_fp.select("fp"), RADIUS, forest=_fingerprint_forest), "near")
    equal = full.join(by_fp, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    ends = [by_fp.toDF(f"{c}_fp", c) for c in "ab"]
    close = near.toDF("a_fp", "b_fp").join(ends[0], "a_fp").join(ends[1], "b_fp").select("a", "b")
    sure = merged(sure, equal.union(close))
    for t in (by_fp, near):
        discard(t)

    # 2. the rest
    cut = store(_prefixes(docs, text, width, similarity, weights), "prefixes")
    once = cut.groupBy("digest").agg(F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    of = store(full.select("node", "digest", "size").join(once, "digest").drop("digest"), "tokens")
    discard(cut)
    shared = None
    for forest in (True, False):
        comp = grouped(sure)
        known = of.join(comp, F.col("node") == F.col("of"), "left").withColumn("comp", F.coalesce("comp", "node"))
        if shared is None:
            # how often a token is there is added up before it is shuffled; its rows then meet that number in a join whose sides can be split
            met = known.select(F.explode("tokens").alias("token"), "node", "comp")
            often = met.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high")
            often = store(often.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("pieces")), "often")
            shared = store(met.join(often, "token").select("token", "node", "pieces"), "shared")
            discard(often)
        pairs = store(_open(shared, known.select("node", "comp", "size", "sketch"), similarity, forest), "open")
        sure = merged(sure, pairs)
        for t in (comp, pairs):
            discard(t)
    comp = grouped(sure)
    found = nodes.join(comp, F.col("node") == F.col("of"), "left").select("digest", F.coalesce("comp", "node").alias("component"), "least")
    out = store(found, "groups")
    check.close()
    for t in (comp, sure, shared, of, full, sets_, nodes):
        discard(t)
    return rows.select("key", "digest"), out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without all but one row of each group of near duplicates: the one with the smallest key (null last), then the smallest MD5 of its text.

    Of rows that are repeated with key and text, one stays. Null texts count as empty. An empty table gives none. Columns may have any names.
    """
    rows, of = groups(docs, key, text, **options)
    first = F.struct(F.col("least").isNull(), "least", "digest")
    best = of.groupBy("component").agg(F.min(first)["digest"].alias("digest"), F.min(first)["least"].alias("best")).select(F.col("digest").alias("d"), "best")
    counted = rows.groupBy("key", "digest").agg(F.count("*").alias("n"))
    stays = (F.col("digest") == F.col("d")) & F.col("key").eqNullSafe(F.col("best"))
    judged = store(counted.join(best, stays, "left").select(F.col("key").alias("j_key"), F.col("digest").alias("j_digest"), F.col("d").isNotNull().alias("stays"), "n"), "judged")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(key).alias("key"), _digest(text).alias("digest"))
    same = F.col("key").eqNullSafe(F.col("j_key")) & (F.col("digest") == F.col("j_digest"))
    single = whole.join(judged.where("NOT stays OR n > 1"), same, "left_anti")
    repeated = whole.join(judged.where("stays AND n > 1"), same, "left_semi").dropDuplicates(["key", "digest"])
    return single.union(repeated).select("row.*")
