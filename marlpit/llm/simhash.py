"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits share a variant within half the radius of both, so each distinct fingerprint
emits all its variants within that half, and fingerprints meet at equal variants. The flips of the first `prefix` bits
are made before the shuffle, one row for each, dealt by the flipped prefix; the flips of the other bits are made where
the rows of a prefix meet, so of 2081 variants (radius 4) only 211 rows travel (prefix 20). Two fingerprints that meet
at a variant differ in at most twice the half radius, which is verified; of all that meet in a task a spanning forest
is kept, so a group of n near copies gives about n links and none between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, parts, slices, store, table
from .graph import _forest, components

BITS, RADIUS, SEED = 64, 4, 42
#: By so many bits a prefix grows that has too many rows for a task.
STEP = 8
CHUNK = 1 << 16
#: Makes pairs that connect the same from the pairs found in a task.
Forest = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def shingle_hashes(raw: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text: A-Z lowered, words split at ASCII white space, `width` words joined by a space."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # of bytes: ASCII only
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    view = memoryview(joined)
    return np.fromiter((xxh64_intdigest(view[a:b], seed) for a, b in zip(starts, stops[width - 1 :], strict=False)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        octets = hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = SEED) -> DataFrame:
    """key and fp (the fingerprint's bits as a signed long) of each row; null texts count as empty, whose fingerprint is zero."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(shingle_hashes(t or b"", width, seed)) for t in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def masks(bits: range, most: int) -> list[np.ndarray]:
    """Flip masks of exactly 0, 1, ... `most` of the given bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(bits, n)], np.uint64) for n in range(most + 1)]


def prefix_bits(n: int) -> int:
    """Prefix for n distinct fingerprints: 20 bits up to 2^27 of them, then as many as keep a prefix's rows at that level."""
    return max(20, min(40, 20 + max(0, int(n).bit_length() - 27)))


def meet(base: np.ndarray, owner: np.ndarray, flips: np.ndarray, low: list[np.ndarray], radius: int, at_once: int = 1 << 22, forest: Forest | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between owners whose rows reach the same variant: base with as many further low flips as the half radius leaves."""
    half = len(low) - 1
    pieces, owners = [], []
    for used in range(half + 1):
        own = np.flatnonzero(flips == used)
        if len(own):
            mask = np.concatenate(low[: half - used + 1])
            pieces.append((own, mask))
    total = sum(len(o) * len(m) for o, m in pieces)
    slices = max(1, -(-total // at_once))  # by variant, so that equal variants fall together and memory stays bounded
    left, right = [], []
    for s in range(slices):
        values, owners = [], []
        for own, mask in pieces:
            step = max(1, at_once // len(mask))
            for i in range(0, len(own), step):
                v = base[own[i : i + step], None] ^ mask[None, :]
                if slices > 1:
                    kept = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(slices) == s
                    r, _ = np.nonzero(kept)
                    values.append(v[kept])
                    owners.append(own[i : i + step][r])
                else:
                    values.append(v.ravel())
                    owners.append(np.repeat(own[i : i + step], len(mask)))
        v = np.concatenate(values)
        ordered = np.sort(v)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        place = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        hit = shared[place] == v
        group, who = place[hit], owner[np.concatenate(owners)[hit]]
        order = np.lexsort((who, group))
        group, who = group[order], who[order]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        head = who[np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))]
        differ = head != who
        pair = np.unique(np.stack((head[differ], who[differ]), axis=1), axis=0)
        left.append(pair[:, 0])
        right.append(pair[:, 1])
    if not left:
        return np.array([], np.uint64), np.array([], np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    near = np.bitwise_count(a ^ b) <= radius
    return (forest or _forest)(a[near], b[near])


def links(fps: DataFrame, radius: int = RADIUS, prefix: int | None = None, chunk_rows: int = 1 << 17, most_rows: int = 1 << 20, forest: Forest | None = None) -> DataFrame:
    """(a, b), a stored table: pairs of fingerprints that connect all fingerprints within `radius` (even) bits of each other.

    fps has one column of distinct fingerprints, as signed longs. Rows of a prefix that has more than `most_rows` aren't held
    in a task: they pass through it, get the flips of the next STEP bits and meet again at the longer prefix.
    """
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("radius must be even, at most 8")
    spark, half = fps.sparkSession, radius // 2
    n = parts(spark)
    prefix = prefix or prefix_bits(fps.count())
    low_bits = BITS - prefix
    high = masks(range(low_bits, BITS), half)
    flat, low = np.concatenate(high), masks(range(low_bits), half)
    assert sum(len(high[i]) * len(np.concatenate(low[: half - i + 1])) for i in range(half + 1)) == sum(comb(BITS, i) for i in range(half + 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            base = (fp[:, None] ^ flat[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(base.view(np.int64)), pa.array(np.tile(np.arange(len(flat), dtype=np.int32), len(fp)))], ["base", "mask"])

    def further(bits: int, low_bits: int):
        """Rows (base, owner) with further flips of the next bits, as many as the half radius leaves."""
        more = masks(range(low_bits, low_bits + bits), half)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2048):
                base, owner = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
                used = np.bitwise_count(base ^ owner)
                for u in range(half + 1):
                    own, mask = np.flatnonzero(used == u), np.concatenate(more[: half - u + 1])
                    out = [(base[own][:, None] ^ mask[None, :]).ravel(), np.repeat(owner[own], len(mask))]
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in out], ["base", "owner"])

        return run

    def collide(low_bits: int, low: list[np.ndarray], masked: bool):
        def row(base: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            base = base.view(np.uint64)
            return base, base ^ flat[other] if masked else other.view(np.uint64)

        def found(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

        def work(base: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
            base, owner = row(base, other)
            return found(*meet(base, owner, np.bitwise_count(base ^ owner), low, radius, forest=forest), False)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[list[np.ndarray]] = []
            size, hot = 0, None  # hot: a prefix whose rows pass through
            for batch in batches:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
                if not len(cols[0]):
                    continue
                if hot is not None:
                    through = int(np.searchsorted(cols[0].view(np.uint64) >> np.uint64(low_bits) != hot, True))
                    if through:
                        yield found(*row(*(c[:through] for c in cols)), True)
                    cols = [c[through:] for c in cols]
                    if not len(cols[0]):
                        continue
                    hot = None
                waiting.append(cols)
                size += len(cols[0])
                keys = cols[0].view(np.uint64) >> np.uint64(low_bits)
                whole = keys[0] == keys[-1] and (len(waiting) == 1 or waiting[0][0].view(np.uint64)[0] >> np.uint64(low_bits) == keys[-1])
                if size >= chunk_rows and not whole:
                    base, other = (np.concatenate(c) for c in zip(*waiting, strict=True))
                    keys = base.view(np.uint64) >> np.uint64(low_bits)
                    cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1  # the last prefix may go on
                    yield work(base[:cut], other[:cut])
                    waiting, size = [[base[cut:], other[cut:]]], len(base) - cut
                if size > most_rows and low_bits:  # now one prefix only
                    hot = keys[-1]
                    for part in waiting:
                        yield found(*row(*part), True)
                    waiting, size = [], 0
            if size:
                yield work(*(np.concatenate(c) for c in zip(*waiting, strict=True)))

        return run

    rows = fps.toDF("fp").repartition(n, "fp").mapInArrow(emit, "base long, mask int")
    out, masked = None, True
    while True:
        key = F.shiftrightunsigned("base", low_bits) if low_bits else F.col("base")
        dealt = rows.repartition(n, key).sortWithinPartitions(key)
        table_ = store(dealt.mapInArrow(collide(low_bits, low, masked), "a long, b long, hot boolean"), "meetings")
        own = table_.where("NOT hot").select("a", "b")
        out = own if out is None else out.union(own)
        if not low_bits or not table_.where("hot").limit(1).count():
            return out.distinct()
        bits = min(STEP, low_bits)
        low_bits -= bits
        low, masked = masks(range(low_bits), half), False
        rows = table_.where("hot").select("a", "b").repartition(n).mapInArrow(further(bits, low_bits), "base long, owner long")


def cluster(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component) for the rows of fingerprints(): component is the smallest key that a row reaches by links.

    Rows of one fingerprint are linked. Null keys never name a component unless it has no other; repeated rows stay.
    """
    known = store(fps, "fingerprints")
    nodes = store(known.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    found = store(links(nodes.select("fp"), radius), "links")
    linked = store(components(found), "linked")
    # plain tables: their exchanges, and so the rows of a hot component or fingerprint, can be split
    groups = store(nodes.join(linked, nodes.fp == linked.node).groupBy("component").agg(F.min("least").alias("c")), "groups")
    labels = linked.join(groups, "component").select(F.col("node").alias("node_fp"), "c")
    named = nodes.join(labels, nodes.fp == F.col("node_fp"), "left").select(F.col("fp").alias("of"), F.coalesce("c", "least").alias("component"))
    named = store(named, "named")
    for t in (nodes, found, linked, groups):
        discard(t)
    return known.join(named, known.fp == F.col("of")).select("key", "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
