import random

import numpy as np
import pyarrow as pa
import xxhash

from marlpit.llm import graph
from marlpit.llm.graph import components
from marlpit.llm.simhash import _forest, cluster, fingerprint, fingerprints, links, masks, meet, shingle_hashes


def roots(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


def brute_fingerprint(text, width):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "a b c", "a b c d", "A  B\tc\x0bd\x0ce é É", "x y z w " * 300, "\x1c odd  space   here now", "É é ß ẞ"]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    assert [r.fp % 2**64 for r in fingerprints(rows).orderBy("key").collect()] == [brute_fingerprint(t, 4) for t in texts]
    many = " ".join(str(i % 977) for i in range(140_000))
    assert fingerprint(shingle_hashes(many.encode(), 4)) == brute_fingerprint(many, 4)
    spark_hash = spark.sql("select xxhash64('a b c d') h").first().h
    assert shingle_hashes(b"a b c d", 4)[0] == spark_hash % 2**64


def near(rng, n):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.choice([0, 0, 1, 6])):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_links_find_every_group(spark):
    rng = random.Random(3)
    fps = near(rng, 500) + [0]
    ball = rng.getrandbits(64)
    fps = sorted({*fps, *(ball ^ (1 << i) for i in range(64)), *(ball ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(i))})
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for prefix, chunk, most in ((20, 1 << 17, 1 << 20), (9, 300, 1 << 20), (9, 300, 500), (60, 300, 20)):  # the last two split hot prefixes
        got = links(spark.createDataFrame([(x,) for x in signed], "fp long"), prefix=prefix, chunk_rows=chunk, most_rows=most).collect()
        at = {x: i for i, x in enumerate(signed)}
        assert roots(len(fps), [(at[r.a], at[r.b]) for r in got]) == want


def test_slices_change_nothing():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    owner = np.unique(np.concatenate([centre, centre ^ np.uint64(5), centre ^ np.uint64(1 << 40), centre ^ np.uint64(0b1111)]))
    low = masks(range(64), 2)
    results = [_forest(*meet(owner, owner, np.zeros(len(owner), int), low, 4, n)) for n in (1 << 22, 1500)]
    assert [r.tolist() for r in results[0]] == [r.tolist() for r in results[1]] and len(results[0][0]) == 12


def test_clusters_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " end"), (None, base), (7, None), (2, ""), (8, "something else entirely"), (8, "something else entirely")]
    got = sorted((r.key or 0, r.component) for r in cluster(fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert got == [(0, 3), (2, 2), (3, 3), (5, 3), (7, 2), (8, 8), (8, 8), (9, 3)]
    assert cluster(fingerprints(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_components(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(4, 4)]
    want = roots(2200, edges)
    for kind, held, parts in (("long", 1 << 22, 1), ("long", 1 << 22, 7), ("long", 20, 3), ("int", 20, 3)):  # forests of one task, of several, in pieces; rounds alone
        monkeypatch.setattr(graph, "HELD", held)
        got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 3)], f"a {kind}, b {kind}").repartition(parts)).collect()}
        assert got == {n: want[n] for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_contraction_keeps_connections(monkeypatch):
    monkeypatch.setattr(graph, "HELD", 30)
    rng = np.random.default_rng(2)
    edges = rng.integers(0, 400, (500, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(edges[i : i + 17, 0]), pa.array(edges[i : i + 17, 1])], ["a", "b"]) for i in range(0, 500, 17)]
    out = [(x, y) for b in graph._contract(iter(batches)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert all(x > y for x, y in out) and roots(400, out) == roots(400, edges.tolist())
