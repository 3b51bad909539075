from collections import defaultdict
from hashlib import md5
from math import comb

import pytest
from pyspark.sql import functions as F

from marlpit.llm.mixing import draws, hypergeometric, in_order, mix, plan, shard_count, split_tree, targets, words, write_shards


def reshared(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3}, {"é": 5, "z": 5, "Z": 5, None: 5}, {"a": 0, "b": 0}, {"a": 7}, {f"s{i}": (i * 37) % 101 for i in range(23)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    assert {r.source: r.target for r in targets(rows).collect()} == pytest.approx(reshared(sizes))


def test_quantiles_follow_the_law(spark):
    for pool, marked, drawn in [(20, 7, 9), (5, 5, 3), (6, 0, 2), (300, 120, 150), (1, 1, 1), (0, 0, 0), (9, 4, 9)]:
        us = [(i + 0.5) / 200 for i in range(200)]
        rows = spark.createDataFrame([(u,) for u in us], "u double").select("u", F.expr(hypergeometric(str(pool), str(marked), str(drawn), "u")).alias("k")).collect()
        for r in rows:
            below = lambda k: sum(comb(marked, i) * comb(pool - marked, drawn - i) for i in range(max(0, drawn + marked - pool), k + 1)) / comb(pool, drawn)
            assert below(r.k) >= r.u - 1e-9 and (r.k == max(0, drawn + marked - pool) or below(r.k - 1) <= r.u + 1e-9)


def test_tree_splits_exactly(spark):
    rows = split_tree(spark.createDataFrame([([50, 0, 1, 700, 13],)], "quotas array<bigint>"), 8).collect()
    assert [sum(c) for c in zip(*(r.quotas for r in rows), strict=True)] == [50, 0, 1, 700, 13] and sorted(r.shard for r in rows) == list(range(8))
    assert {sum(r.quotas) for r in rows} <= {95, 96} and all(q >= 0 for r in rows for q in r.quotas)


def test_words(spark):
    texts = [None, "", " ", "a", " a  b\n", "é\x1cx y", "𝄞 𝄞\t𝄞"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(words(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 1, 2, 2, 3]


def docs(spark):
    rows = [(i, f"s{i % 4}" if i % 7 else None, " ".join(["w"] * (i * 13 % 90)), i) for i in range(400)]
    rows += [(None, "s0", "x y z", 1), (5000, "s1", None, 1), (5001, "s9", "", 1), (7, "s3", "a b", 1), (7, "s3", "a b", 1), *[(6000, "tie", "q " * 50, 2)] * 3]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, target long")


def test_mix_meets_targets_and_is_whole(spark):
    rows = draws(docs(spark), shards=4).collect()
    assert len(rows) == 408
    by = defaultdict(list)
    for r in rows:
        taken = sum(d.words for d in r.mix_draws)
        assert 0 <= taken <= 2 * r.mix_size and all(0 <= d.shard < 4 for d in r.mix_draws)
        by[r.source].append((taken, r.mix_target, r.mix_size))
    for source, x in by.items():
        assert abs(sum(t for t, *_ in x) - x[0][1]) <= (3 if source == "tie" else 1.5)
    mixed = mix(docs(spark), shards=4)
    got = mixed.withColumn("n", words(F.col("text"))).collect()
    assert all(r.n == r.mix_words for r in got) and mixed.columns[:4] == docs(spark).columns
    assert sum(r.mix_words for r in got) == sum(t for x in by.values() for t, *_ in x)
    again = mix(docs(spark).repartition(7), shards=4).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixed.collect())


def test_empty_and_shards(spark, tmp_path):
    assert mix(docs(spark).limit(0)).count() == 0
    assert draws(docs(spark).where("text is null")).count() == 1
    write_shards(mix(docs(spark), shards=2), f"file://{tmp_path}/m")
    assert {r.mix_shard for r in spark.read.parquet(f"file://{tmp_path}/m").collect()} == {0, 1}


def quotas_by_hand(quotas, shards, seed=7):
    """The tree node by node, with whole numbers."""
    nodes = {1: list(quotas)}
    for _ in range(shards.bit_length() - 1):
        below = {}
        for node, q in nodes.items():
            rest, drawn, left = sum(q), sum(q) // 2, []
            for i, marked in enumerate(q, 1):
                u = int(md5(f"{seed}:{node}:{i}".encode()).hexdigest()[:13], 16) / 2**52
                under, whole = 0, comb(rest, drawn)
                for k in range(max(0, drawn + marked - rest), min(marked, drawn) + 1):
                    under += comb(marked, k) * comb(rest - marked, drawn - k)
                    if under / whole >= u:
                        break
                left.append(k)
                rest, drawn = rest - marked, drawn - k
            below |= {2 * node: left, 2 * node + 1: [a - b for a, b in zip(q, left, strict=True)]}
        nodes = below
    return [nodes[n] for n in sorted(nodes)]


def test_draws_go_where_the_tree_says(spark, monkeypatch):
    """From the query's column back to blocks, and from there to the splitting tree made by hand."""
    monkeypatch.setattr("marlpit.llm.mixing.BLOCK_WORDS", 50)
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (1 + i * 13 % 90))) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    made, shards = plan(table, shards=8)
    known = {r.source: r for r in made.collect()}
    order = sorted(known.values(), key=lambda r: r["rank"])
    by_hand = quotas_by_hand([r.draws for r in order], 8)
    assert shards == 8 and [[b - a for a, b in zip([0, *r.ends[:-1]], r.ends, strict=True)] for r in order] == [list(c) for c in zip(*by_hand, strict=True)]
    assert len({tuple(q) for q in by_hand}) > 1  # a constant split would give equal shards
    got = draws(table, shards=8).collect()
    for r in got:
        s = known[r.source]
        block = int(md5(f"7:{r.doc_id}".encode()).hexdigest()[:15], 16) % s.blocks
        assert all(d.shard == sum(e <= d.epoch * s.blocks + block for e in s.ends) for d in r.mix_draws)
    assert {d.shard for r in got for d in r.mix_draws} == set(range(8))


def test_shards_follow_the_hypergeometric_law(spark):
    """Over many seeds, a source's quota in a shard has the mean and variance of a draw of that shard's size."""
    quotas = [120, 30, 50]
    root = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    trees = split_tree(root, 4, seed=0)
    for seed in range(1, 24):
        trees = trees.union(split_tree(root, 4, seed=seed))
    found = [r.quotas for r in trees.collect()]
    assert all(sum(q) == 50 for q in found)
    for i, marked in enumerate(quotas):
        values = [q[i] for q in found]
        p = marked / 200
        variance = 50 * p * (1 - p) * 150 / 199
        mean = sum(values) / len(values)
        assert mean == pytest.approx(50 * p) and 0.6 < sum((v - mean) ** 2 for v in values) / len(values) / variance < 1.5


def test_own_output_and_too_many_sources(spark):
    once = draws(docs(spark), shards=2)
    assert draws(once, shards=2).columns == once.columns and mix(mix(docs(spark), shards=2), shards=2).columns == mix(docs(spark), shards=2).columns
    assert shard_count(3, 10) == 32 and shard_count(3, 10**6) == 8192 and shard_count(1 << 17, 10**9) == 32
    with pytest.raises(ValueError, match="sources"):
        shard_count((1 << 17) + 1, 5)


def test_order_of_the_mix(spark):
    rows = in_order(mix(docs(spark), shards=4)).withColumn("task", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()).collect()
    for task in {r.task for r in rows}:
        own = sorted((r for r in rows if r.task == task), key=lambda r: r.n)
        assert [(r.mix_shard, r.mix_order) for r in own] == sorted((r.mix_shard, r.mix_order) for r in own)
