import math

import numpy as np
import pytest

from marlpit.llm import topk
from marlpit.llm.topk import PIVOTS, RINGS, scores, search, shape


def brute(rows, k=5, every=50):
    ok = [(i, key, [math.floor(256 * x) for x in v]) for i, (key, v, *_) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, q in ok:
        if key is not None and key % every == 0:
            all_ = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), 2**63 if c is None else c) for j, c, x in ok if j != i and len(x) == len(q))[:k]
            out += [(key, r + 1, None if c == 2**63 else c, -s) for r, (s, c) in enumerate(all_)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("cell,run,clustered", [(4096, 512, False), (16, 8, True), (9, 4, False), (40, 16, True)])
def test_is_exact(spark, monkeypatch, cell, run, clustered):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "RUN", run)
    monkeypatch.setattr(topk, "PIVOTS", 6)
    rng = np.random.default_rng(cell)
    centres = rng.standard_normal((5, 8))
    v = (centres[rng.integers(0, 5, 400)] * 0.5 + 0.02 * rng.standard_normal((400, 8)) if clustered else rng.standard_normal((400, 8)) * rng.random((400, 1))).astype(np.float32).astype(float)
    v[100:160] = v[100]  # ties
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(None, v[3].tolist(), 1), (1000, None, 1), (1050, [], 1), (1100, [float("nan")] * 8, 1), (1150, [None] * 8, 1), (1200, [1.0], 1), (1201, [2.0], 1), (1250, [0.0] * 8, 1), (50, v[5].tolist(), 1), (100, v[100].tolist(), 1), (-50, (v[7] * 3).tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int").repartition(3)
    got = search(frame, "vec_id % 50 = 0").collect()
    assert sorted(repr((r.query_id, r["rank"], r.key, r.score)) for r in got) == brute(rows)


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0] * 8), (1, [2.0] * 8), (50, [0.5] * 8)], "vec_id long, embedding array<float>")
    assert sorted(repr((r.query_id, r["rank"], r.key, r.score)) for r in search(frame, "vec_id % 50 = 0").collect()) == brute(frame.collect())
    assert search(frame.limit(0), "vec_id % 50 = 0").count() == 0 and search(frame, "vec_id > 90").count() == 0


def test_large_components_stay_exact():
    q = np.array([[2**30, 3]], np.int64)
    assert scores(q, q)[0, 0] == 2**60 + 9


def test_small_tables_have_several_annuli():
    assert all(min(shape(n)) > 1 for n in (500, 2000, 50_000, 10**9)) and shape(10**12) == (PIVOTS, RINGS) and shape(1) == (1, 1)


def test_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3 if i % 4 else 5).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(repr((r.query_id, r["rank"], r.key, r.score)) for r in search(frame, "vec_id % 50 = 0").collect()) == brute(rows)


def test_large_scores_are_exact_or_refused(spark):
    rows = [(i, [3e6 + i, -1e6 * (i % 7)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(repr((r.query_id, r["rank"], r.key, r.score)) for r in search(frame, "vec_id % 50 = 0").collect()) == brute(rows)
    for x in (3e7, 1e300):
        with pytest.raises(ValueError, match="64 bits"):
            search(spark.createDataFrame([(0, [x] * 8), (1, [x] * 8)], "vec_id long, embedding array<double>"), "vec_id % 50 = 0")


def test_large_vectors_that_meet_small_ones(spark):
    rows = [(i, [0.5 + i, -1.0]) for i in range(120)]
    for large in (1, 50):  # a candidate, and a query, whose product with itself leaves 64 bits
        mixed = [(i, [3e9, 1.0] if i == large else v) for i, v in rows]
        frame = spark.createDataFrame(mixed, "vec_id long, embedding array<double>")
        assert sorted(repr((r.query_id, r["rank"], r.key, r.score)) for r in search(frame, "vec_id % 50 = 0").collect()) == brute(mixed)
    with pytest.raises(ValueError, match="64 bits"):
        search(spark.createDataFrame([(i, [3e9, 1.0] if i in (1, 50) else v) for i, v in rows], "vec_id long, embedding array<double>"), "vec_id % 50 = 0")


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"), "true").count()
    assert spark.conf.get(key) == before
