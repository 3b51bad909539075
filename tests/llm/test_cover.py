import numpy as np
import pytest

from marlpit.llm import cover
from marlpit.llm.cover import CoverTree, near_duplicates, traverse, unit


def sample(rng, n, d, clusters, spread):
    centres = unit(rng.standard_normal((clusters, d)))
    return unit(np.concatenate([rng.standard_normal((n // 2, d)), centres[rng.integers(0, clusters, n - n // 2)] + spread * rng.standard_normal((n - n // 2, d))]))


@pytest.mark.parametrize("d,spread", [(2, 0.05), (3, 0.1), (16, 0.03), (64, 0.02), (64, 0.001)])
def test_traversal_is_exact(d, spread, monkeypatch):
    monkeypatch.setattr(cover, "PAIRS_AT_ONCE", 997)
    rng = np.random.default_rng(d)
    a, b = sample(rng, 300, d, 4, spread), sample(rng, 200, d, 4, spread)
    b[:50] = unit(a[:50] + 0.02 * rng.standard_normal((50, d)))
    ma, mb = rng.integers(1, 5, 300), rng.integers(1, 5, 200)
    ta, tb = CoverTree(a, 0.025), CoverTree(b, 0.025)
    for t, p in ((ta, a), (tb, b)):
        assert np.array_equal(np.sort(t.order), np.arange(len(p)))
        assert all(np.all(np.diff(x) > 0) and x[-1] == len(p) for x in t.bounds)
    near = a @ b.T >= 0.98
    ca, cb, x, y = traverse(ta, tb, ma, mb, 0.98).result()
    assert np.array_equal(ca, near @ mb) and np.array_equal(cb, near.T @ ma) and near[x, y].all() and near.any()
    own = (a @ a.T >= 0.98) & ~np.eye(300, dtype=bool)
    ca, _, x, y = traverse(ta, ta, ma, ma, 0.98).result()
    assert np.array_equal(ca, own @ ma) and (own[x, y] | (x == y)).all()


def brute(rows):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = {i: [j for j in range(n) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= 0.98] for i in range(n)}
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("home,centres", [(4096, 64), (12, 5), (25, 64)])
def test_rows(spark, monkeypatch, home, centres):
    monkeypatch.setattr(cover, "HOME", home)
    monkeypatch.setattr(cover, "CENTRES", centres)
    rng = np.random.default_rng(home)
    points = np.concatenate([sample(rng, 150, 8, 3, 0.04), np.tile(unit(rng.standard_normal((1, 8))), (12, 1))]).astype(np.float32).astype(float)
    rows = [(i, p.tolist(), int(i % 3 == 0) if i % 11 else None, "x") for i, p in enumerate(points)]
    rows += [(900, None, 1, "x"), (901, [], 1, "x"), (902, [0.0] * 8, 1, "x"), (903, [1.0, None, 2.0], 1, "x"), (904, [float("nan")] * 8, 1, "x"), (905, [float("inf")] * 8, 1, "x"), (906, [1.0, 2.0], 1, "x"), (907, [2.0, 4.0], 1, "x"), (None, points[0].tolist(), 1, "x"), (5, points[0].tolist(), 1, "x"), (5, points[7].tolist(), 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, home string").repartition(3)
    got = sorted(repr((r.key, r.n_links, r.component)) for r in near_duplicates(frame).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).collect()[0].component == 1
