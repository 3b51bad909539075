import random

import numpy as np

from marlpit.llm.near import Sketches, _meetings, dedup, groups, sketch, span


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_groups_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 90))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += ["few words", "Few  words", "other", "", None, " ", "few words"]
    hot = [word() for _ in range(200)]
    for i in range(150):
        w = list(hot)
        w[i] = "x"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            equal = (texts[i] or "") == (texts[j] or "")
            if equal or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                links += 1
                root[top(i)] = top(j)
    want = {}
    for i in range(len(texts)):
        want.setdefault(top(i), []).append(ids[i])
    docs = spark.createDataFrame([(ids[i], t, "e") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    kept = sorted(r.doc_id for r in dedup(docs).collect())
    expected = sorted(min(g) for g in want.values())
    assert kept == expected
    assert dedup(docs).columns == docs.columns


def test_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone it is in this row"), (None, "alone it is in this row"), (2, "unlike"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, dedup(docs).collect())) == sorted(map(str, [docs.collect()[i] for i in (0, 3, 5, 6)]))
    assert dedup(docs.limit(0)).count() == 0 and groups(docs)[1].count() == 4


def kept_and_expected(spark, texts):
    """Keys that dedup keeps, and those of an exhaustive comparison."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in dedup(docs).collect()), [i for i in range(len(texts)) if root[i] == i]


def test_template(spark):
    """Texts of one template are alike at 0.6 to 0.79; the true pairs among them reach 0.8 only just."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    template, texts = [word() for _ in range(160)], []
    for _ in range(150):
        w = template + [word() for _ in range(44)]
        texts.append(" ".join(w))
        if len(texts) % 3 == 1:
            texts.append(" ".join(w[:160] + w[160:182] + [word() for _ in range(22)]))
    kept, expected = kept_and_expected(spark, texts)
    assert kept == expected and len(expected) < len(texts)


def test_meetings_against_all_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 30, 400):
        group, size = rng.integers(0, 3, n), rng.integers(1, 30, n)
        got = [tuple(sorted(p)) for x, y in _meetings(group, size, 0.8) for p in zip(x.tolist(), y.tolist(), strict=True)]
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) - 1e-9}
        assert len(got) == len(set(got)) and set(got) == want


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 10, 300, 520, 1000, 5000, 40000)]
    sets += [np.union1d(s[: len(s) * 9 // 10], rng.integers(0, 2**63, len(s) // 5).astype(np.uint64)) for s in sets]
    made = Sketches([sketch(s) for s in sets])
    x, y = (z.ravel() for z in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    differ = made.differ(x, y)
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(differ, x, y, strict=True))
    near = (np.maximum(made.bytes[x], made.bytes[y]) <= 2 * np.minimum(made.bytes[x], made.bytes[y])) & (x != y)
    assert (differ[near] > 0).all()


def test_span_connects_at_the_least_cost():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200):
        a, b, cost = rng.integers(0, 40, n), rng.integers(0, 40, n), rng.integers(0, 6, n)
        a, b, cost = a[a != b], b[a != b], cost[a != b]
        root = list(range(40))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        want = 0
        for i in np.argsort(cost, kind="stable"):
            if top(a[i]) != top(b[i]):
                want += cost[i]
                root[top(a[i])] = top(b[i])
        kept = span(a, b, cost)
        assert cost[kept].sum() == want and len(kept) == len({top(i) for i in range(40)} ^ set(range(40)))


def test_blocks_of_a_common_hash(spark, monkeypatch):
    """One phrase in all texts, whose hash is dealt to pairs of small blocks, must not lose a pair; nor must sets too many for a task."""
    monkeypatch.setattr("marlpit.llm.near.BLOCK", 8)
    monkeypatch.setattr("marlpit.llm.near.GROUP_BYTES", 4000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts, phrase = [], [word() for _ in range(30)]
    for _ in range(60):
        tail = [word() for _ in range(4)]
        texts += [" ".join([*phrase, *tail]), " ".join([*phrase, *tail[:2]])]
    kept, expected = kept_and_expected(spark, texts)
    assert kept == expected


def test_many_pairs_at_the_threshold(spark):
    """Isolated pairs of a similarity of 0.80 to 0.84, long and short: none is lost."""
    rng = random.Random(21)
    texts = []
    while len(texts) < 400:
        n = rng.choice([25, 40, 150])
        w = [f"{rng.randrange(10**9):x}" for _ in range(n)]
        v = [f"{rng.randrange(10**9):x}" for _ in range(rng.randint(1, n // 5 + 1))]
        pair = [" ".join(w), " ".join(w + v)]
        x, y = map(shingles, pair)
        if 0.8 <= len(x & y) / len(x | y) <= 0.84:
            texts += pair
    kept, expected = kept_and_expected(spark, texts)
    assert kept == expected == list(range(0, 400, 2))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "a b c", 4, 5, 6)], "doc_id long, text string, j_key long, _digest long, row long")
    assert [tuple(r) for r in dedup(docs).collect()] == [(1, "a b c", 1, 2, 3)]


def test_short_texts_at_the_threshold(spark):
    """5 shingles against 4 of them: a similarity of exactly 0.8."""
    rng = random.Random(12)
    texts = []
    for i in range(80):
        w = [f"w{i}x{rng.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(w), " ".join(w[:8])]
    kept, expected = kept_and_expected(spark, texts)
    assert kept == expected == list(range(0, 160, 2))


def test_chains(spark):
    """Edited copies of edited copies: each reaches 0.8 with one member of a large group only."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(80):
        w = list(base)
        for _ in range(2):
            for i in rng.sample(range(5, 195, 10), 3):
                w[i] = word()
            texts.append(" ".join(w))
    kept, expected = kept_and_expected(spark, texts)
    assert kept == expected and len(expected) < 10
