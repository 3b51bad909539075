"""Spans and items against a search for every window in every text."""

import random
import re

import pytest

from marlpit.llm import winnow

DOC, ITEM = "doc_id long, text string, t string, items int, spans int", "item_id long, text string, size int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, span=winnow.SPAN):
    windows = {}
    for key, text, *_ in items:
        w = cut(text)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(key)
    out = []
    for key, text, *_ in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (items_of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= items_of
        out.append((key, len(w), frozenset(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    for r in rows:  # spans are disjoint and in order
        assert all(a.start < a.end for a in r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, frozenset(x for s in r.spans for x in range(s.start, s.end)), tuple(r["items"])) for r in rows), key=repr)


def run(spark, docs, items, **options):
    docs, items = [(*d, "x", 1, 1)[:5] for d in docs], [(*i, 1)[:3] for i in items]
    return got(winnow.decontaminate(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM), **options))


def test_items_of_every_length(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 25])]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i, (_, t) in enumerate(items):
        w = t.split()
        docs += [(100 + i, f"{text(7)} {t} {text(5)}"), (200 + i, f"{text(3)} {' '.join(w[1:])} {text(2)}"), (300 + i, " ".join(w[:-1])), (400 + i, f"{t}, {t.upper()}! {t}")]
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("words", [1, 2, 3])
def test_repetitive_texts(spark, words):
    """Runs of one fingerprint over many windows, and ties of hashes."""
    rng = random.Random(words)
    text = lambda n: " ".join(rng.choices("abc"[:words], k=n))
    items = [(i, text(rng.randint(1, 25))) for i in range(12)]
    docs = [(i, text(rng.randint(0, 80))) for i in range(30)] + [(99, "a " * 3000)]
    assert run(spark, docs, items) == brute(docs, items)


def test_only_whole_windows(spark):
    item = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(["x"] * i + item[i : i + n] + ["y"] * 3)) for i, n in enumerate([9, 10, 11, 15, 16, 9, 10])]
    found = run(spark, docs, [(5, " ".join(item))])
    assert found == brute(docs, [(5, " ".join(item))])
    assert [len(r[2]) for r in found] == [0, 10, 11, 15, 16, 0, 10]


def test_case_separators_and_scripts(spark):
    docs = [
        (1, "ÉTÉ à la plage"), (2, "été À LA plage"), (3, "Été à LA-plage"), (4, "İstanbul straße ǅ 12.5"), (5, "istanbul strasse ǆ 12 5"), (6, "\x00a\x7fb_c"), (7, "a b\x1fc"), (8, "日本 語"), (9, "x y"),
    ]
    items = [(1, "été à la PLAGE"), (2, "İstanbul STRAßE ǅ 12 5"), (3, "A-B-C"), (4, "日本、語"), (5, "x\xa0y")]
    assert run(spark, docs, items) == brute(docs, items)


def test_nulls_ties_repeats_and_copies(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, None), (2, ""), (None, passage), (None, passage), (None, "other"), (3, passage), (3, passage), (3, "else"), (4, long), (5, f"{long} {passage}")] + [(10 + i, f"{passage} tail {i % 3}") for i in range(60)]
    items = [(1, None), (2, "..."), (None, passage), (7, passage), (7, passage), (7, "else"), (10, passage + " end"), (9, passage), (11, " ".join(f"v{i}" for i in range(29990, 30000)))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c"), (None, None)], []) == brute([(1, "a b c"), (None, None)], [])
    assert run(spark, [(1, "a b c")], [(1, "?"), (2, None)]) == brute([(1, "a b c")], [])


def test_other_spans_and_grams(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices("abcdef", k=n))
    docs, items = [(i, text(50)) for i in range(20)], [(i, text(n)) for i, n in enumerate([1, 2, 4, 6, 9])]
    for span, gram in [(4, 2), (4, 4), (3, 9), (1, 1)]:
        assert run(spark, docs, items, span=span, gram=gram) == brute(docs, items, span)
