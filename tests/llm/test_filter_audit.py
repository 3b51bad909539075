"""The audit's counts against a loop over rows and orders."""

import hashlib
from itertools import permutations

import numpy as np
import pytest

from marlpit.llm import filter_audit

DOC = "doc_id long, text string, source string, A string, part int, `first` int"


def loop_flags(docs):
    seen = {}
    for key, text, *_ in docs:
        if key is not None:
            seen[text or ""] = min(seen.get(text or "", key), key)
    for key, text, *_ in docs:
        t = text or ""
        words = [w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        first = seen.get(t)
        yield {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": first is not None and (key is None or key > first),
        }


def loop_audit(rows, filters):
    """rows: (part, failed filters as a set, good, toxic)."""
    out = {}
    for part in {r[0] or "" for r in rows}:
        mine = [r for r in rows if (r[0] or "") == part]
        total = dict.fromkeys(filters, 0)
        for order in permutations(filters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                redundant = sum(f in r[1] for r in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in mine), sum(bool(r[2]) for r in gone), sum(bool(r[3]) for r in gone), f]
    return {k: (*v[:6], total_of(out, k[0], v[6])) for k, v in out.items()}


def total_of(out, part, f):
    return sum(v[1] for k, v in out.items() if k[0] == part and v[6] == f)


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in filter_audit.MEASURES) for r in df.collect()}


def test_audit_equals_a_loop(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(700):
        part = [None, "", "a", "b", f"p{i % 30}"][int(rng.integers(5))]
        rows.append((part, {f for f in "XYZ" if rng.random() < 0.4}, rng.random() < 0.5, rng.random() < 0.1))
    frame = spark.createDataFrame([(p, *[f in s or (None if p == "a" else False) for f in "XYZ"], g, t, 1) for p, s, g, t in rows], "p string, X boolean, Y boolean, Z boolean, g boolean, t boolean, subset int").repartition(5)
    assert got(filter_audit.audit(frame, list("XYZ"), "p", "g", "t")) == loop_audit(rows, "XYZ")


def test_many_parts_in_one_task(spark):
    n = filter_audit.PARTS_HELD * 2 + 77
    frame = spark.range(0, n, 1, 1).selectExpr("cast(id as string) AS p", "id % 2 = 0 AS X", "true AS g", "false AS t")
    report = filter_audit.audit(frame, ["X"], "p", "g", "t")
    assert report.count() == n
    assert report.selectExpr("sum(kept)", "sum(removed)", "sum(good_lost)", "max(shapley)").first()[:] == (n // 2, n - n // 2, n - n // 2, 1)


def documents():
    long = " ".join(f"w{i}" for i in range(60))
    return [
        (1, long, "s", "x", 0, 0), (2, long, "s", "x", 0, 0), (2, long, "s", "x", 0, 0), (None, long, None, "x", 0, 0), (None, "only here", "s", "x", 0, 0),
        (3, None, "t", "x", 0, 0), (4, "", "t", "x", 0, 0), (5, "A" * 10, "t", "x", 0, 0), (6, "a " * 60, "t", "x", 0, 0), (7, long + " #", "t", "x", 0, 0),
        (8, "\x0b\t words  \r\n", "", "x", 0, 0), (9, " ".join(f"é{i}" for i in range(20000)), "t", "x", 0, 0), (10, "AB " + "x" * 37, "t", None, None, None), (11, "ABC " + "x" * 36, "t", None, None, None),
        (12, " ".join(f"w{i % 39}" for i in range(60)), "t", "x", 0, 0), (13, " ".join(f"w{i % 38}" for i in range(60)), "t", "x", 0, 0), (14, "no\xa0break" * 60, "t", "x", 0, 0),
    ]


def test_flags_and_labels(spark):
    docs = documents()
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (5, 2, 1), (99, 1, 1)]
    known = {1: (True, False), 2: (True, True), 5: (False, True)}
    want = [(d[2], *f.values(), *known.get(d[0], (False, False))) for d, f in zip(docs, loop_flags(docs), strict=True)]
    frame = filter_audit.document_flags(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(repr((r[0], *[bool(x) for x in r[1:]])) for r in frame.collect()) == sorted(map(repr, want))
    report = got(filter_audit.audit(frame, list("ABCDE"), "part", "good", "toxic"))
    assert report == loop_audit([(w[0], {f for f, x in zip("ABCDE", w[1:6], strict=True) if x}, w[6], w[7]) for w in want], "ABCDE")
    assert hashlib.sha256(b"").hexdigest() and ("", "ABCDE", 5) in report


def test_empty_tables_and_limits(spark):
    none = filter_audit.document_flags(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    report = filter_audit.audit(none, list("ABCDE"), "part", "good", "toxic")
    assert report.columns == ["part", "filter_order", "step", *filter_audit.MEASURES] and not report.collect()
    some = filter_audit.document_flags(spark.createDataFrame(documents()[:2], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert filter_audit.audit(some, list("ABCDE"), "part", "good", "toxic").count() == 600
    with pytest.raises(ValueError):
        filter_audit.audit(some, list("ABCDEABC"), "part", "good", "toxic")
