"""Every query with SQL gives the rows that DuckDB gives on the small tables; every other query runs."""

import hashlib
import math
import re
import uuid
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from marlpit.plans import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return [cell(y) for y in x]
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if type(x).__name__ in ("bool", "bool_"):
        return bool(x)
    if isinstance(x, (int, float)) or hasattr(x, "item"):
        return round(float(x), 6)
    return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([cell(x) for x in r]) for r in df[names].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql() | registry.SMALL_ORACLES
    if name in sql:
        assert rows(got) == rows(duck.execute(sql[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_rouge_by_hand(spark):
    words = lambda t: re.findall(r"\w+", t.lower())
    got = {r.item_id: r.rouge_l for r in registry.queries()["r21_rouge_l"](spark, SF).collect()}
    for r in _table(spark, "benchmark"):
        a, b = words(r.text), words(r.text[29:] + " the the")
        n = _lcs(a, b)
        assert got[r.item_id] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0, abs=2e-6)


def test_hash_embeddings_by_hand(spark):
    got = {r.item_id: list(r.embedding) for r in registry.queries()["r9_hash_embedding"](spark, SF).collect()}
    for r in _table(spark, "benchmark"):
        counts = Counter(int(hashlib.blake2b(w.encode(), digest_size=4).hexdigest(), 16) % 32 for w in r.text.lower().split())
        norm = math.sqrt(sum(n * n for n in counts.values()))
        assert got[r.item_id] == pytest.approx([counts[i] / norm for i in range(32)])


def test_facets_by_hand(spark):
    marks = {"method": ["approach", "method", "the"], "result": ["result", "and"], "data": ["dataset", "la", "der"]}
    got = {r.doc_id: list(r.facets) for r in registry.queries()["h45_facets"](spark, SF).collect()}
    for r in _table(spark, "documents"):
        first = {n: min((r.text.lower().find(w) for w in words if w in r.text.lower()), default=None) for n, words in marks.items()}
        assert got[r.doc_id] == [n for _, n in sorted((p, n) for n, p in first.items() if p is not None)]


def test_panel_groups_by_hand(spark):
    boxes = {r.p_partkey: (r.p_brand, r.p_partkey * 37 % 1000, r.p_partkey * 91 % 1400) for r in _table(spark, "part")}
    root = {k: k for k in boxes}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (page, x, y) in boxes.items():
        for b, (other, u, v) in boxes.items():
            if a < b and page == other:
                wide, high = 60 - abs(x - u), 40 - abs(y - v)
                if (high >= 20 and -wide <= 24) or (wide >= 30 and -high <= 24):
                    low, up = sorted((top(a), top(b)))
                    root[up] = low
    got = {r[0]: r[1] for r in registry.queries()["j18_panel_groups"](spark, SF).collect()}
    assert got == {k: top(k) for k in boxes}


def test_fuzzy_names_by_hand(spark):
    parts = _table(spark, "part")
    brands = {}
    for r in parts:
        brands[r.p_brand] = min(brands.get(r.p_brand, r.p_name), r.p_name)
    asked = {n if b.endswith("3") else n[: len(n) - 2] for b, n in brands.items()}
    want = set()
    for a in asked:
        equal = any(r.p_name == a for r in parts)
        scored = [(-0.98 if r.p_name == a else -round(0.82 if a.lower().strip() in r.p_name.lower() else SequenceMatcher(None, a.lower().strip(), r.p_name.lower().strip()).ratio(), 6), r.p_partkey) for r in parts if not equal or r.p_name == a]
        ranked = sorted(s for s in scored if s[0] <= -0.45)[:5]
        want |= {(a, k, -s, i) for i, (s, k) in enumerate(ranked, 1)}
    got = registry.queries()["k10_fuzzy_names"](spark, SF).collect()
    assert {(r.asked, r.p_partkey, r.score, r["rank"]) for r in got} == want and len(got) == len(want)


def test_positions_and_ids_by_hand(spark):
    got = {r.doc_id: (r.n_flat, r.last) for r in registry.queries()["h51_positions"](spark, SF).collect()}
    ids = {r.doc_id: r.id for r in registry.queries()["h22_stable_ids"](spark, SF).collect()}
    for r in _table(spark, "documents"):
        flat = " ".join(r.text.split())
        assert got[r.doc_id][0] == len(flat) and (not flat or r.text[got[r.doc_id][1]] == flat[-1])
        assert ids[r.doc_id] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"doc:{r.doc_id}"))


def test_positions_of_texts_without_any(spark, tmp_path):
    spark.createDataFrame([(1, "a  b"), (2, ""), (3, " \n "), (4, None), (5, "\nx ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["h51_positions"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 3), (2, 0, None), (3, 0, None), (4, 0, None), (5, 1, 1)]


def test_positions_in_small_frames(spark):
    import numpy as np

    from marlpit.functions import more

    texts = pd.Series(["  a \n b\u00a0c  ", None, "", *["word  " * 100_000] * 4])
    frames = list(more.squeeze_with_positions.func(iter([texts, texts[:0]])))
    assert all(isinstance(x, np.ndarray) and x.dtype == np.int32 for f in frames for x in f.positions)
    assert max(sum(map(len, f.positions)) for f in frames) < 2 * more.POSITIONS and [f for f in frames if len(f)][1:]
    whole = pd.concat(frames)
    assert len(whole) == len(texts) and whole["flat"][:3].tolist() == ["a b c", "", ""] and list(whole.positions.iloc[0]) == [2, 3, 6, 7, 8]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i != 1], "i long, t string").coalesce(1)
    got = df.select("i", "t", more.squeeze_with_positions("t").alias("s")).select("i", "t", "s.*").collect()
    assert len(got) == 6 and all(r.flat == " ".join(r.t.split()) and [r.t[p].strip() or " " for p in r.positions] == list(r.flat) for r in got)


def test_global_rank(spark):
    from marlpit.operators.ranking import global_rank

    rows = [(i, (i * 7919 % 97) if i % 11 else None) for i in range(500)]
    got = global_rank(spark.createDataFrame(rows, "id long, v long").repartition(5), "v", ["id"], ranges=16).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [(r.id, r.v) for r in sorted(got, key=lambda r: r.place)] == want and [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(1, 501))
    assert global_rank(spark.createDataFrame([], "id long, v long"), "v", ["id"]).count() == 0
