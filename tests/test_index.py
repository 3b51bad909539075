"""The lexical index against scans of the visible documents, over batches that bring, change and remove documents."""

import random

import pytest
from pyspark.sql import functions as F

from marlpit.operators import index, lexical, spans
from pyspark.sql import Window as W

FIELDS = {"title": 2.0, "text": 1.0}
SCHEMA = "doc long, title string, text string"


def docs_of(n, seed, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 40)))
    return [(i, " ".join(rng.choices(words, k=3)), text()) for i in range(first, first + n)]


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    rows = [(q, [f"w{rng.randint(0, 64)}" for _ in range(rng.randint(0, 6))]) for q in range(25)] + [(99, ["w0", "w0", None]), (100, ["nowhere"])]
    return spark.createDataFrame(rows, "query_id long, terms array<string>")


def table(rows):
    return sorted((r.query_id, r.key, r.score, r.rank) for r in rows.collect())


def scanned(spark, docs, asked, k=5):
    frame = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("doc", "key")
    return table(lexical.top(lexical.bm25(frame, asked, "key", FIELDS), k, "key"))


def test_search_equals_scan(spark, asked, tmp_path):
    docs, path = docs_of(300, 1), str(tmp_path / "i")
    index.append(spark.createDataFrame(docs, SCHEMA), path, 0, "doc", FIELDS, block=4)
    want = scanned(spark, docs, asked)
    assert len({x[0] for x in want}) > 20
    for first in (1, 4, 1000):
        assert table(index.search(spark, path, asked, 5, first=first)) == want
    opened = index.plan(spark, path, asked).open_blocks(5, 2)
    assert 0 < opened.where("open").count() < opened.count()  # some blocks are left out
    assert index.check(spark, path).count() == 0


def test_changed_corpus_equals_rebuild(spark, asked, tmp_path):
    path, again = str(tmp_path / "i"), str(tmp_path / "j")
    old = docs_of(80, 2)
    new = docs_of(40, 3, 20)  # 20 to 59 with other texts
    gone = [(i, None, None) for i in (0, 1, 25, 500)]
    put = lambda rows, n, **o: index.append(spark.createDataFrame(rows, SCHEMA), path, n, "doc", FIELDS, block=8, **o)
    put(old, 0)
    put(new + old[60:], 1)
    put(gone + [(None, "w1", "w1")], 2)
    put([old[1], old[2]], 3, gone=F.col("doc") == 2)
    left = {d[0]: d for d in old} | {d[0]: d for d in new}
    for i in (0, 2, 25):
        del left[i]
    assert table(index.search(spark, path, asked, 5, first=2)) == scanned(spark, list(left.values()), asked)
    index.append(spark.createDataFrame(list(left.values()), SCHEMA), again, 0, "doc", FIELDS)
    rows = lambda p: sorted(map(tuple, index.live_postings(spark, p).select("key", "term", "tf", "dl").collect()))
    assert rows(path) == rows(again) and index.check(spark, path).count() == 0
    # unchanged documents and removals of unknown ones wrote nothing
    assert [(r.batch, r.documents, r.removed) for r in index.manifest(spark, path).orderBy("batch").collect()] == [(0, 80, 0), (1, 40, 0), (2, 3, 3), (3, 2, 1)]


def test_unfinished_batch_is_not_seen_and_mended(spark, asked, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "i"), docs_of(60, 4)
    index.append(spark.createDataFrame(docs[:30], SCHEMA), path, 0, "doc", FIELDS)
    real, seen = index._write, scanned(spark, docs[:30], asked)
    for fails in ("postings", "blocks", "versions"):

        def write(df, to, by, fails=fails):
            if to.endswith(fails):
                raise OSError("lost")
            real(df, to, by)

        monkeypatch.setattr(index, "_write", write)
        with pytest.raises(OSError):
            index.append(spark.createDataFrame(docs, SCHEMA), path, 1, "doc", FIELDS)
        assert table(index.search(spark, path, asked, 5)) == seen
    assert {r.problem for r in index.check(spark, path).collect()} == {"postings_without_version"}
    monkeypatch.setattr(index, "_write", real)
    for _ in range(2):
        index.append(spark.createDataFrame(docs, SCHEMA), path, 1, "doc", FIELDS)
        assert table(index.search(spark, path, asked, 5)) == scanned(spark, docs, asked)
    assert index.check(spark, path).count() == 0


def test_no_batch_and_no_words(spark, asked, tmp_path):
    path = str(tmp_path / "i")
    assert index.search(spark, path, asked, 5).count() == 0 and index.check(spark, path).count() == 0
    index.append(spark.createDataFrame([(1, None, "?!"), (2, "", None)], SCHEMA), path, 0, "doc", FIELDS)
    assert index.search(spark, path, asked, 5).count() == 0 and index.live(spark, path).count() == 2


def test_spans_equal_windows(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.randint(0, 9), rng.choice([None, "a", "b"])) for c in range(6) for t in sorted(rng.sample(range(-20, 60), 30))] + [(9, 5, None, None)]
    frame = spark.createDataFrame(rows, "c int, t long, n int, v string")
    w = W.partitionBy("c").orderBy("t")
    want = frame.withColumns({"total": F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)), "after": F.lead("v").over(w), "before": F.lag("v").over(w)})
    for width in (1, 7, 1024):
        got = spans.running(frame, ["c"], "t", F.col("n"), "total", width)
        got = spans.beside(spans.beside(got, ["c"], "t", F.col("v"), "after", True, width), ["c"], "t", F.col("v"), "before", False, width)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_texts_are_tokenized_once_in_bounded_tasks(spark, tmp_path, monkeypatch):
    real, path, plans = index._write, str(tmp_path / "i"), {}

    def write(df, to, by):
        plans[to.rsplit("/", 1)[1]] = df._jdf.queryExecution().optimizedPlan().toString()
        real(df, to, by)

    docs = spark.range(60).select(F.col("id").alias("doc"), F.lit("w1").alias("title"), F.concat(F.lit("w2 w3 w"), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(index, "_write", write)
    monkeypatch.setattr(index, "TASK_CHARS", 100, raising=False)
    index.append(docs, path, 0, "doc", FIELDS, block=4)
    assert [n for n, p in plans.items() if "regexp_extract_all" in p] == ["postings"] and len(plans) == 3
    asked = spark.createDataFrame([(1, ["w2", "w7"]), (2, ["w3", "w1"])], "query_id long, terms array<string>")
    want = table(index.search(spark, path, asked, 5))
    monkeypatch.setattr(index, "PAIRS", 10, raising=False)
    monkeypatch.setattr(index, "SENT_BLOCKS", 0, raising=False)
    assert table(index.search(spark, path, asked, 5)) == want and len(want) == 10


def test_blocks_are_made_where_documents_are_counted(spark, tmp_path, monkeypatch):
    """Blocks' rows come with the postings, over batches of a few rows; they are neither grouped nor shuffled again."""
    real, path, plans = index._write, str(tmp_path / "i"), {}

    def write(df, to, by):
        plans[to.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        real(df, to, by)

    monkeypatch.setattr(index, "_write", write)
    docs = [(f"k{i}", t, x) for i, t, x in docs_of(90, 5)] + [("n", None, "w1 É_x"), ("o", "w1", None), ("p", "?", "!"), ("k3", "w1 w1", "other"), (None, "w1", "w1")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index.append(spark.createDataFrame(docs, "doc string, title string, text string").repartition(3), path, 0, "doc", FIELDS, block=8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Exchange" not in plans["blocks"] and "Aggregate" not in plans["blocks"]
    assert index.check(spark, path, "string").count() == 0
    got = {(r.key, r.term): (r.tf, r.dl) for r in index.live_postings(spark, path, "string").collect()}
    want, chosen = {}, {k: (t, x) for k, t, x in docs if k and k != "k3"}
    k3 = {r.key: r.dl for r in index.live(spark, path, "string").collect()}["k3"]
    chosen["k3"] = next((t, x) for k, t, x in docs if k == "k3" and 2.0 * len(t.split()) + len(x.split()) == k3)
    for k, texts in chosen.items():
        cut = [[w for w in (t or "").lower().split() if w not in "?!"] for t in texts]
        for w in {w for c in cut for w in c}:
            want[k, w] = (2.0 * cut[0].count(w) + cut[1].count(w), 2.0 * len(cut[0]) + len(cut[1]))
    assert got == want and len(spark.read.parquet(f"{path}/blocks").select("block").distinct().collect()) > 8
    wrong = spark.read.parquet(f"{path}/postings").where("bucket <> substring(md5(term), 1, 1)")
    assert wrong.count() == 0
