"""Hybrid search, reranking by a model, panels and versions of published tables."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marlpit.operators import fusion, graph, hybrid
from marlpit.sources import files

TEXTS = [f"word{i % 7} word{i % 5} graph net{i}" for i in range(60)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    vec = lambda: [rng.random() for _ in range(4)]
    kinds = ["text", "table", "figure", "other"]
    chunks = spark.createDataFrame([(i, i % 12, kinds[i % 4], TEXTS[i], vec() if i % 9 else None) for i in range(60)], "id long, document_id long, kind string, content string, embedding array<double>")
    cards = spark.createDataFrame([(i, vec(), ["multimodal_fusion"] if i % 4 == 0 else [], "audio visual" if i == 4 else None) for i in range(12)], "document_id long, embedding array<double>, topic_tags array<string>, text string")
    asked = spark.createDataFrame([(0, "word1 graph", vec()), (1, "a multimodal word2", vec()), (2, "audio-visual fusion word3", vec()), (3, None, vec()), (4, "net17", None)], "query_id long, text string, q array<double>")
    return chunks, cards, asked


def test_documents_are_chosen_by_topic(spark, corpus):
    _, cards, asked = corpus
    got = {}
    for r in hybrid.select_documents(cards, asked, 2).collect():
        got.setdefault(r.query_id, set()).add(r.document_id)
    assert len(got[0]) == 8 and got[1] == {0, 4, 8} and got[2] == {4} and len(got[3]) == 8 and 4 not in got
    nobody = hybrid.select_documents(cards.withColumn("topic_tags", F.array().cast("array<string>")).withColumn("text", F.lit("")), asked, 2)
    assert nobody.where("query_id = 2").count() == 8  # nothing meets the topics: the nearest stay


def test_scopes_and_fallbacks(spark, corpus):
    chunks, cards, asked = corpus
    document = {r.id: r.document_id for r in chunks.collect()}
    free = hybrid.search_each(chunks, cards, asked, 4).collect()
    chosen = {(r.query_id, r.document_id) for r in hybrid.select_documents(cards, asked, 4).collect()}
    assert {r.query_id for r in free} == {0, 1, 2, 3, 4} and all((r.query_id, document[r.id]) in chosen for r in free if r.vector_rank)
    assert [r.id for r in free if r.query_id == 4] == [17]  # without a vector: by words alone
    # no cards and no scope: all documents' vectors
    bare = hybrid.search_each(chunks, cards.limit(0), asked, 4, rerank=False).collect()
    assert {r.query_id for r in bare if r.vector_rank} == {0, 1, 2, 3}
    scope = spark.createDataFrame([(0, 1), (0, 2), (1, 99)], "query_id long, document_id long")
    held = hybrid.search_each(chunks, cards, asked, 4, scope).collect()
    assert {r.query_id for r in held} == {0} and {document[r.id] for r in held} <= {1, 2}
    assert hybrid.search_each(chunks, cards, asked, 4, scope.limit(0)).count() == 0 and hybrid.search_each(chunks.limit(0), cards, asked, 4).count() == 0
    for r in free:  # ranks are 1 to 4, by falling score
        assert 1 <= r["rank"] <= 4


def ranked(spark, per=30):
    rng = random.Random(5)
    rows = [(q, f"q{q} word{q} graph", i, TEXTS[(i * 7 + q) % 60], round(1 / (60 + p), 6), p) for q in range(5) for p, i in enumerate(rng.sample(range(60), per if q else 3), 1)]
    return rows, spark.createDataFrame(rows, "query_id int, text string, id int, content string, score double, place int")


def loop(rows, score, k, first):
    out = {}
    for q in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: r[5])
        head = sorted(((round(score(r), 6), -r[5], r[2]) for r in mine[:first]), reverse=True)[:k]
        both = sorted([(s, 1, p, i) for s, p, i in head] + [(r[4], 0, -r[5], r[2]) for r in mine[first:]], reverse=True)[:k]
        out[q] = [(i, s) for s, _, _, i in both]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.rerank_score))
    return out


def test_cross_encoder_equals_a_loop(spark):
    rows, frame = ranked(spark)

    def load():
        def score(pairs):
            if len(pairs) > 8:
                raise ValueError("too many at once")
            return [1 / (1 + math.exp(-len(set(q.split()) & set(t.split())) / len(t))) for q, t in pairs]

        return score

    one = lambda r: load()([(r[1], r[3])])[0]
    assert listed(fusion.cross_rerank(frame, "loop-model", load, 6, 20, batch=8)) == loop(rows, one, 6, 20)
    assert listed(fusion.cross_rerank(frame, "loop-model", load, 6, 2, batch=8)) == loop(rows, one, 6, 2)
    assert fusion._cut("a b c", "d e f g h", 6) == ("a b c", "d e f") and fusion._cut("a b c d e", "f", 4) == ("a b c", "f") and fusion._cut("a", "b", 9) == ("a", "b")


def test_a_model_that_fails_leaves_the_order(spark):
    rows, frame = ranked(spark)

    def broken():
        raise OSError("no such model")

    def picky():
        def score(pairs):
            if any(q.startswith("q2") for q, _ in pairs):
                raise ValueError("a pair that fails")
            return [0.5 for _ in pairs]

        return score

    order = {q: [(r[2], r[4]) for r in sorted((r for r in rows if r[0] == q), key=lambda r: r[5])[:6]] for q in range(5)}
    base = fusion.cross_rerank(frame, "broken-model", broken, 6)
    assert listed(base) == order and {r.backend for r in base.collect()} == {"base"}
    got = listed(fusion.cross_rerank(frame, "picky-model", picky, 6, batch=1))
    assert got[2] == order[2] and got[1] != order[1] and all(s == 0.5 for _, s in got[1])


def test_panels_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    boxes = [(i, i % 2, x := rng.uniform(0, 600), y := rng.uniform(0, 900), x + rng.uniform(1, 200), y + rng.uniform(1, 300)) for i in range(120)]
    frame = spark.createDataFrame(boxes, "box_id int, page int, x0 double, y0 double, x1 double, y1 double")

    def near(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        beside = h >= 0.5 * min(a[5] - a[3], b[5] - b[3]) and -w <= 24
        return beside or (w >= 0.5 * min(a[4] - a[2], b[4] - b[2]) and -h <= 24)

    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] == b[1] and near(a, b)}
    for height in (16, 128, 5000):
        monkeypatch.setattr(graph, "STRIP", height)
        got = [(r.src, r.dst) for r in graph.panels(frame, ["page"]).collect()]
        assert set(got) == want and len(got) == len(want) > 50


def test_versions_appear_together(spark, tmp_path):
    path = f"file://{tmp_path}/cards"
    frame = lambda n: spark.range(n)
    with pytest.raises(ValueError):
        files.published(spark, path)
    assert files.publish_version({"cards": frame(3), "items": frame(5)}, path) == 1
    both = lambda **k: (files.published(spark, path, "cards", **k).count(), files.published(spark, path, "items", **k).count())
    # a table that is too small, a check that fails, a write that breaks: the old version stays whole
    with pytest.raises(ValueError):
        files.publish_version({"cards": frame(4), "items": frame(0)}, path)
    orphans = lambda t: ["items without a card"] if t["items"].join(t["cards"], "id", "left_anti").count() else []
    with pytest.raises(ValueError, match="without a card"):
        files.publish_version({"cards": frame(4), "items": frame(9)}, path, checks=orphans)
    with pytest.raises(Exception):  # noqa: B017
        files.publish_version({"cards": frame(7), "items": frame(7).selectExpr("raise_error('lost') AS id")}, path)
    assert both() == (3, 5)
    assert files.publish_version({"cards": frame(9), "items": frame(9)}, path, checks=orphans) == 2 and both() == (9, 9) and both(version=1) == (3, 5)


def test_bm25_reads_texts_once_in_bounded_tasks(spark, monkeypatch):
    from marlpit.operators import lexical

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        read.add(1)
        return x

    docs = spark.range(40).select(F.col("id").alias("doc_id"), told(F.concat(F.lit("alpha beta x"), F.col("id").cast("string"))).alias("text"), F.lit("Beta").alias("title"))
    asked = spark.createDataFrame([(1, ["alpha", "x7"]), (2, ["beta"])], "query_id long, terms array<string>")
    rows = lambda: sorted(map(tuple, lexical.bm25(docs, asked, "doc_id", {"title": 2.0, "text": 1.0}, scope=F.col("doc_id") < 30).collect()))
    want = rows()
    assert len(want) == 60 and read.value == 40  # statistics and scores share what was counted
    monkeypatch.setattr(lexical, "PAIRS", 10, raising=False)
    assert rows() == want and lexical.bm25(docs, asked, "doc_id", {"text": 1.0}).rdd.getNumPartitions() == 8


def test_bm25_counts_words_in_their_rows(spark, monkeypatch):
    """A row for each document is shuffled, no table of documents and words is made, and listing terms changes no score."""
    from marlpit.operators import lexical

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["Alpha", "beta", "gamma", "x_1", "été"]) for _ in range(i % 9)) if i % 7 else None, f"beta x{i}" if i % 3 else None) for i in range(50)], "doc_id long, text string, title string")
    asked = spark.createDataFrame([(1, ["alpha", "x7", "alpha"]), (2, ["beta", "été"]), (3, ["nowhere"]), (4, [])], "query_id long, terms array<string>")
    for fields in ({"text": 1.0}, {"title": 2.5, "text": 1.0}):
        found = lexical.bm25(docs, asked, "doc_id", fields)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"keys=\[doc_id#\d+L, term|hashpartitioning\(doc_id#\d+L, term", plan)
        want = {(r.query_id, r.doc_id): r.score for r in lexical.score(lexical.postings(docs, "doc_id", fields), lexical.lengths(docs, "doc_id", fields), asked, "doc_id").collect()}
        got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
        assert got == want and len(got) > 40
        monkeypatch.setattr(lexical, "LISTED_TERMS", 0)
        assert {(r.query_id, r.doc_id): r.score for r in lexical.bm25(docs, asked, "doc_id", fields).collect()} == want
        monkeypatch.undo()


def test_searches_before_a_rerank_are_done_once(spark):
    """A candidate passes the model's step with its row, and long contents don't travel to meet few candidates."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        read.add(1)
        return x

    rows, frame = ranked(spark)
    frame = frame.repartition(3).withColumn("score", told("score"))
    assert len(listed(fusion.cross_rerank(frame, "once-model", lambda: lambda pairs: [0.5 for _ in pairs], 6))) == 5 and read.value == len(rows)


def test_vectors_in_a_table_of_their_own(spark, corpus):
    chunks, cards, asked = corpus
    rows = lambda df: sorted(map(str, df.collect()))
    want = hybrid.search_each(chunks, cards, asked, 4)
    held = chunks.where("embedding IS NOT NULL").select("id", "embedding").union(chunks.limit(1).selectExpr("9999L", "embedding"))
    got = hybrid.search_each(chunks.drop("embedding"), cards, asked, 4, vectors=held)
    assert rows(got) == rows(want) and got.columns == want.columns
