"""The registered queries over tables with nulls, empty and odd rows, repeated rows and no rows."""

import pytest

from marlpit.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the cat sat on the mat with a@b.co " * 5, "en", "s", 1), (1, "the cat sat on the mat with a@b.co " * 5, "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, " \n\t", "de", "s", 3),
    (4, "der hund und die katze " * 2000, "de", "z", 9), (5, "\x00  漢字 é", None, "é", 5), (6, "x" * 50_000, "fr", "s", 1), (7, " " * 20_000, "en", "s", 1), (8, "4041 8949 7460 8795 +1 (709) 555-3299", None, "s", 2),
]
VECTORS = [(0, [1.0, 0.5, 0.0], 1), (50, [1.0, 0.5, 0.0], 1), (50, [0.9, 0.5, 0.1], None), (1, None, 1), (2, [None, 1.0, 1.0], 1), (3, [float("nan"), 1.0, 1.0], 2), (None, [0.1, 0.2, 0.3], 2), (100, [0.0, 0.0, 0.0], 2)]
LABELS = [(1, 1, None), (1, None, 1), (None, 1, 1), (2, 0, 0), (77, 1, 1)]
ITEMS = [(1, "the cat sat on the mat with a b co"), (1, None), (None, "der hund und die katze"), (2, ""), (3, "katze"), (3, "katze")]
PAGES = [(1, "http://a.example.org/es/", "<p>x</p>"), (1, "http://a.example.org/es/", "<p>x</p>"), (2, None, None), (3, "", ""), (None, "://", "<p>x</p>"), (4, "http://b.com/de/\nx", "y" * 100_000)]


@pytest.fixture(scope="module", params=["rows", "empty"])
def folder(spark, request, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp(request.param)}"
    keep = "true" if request.param == "rows" else "false"
    spark.createDataFrame(ROWS, DOCS).where(keep).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").where(keep).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").where(keep).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").where(keep).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").where(keep).write.parquet(f"{path}/benchmark.parquet")
    return path, request.param == "rows"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, name):
    path, full = folder
    got = QUERIES[name](spark, path).toPandas()
    want = {"op4_url_filters": len(PAGES), "op6_warc": len(PAGES), "op8_cover_tree": len(VECTORS)}.get(name, len(ROWS))
    if not full:
        assert len(got) == 0
    elif name in ("op3_token_counts", "op10_packing"):
        assert len(got) >= want
    elif name == "op11_filter_audit":
        assert len(got) == 600 * len({r[3] or "" for r in ROWS})
        last = got[got.step == 5].groupby("part").kept.agg(["min", "max"])
        assert (last["min"] == last["max"]).all()
        # the empty text of row 3 is that of row 2; the rows of key 1 have no smaller key
        assert got[(got.filter_order == "EABCD") & (got.step == 1)].removed.sum() == 1
    elif name == "op12_decontamination":
        found = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in got.fillna({"doc_id": -1}).itertuples()}
        assert found[1, 50] == (50, 1) and found[4, 10_000] == (10_000, 1) and found[2, 0] == found[-1, 0] == (0, 0) and found[5, 3] == (0, 0)
    elif name == "op2_topk":
        assert sorted(set(got.query_id)) == [0, 50, 100] and got.groupby("query_id").size().to_dict() == {0: 4, 50: 8, 100: 4}
    else:
        assert len(got) == want


def test_pipeline(spark, folder):
    import corpus_pipeline

    path, full = folder
    got = corpus_pipeline.run(spark, path).toPandas()
    assert len(got) > 0 if full else len(got) == 0
