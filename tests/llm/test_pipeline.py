"""The pipeline against brute-force versions of its stages on a small table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlpit.llm import mixing
from marlpit.llm.pii import spans_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(90001, None, None, None, 0), (90002, "12 34 ##", "en", "src0", 8), (90003, "", "en", "src1", 0), (None, "the words of a document without a key and a@b.co", "en", "src2", 48)], "doc_id long, text string, lang string, source string, n_chars long"))
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5]) and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_language_drops_what_has_no_language(steps):
    gone = {r.doc_id for r in steps[0].join(steps[1], steps[0].doc_id.eqNullSafe(steps[1].doc_id), "left_anti").collect()}
    assert {90001, 90002, 90003} <= gone and len(gone) <= 6 and None not in gone


def test_one_of_each_group_of_equal_texts_stays(steps):
    texts = Counter(r.text for r in steps[2].collect())
    assert max(texts.values()) == 1
    first = {}
    for r in steps[1].collect():
        first[r.text] = min(first.get(r.text, 1 << 62), 1 << 62 if r.doc_id is None else r.doc_id)
    assert {r.doc_id for r in steps[2].where("doc_id IS NOT NULL").collect()} <= set(first.values())


def test_personal_data_is_replaced(steps):
    rows = steps[3].collect()
    assert len(rows) == steps[2].count() and all(r.n_chars == len(r.text) for r in rows)
    before = {r.doc_id: r.text for r in steps[2].collect()}
    for r in rows:
        assert not spans_of(r.text), r.text
        assert r.text == before[r.doc_id] or spans_of(before[r.doc_id])


def test_mix_meets_targets(spark, steps):
    sizes = steps[3].select("source", mixing.words(F.col("text")).alias("size"))
    goal = {r.source: r.target for r in mixing.targets(sizes).collect()}
    got = {r.source: r.n for r in steps[4].groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in goal.items())


def test_packing_holds_every_token_once(steps):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in steps[4].collect())
    assert steps[5].agg(F.sum("length")).first()[0] == want
    assert steps[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_run_matches_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, SF).columns == steps[5].columns
