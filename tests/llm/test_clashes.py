"""Operators and stages over tables whose other columns have the names that they use inside."""

import pytest
from pyspark.sql import functions as F

from marlpit.llm import cover, filter_audit, langid, mixing, near, packing, pii, simhash, tokens, topk, url_filter, warc, winnow

NAMES = (
    "row rank score key k t v n x y u h p l s d e a b i node component of comp token tokens tied size take taken target best best_u blocks block digest j_key j_digest _mark label kept label_2 fp set sets first firsts least "
    "low high cell piece asks gap norm dim part parts cut _w _h _k _t _n _size window windows mark start end spans span items item hits host path rule verdict sequence_id offset length ids loss want wanted lang_pred lang_score shard draw copies mask subset filter"
).split()
TEXTS = ["the cat sat on the mat and looked at the dog again", "the cat sat on the mat and looked at the dog again", "der Hund und die Katze sitzen auf der Matte", "mail a@b.co or +1 (709) 555-3299", None, "", "le chat et le chien sont sur le tapis ici"]
DOCS = [(i, t, ["en", "en", "de", "en", None, "en", "fr"][i], "ab"[i % 2], len(t or "")) for i, t in enumerate(TEXTS)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def widened(df, but=()):
    """df with a column of each name, of its own values, that it hasn't."""
    return df.select("*", *[F.lit(f"clash {n}").alias(n) for n in NAMES if n.lower() not in {c.lower() for c in df.columns} | set(but)])


def same(got, want):
    pick = sorted(want.columns)
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in pick]).collect())
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, COLUMNS).coalesce(1)


def test_operators_on_documents(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, TEXTS[0]), (2, "katze sitzen")], "item_id long, text string")
    for run in (
        lambda d: mixing.mix(d).select("doc_id", "text", "mix_shard", "mix_epoch", "mix_words", "mix_order"),
        lambda d: tokens.count_tokens(d, ["source", "text"]),
        lambda d: pii.redact(d).select("doc_id", "text"),
        lambda d: simhash.cluster(simhash.fingerprints(d)),
        lambda d: packing.pack(d),
        lambda d: near.dedup(d).select("doc_id", "text"),
        lambda d: filter_audit.document_flags(d, widened(labels) if d is not docs else labels).drop("part"),
        lambda d: winnow.decontaminate(d, widened(items) if d is not docs else items),
    ):
        same(run(widened(docs)), run(docs))
    flags = filter_audit.document_flags(docs, labels)
    same(filter_audit.audit(widened(flags, ("part", "good", "toxic")), list("ABCDE"), "part", "good", "toxic"), filter_audit.audit(flags, list("ABCDE"), "part", "good", "toxic"))


def test_languages(spark, docs):
    many = docs
    for _ in range(3):
        many = many.union(many)
    net = langid.fit(many)
    same(langid.identify(widened(docs, ("lang_pred", "lang_score")), net).select("doc_id", "lang_pred", "lang_score"), langid.identify(docs, net).select("doc_id", "lang_pred", "lang_score"))
    same(langid.identify(docs, langid.fit(widened(many))).select("doc_id", "lang_pred"), langid.identify(docs, net).select("doc_id", "lang_pred"))


def test_vectors_and_pages(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], i % 2) for i in range(60)], "vec_id long, embedding array<float>, label int")
    same(topk.search(widened(vectors), "vec_id % 20 = 0").drop("query_row"), topk.search(vectors, "vec_id % 20 = 0").drop("query_row"))
    pages = spark.createDataFrame([(i, f"http://a{i % 3}.example.org/es/{i}", f"<p>{i % 4}</p>") for i in range(20)], "page_id long, url string, html string")
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    pick = ["page_id", "host", "path", "rule", "verdict"]
    same(url_filter.judge(widened(pages, ("host", "path", "rule", "verdict")), rules).select(*pick), url_filter.judge(pages, rules).select(*pick))
    same(cover.near_duplicates(widened(vectors), threshold=0.9), cover.near_duplicates(vectors, threshold=0.9))
    read = []
    for i, d in enumerate((widened(pages), pages)):
        warc.write_bundles(d, f"file://{tmp_path}/{i}")
        read.append(warc.read_bundles(spark, f"file://{tmp_path}/{i}"))
    same(*read)
