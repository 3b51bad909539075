import math
import zlib

import numpy as np
import pytest

from marlpit.llm import langid
from marlpit.llm.langid import Network, fit, held_out, identify, predict, train, windows_of

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_windows_cover_all_bytes():
    for n in (0, 1, 127, 128, 129, 1000):
        raw = bytes(i % 251 + 1 for i in range(n))
        x, lengths = windows_of(raw)
        assert x.tobytes().rstrip(b"\0") == raw and lengths.sum() == n


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network.fresh(["a", "b", "c"], 3)
    for name in ("embedding", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.biases = [b.astype(np.float64) + 0.05 for b in net.biases]
    x, y = rng.integers(0, 256, (5, langid.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.forward(x)[0][np.arange(5), y]).mean()
    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if p is net.embedding:
                at = (int(x[0, int(rng.integers(0, 60))]), at[1])
            was = p[at]
            p[at] = was + 1e-5
            up = loss()
            p[at] = was - 1e-5
            down = loss()
            p[at] = was
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=2e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    net = fit(docs.where(~held_out(docs.doc_id)))
    rows = identify(docs.withColumn("h", held_out(docs.doc_id)), net).collect()
    assert len(rows) == docs.count() and all(0 <= r.lang_score <= 1 for r in rows)
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.h]
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.95
    again = fit(docs.repartition(5).where(~held_out(docs.doc_id)))
    assert all(np.array_equal(a, b) for a, b in zip(net.parameters(), again.parameters(), strict=True))


def test_edges(spark):
    rows = [(1, "the cat and the dog " * 40, "en", "x"), (1, "the cat and the dog " * 40, "en", "x"), (2, "der hund und die katze " * 9000, "de", "x"), (3, None, "de", "x"), (4, "", "en", "x"), (5, "12 345 !!", None, "x"), (None, "der hund", None, "x"), (6, "漢", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    net = fit(docs)
    got = {(r.doc_id, r.text and r.text[:3]): (r.lang_pred, r.lang_score) for r in identify(docs, net).collect()}
    assert got[(1, "the")][0] == "en" and got[(2, "der")][0] == "de" and {got[(None, "der")][0], got[(6, "漢")][0]} <= {"de", "en"}
    assert got[(3, None)] == got[(4, "")] == got[(5, "12 ")] == ("und", 0.0)
    assert identify(docs.limit(0), net).count() == 0 and fit(docs.limit(0)) is None
    assert predict(None, ["abc"]) == (["und"], [0.0]) and {r.lang_pred for r in identify(docs, None).collect()} == {"und"}
    long, short = predict(net, ["der hund und die katze " * 9000, "12"]), predict(net, ["der hund und die katze " * 9000])
    assert long[0][0] == short[0][0] == "de" and train([], []) is None


def test_predictions_against_loops():
    """Filters, pooling and softmax position by position, over every window of a text, weighed by its bytes."""
    texts = ["der hund und die katze, sehr lang " * 9, "the cat and the dog", "é", "le chat et le chien dans la maison " * 5]
    net = train(texts * 3, ["de", "en", "fr", "fr"] * 3, epochs=4)
    assert (net.out != Network.fresh(net.languages, 1).out).any()

    def by_hand(window):
        e, h = [net.embedding[b] for b in window], []
        for width, filters, biases in zip(langid.WIDTHS, net.filters, net.biases, strict=True):
            for k in range(langid.FILTERS):
                best = max(sum(float(e[p + i][d]) * float(filters[i * langid.DIM + d][k]) for i in range(width) for d in range(langid.DIM)) for p in range(0, langid.WINDOW - width + 1, langid.STRIDE))
                h.append(max(best + float(biases[k]), 0.0))
        z = [sum(x * float(w) for x, w in zip(h, net.out[:, c], strict=True)) + float(net.out_bias[c]) for c in range(len(net.languages))]
        p = [math.exp(v - max(z)) for v in z]
        return [v / sum(p) for v in p]

    languages, scores = predict(net, texts)
    for text, language, score in zip(texts, languages, scores, strict=True):
        raw, total = text.encode(), [0.0] * len(net.languages)
        for at in range(0, len(raw), langid.WINDOW):
            piece = raw[at : at + langid.WINDOW]
            for c, p in enumerate(by_hand(piece.ljust(langid.WINDOW, b"\0"))):
                total[c] += p * len(piece) / len(raw)
        assert language == net.languages[max(range(len(total)), key=lambda c: total[c])] and score == pytest.approx(max(total), abs=1e-4)
