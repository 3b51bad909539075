"""Language identification by a small byte convolutional network in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows (stride 2), the maxima over a window go to
a softmax layer. A text is cut into windows that cover all of it; their probabilities are averaged by length.
Training: Adam on windows of a bounded sample of labelled rows, on the driver, with fixed seeds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import slices, table

WINDOW, STRIDE, WIDTHS, FILTERS, DIM = 128, 2, (2, 3, 4), 16, 6
#: At most so many labelled rows of each language are fitted, and so many windows of each row.
SAMPLE_ROWS, SAMPLE_WINDOWS = 1500, 4
#: The network has a class for each language, so their number is bounded.
MOST_LANGUAGES = 500
UNKNOWN = "und"
_common_letter = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]").search


def has_letter(text: str) -> bool:
    return bool(_common_letter(text)) or any(map(str.isalpha, text))


def windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover all bytes, zero-padded, and the bytes in each."""
    n = max(1, -(-len(raw) // WINDOW))
    padded = np.zeros(n * WINDOW, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    lengths = np.full(n, WINDOW, np.int64)
    lengths[-1] = len(raw) - (n - 1) * WINDOW
    return padded.reshape(n, WINDOW), lengths


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(languages, f32(256, DIM, scale=0.5), [f32(w * DIM, FILTERS, scale=(w * DIM) ** -0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], f32(FILTERS * len(WIDTHS), len(languages), scale=0.1), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        """Probabilities of windows (n, WINDOW), and what training needs."""
        e = self.embedding[x]
        pooled, kept = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2)
            cols = cols.reshape(len(x), -1, w * DIM)
            y = cols @ f
            kept.append((cols, y))
            pooled.append(np.maximum(y.max(axis=1) + b, 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), kept, h

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p, kept, h = self.forward(x)
        d = p
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dh = (d @ self.out.T) * (h > 0)
        d_emb, d_filters, d_biases = np.zeros_like(self.embedding), [], []
        for i, (w, f, (cols, conv)) in enumerate(zip(WIDTHS, self.filters, kept, strict=True)):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            at = conv.argmax(axis=1)
            patch = np.take_along_axis(cols, at[:, :, None], axis=1)  # what each maximum saw
            d_filters.append(np.einsum("nk,nkj->jk", g, patch))
            d_biases.append(g.sum(axis=0))
            back = (g[:, :, None] * f.T[None]).reshape(len(x), FILTERS, w, DIM)
            where = x[np.arange(len(x))[:, None, None], at[:, :, None] * STRIDE + np.arange(w)]
            np.add.at(d_emb, where.ravel(), back.reshape(-1, DIM))
        return [d_emb, *d_filters, *d_biases, h.T @ d, d.sum(axis=0)]


def train(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.004, seed: int = 1) -> Network | None:
    """A network for the languages among labels, from windows of texts; None without rows."""
    if not texts:
        return None
    languages = sorted(set(labels))
    x, y = [], []
    for t, label in zip(texts, labels, strict=True):
        w, lengths = windows_of(t.encode())
        w = w[lengths > 0]
        x.append(w)
        y += [languages.index(label)] * len(w)
    x, y = np.concatenate(x), np.array(y)
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    if not len(y):
        return net
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            step += 1
            now = rate * (1 - step / (total + 1))
            pick = order[i : i + batch]
            for p, g, m in zip(net.parameters(), net.gradients(x[pick], y[pick]), moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p -= now * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
    return net


def predict(net: Network | None, texts: list[str | None], at_once: int = 512) -> tuple[list[str], list[float]]:
    """The language and its mean probability over each whole text; `und` and 0 for null, without a letter, or without a network."""
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if net else []
    if not rows:
        return languages, scores
    sums, weight = np.zeros((len(rows), len(net.languages))), np.zeros(len(rows))
    pending: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def run() -> None:
        x, n = np.concatenate([p[1] for p in pending]), np.concatenate([p[2] for p in pending])
        owner = np.repeat([p[0] for p in pending], [len(p[2]) for p in pending])
        for i in range(0, len(x), at_once):
            p = net.forward(x[i : i + at_once])[0] * n[i : i + at_once, None]
            np.add.at(sums, owner[i : i + at_once], p)
        np.add.at(weight, owner, n)
        pending.clear()

    for k, i in enumerate(rows):
        x, n = windows_of(texts[i].encode())
        pending.append((k, x, n))
        size += len(n)
        if size >= at_once:
            run()
            size = 0
    if pending:
        run()
    mean = sums / weight[:, None]
    best = mean.argmax(axis=1)
    for k, i in enumerate(rows):
        languages[i], scores[i] = net.languages[best[k]], float(min(1.0, mean[k, best[k]]))
    return languages, scores


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", most_rows: int = SAMPLE_ROWS, most_windows: int = SAMPLE_WINDOWS, **options) -> Network | None:
    """Trains on at most `most_rows` rows of each language, chosen by hash, and `most_windows` pieces of each; rows without text or label are left out.

    Languages are taken in the order of their hash-free names; there is one class for each, so their number must be small.
    """
    piece = F.expr(f"transform(sequence(0, least({most_windows}, ceil(length(`{text}`) / {WINDOW})) - 1), i -> substring(`{text}`, CAST(1 + i * greatest({WINDOW}, length(`{text}`) div {most_windows}) AS INT), {WINDOW}))")
    known = rows.where(F.col(label).isNotNull() & (F.length(text) > 0))
    # few more rows than are kept pass a bound on the hash, so little is sorted or shuffled, and of those only pieces
    counts = known.groupBy(label).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    mark = F.xxhash64(F.col(key).cast("string"), F.col(text))
    share = F.shiftrightunsigned(mark, 11) / float(1 << 53)
    bound = F.coalesce(*[F.when(F.col(label) == r[0], F.lit((2.0 * most_rows + 64) / r.n)) for r in counts], F.lit(0.0))
    passing = known.withColumn("_mark", mark).where(share <= bound)
    order = W.partitionBy("label").orderBy("_mark", "_key")
    sample = passing.select(F.col(label).alias("label"), F.col(key).alias("_key"), "_mark", piece.alias("_pieces"))
    sample = sample.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_rows)
    got = sample.select("label", "_n", F.posexplode("_pieces").alias("i", "piece")).orderBy("label", "_n", "i").collect()
    return train([r.piece for r in got], [r.label for r in got], **options)


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1) for each whole text. Columns of these names are replaced; null texts are `und`."""
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            languages, scores = predict(net, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, lang_score double")


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text leaves 2 on division by 4; false for null keys."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
