"""Tokenizer access and token counts by section.

Token counts use offset-mapped attribution: a document is encoded once and whole; the tokens' offsets are joined to
the spans of its sections; a token over a boundary is allocated by one of four rules:
`first` and `last` (the section that holds the token's first or last byte), `most` (the section that holds most of its
bytes, the earlier one in a tie), `split` (shares in proportion to bytes).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, slices, table

END_OF_TEXT = "<|endoftext|>"
RULES = ("first", "last", "most", "split")


def default_vocabulary() -> str:
    """The file of the byte-level vocabulary; every function here takes another one as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Runs of Unicode white space.
_long_space = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}").finditer


class Encoder:
    """Byte-level BPE over a file of ranks. The ids are those of the same vocabulary's JSON file in `tokenizers`, several times as fast."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {END_OF_TEXT: len(ranks)}
        self._coding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(len(ranks) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.lengths[len(ranks)] = len(END_OF_TEXT)

    def _plain(self, text: str) -> list[int]:
        return self._coding.encode(text, allowed_special="all") if END_OF_TEXT in text else self._coding.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text. Very long runs of white space are encoded apart, since the coder's pattern overflows its stack in them.

        Such a run always begins a piece, which ends before its last character if another one follows the run.
        """
        out, at = [], 0
        for run in _long_space(text):
            end = run.end() - (run.end() < len(text))
            out += self._plain(text[at : run.start()])
            out += self._coding._encode_single_piece(text[run.start() : end])
            at = end
        return np.asarray([*out, *self._plain(text[at:])] if at else self._plain(text), dtype=np.uint32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def line_spans(raw: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines of a text; a line keeps its newline. An empty text has one empty line."""
    ends = np.flatnonzero(raw == 10) + 1
    bounds = np.concatenate(([0], ends, [len(raw)])) if not len(ends) or ends[-1] != len(raw) else np.concatenate(([0], ends))
    return np.stack((bounds[:-1], bounds[1:]), axis=1)


def attribute(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each span, and how many of the tokens that touch it cross its bounds. Spans are byte bounds, in order and disjoint."""
    n = len(spans)
    a = np.searchsorted(spans[:, 1], starts, "right")  # the first span that ends after the token's start
    b = np.searchsorted(spans[:, 0], ends, "left") - 1  # the last span that begins before the token's end
    inside = (a <= b) & (a < n) & (b >= 0)
    crossing = np.zeros(n, np.int64)
    over = inside & ((a != b) | (spans[np.minimum(a, n - 1), 0] > starts) | (spans[np.maximum(b, 0), 1] < ends))
    whole = inside & ~over
    counts = np.bincount(a[whole], minlength=n).astype(np.float64)
    for s, e, i, j in zip(starts[over], ends[over], a[over], b[over], strict=True):
        shares = np.minimum(spans[i : j + 1, 1], e) - np.maximum(spans[i : j + 1, 0], s)
        crossing[i : j + 1] += shares > 0
        if rule == "split":
            counts[i : j + 1] += shares / (e - s)
        elif rule == "most":
            counts[i + int(np.argmax(shares))] += 1
        elif rule == "first" and spans[i, 0] <= s:
            counts[i] += 1
        elif rule == "last" and spans[j, 1] >= e:
            counts[j] += 1
    return counts, crossing


def count_tokens(docs: DataFrame, fields: list[str] | None = None, key: str = "doc_id", text: str = "text", rule: str = "first", vocabulary: str | None = None, separator: str = "\n") -> DataFrame:
    """One row for each section of each row: key, section (from 0), name, start, end, tokens, crossing.

    Without `fields` the sections are the lines of `text`; with them, the rows' fields are joined by `separator`,
    encoded as one text, and each field with the separator after it is a section. start and end are code points of
    the encoded text, end exclusive; tokens is a double (whole numbers unless rule is `split`), and the sections' tokens add up to the
    text's. Null texts and fields count as empty; an empty text has one section without tokens. Repeated keys each keep their rows.
    An empty table gives none. Other columns aren't read; a key named like a result is refused.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    own_name(key, ["section", "name", "start", "end", "tokens", "crossing"])
    path, names = vocabulary or default_vocabulary(), list(fields or [text])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            values = [batch.column(i + 1).to_pylist() for i in range(len(names))]
            for k, *texts in zip(batch.column(0).to_pylist(), *values, strict=True):
                texts = [t or "" for t in texts]
                if fields:
                    texts = [t + separator for t in texts[:-1]] + texts[-1:]
                whole = "".join(texts)
                raw = np.frombuffer(whole.encode(), np.uint8)
                if fields:
                    cuts = np.cumsum([0, *(len(t.encode()) for t in texts)])
                    spans = np.stack((cuts[:-1], cuts[1:]), axis=1)
                else:
                    spans = line_spans(raw)
                ends = np.cumsum(coder.lengths[coder.ids(whole)])
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                counts, crossing = attribute(starts, ends, spans, rule)
                before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                n = len(spans)
                for col, x in zip(cols, ([k] * n, range(n), names if fields else ["line"] * n, before[spans[:, 0]].tolist(), before[spans[:, 1]].tolist(), counts.tolist(), crossing.tolist()), strict=True):
                    col.extend(x)
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "section", "name", "start", "end", "tokens", "crossing"])

    rows = docs.select(F.col(key).alias("key"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(run, f"key {kind}, section int, name string, start long, end long, tokens double, crossing long").withColumnRenamed("key", key)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "section", "start", "end", F.col("tokens").cast("long").alias("tokens"), "crossing")
