"""Further text functions: figure labels, sentence-safe clips, windows around a query, table cuts, quotes, cues."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def figure_label(caption: Column) -> Column:
    """struct(number, panel) of a caption such as `Figure 3b`; nulls where there is none."""
    pattern = r"(?i)^\s*(?:fig\.?|figure|hình)\s*(\d+)\s*([a-z])?(?![\p{L}\p{N}])"
    number = F.regexp_extract(caption, pattern, 1)
    return F.struct(F.when(number != "", number.cast("int")).alias("number"), F.nullif(F.lower(F.regexp_extract(caption, pattern, 2)), F.lit("")).alias("panel"))


def requested_numbers(text: Column, kind: str) -> Column:
    """Distinct numbers of the figures or tables a query names, in order."""
    names = r"fig(?:ure|\.)?|hình" if kind == "figure" else r"tables?|bảng"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?<![\p{{L}}])(?:{names})\s*(\d+)"), F.lit(1)), lambda n: n.cast("int")))


def safe_clip(text: Column, most: int) -> Column:
    """At most `most` characters: whole sentences if that leaves a third, else up to a clause, else to a word."""
    head = F.substring(text, 1, most)
    back = F.reverse(head)
    at = lambda pattern: F.when(F.regexp_instr(back, F.lit(pattern)) > 0, F.length(head) - F.regexp_instr(back, F.lit(pattern)) + 1)
    sentence, clause, word = at(r"[.!?]"), at(r"[,;:]"), at(r"\s")
    end = F.when(sentence >= most / 3, sentence).when(clause >= most / 3, clause - 1).when(word > 1, word - 1).otherwise(most)
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(F.substring(head, F.lit(1), end.cast("int"))))


def query_window(text: Column, terms: Column, width: int) -> Column:
    """The `width` characters that begin a quarter before the first query term; the start without one."""
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0)
    start = F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - width // 4)
    cut = F.least(start, F.greatest(F.lit(1), F.length(text) - width + 1))
    return F.when(F.length(text) <= width, text).otherwise(F.substring(text, cut, F.lit(width)))


def cut_table(markdown: Column, terms: Column, rows: int) -> Column:
    """A pipe table's head and at most `rows` rows: those with a query term first, all in their order."""
    lines = F.split(markdown, "\n")
    body = F.transform(F.slice(lines, F.lit(3), F.size(lines)), lambda r, i: F.struct(F.when(F.exists(terms, lambda t: F.lower(r).contains(t)), 0).otherwise(1).alias("far"), i.alias("i"), r.alias("r")))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(body), 1, rows), lambda x: F.struct(x["i"], x["r"])))
    return F.array_join(F.concat(F.slice(lines, 1, 2), F.transform(kept, lambda x: x["r"])), "\n")


def table_kind(caption: Column, markdown: Column) -> Column:
    low = F.lower(F.concat_ws(" ", caption, markdown))
    return F.when(low.rlike("ablation"), "ablation").when(low.rlike("accuracy|f1|score|wer|result|performance"), "results").when(low.rlike("dataset|samples|corpus|split"), "dataset").when(low.rlike("parameter|hyper|setting|learning rate"), "settings").otherwise("other")


def citation(kind: Column, number: Column, page: Column, name: Column) -> Column:
    """A label of at most 32 characters."""
    label = F.when(kind == "table", F.concat(F.lit("Table "), number.cast("string"))).when(kind == "figure", F.concat(F.lit("Figure "), number.cast("string"))).when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string"))).otherwise(name)
    return F.substring(label, 1, 32)


def reference_sentences(text: Column, number: Column, most: int = 4, length: int = 600) -> Column:
    """Sentences that mention a figure by number; `Fig.` doesn't end one."""
    whole = F.regexp_replace(text, r"(?i)\b(figs?)\.", "$1")
    parts = F.split(whole, r"(?<=[.!?])\s+")
    return F.transform(F.slice(F.filter(parts, lambda s: F.regexp_like(s, F.concat(F.lit(r"(?i)\bfig(?:ure|s)?\s*"), number.cast("string"), F.lit(r"\b")))), 1, most), lambda s: F.substring(s, 1, length))


def abstains(answer: Column) -> Column:
    return F.lower(answer).rlike(r"(?:not|n't|no) (?:enough |sufficient )?(?:information|evidence|mention|contain|answer|know)|cannot (?:answer|determine)|unanswerable")


def sensitive(value: Column) -> Column:
    """Values that memory must not keep."""
    return value.rlike(r"(?i)password|passcode|api[ _-]?key|secret|token\b|private key") | value.rlike(r"[0-9](?:[ -]?[0-9]){12,}")


@F.pandas_udf(T.StringType())
def stable_id(name: pd.Series) -> pd.Series:
    """UUID version 5 of a canonical name."""
    return name.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)))


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


#: Characters whose places are held at once, four bytes each; a longer text goes by itself.
POSITIONS = 1 << 20


def _squeezed(text: str | None) -> tuple[str, np.ndarray]:
    t = text or ""
    kept = np.ones(len(t), bool)
    for space in re.finditer(r"\s+", t):
        outer = space.start() == 0 or space.end() == len(t)
        kept[space.start() + (not outer) : space.end()] = False
    return " ".join(t.split()), np.flatnonzero(kept).astype("int32")


@F.pandas_udf(T.StructType([T.StructField("flat", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))
def squeeze_with_positions(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A text with single spaces, and the place in the original of each of its characters; rows are handed on before their places take much memory."""
    for batch in texts:
        held: list[tuple[str, np.ndarray]] = []
        size = 0
        for text in batch:
            held.append(_squeezed(text))
            size += len(held[-1][1])
            if size >= POSITIONS:
                yield pd.DataFrame(held, columns=["flat", "positions"])
                held, size = [], 0
        if held or not len(batch):
            yield pd.DataFrame(held, columns=["flat", "positions"])
