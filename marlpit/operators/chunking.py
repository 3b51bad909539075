"""Structural chunking: sections, parents, children with overlap, pipe tables and captions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHILD_TOKENS, OVERLAP_TOKENS, PARENT_TOKENS = 384, 48, 1536
_token = re.compile(r"\s*(?:\w+|[^\w\s])")
_heading = re.compile(r"(?:[IVX]+\.|\d+(?:\.\d+)*\.?)\s+[^\W\d_][^\n]{2,}")
_sentence_end = re.compile(r"(?<=[.!?。！？])\s+(?=[A-ZÀ-Ỹ0-9])")
_after_sentence = re.compile(r"(?<=[.!?。！？])\s+")


def tokens(text: str) -> list[str]:
    return _token.findall(text)


@lru_cache(maxsize=4096)
def n_tokens(text: str) -> int:
    """How many tokens a block has; blocks are asked for theirs when they are cut, packed and put out."""
    return len(tokens(text))


def section_title(block: str) -> str | None:
    """The title that a block's first line is, if it is one."""
    line = block.strip().split("\n", 1)[0].strip()
    if line.startswith("#"):
        return line.lstrip("#").strip()[:160] or None
    short = len(line) <= 140 and not line.endswith(".")
    capitals = line.isupper() and 4 <= len(line) <= 80
    return line[:160] if short and line and (_heading.fullmatch(line) or capitals) else None


def blocks(text: str) -> list[str]:
    """Blocks between blank lines; lines where there is only one."""
    found = [b.strip() for b in re.split(r"\n\s*\n+", text) if b.strip()]
    return found if len(found) > 1 else [x.strip() for x in text.split("\n") if x.strip()]


def _runs(pieces: list[str], most: int) -> Iterator[str]:
    """Joins pieces to texts of at most `most` tokens; a larger piece is cut."""
    held: list[str] = []
    size = 0
    for piece in pieces:
        own = tokens(piece)
        if held and size + len(own) > most:
            yield " ".join(held)
            held, size = [], 0
        if len(own) > most:
            yield from ("".join(own[i : i + most]).strip() for i in range(0, len(own), most))
        else:
            held.append(piece)
            size += len(own)
    if held:
        yield " ".join(held)


def units(text: str, most: int) -> list[tuple[str, str | None]]:
    """(text, section) of blocks; a section carries on until the next title. Blocks beyond `most` tokens are cut at sentences."""
    out, section = [], None
    for block in blocks(text):
        section = section_title(block) or section
        if n_tokens(block) <= most:
            out.append((block, section))
        else:
            out += [(x, section) for x in _runs([s.strip() for s in _sentence_end.split(" ".join(block.split())) if s.strip()], most)]
    return out


@dataclass
class Parent:
    units: list[tuple[str, str | None]]
    section: str | None


def parents(found: list[tuple[str, str | None]], most: int) -> list[Parent]:
    """Packs units; a parent ends where the section changes or the next unit would overflow it."""
    plain = lambda s: " ".join(s.lower().replace("#", " ").split()) if s else None
    out: list[Parent] = []
    size = 0
    for text, section in found:
        n = n_tokens(text)
        now = out[-1] if out else None
        if now is None or size + n > most or (section and now.section and plain(section) != plain(now.section)):
            out.append(now := Parent([], None))
            size = 0
        now.units.append((text, section))
        now.section = section or now.section
        size += n
    return out


def tail(text: str, n: int) -> str:
    """The last n tokens, from the first sentence that begins in them unless too little would be left."""
    own = tokens(text)
    end = "".join(own[-n:]).strip() if n > 0 else ""
    if len(own) > n and (m := _after_sentence.search(end)) and m.end() < len(end) - 20:
        end = end[m.end() :].strip()
    return end


def children(parent: Parent, most: int, overlap: int) -> list[str]:
    """Packs a parent's units; each child after the first begins with the tail of the one before, if that fits."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for text, _ in parent.units:
        n = n_tokens(text)
        if held and size + n > most:
            out.append("\n\n".join(held))
            before = tail(out[-1], overlap)
            m = len(tokens(before))
            held, size = ([before], m) if before and m + n <= most else ([], 0)
        held.append(text)
        size += n
    return [*out, "\n\n".join(held)] if held else out


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS, parent_most: int = PARENT_TOKENS) -> DataFrame:
    """(key, chunk_index, parent_index, section, content, n_tokens, parent_content) of each document; a null text has none."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "chunk_index", "parent_index", "section", "content", "n_tokens", "parent_content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (got.slice(i, 64) for got in batches for i in range(0, got.num_rows, 64)):  # each child brings its parent's text
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for p, parent in enumerate(parents(units(t or "", most), parent_most)):
                    whole = "\n\n".join(u for u, _ in parent.units)
                    for child in children(parent, most, overlap):
                        rows.append((k, at, p, parent.section, child, n_tokens(child), whole))
                        at += 1
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, chunk_index int, parent_index int, section string, content string, n_tokens int, parent_content string")
    return out.withColumnRenamed("key", key)


#: A pipe row, a separator row, and pipe rows after it; repeats take all they can (++, *+), for else each row of a long table is a call on Java's stack.
_table = r"(?m)^([^\n]*\|[^\n]*)\n[^\S\n]*\|?[^\S\n]*:?-{3,}:?[^\S\n]*(?:\|[^\S\n]*:?-{3,}:?[^\S\n]*)++\|?[^\S\n]*((?:\n[^\n]*\|[^\n]*)*+)"
TABLE_CAPTION, FIGURE_CAPTION = r"(?i)^(table|bảng)\s*\d+\s*[.:–-]", r"(?i)^(fig\.?|figure|hình)\s*\d+\s*[.:–-]"


def pipe_tables(text: Column) -> Column:
    """Markdown pipe tables as an array of whole matches."""
    return F.regexp_extract_all(text, F.lit(_table), F.lit(0))


def cells(row: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+$", ""), r"\|"), F.trim), lambda c: c != "")


def tables_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, table_index, markdown, n_rows, n_columns, caption): the caption is the nearest of the three lines above."""
    found = docs.select(key, text, F.posexplode(pipe_tables(F.col(text))).alias("table_index", "markdown"))
    lines = F.split("markdown", "\n")
    above = F.split(F.expr(f"substring_index(`{text}`, markdown, 1)"), "\n")
    near = F.filter(F.transform(F.slice(F.reverse(above), 2, 3), F.trim), lambda x: x.rlike(TABLE_CAPTION))
    rows = F.filter(F.slice(lines, F.lit(3), F.size(lines)), lambda r: F.size(cells(r)) > 0)
    return found.select(key, "table_index", "markdown", F.size(rows).alias("n_rows"), F.size(cells(F.element_at(lines, 1))).alias("n_columns"), F.try_element_at(near, F.lit(1)).alias("caption"))


def captions(docs: DataFrame, kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, caption_index, caption) of figures or tables with the lines that continue them, at most 500 characters.

    Gaps and islands over the lines: a caption line opens an island; a blank line, a caption of the other kind and, for tables, a pipe row end it.
    """
    from pyspark.sql import Window as W

    own, other = (TABLE_CAPTION, FIGURE_CAPTION) if kind == "table" else (FIGURE_CAPTION, TABLE_CAPTION)
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    opens = F.col("line").rlike(own)
    ends = (F.col("line") == "") | F.col("line").rlike(other) | (F.col("line").contains("|") if kind == "table" else F.lit(False))
    mark = F.when(opens, 1).when(ends, 0)
    w = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    islands = lines.withColumns({"state": F.last(mark, ignorenulls=True).over(w), "island": F.sum(F.when(opens, 1).otherwise(0)).over(w)})
    parts = islands.where("state = 1 AND line <> ''").groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("parts"))
    joined = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["line"]), " "), r"- (?=\p{Ll})", "")
    return parts.select(key, (F.col("island") - 1).alias("caption_index"), F.substring(joined, 1, 500).alias("caption"))


def heading_path(lines: DataFrame, key: str, order: str, line: str, deepest: int = 6) -> DataFrame:
    """The open markdown headings above each line, one column of the window for each level."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
    out = lines.withColumn("_l", F.when(level > 0, level))
    names = []
    for n in range(1, deepest + 1):
        # the last heading of this level, unless one of a higher level came after it
        here = F.last(F.when(F.col("_l") == n, F.struct(F.col(order), F.trim(F.regexp_replace(line, r"^#+", "")).alias("t"))), ignorenulls=True).over(w)
        above = F.last(F.when(F.col("_l") < n, F.col(order)), ignorenulls=True).over(w)
        out = out.withColumn(f"_h{n}", F.when(above.isNull() | (here[order] > above), here["t"]))
        names.append(f"_h{n}")
    return out.withColumn("heading_path", F.array_compact(F.array(*names))).drop("_l", *names)


def overlap(left: str, right: str, least: int = 20, most: int = 600) -> int:
    """Length of the longest suffix of one text that the other begins with, of `least` to `most` characters; else 0."""
    n = min(most, len(left), len(right))
    if n < least or least < 1:
        return next((i for i in range(n, least - 1, -1) if left.endswith(right[:i])), 0)
    # such a suffix begins with the first `least` characters: their places are tried, from the longest suffix on
    at = left.find(right[:least], len(left) - n)
    while at >= 0:
        if right.startswith(left[at:]):
            return len(left) - at
        at = left.find(right[:least], at + 1)
    return 0


def merge_overlap(left: str, right: str, least: int = 20, most: int = 600) -> str:
    """Joins two texts without repeating an overlap; without one, by a blank line."""
    return merge_all([left, right], least, most)


def merge_all(parts: Iterable[str], least: int = 20, most: int = 600) -> str:
    """Joins texts in order by their overlaps. Only the end of what is joined is looked at, so the work grows with the texts' length."""
    out, tail = [], ""
    for part in parts:
        if not part:
            continue
        n = overlap(tail, part, least, most)
        new = part[n:] if n or not out else "\n\n" + part
        out.append(new)
        tail = (tail + new)[-most:]
    return "".join(out)


def rebuild(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", content: str = "content") -> DataFrame:
    """A document's text from its stored chunks, overlaps merged. Chunks are gathered in order by Spark, and documents merged batch by batch."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (got.slice(i, 64) for got in batches for i in range(0, got.num_rows, 64)):
            texts = [merge_all(parts) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    parts = F.array_sort(F.collect_list(F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.col(content).alias("part"))))
    gathered = chunks.groupBy(F.col(key).alias("key")).agg(F.transform(parts, lambda p: p["part"]).alias("parts"))
    return gathered.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def canonical_text(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each parent's text once, at its first chunk; chunks without a parent give their own."""
    first = chunks.groupBy(key, F.coalesce(F.col("parent_index"), -1 - F.col("chunk_index")).alias("p")).agg(F.min(F.struct("chunk_index", F.coalesce("parent_content", "content").alias("t"))).alias("x"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("text"))
