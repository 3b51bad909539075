"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_letters = {"a": "àáảãạăằắẳẵặâầấẩẫậäåā", "c": "çćč", "d": "đ", "e": "èéẻẽẹêềếểễệëē", "i": "ìíỉĩịïîī", "n": "ñń", "o": "òóỏõọôồốổỗộơờớởỡợöōø", "u": "ùúủũụưừứửữựüûū", "y": "ỳýỷỹỵÿ", "s": "š", "z": "ž"}
ACCENTED, PLAIN = "".join(_letters.values()), "".join(k * len(v) for k, v in _letters.items())
#: Letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"


def squeeze(text: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_tokens(text: Column, most: int | None = 12, stopwords: list[str] = fixed.SEARCH_STOPWORDS) -> Column:
    """Distinct lower-cased words in order of first use, stripped of `._-`, of two characters or more, without stopwords; at most `most`."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, r"^[._-]+|[._-]+$", ""))
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stopwords)))
    kept = F.coalesce(kept, F.array().cast("array<string>"))
    return kept if most is None else F.slice(kept, 1, most)


def last_terms(text: Column, most: int = 64) -> Column:
    """The last `most` distinct search tokens, for queries that carry a history."""
    words = search_tokens(text, None)
    return F.when(F.size(words) > most, F.slice(words, -most, most)).otherwise(words)


def or_query(tokens: Column) -> Column:
    """Quoted tokens joined by OR; quotes inside are doubled."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def lexical_tokens(text: Column) -> Column:
    """Words and punctuation marks with the white space before them, so that joining them gives the text (but for white space at its end)."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(0)), F.array().cast("array<string>"))


def count_tokens(text: Column) -> Column:
    return F.size(lexical_tokens(text))


def blocks(text: Column) -> Column:
    """Blocks between blank lines; a text with one block only is split by line."""
    split = lambda pattern: F.filter(F.transform(F.split(text, pattern), F.trim), lambda b: b != "")
    by_blank = split(r"\n\s*\n+")
    return F.when(F.size(by_blank) > 1, by_blank).otherwise(split(r"\n"))


def is_heading(line: Column) -> Column:
    """Markdown, numbered, roman-numbered or capital headings of 4 to 80 characters."""
    one_line = ~line.contains("\n") & (F.length(line) <= 120)
    numbered = line.rlike(r"^(?:\d+(?:\.\d+)*|[IVXLC]+)[.)]?\s+\p{Lu}") & ~line.rlike(r"[.!?]$")
    capitals = (F.upper(line) == line) & line.rlike(r"\p{Lu}") & F.length(line).between(4, 80)
    return F.coalesce(line.rlike(r"^#{1,6}\s+\S") | (one_line & (numbered | capitals)), F.lit(False))


def sentences(text: Column) -> Column:
    """Split after terminal punctuation before a capital or digit."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}])"), lambda s: s != "")


def title_guess(text: Column, stem: Column) -> Column:
    """The first `. `-segment of 8 to 160 characters and at most 18 words, else the stem with spaces."""
    parts = F.transform(F.split(squeeze(text), r"\. "), lambda p: F.trim(F.regexp_replace(F.trim(p), "^#+", "")))
    fits = F.filter(parts, lambda p: F.length(p).between(8, 160) & (F.size(F.split(p, " +")) <= 18))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.trim(F.replace(stem, F.lit("_"), F.lit(" "))))


def summary(text: Column, most: int = 700, least: int = 180) -> Column:
    """At most `most` characters, cut at the last `. ` if that is at `least` or later."""

    def cut(flat: Column) -> Column:
        head = F.substring(flat, 1, most)
        stop = F.length(head) - F.instr(F.reverse(head), " .") - 1
        at = F.when((F.instr(F.reverse(head), " .") > 0) & (stop >= least), stop).otherwise(most)
        return F.when(F.length(flat) <= most, flat).otherwise(F.trim(F.substring(head, F.lit(1), at)))

    return F.element_at(F.transform(F.array(squeeze(text)), cut), 1)


def card_language(text: Column) -> Column:
    return F.when(squeeze(text).rlike(f"[{fixed.VIETNAMESE_MARKERS}]"), "vi").otherwise("en")


def topic_tags(haystack: Column, most: int = 12) -> Column:
    """Tags in rule order, of those with a pattern that occurs in the lower-cased haystack."""
    tags = lambda low: F.slice(F.array_compact(F.array(*[F.when(low.rlike("|".join(patterns)), tag) for tag, patterns in fixed.TOPIC_RULES.items()])), 1, most)
    return F.element_at(F.transform(F.array(F.lower(haystack)), tags), 1)  # bound, so that the text is lowered once


def project_tags(haystack: Column) -> Column:
    """Substring rules; `ser` also counts inside words."""

    def tags(low: Column) -> Column:
        has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        return F.array_compact(F.array(F.when(has("project_plan", "local ai agent", "lancedb"), "local_ai_agent"), F.when(has("speech emotion", "multimodal", "ser"), "ser_research")))

    return F.element_at(F.transform(F.array(F.lower(haystack)), tags), 1)  # bound, so that the text is lowered once


def haystack(filename: Column, text: Column) -> Column:
    """The file name and the squeezed text as one, as they are and lower-cased; bound once for the rules that read them."""
    return F.element_at(F.transform(F.array(F.concat_ws(" ", filename, squeeze(text))), lambda h: F.struct(h.alias("cased"), F.lower(h).alias("low"))), 1)


def doc_type(filename: Column, text: Column, tags: Column) -> Column:
    return doc_type_of(filename, haystack(filename, text)["low"], tags)


def doc_type_of(filename: Column, low: Column, tags: Column) -> Column:
    paper = low.contains("abstract") & (low.contains("references") | low.contains("introduction"))
    technical = low.contains("lancedb") | F.array_contains(tags, "rag") | F.array_contains(tags, "agent")
    return F.when(low.contains("project_plan"), "project_plan").when(technical, "technical_plan").when(paper, "research_paper").when(F.lower(filename).endswith(".md"), "markdown_note").otherwise("document")


def overlap_ratio(query: Column, other: Column) -> Column:
    """Share of the query's tokens that the other has; 0 for none."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, other)) / F.size(query)).otherwise(0.0)


def fold_accents(text: Column) -> Column:
    """Lower case without the accents of Latin letters, and đ as d."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def clip(text: Column, most: int) -> Column:
    """At most `most` characters and `...`, cut at the last `. ` or space of the second half."""
    head = F.substring(text, 1, most)
    stop = F.length(head) - F.instr(F.reverse(head), " .")
    space = F.length(head) - F.instr(F.reverse(head), " ")
    has = lambda needle: F.instr(F.reverse(head), needle) > 0
    at = F.when(has(" .") & (stop >= most // 2), stop).when(has(" ") & (space >= most // 2), space).otherwise(most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(head, F.lit(1), at)), F.lit("...")))


def head_tail(text: Column, most: int, mark: str = fixed.CLIP_MARK) -> Column:
    """Two parts of the head and one of the tail around a mark, `most` characters in all."""
    room = max(0, most - len(mark))
    head, tail = room * 2 // 3, room - room * 2 // 3
    end = F.right(text, F.lit(tail)) if tail else F.lit("")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), end))


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct runs of `width` lower-cased words; shorter texts give none."""
    none = F.array().cast("array<string>")

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
        return F.when(F.size(w) >= width, F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + (k - 1)) for k in range(width)])))).otherwise(none)  # slice would copy all words each time

    # the words are bound to a variable: inside the inner function they would be found again for each shingle
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.coalesce(F.element_at(F.transform(F.array(words), cut), 1), none)


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """Distinct 64-bit hashes of the runs of `width` lower-cased words; each word is hashed once. Shorter and null texts give none."""
    none = F.array().cast("array<bigint>")

    def cut(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(1)))
        return F.when(F.size(h) >= width, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(width)])))).otherwise(none)

    hashes = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return F.coalesce(F.element_at(F.transform(F.array(hashes), cut), 1), none)


def first_words(text: Column, most: int) -> Column:
    """The first words of a text, joined by spaces."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, most), " ")


def first_line_title(text: Column, most: int = 60) -> Column:
    """A conversation's title: the start of its compact text."""
    return F.trim(F.substring(squeeze(text), 1, most))


def context_prefix(filename: Column, title: Column, page: Column, section: Column, summary_: Column) -> Column:
    """Labelled lines that precede a chunk for embedding; absent parts are skipped."""
    line = lambda name, value: F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f"{name}: "), value.cast("string")))
    return F.concat_ws("\n", line("File", filename), line("Title", F.substring(title, 1, 200)), line("Page", page), line("Section", section), line("Summary", F.substring(summary_, 1, 280)))
