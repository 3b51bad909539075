"""Filter interaction audit: what each filter removes at each place of every order, from a packed bitmap index.

Each task packs the rows at hand into NumPy bitsets, one for each filter and label. Rows are laid out by part, and each part
begins at a whole byte, so that a part's bitset is a range of bytes. For each subset of filters that may come first, AND-NOT
with the subset's union and a population count give the rows that a filter still removes; the counts of all partitions add up,
and every order of filters only looks its prefix subsets up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
#: Orders are the factorial of the number of filters; the report has a row for each order, step and part.
MOST_FILTERS = 7
#: Parts whose counts a task holds before it hands them on.
PARTS_HELD = 1024
_SPACE = " \t\n\x0b\x0c\r"


def subset_counts(flags: list[np.ndarray], rows: np.ndarray, good: np.ndarray, toxic: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts (part, subset, filter, measure) from bitsets; a part is the bytes from its start to the next one's."""
    n = len(flags)
    count = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts)
    union = [np.zeros_like(rows)]
    for subset in range(1, 1 << n):
        low = subset & -subset
        union.append(union[subset ^ low] | flags[low.bit_length() - 1])
    fails = [count(f) for f in flags]
    out = np.zeros((len(starts), 1 << n, n, len(MEASURES)), np.int64)
    for subset in range(1 << n):
        size = subset.bit_count()
        for f in range(n):
            if subset >> f & 1:
                continue
            here = flags[f] & ~union[subset]
            removed, one = count(here), out[:, subset, f]
            one[:, 0] = count(rows & ~union[subset | 1 << f])
            one[:, 1] = removed
            one[:, 2] = fails[f] - removed
            one[:, 4] = count(here & good)
            one[:, 5] = count(here & toxic)
            # as many orders begin with this subset and then this filter
            out[:, :, f, 6] += (removed * (factorial(size) * factorial(n - 1 - size)))[:, None]
    for f in range(n):
        out[:, :, f, 3] = out[:, ((1 << n) - 1) ^ (1 << f), f, 1][:, None]
    return out


def _packed(codes: np.ndarray, n_parts: int, masks: np.ndarray, n_bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bitsets of the masks' bits, the bitset of rows, and each part's first byte."""
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=n_parts)
    width = (sizes + 7) // 8
    starts = np.cumsum(width) - width
    first = np.cumsum(sizes) - sizes
    sorted_codes = codes[order]
    place = starts[sorted_codes] * 8 + (np.arange(len(codes)) - first[sorted_codes])
    laid = np.zeros(int(width.sum()) * 8, masks.dtype)
    laid[place] = masks[order] | (1 << n_bits)
    sets = [np.packbits((laid >> b) & 1 == 1) for b in range(n_bits + 1)]
    return sets[:-1], sets[-1], starts


def _counter(n: int):
    used = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    pick = np.array(used).T

    def emit(held: dict) -> pa.RecordBatch:
        parts, values = list(held), np.stack(list(held.values()))
        cell = values[:, pick[0], pick[1]].reshape(-1, len(MEASURES))
        cols = [pa.array(np.repeat(np.array(parts, object), len(used)), pa.string()), pa.array(np.tile(pick[0], len(parts)).astype(np.int32)), pa.array(np.tile(pick[1], len(parts)).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols + [pa.array(cell[:, i]) for i in range(len(MEASURES))], ["part", "subset", "filter", *MEASURES])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            names = coded.dictionary.to_pylist()
            sets, rows, starts = _packed(coded.indices.to_numpy(), len(names), batch.column(1).to_numpy(), n + 2)
            for name, counts in zip(names, subset_counts(sets[:n], rows, sets[n], sets[n + 1], starts), strict=True):
                held[name] = held[name] + counts if name in held else counts
            if len(held) > PARTS_HELD:
                yield emit(held)
                held = {}
        if held:
            yield emit(held)

    return count


def audit(rows: DataFrame, filters: list[str], part: str, good: str, toxic: str) -> DataFrame:
    """A row for each part, order of filters and step: (part, filter_order, step, and the counts in MEASURES).

    `filters`, `good` and `toxic` name boolean columns; null is false. A null part is the empty string. Rows that are repeated
    count each. kept: rows left after the step; removed: rows that the step's filter takes here; redundant: rows that fail it but were
    taken before; unique_fails: rows that fail it alone; good_lost, toxic_lost: removed rows with that label; shapley: rows that the
    filter removes, summed over all orders. Parts without failures have all their rows with zeros; an empty table gives none.
    Other columns are not read, so their names don't matter.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be put into all orders")
    n = len(filters)
    spark = rows.sparkSession
    bit = lambda c, i: F.when(F.col(c), F.lit(1 << i)).otherwise(F.lit(0))
    mask = sum((bit(c, i) for i, c in enumerate([*filters, good, toxic])), F.lit(0)).cast("int")
    schema = "part string, subset int, filter int, " + ", ".join(f"{m} long" for m in MEASURES)
    counted = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask")).mapInArrow(_counter(n), schema)
    total = counted.groupBy("part", "subset", "filter").agg(*[F.sum(m).alias(m) for m in MEASURES])
    orders = [("".join(filters[f] for f in order), step + 1, sum(1 << f for f in order[:step]), order[step]) for order in permutations(range(n)) for step in range(n)]
    places = spark.createDataFrame(orders, "filter_order string, step int, subset int, filter int")
    # factorial(n) * n rows, whatever the input
    return total.join(F.broadcast(places), ["subset", "filter"]).select("part", "filter_order", "step", *MEASURES)


def text_flags(text: Column) -> dict[str, Column]:
    """Failure conditions that a text has by itself: A short, B repetitive, C capitals, D symbols. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(_SPACE))
    words = F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 50, "B": distinct * F.lit(100).cast("long") < n * F.lit(65).cast("long"), "C": capitals * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"), "D": text.rlike("[#$%&*|]")}


def document_flags(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic), a row for each document.

    E: the text (null: empty) is that of a row with a smaller key. A null key is larger than all others and smaller than none. Texts
    are equal if their SHA-256 are. Repeated rows have no smaller key among themselves. A label row counts if its value is 1; a key with several
    label rows has a label if one of them has it; documents without label rows, or without a key, have none.
    """
    own = F.coalesce(text, F.lit(""))
    marks = docs.select(F.col(key).alias("k"), F.col(part).alias("part"), F.unhex(F.sha2(own, 256)).alias("digest"), *[c.alias(f) for f, c in text_flags(F.col(text)).items()])
    marks = store(marks, "flags")  # texts are read once; what follows has some 50 bytes a document
    # one row for each text that is there more than once; documents of one hot text meet it in a join whose sides can be split
    firsts = store(marks.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"), "firsts")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = marks.join(known, "k", "left").join(firsts, "digest", "left")
    later = F.col("first").isNotNull() & (F.col("k").isNull() | (F.col("k") > F.col("first")))
    return joined.select("part", "A", "B", "C", "D", later.alias("E"), "good", "toxic")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(document_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), list("ABCDE"), "part", "good", "toxic")


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), m AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * list_unique(words) < 65 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN first < doc_id THEN 16 ELSE 0 END) AS fails
  FROM w
), g AS (
  SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n FROM m LEFT JOIN labels USING (doc_id) GROUP BY ALL
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)
), o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), s AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(step)
), c AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM c
"""
