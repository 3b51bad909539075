"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is `span` consecutive words of a benchmark item. The fingerprint of a window is the least of the hashes of its k-grams, and a text
keeps one fingerprint for each run of windows that share it: at most one for each window, about two for `span - k + 2` words. A text that holds
a window holds its fingerprint, so every shared span of `span` words or more is found:

1. the items' fingerprints set bits in a map of fixed size, which every task holds: runs whose bit is unset are dropped where they are;
2. windows of the runs that are left are joined to the items' windows on the fingerprint and words for words, whether few or many are left;
3. windows that occur become spans of words, and the sets of items that hold them become item lists.

Texts are never shuffled. The map has MAP_BITS bits, so its size doesn't grow; with W windows in the benchmark, about W / MAP_BITS of the
other runs stay until the join.

An item of fewer than `span` words is one window; such windows are found by the same steps with their own length, with as many k-grams as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store, table

SPAN, GRAM = 10, 5
#: 1 MB, as 64-bit words.
MAP_BITS = 1 << 23
#: What stands between words: ASCII but for digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in its own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _hashes(word_list: str) -> Column:
    return F.transform(word_list, lambda w: F.xxhash64(lowered(w)))


def _up_to(last: Column) -> Column:
    """0 to last, nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: str, k: int) -> Column:
    return F.transform(_up_to(F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)]))


def _least(grams: str, n: int) -> Column:
    """The least of n neighbouring hashes, from each place."""
    if n == 1:
        return F.col(grams)
    return F.transform(_up_to(F.size(grams) - n), lambda i: F.least(*[F.get(F.col(grams), i + j) for j in range(n)]))


def _fingerprints(rows: DataFrame, sizes: list[int], gram: int) -> DataFrame:
    """Adds `_least<size>`, the fingerprint of each window, for each size; rows have their words' hashes in `_h`."""
    for k in sorted({min(gram, size) for size in sizes}):
        rows = rows.withColumn(f"_gram{k}", _grams("_h", k))
    for size in sizes:
        k = min(gram, size)
        rows = rows.withColumn(f"_least{size}", _least(f"_gram{k}", size - k + 1))
    return rows


def _slot(mark: Column) -> Column:
    """The map's word for a fingerprint; its bit there is the fingerprint's last six bits."""
    return F.shiftrightunsigned(mark, 64 - (MAP_BITS // 64 - 1).bit_length()).cast("int")


def _map(marks: DataFrame) -> Column:
    """The bits of all fingerprints as a constant array: MAP_BITS // 64 numbers, whatever the benchmark."""
    words_ = marks.groupBy(_slot(F.col("mark")).cast("long").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(mark & 63 AS int))")).alias("bits"))
    full = marks.sparkSession.range(MAP_BITS // 64).join(words_, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("x"))
    text = full.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"].cast("string")), ",")).first()[0]
    return F.split(F.lit(text), ",").cast("array<bigint>")


def _starts(size: int) -> Column:
    """The windows whose fingerprint is not that of the window before."""
    least = F.col(f"_least{size}")
    return F.filter(_up_to(F.size(least) - 1), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))


def _runs(size: int, known: Column) -> Column:
    """(size, fingerprint, first window, number of windows) of each run of windows with one fingerprint that the map knows."""
    least, starts = F.col(f"_least{size}"), F.col(f"_starts{size}")
    end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(least))
    runs = F.transform(starts, lambda i, j: F.struct(F.lit(size).alias("size"), F.get(least, i).alias("mark"), i.alias("start"), (end(j) - i).alias("n")))
    return F.filter(runs, lambda r: F.getbit(F.get(known, _slot(r["mark"])), r["mark"].bitwiseAND(63).cast("int")) == 1)


def _cut_out(run: Column) -> Column:
    """(size, mark, start, window) of a run's windows, in lower case."""
    window = lambda i: F.array_join(F.transform(F.slice("_w", i + 1, run["size"]), lowered), " ")
    return F.transform(F.sequence(run["start"], run["start"] + run["n"] - 1), lambda i: F.struct(run["size"].alias("size"), run["mark"].alias("mark"), i.alias("start"), window(i).alias("window")))


def _item_windows(items: DataFrame, span: int, gram: int) -> tuple[DataFrame, list[int]]:
    """(item, size, mark, window) of all items, and the sizes that occur: at most `span` of them."""
    items = items.withColumn("_size", F.least(F.size("_w"), F.lit(span))).where("_size > 0")
    sizes = sorted(r[0] for r in items.select("_size").distinct().collect())
    if not sizes:
        return items.select("item", F.col("_size").alias("size"), F.lit(0).cast("long").alias("mark"), F.lit("").alias("window")), sizes
    items = items.withColumn("_w", F.transform("_w", lowered)).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    marked = _fingerprints(items, sizes, gram)

    def windows(size: int) -> Column:
        return F.transform(f"_least{size}", lambda m, i: F.struct(F.lit(size).alias("size"), m.alias("mark"), F.array_join(F.slice("_w", i + 1, size), " ").alias("window")))

    cut = F.coalesce(*[F.when(F.col("_size") == size, windows(size)) for size in sizes])
    return marked.select("item", F.explode(cut).alias("x")).select("item", "x.*").distinct(), sizes


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, n_words, spans, items), a row for each row of docs.

    spans: disjoint (start, end) in words, end exclusive, of all that occurs of any item's windows; items: the items, as strings in their
    order, whose windows occur. Null texts have no words. Documents that are repeated, and null keys, keep their rows. Items
    that are repeated, or share their key, are one; windows of an item without a key are found, but the item is not listed. Documents or items
    without words hit nothing; empty tables give no rows, or documents without spans. Other columns are not read.
    """
    docs = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("_w"))
    found, sizes = _item_windows(items, span, gram)
    found = store(found, "item_windows")
    # windows that the same items hold share a set, so that a passage of many windows meets its items once
    sets = found.groupBy("size", "mark", "window").agg(F.concat_ws("-", F.count("item"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64("item", F.lit(span)))).alias("set"))
    sets = store(sets, "windows")
    members = store(found.where("item IS NOT NULL").join(sets, ["size", "mark", "window"]).select("set", "item").distinct(), "members")

    same = F.col("k").eqNullSafe(F.col("k2")) & F.col("t").eqNullSafe(F.col("t2"))
    cut = docs.withColumn("_w", words(F.col("text"))).withColumn("_h", _hashes("_w")).select("k", "t", "_w", "_h")
    cut = _fingerprints(cut, sizes, gram)
    for size in sizes:
        cut = cut.withColumn(f"_starts{size}", _starts(size))
    marked = _map(sets)
    runs = F.concat(*[_runs(size, marked) for size in sizes]) if sizes else F.lit(None).cast("array<struct<size:int,mark:bigint,start:int,n:int>>")
    tried = cut.select("k", "t", F.explode(F.flatten(F.transform(runs, _cut_out))).alias("x")).select("k", "t", "x.*")
    hits = store(tried.join(sets, ["size", "mark", "window"]).select("k", "t", "start", (F.col("start") + F.col("size")).alias("end"), "set").distinct(), "hits")

    before = W.partitionBy("k", "t").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    fresh = (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")
    islands = hits.select("k", "t", "start", "end").distinct().withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(W.partitionBy("k", "t").orderBy("start", "end")))
    spans = islands.groupBy("k", "t", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    listed = hits.select("k", "t", "set").distinct().join(members, "set").groupBy("k", "t").agg(F.sort_array(F.collect_set("item")).alias("items"))
    known = spans.join(listed.withColumnsRenamed({"k": "k2", "t": "t2"}), same, "left").drop("k2", "t2").withColumnsRenamed({"k": "k2", "t": "t2"})
    out = docs.select("k", "t", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(store(known, "spans"), same, "left")
    none = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    return out.select(F.col("k").alias(key), "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, range(1, 1 + (SELECT max(len(w)) FROM b)) r(i) WHERE len(w) > 0 AND i <= len(w) - least(len(w), 10) + 1
), sizes AS (
  SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (size, win)
), n AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
