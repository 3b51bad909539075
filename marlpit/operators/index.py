"""A lexical index that searches read and batches of documents change: postings in plain partitioned tables, a generation for each batch.

    versions/batch=n                   a row for each document that batch n brought, changed or removed; written last
    blocks/bucket=b/batch=n            for each term and block of some 128 documents: how many, the most uses, the least length
    postings/bucket=b/batch=n          (term, block, key, tf, dl); the first of a term and block also has what the block's row says of them

A document's newest version counts, older ones and removed documents are passed over, so a batch only adds partitions and a batch that is
written again replaces its own. Buckets are the first hex digits of a term's MD5: a search reads those of its terms. What the blocks
hold bounds the score of every document in them, and blocks that can't reach the k-th best score known so far are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from .lexical import PAIRS, SENT_TERMS, words_of

#: Documents a block.
BLOCK = 128
#: Blocks of a query whose documents are scored first, to know how good the k-th best is at least.
FIRST_BLOCKS = 4
#: Characters of changed texts that a task of append() tokenizes, about, and of a block at most, about.
TASK_CHARS = 4_000_000
#: Postings that append() hands on at once.
HANDED = 1 << 16
#: Pairs of a query and a block that are sent to all tasks at most; with more, blocks are passed over only if no query needs them.
SENT_BLOCKS = 1_000_000
TABLES = ("versions", "blocks", "postings")


def bucket_of(term: str = "term", digits: int = 1) -> Column:
    return F.substring(F.md5(F.col(term)), 1, digits)


def read(spark: SparkSession, path: str, name: str, key_type: str = "long") -> DataFrame:
    """One of an index's tables; empty if the index has no batch yet."""
    schema = {
        "versions": f"key {key_type}, digest string, dl double, removed boolean, batch long",
        "blocks": "term string, block long, n long, max_tf double, min_dl double, bucket string, batch long",
        "postings": f"term string, block long, key {key_type}, tf double, dl double, bucket string, batch long",
        "noted": "term string, block long, n long, max_tf double, min_dl double, bucket string, batch long",
    }[name]
    try:
        return spark.read.schema(schema).parquet(f"{path}/{'postings' if name == 'noted' else name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def current(versions: DataFrame) -> DataFrame:
    """(key, batch, digest, dl, removed): the newest version of each key."""
    newest = versions.groupBy("key").agg(F.max(F.struct("batch", "digest", "dl", "removed")).alias("v"))
    return newest.select("key", "v.*")


def _counted(docs: pa.Table, weights: list[float], digits: int) -> pa.Table:
    """Postings of whole blocks: each document's words counted; a bucket is made once for each word, and a block's row stands with its first posting."""
    cut = [docs.column(2 + i).combine_chunks() for i in range(len(weights))]
    dl = sum((np.diff(c.offsets.to_numpy()) * w for c, w in zip(cut, weights, strict=True)), np.zeros(len(docs)))
    of = np.concatenate([np.repeat(np.arange(len(docs)), np.diff(c.offsets.to_numpy())) for c in cut])
    terms = pa.concat_arrays([c.flatten() for c in cut]).dictionary_encode()
    words, uses = max(len(terms.dictionary), 1), np.repeat(weights, [len(c.flatten()) for c in cut])
    pairs, at = np.unique(of * words + terms.indices.to_numpy(), return_inverse=True)
    doc, term, tf = pairs // words, pairs % words, np.bincount(at, uses, len(pairs))
    block = docs.column(0).to_numpy()
    group = np.unique(block, return_inverse=True)[1][doc] * words + term
    order = np.argsort(group)
    new = np.flatnonzero(np.diff(group[order], prepend=-1))  # where another block or term begins
    first, noted = np.zeros(len(pairs), bool), np.zeros((3, len(pairs)))
    if len(new):
        first[order[new]] = True
        noted[:, order[new]] = np.diff(new, append=len(pairs)), np.maximum.reduceat(tf[order], new), np.minimum.reduceat(dl[doc][order], new)
    buckets = pa.array([hashlib.md5(t.encode()).hexdigest()[:digits] for t in terms.dictionary.to_pylist()], pa.string())
    note = lambda x, kind: pa.array(x.astype(kind), mask=~first)
    columns = [terms.dictionary.take(pa.array(term)), pa.array(block[doc]), docs.column(1).take(pa.array(doc)), pa.array(tf), pa.array(dl[doc]), note(noted[0], "int64"), note(noted[1], "float64"), note(noted[2], "float64"), buckets.take(pa.array(term))]
    return pa.table(columns, ["term", "block", "key", "tf", "dl", "n", "max_tf", "min_dl", "bucket"])


def _postings(cut: DataFrame, weights: list[float], digits: int) -> DataFrame:
    """Postings of rows (block, key, words of each field), dealt by block. A task holds the documents of a few blocks, and hands on those that are whole."""
    kind = cut.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(block, prepend=held[0].column(0)[0].as_py() if held else block[0]))  # where a block begins, but for one that goes on
            if len(starts):
                whole = [*held, batch.slice(0, starts[-1])]
                yield from _counted(pa.Table.from_batches(whole), weights, digits).to_batches(HANDED)
                held = []
            held.append(batch.slice(starts[-1] if len(starts) else 0))
        if held:
            yield from _counted(pa.Table.from_batches(held), weights, digits).to_batches(HANDED)

    return cut.sortWithinPartitions("block").mapInArrow(run, f"term string, block long, key {kind}, tf double, dl double, n long, max_tf double, min_dl double, bucket string")


def append(docs: DataFrame, path: str, batch: int, key: str, fields: dict[str, float], gone: Column | None = None, digits: int = 1, block: int = BLOCK) -> None:
    """Indexes the documents of batch number `batch` that are new or differ from their newest version.

    A document with only null fields, or for which `gone` holds, is removed. Of several rows with one key, the one with the largest
    digest counts; rows without a key are left out. A batch that is written again must hold the same rows, and gives the same tables: what
    stood there before it is read without it.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    gone = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    none = F.coalesce(*[F.col(f).cast("string") for f in fields]).isNull() | gone
    digest = F.when(~none, F.sha2(F.to_json(F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}), 256)).otherwise("")
    marked = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), digest.alias("digest"), none.alias("removed"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    before = current(read(spark, path, "versions", kind).where(F.col("batch") < batch)).select("key", F.col("digest").alias("old"), F.col("removed").alias("was_removed"))
    # narrow rows decide what changes; texts are met once, by key
    chars = sum((F.coalesce(F.length(f"f{i}"), F.lit(0)) for i in range(len(fields))), F.lit(0)).cast("long")
    wanted = marked.groupBy("key").agg(F.max(F.struct("digest", "removed", chars.alias("chars"))).alias("m")).select("key", "m.*").join(before, "key", "left")
    wanted = wanted.where(F.when(F.col("removed"), F.coalesce(~F.col("was_removed"), F.lit(False))).otherwise(F.col("old").isNull() | (F.col("old") != F.col("digest"))))
    wanted = wanted.select("key", "digest", "removed", "chars").persist()
    try:
        n_new, n_chars = wanted.agg(F.count("*"), F.sum("chars")).first()
        tasks = -(-max(n_chars or 0, 1) // TASK_CHARS)
        blocks = max(-(-max(n_new, 1) // block), tasks)
        # texts are dealt by block to as many tasks as their size asks for, meet there what says that they are new, and are counted
        texts = [f"f{i}" for i in range(len(fields))]
        asked = wanted.where(~F.col("removed")).select("key", F.lit(True).alias("asked"), F.lit(None).cast("string").alias("digest"), *[F.lit(None).cast("string").alias(t) for t in texts])
        both = marked.where(~F.col("removed")).select("key", F.lit(False).alias("asked"), "digest", *texts).union(asked)
        dealt = both.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).repartition(tasks, "block")
        new = dealt.groupBy("block", "key").agg(F.max("asked").alias("asked"), F.max(F.struct("digest", *texts)).alias("t")).where("asked")
        made = _postings(new.select("block", "key", *[words_of(F.col(f"t.{t}")).alias(f"w{t}") for t in texts]), [float(w) for w in fields.values()], digits).withColumn("batch", F.lit(batch).cast("long"))
        # dealt by bucket, and a bucket with a term that most documents have is split
        _write(made.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "batch"), f"{path}/postings", ["bucket", "batch"])
        summary = read(spark, path, "noted").where((F.col("batch") == batch) & F.col("n").isNotNull())
        _write(summary.select("term", "block", "n", "max_tf", "min_dl", "bucket", "batch"), f"{path}/blocks", ["bucket", "batch"])
        held = read(spark, path, "postings", kind).where(F.col("batch") == batch)
        sizes = held.groupBy("key").agg(F.max("dl").alias("dl"))  # each posting has its document's length; documents without words have none
        brought = wanted.select("key", "digest", "removed").join(sizes, "key", "left")
        _write(brought.select("key", "digest", F.coalesce("dl", F.lit(0.0)).alias("dl"), "removed", F.lit(batch).cast("long").alias("batch")), f"{path}/versions", ["batch"])
    finally:
        wanted.unpersist()


def live(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """(key, batch, dl) of the documents that searches see."""
    return current(read(spark, path, "versions", key_type)).where(~F.col("removed")).select("key", "batch", "dl")


def live_postings(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """(key, term, tf, dl, bucket) of the documents that searches see."""
    return read(spark, path, "postings", key_type).join(live(spark, path, key_type).select("key", "batch"), ["key", "batch"], "left_semi").select("key", "term", "tf", "dl", "bucket")


@dataclass
class Plan:
    """What a search knows before it reads the postings of its candidates."""

    query_key: str
    postings: DataFrame
    weighed: DataFrame
    bounds: DataFrame
    seen: DataFrame
    score: Callable[[str, str], Column]
    asked: int
    tasks: int
    pairs: int

    def scores(self, chosen: DataFrame, most: int | None = None) -> DataFrame:
        """(query_key, key, score) of the visible documents in the chosen blocks, of which there are at most `most` in all queries.

        Postings travel once, by document, and meet the queries where they arrive: only a query's sums leave a task.
        """
        few = (self.pairs if most is None else min(most, self.pairs)) <= SENT_BLOCKS
        read = self.postings if few else self.postings.join(chosen.select("batch", "block").distinct(), ["batch", "block"], "left_semi")
        dealt = read.repartition(self.tasks, "key").join(self.seen.select("key", F.col("batch").alias("_live")).repartition(self.tasks, "key"), "key").where("batch = _live")
        met = dealt.join(self.weighed, "term")
        if few:
            met = met.join(F.broadcast(chosen.select(self.query_key, "batch", "block")), [self.query_key, "batch", "block"], "left_semi")
        return met.groupBy(self.query_key, "key").agg(F.round(F.sum(self.score("tf", "dl")), 6).alias("score"))

    def best(self, scored: DataFrame, k: int) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(W.partitionBy(self.query_key).orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)

    def open_blocks(self, k: int, first: int) -> DataFrame:
        """Each query's blocks with their bound, and whether a document in them could be among the k best.

        The k-th best score of the first blocks is what the k-th best of all is at least.
        """
        floor = self.best(self.scores(self.bounds.where(F.col("place") <= first), first * self.asked), k).where(F.col("rank") == k).select(self.query_key, F.col("score").alias("floor"))
        return self.bounds.join(floor, self.query_key, "left").withColumn("open", F.col("bound") + 1e-5 >= F.coalesce("floor", F.lit(0.0)))


def plan(spark: SparkSession, path: str, queries: DataFrame, query_key: str = "query_id", terms: str = "terms", key_type: str = "long", digits: int = 1, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> Plan:
    """Statistics of the visible documents, weights of the queries' terms and bounds of their blocks."""
    wanted = queries.select(query_key, F.explode(F.array_distinct(terms)).alias("term")).where(F.col("term").isNotNull() & F.col(query_key).isNotNull()).withColumn("bucket", bucket_of(digits=digits))
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # 16 ** digits at most
    seen = live(spark, path, key_type)
    n_asked, n_terms = queries.agg(F.count("*"), F.sum(F.size(terms))).first()
    sent = F.broadcast if (n_terms or 0) <= SENT_TERMS else lambda x: x
    tasks = max(1, -(-seen.count() * n_asked // PAIRS))
    n_blocks = read(spark, path, "blocks", key_type).groupBy("batch").agg((F.max("block") + 1).alias("n")).agg(F.sum("n")).first()[0] or 0
    stats = seen.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    vocabulary = wanted.select("term").distinct()
    known = read(spark, path, "versions", key_type)
    of_terms = lambda name: read(spark, path, name, key_type).where(F.col("bucket").isin(buckets)).drop("bucket").join(sent(vocabulary), "term", "left_semi")
    blocks = of_terms("blocks").join(known.select("batch").distinct(), "batch", "left_semi").where("block IS NOT NULL")  # finished batches; all that read bounds ask for the same rows, and share them
    postings = of_terms("postings")
    # documents that came anew or went: their old postings still count in the blocks
    old = known.select("key", "batch").join(seen.select("key", "batch"), ["key", "batch"], "left_anti")
    over = postings.select("term", "key", "batch").join(old, ["key", "batch"], "left_semi").groupBy("term").agg(F.count("*").alias("over"))
    df = blocks.groupBy("term").agg(F.sum("n").alias("n")).join(over, "term", "left").select("term", (F.col("n") - F.coalesce("over", F.lit(0))).alias("df")).where("df > 0")
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(fixed.BM25_LEAST_IDF))
    weighed = sent(wanted.join(df.join(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl"), "term"))  # stats: one row

    def score(tf: str, dl: str) -> Column:
        return F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.col("avgdl")))

    bounds = blocks.join(weighed, "term").groupBy(query_key, "batch", "block").agg(F.sum(score("max_tf", "min_dl")).alias("bound"))
    bounds = bounds.withColumn("place", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("bound"), "batch", "block")))
    return Plan(query_key, postings, weighed, bounds, seen, score, n_asked, tasks, n_blocks * n_asked)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, first: int = FIRST_BLOCKS, **options) -> DataFrame:
    """(query_key, key, score, rank): the k best documents by BM25 as lexical.bm25() scores them, ties to the smaller key.

    Statistics are those of the documents now visible. Postings of blocks that can't hold one of the k best are not read into scores.
    Queries without terms, and terms that no document has, give nothing. `options` are plan()'s.
    """
    p = plan(spark, path, queries, **options)
    return p.best(p.scores(p.open_blocks(k, first).where("open")), k)


def check(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """(problem, batch, n): what doesn't fit together; no rows for a sound index.

    Postings and lengths of documents that no version names (a batch that was not finished), versions whose postings' uses don't add up to their
    length, and blocks that don't say what their postings do.
    """
    versions, blocks, postings = (read(spark, path, name, key_type) for name in TABLES)
    summed = postings.groupBy("key", "batch").agg(F.sum("tf").alias("total"))
    both = versions.join(summed, ["key", "batch"], "full_outer")
    held = F.when(F.col("dl").isNull(), "postings_without_version").when(F.abs(F.col("dl") - F.coalesce("total", F.lit(0.0))) > 1e-6, "length_differs")
    own = postings.groupBy("bucket", "batch", "term", "block").agg(F.count("*").alias("n2"), F.max("tf").alias("tf2"), F.min("dl").alias("dl2"))
    blocked = blocks.join(own, ["bucket", "batch", "term", "block"], "full_outer").where(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("max_tf").eqNullSafe(F.col("tf2")) & F.col("min_dl").eqNullSafe(F.col("dl2"))))
    found = both.select(held.alias("problem"), "batch").where("problem IS NOT NULL").union(blocked.select(F.lit("block_differs"), "batch"))
    return found.groupBy("problem", "batch").agg(F.count("*").alias("n"))


def manifest(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """(batch, documents, removed, live, words): what each batch brought, and how much of it is still visible."""
    versions = read(spark, path, "versions", key_type)
    seen = live(spark, path, key_type).select("key", "batch", F.lit(1).alias("seen"))
    return versions.join(seen, ["key", "batch"], "left").groupBy("batch").agg(F.count("*").alias("documents"), F.sum(F.col("removed").cast("long")).alias("removed"), F.count("seen").alias("live"), F.sum("dl").alias("words"))
