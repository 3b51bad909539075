"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Weights share `factor` times all words; a target stops at `most` times its source's words and the excess is shared anew.
2. The documents of a source are dealt by hash into blocks, in a permuted order that needs no sort. Drawing goes over the
   blocks, once or more, and ends inside one of them, so that the words taken are the target, rounded.
3. All block draws are the root of a tree. Each node splits its quotas by source between two children: one gets half of the
   draws, its quotas follow the multivariate hypergeometric law, source by source by inversion. The leaves are output shards.
4. A shard's quota of a source is the next run of that source's permuted blocks, so draws are disjoint; within a shard
   documents are ordered by hash.

Only DataFrame and SQL functions are used. One row for each source is gathered in one place, never documents or blocks;
there are at most MOST_CELLS quotas (sources times shards), so the plan that is joined to the documents stays under 32 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, discard, store, table

WEIGHTS = (5, 2, 1)
FACTOR, MOST = 1.5, 2
BLOCK_WORDS, BLOCKS, SHARDS, SEED = 16384, 65536, 32, 7
#: Shards have SHARD_BLOCKS block draws or more; there are SHARDS or more, and at most MOST_CELLS quotas.
SHARD_BLOCKS, MOST_CELLS = 64, 1 << 22
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_draws")


def words(text: Column) -> Column:
    """Number of words, counted by their first characters so that no array of words is built; null: 0."""
    first = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]"
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, first, "")), F.lit(0)).cast("long")


def place(key: Column, seed: int = SEED) -> Column:
    """60 bits of MD5 of the key as text; null keys count as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, target) from (source, size): weights repeat over sources in code point order, null last."""
    if not weights or min(weights) < 1 or factor > most:
        raise ValueError("weights must be positive integers, and factor at most `most`")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, order = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    ranked = by_source.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("double"))
    before = everything.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    whole = F.sum("source_size").over(everything) * F.lit(float(factor))
    capped_before, weight_before = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = ranked.withColumn("level", (whole - capped_before) / (F.sum("w").over(everything) - weight_before))
    capped = level.withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(shared * F.col("w"))
    return capped.select("source", F.col("rank").cast("long").alias("rank"), "source_size", target.alias("target"))


def hypergeometric(pool: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the u-quantile of the number of marked ones among those drawn of a pool, by inversion within 12 standard deviations of the mode."""
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    ratio = "((p.marked - k) * (p.drawn - k)) / ((k + 1) * (p.pool - p.marked - p.drawn + k + 1))"
    numbers = f"named_struct('pool', CAST({pool} AS DOUBLE), 'marked', CAST({marked} AS DOUBLE), 'drawn', CAST({drawn} AS DOUBLE), 'u', {u})"
    spread = "sqrt(greatest(0D, p.drawn * (p.marked / greatest(p.pool, 1D)) * ((p.pool - p.marked) / greatest(p.pool, 1D)) * ((p.pool - p.drawn) / greatest(p.pool - 1, 1D))))"
    shape = f"named_struct('lo', greatest(0D, p.drawn + p.marked - p.pool), 'hi', least(p.drawn, p.marked), 'mode', CAST(floor((p.drawn + 1) * (p.marked + 1) / (p.pool + 2)) AS DOUBLE), 'w', CAST(ceil(12 * {spread}) AS DOUBLE) + 12)"
    bounds = "sequence(CAST(greatest(r.lo, r.mode - r.w) AS BIGINT), CAST(least(r.hi, r.mode + r.w) AS BIGINT))"
    total = f"aggregate(ks, named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w)).s"
    pick = f"aggregate(ks, named_struct('w', 1D, 'c', 0D, 'k', element_at(ks, 1)), (a, k) -> named_struct('w', a.w * {ratio}, 'c', a.c + a.w, 'k', if(a.c < p.u * total, k, a.k))).k"
    return let(numbers, "p", let(shape, "r", let(bounds, "ks", let(total, "total", pick))))


def split_tree(root: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, quotas): the array of block draws by source in one row, `quotas`, split among `shards` (a power of two)."""
    depth = shards.bit_length() - 1
    if 1 << depth != shards:
        raise ValueError("shards must be a power of two")
    nodes = root.select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(depth):
        u = f"CAST(conv(substring(md5(concat('{seed}:', node, ':', i)), 1, 13), 16, 10) AS DOUBLE) / 4503599627370496D"
        quota = hypergeometric("acc.rest", "element_at(quotas, i)", "acc.draws", u)
        total = "aggregate(quotas, 0L, (a, x) -> a + x)"
        step = f"element_at(transform(array({quota}), x -> named_struct('rest', acc.rest - element_at(quotas, i), 'draws', acc.draws - x, 'out', concat(acc.out, array(x)))), 1)"
        left = f"aggregate(sequence(1, size(quotas)), named_struct('rest', {total}, 'draws', {total} div 2, 'out', CAST(array() AS ARRAY<BIGINT>)), (acc, i) -> {step}).out"
        halves = nodes.where("size(quotas) > 0").withColumn("left", F.explode(F.array(F.expr(left))))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
        nodes = halves.select(F.explode(children).alias("c")).select("c.*")
        if level == 9:
            nodes = nodes.repartition("node")
    return nodes.select((F.col("node") - shards).alias("shard"), "quotas")


def shard_count(sources: int, draws: int) -> int:
    """A power of two. More sources than MOST_CELLS / SHARDS are refused: group them, such as domains by a hash, before mixing."""
    if sources * SHARDS > MOST_CELLS:
        raise ValueError(f"{sources} sources; at most {MOST_CELLS // SHARDS} can be mixed")
    wanted = max(SHARDS, draws // SHARD_BLOCKS)
    return 1 << (min(wanted, MOST_CELLS // max(1, sources)).bit_length() - 1)


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: int = MOST, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, int]:
    """One row for each source: its target, its blocks, where drawing ends, and `ends`, the block draws up to each shard's last; and the number of shards."""
    sizes = store(docs.select(F.col(source).alias("source"), words(F.col(text)).alias("size"), place(F.col(key), seed).alias("h")), "sizes")
    goal = targets(sizes, weights, factor, most).withColumn("take", F.floor(F.col("target") + 0.5))
    some = F.greatest("source_size", F.lit(1))
    goal = goal.withColumn("full", F.floor(F.col("take") / some)).withColumn("rest", F.col("take") - F.col("full") * F.col("source_size"))
    goal = store(goal.withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("long")), "targets")

    dealt = sizes.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source"))).withColumn("block", F.col("h") % F.col("blocks"))
    up_to = lambda *order: F.sum("n").over(W.partitionBy("rank").orderBy(*order))
    blocks = dealt.groupBy("rank", "rest", "block").agg(F.sum("size").alias("n"))  # at most BLOCKS rows a source
    last = blocks.withColumn("end", up_to("block")).where("end - n < rest AND rest <= end")
    last = last.select(F.col("rank").alias("of"), F.col("block").alias("last"), (F.col("rest") - (F.col("end") - F.col("n"))).alias("left"))
    inside = dealt.join(last, (F.col("rank") == F.col("of")) & (F.col("block") == F.col("last"))).where("size > 0")
    tied = inside.groupBy("rank", "last", "left", "h", "size").agg(F.sum("size").alias("n"), F.count("*").alias("ties"))
    cut = tied.withColumn("end", up_to("h", "size")).where("end - n < left AND left <= end")
    cut = cut.select(F.col("rank").alias("of"), "last", F.col("h").alias("cut_h"), F.col("size").alias("cut_size"), F.floor((F.col("left") - (F.col("end") - F.col("n"))) / F.col("ties")).alias("cut_words"))
    whole = goal.join(cut, F.col("rank") == F.col("of"), "left").drop("of", "take", "rest")
    whole = store(whole.withColumn("draws", F.col("full") * F.col("blocks") + F.coalesce(F.col("last") + 1, F.lit(0))), "plan")

    many = whole.agg(F.count("*"), F.coalesce(F.sum("draws"), F.lit(0))).first()
    shards = shards or shard_count(*many)
    root = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "draws"))), lambda x: x["draws"]).alias("quotas"))
    leaves = split_tree(root, shards, seed).select("shard", F.posexplode("quotas").alias("rank", "quota"))
    ends = leaves.withColumn("end", F.sum("quota").over(W.partitionBy("rank").orderBy("shard")))
    ends = ends.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    made = store(whole.join(ends, "rank"), "mix")
    for t in (sizes, goal, whole):
        discard(t)
    return made, shards


def draws(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: int = MOST, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, and mix_draws: array of (epoch, shard, words), one for each time the row is drawn.

    Words of null texts: none; rows without words are never drawn. Rows of equal key and size that share the end of their source's drawing
    get equal parts of it. Null sources are a source, null keys hash like an empty one, and an empty table gives the same columns.
    Each source's words taken are its target, rounded, but for fewer words than such ties. Columns of the names added are replaced.
    """
    docs = docs.drop(*ADDED)
    made, shards = plan(docs, key, text, source, weights, factor, most, shards, seed)
    made = made.select(*[F.col(c).alias(f"_mix_{c}") for c in made.columns])
    c = lambda name: F.col(f"_mix_{name}")
    rows = docs.withColumns({"mix_size": words(F.col(text)), "_mix_h": place(F.col(key), seed)}).join(made, F.col(source).eqNullSafe(c("source")))
    block = c("h") % c("blocks")
    before = (c("h") < c("cut_h")) | ((c("h") == c("cut_h")) & (F.col("mix_size") < c("cut_size")))
    part = F.when(block < c("last"), F.col("mix_size")).when(block == c("last"), F.when(before, F.col("mix_size")).when((c("h") == c("cut_h")) & (F.col("mix_size") == c("cut_size")), c("cut_words")).otherwise(0)).otherwise(0)

    def shard(draw: Column) -> Column:
        """How many shards end at or before a draw, by halving."""
        steps = [1 << i for i in reversed(range(shards.bit_length() - 1))]
        at = F.lit(0)
        return F.aggregate(F.array(*map(F.lit, steps)), at, lambda acc, s: F.when(F.element_at(c("ends"), acc + s) <= draw, acc + s).otherwise(acc)) if steps else at

    times = F.transform(F.sequence(F.lit(0).cast("long"), c("full")), lambda e: F.struct(e.cast("int").alias("epoch"), F.when(e < c("full"), F.col("mix_size")).otherwise(F.coalesce(part, F.lit(0))).cast("long").alias("words"), (e * c("blocks") + block).alias("draw")))
    taken = F.transform(F.filter(times, lambda t: t["words"] > 0), lambda t: F.struct(t["epoch"].alias("epoch"), shard(t["draw"]).alias("shard"), t["words"].alias("words")))
    return rows.select(*docs.columns, "mix_size", c("source_size").alias("mix_source_size"), c("target").alias("mix_target"), taken.alias("mix_draws"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each draw: docs' columns, mix_shard, mix_epoch, mix_words and mix_order (the place within the shard).

    The text of the one document (with its ties) in which a source's drawing ends is cut after the words taken. Takes the options of draws(),
    whose rules for nulls, ties and empty tables hold. Columns of the names added are replaced.
    """
    docs = docs.drop(*ADDED, "mix_shard", "mix_epoch", "mix_words", "mix_order")
    drawn = draws(docs, key, text, **options).withColumn("_mix_d", F.explode("mix_draws"))
    taken = F.col("_mix_d.words")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), taken.cast("int")), "")
    cut = F.when(taken < F.col("mix_size"), head).otherwise(F.col(text))
    order = F.xxhash64(F.col(key), "_mix_d.epoch", "_mix_d.shard", F.lit(options.get("seed", SEED)))
    columns = [cut.alias(x) if x == text else F.col(x) for x in docs.columns]
    return drawn.select(*columns, F.col("_mix_d.shard").alias("mix_shard"), F.col("_mix_d.epoch").alias("mix_epoch"), taken.alias("mix_words"), order.alias("mix_order"))


def in_order(mixed: DataFrame) -> DataFrame:
    """mix() dealt to tasks by shard and shuffled within each: sorted by mix_order. Shards too large for a task are split, small ones share one."""
    return mixed.hint("rebalance", F.col("mix_shard")).sortWithinPartitions("mix_shard", "mix_order")


def write_shards(mixed: DataFrame, path: str) -> None:
    """Writes mix() as one folder for each shard, in its local order; null texts and repeated rows as mix() gives them. An empty table gives no folder."""
    in_order(mixed).write.partitionBy("mix_shard").parquet(path)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and `draws`: epoch:shard:words of each draw, comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    taken = F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    where = F.array_join(F.transform("mix_draws", lambda d: F.concat_ws(":", d["epoch"], d["shard"], d["words"])), ",")
    return draws(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"), where.alias("draws"))


#: The quantile of hypergeometric() in DuckDB's SQL, of the fields of a struct p.
_RATIO = "(((p.marked - a.k) * (p.drawn - a.k)) / ((a.k + 1) * (p.pool - p.marked - p.drawn + a.k + 1)))"
_SUMS = f"list_reduce(list_transform(ks, lambda k: {{'k': k, 'w': CAST(1 AS DOUBLE), 's': CAST(0 AS DOUBLE), 'at': k}}), lambda a, e: {{'k': e.k, 'w': a.w * {_RATIO}, 's': a.s + a.w, 'at': if(a.s + a.w < p.u * total, e.k, a.at)}})"
_SPREAD = "sqrt(greatest(0, p.drawn * (p.marked / greatest(p.pool, 1)) * ((p.pool - p.marked) / greatest(p.pool, 1)) * ((p.pool - p.drawn) / greatest(p.pool - 1, 1))))"
_MODE, _WIDTH = "floor((p.drawn + 1) * (p.marked + 1) / (p.pool + 2))", f"ceil(12 * {_SPREAD}) + 12"
_KS = f"list_transform(range(CAST(greatest(greatest(0, p.drawn + p.marked - p.pool), {_MODE} - ({_WIDTH})) AS BIGINT), CAST(least(least(p.drawn, p.marked), {_MODE} + {_WIDTH}) AS BIGINT) + 1), lambda k: CAST(k AS DOUBLE))"
_TOTAL = _SUMS.replace("total", "CAST(0 AS DOUBLE)")
_QUANTILE = f"list_transform([{{'pool': CAST(g.rest AS DOUBLE), 'marked': CAST(h.q AS DOUBLE), 'drawn': CAST(g.draws AS DOUBLE), 'u': h.u}}], lambda p: list_transform([{_KS}], lambda ks: list_transform([{_TOTAL}], lambda t: list_transform([t.s + t.w], lambda total: {_SUMS}.at)[1])[1])[1])[1]"
_UNIFORM = "CAST(('0x' || substr(md5('7:' || CAST(node AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 13))::BIGINT AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)"
_LEFT = f"""list_reduce(
      list_concat([{{'q': 0::BIGINT, 'u': CAST(0 AS DOUBLE), 'rest': CAST(list_sum(quotas) AS BIGINT), 'draws': CAST(list_sum(quotas) AS BIGINT) // 2, 'out': CAST([] AS BIGINT[])}}],
        list_transform(range(1, len(quotas) + 1), lambda i: {{'q': quotas[i], 'u': {_UNIFORM}, 'rest': 0::BIGINT, 'draws': 0::BIGINT, 'out': CAST([] AS BIGINT[])}})),
      lambda g, h: list_transform([CAST({_QUANTILE} AS BIGINT)], lambda x: {{'q': h.q, 'u': h.u, 'rest': g.rest - h.q, 'draws': g.draws - x, 'out': list_append(g.out, x)}})[1]).out"""

OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS w, CAST(2 * n AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, (sum(n) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, rank, n, CASE WHEN level * w > cap THEN cap ELSE w * (SELECT arg_min(level, (cap / w, rank)) FROM l WHERE NOT level * w > cap) END AS target FROM l
), t AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS take, greatest(n, 1) AS some, greatest(1, least(65536, CAST(ceil(n / 16384) AS BIGINT))) AS blocks FROM g
), p AS (
  SELECT d.doc_id, d.size, d.h, t.rank, t.n, t.target, t.take // t.some AS full_times, t.take - t.take // t.some * t.n AS rest, d.h % t.blocks AS block
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT rank, rest, block, sum(size) AS m, sum(sum(size)) OVER (PARTITION BY rank ORDER BY block) AS stop FROM p GROUP BY rank, rest, block
), e AS (
  SELECT rank, block AS last, rest - (stop - m) AS remains FROM b WHERE stop - m < rest AND rest <= stop
), c AS (
  SELECT p.rank, last, remains, h, size, sum(size) AS m, count(*) AS ties, sum(sum(size)) OVER (PARTITION BY p.rank ORDER BY h, size) AS stop
  FROM p JOIN e ON p.rank = e.rank AND p.block = e.last WHERE size > 0 GROUP BY p.rank, last, remains, h, size
), x AS (
  SELECT rank, last, h AS cut_h, size AS cut_size, (remains - (stop - m)) // ties AS cut_words FROM c WHERE stop - m < remains AND remains <= stop
), z AS (
  SELECT t.rank, t.take // t.some * t.blocks + coalesce(x.last + 1, 0) AS n FROM t LEFT JOIN x ON t.rank = x.rank
), o AS (
  SELECT list(n ORDER BY rank) AS quotas, CAST(floor(log2(least(greatest(32, sum(n) // 64), 4194304 // count(*)))) AS INTEGER) AS depth FROM z
), tree AS (
  SELECT 0 AS level, 1::BIGINT AS node, list_transform(quotas, lambda q: CAST(q AS BIGINT)) AS quotas FROM o
  UNION ALL
  SELECT level + 1, c.node, c.quotas FROM (
    SELECT level, unnest([{'node': 2 * node, 'quotas': half}, {'node': 2 * node + 1, 'quotas': list_transform(list_zip(quotas, half), lambda y: y[1] - y[2])}]) AS c
    FROM (SELECT level, node, quotas, @LEFT AS half FROM tree WHERE level < (SELECT depth FROM o))
  )
), leaf AS (
  SELECT node, unnest(quotas) AS q, unnest(range(len(quotas))) AS rank FROM tree WHERE level = (SELECT depth FROM o)
), stops AS (
  SELECT rank, list(stop ORDER BY node) AS stops FROM (SELECT rank, node, sum(q) OVER (PARTITION BY rank ORDER BY node) AS stop FROM leaf) GROUP BY rank
), y AS (
  SELECT p.*, stops, blocks, CASE WHEN last IS NULL OR block > last THEN 0 WHEN block < last THEN size
    WHEN (h, size) < (cut_h, cut_size) THEN size WHEN h = cut_h AND size = cut_size THEN cut_words ELSE 0 END AS part
  FROM p LEFT JOIN x ON p.rank = x.rank JOIN stops ON p.rank = stops.rank JOIN t ON p.rank = t.rank
)
SELECT doc_id, size, n AS source_size, target, CAST(full_times * size + part AS BIGINT) AS taken,
  coalesce(array_to_string(list_transform(list_filter(range(CAST(full_times AS BIGINT) + 1), lambda e: if(e < full_times, size, part) > 0),
    lambda e: CAST(e AS VARCHAR) || ':' || CAST(len(list_filter(stops, lambda s: s <= e * blocks + block)) AS VARCHAR) || ':' || CAST(CAST(if(e < full_times, size, part) AS BIGINT) AS VARCHAR)), ','), '') AS draws
FROM y
""".replace("@LEFT", _LEFT)
