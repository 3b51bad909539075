"""Graphs: degrees, components, hubs; provenance of derived chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import shingle_hashes
from ..sources.shared import new_folder


def degrees(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, degree) over undirected edges."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def connected(edges: DataFrame, nodes: DataFrame | None = None, a: str = "src", b: str = "dst", most_rounds: int = 50) -> DataFrame:
    """(node, component): every node with the smallest it reaches; isolated nodes are their own.

    Each round hangs nodes on their smallest neighbour, shortens these trees to stars, and goes on with the edges between stars, which are ever fewer.
    What a round makes is stored in the shared folder, which spark.checkpoint.dir names (a temporary one is made in local mode only), and read from
    there: a frame that was checkpointed keeps its plan's constraints, which grow with each round.
    """
    to = new_folder(edges.sparkSession, "connected")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{to}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{to}/{name}")

    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    left = stored(both.union(both.select("v", "u")).distinct(), "edges")
    seen = left.select(F.col("u").alias("node"))
    seen = (seen.union(nodes.select(nodes.columns[0])) if nodes is not None else seen).distinct()
    labels = stored(seen.withColumn("component", F.col("node")), "labels")
    for n in range(most_rounds):
        if left.isEmpty():
            return labels
        up = stored(left.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), f"up{n}")
        for m in range(most_rounds):
            on = up.select(F.col("root").alias("_node"), F.col("root").alias("_kept")).distinct().join(up.select(F.col("node").alias("_node"), F.col("root").alias("_next")), "_node")
            if on.where("_next <> _kept").isEmpty():
                break
            up = stored(up.join(on, F.col("root") == F.col("_node")).select("node", F.col("_next").alias("root")), f"up{n}_{m}")
        else:
            raise RuntimeError(f"trees did not settle in {most_rounds} rounds")
        at = lambda c, to: up.select(F.col("node").alias(c), F.col("root").alias(to))  # noqa: B023, E731
        labels = stored(labels.join(at("component", "_root"), "component", "left").select("node", F.coalesce("_root", "component").alias("component")), f"labels{n}")
        left = stored(left.join(at("u", "_u"), "u").join(at("v", "_v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).where("u <> v").distinct(), f"edges{n}")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def generic_hub(label: Column, sources: Column, relation: bool = False) -> Column:
    """Names too general to trace: many sources for a name of at most two tokens."""
    return (F.size(sources) >= (12 if relation else 8)) & (F.size(F.split(F.trim(label), r"\s+")) <= 2)


def overlapping(spans: DataFrame, parents: DataFrame, doc: str, least: int = 1) -> DataFrame:
    """Pairs of a span and a parent span of its document that overlap, with the overlap.

    Both sides are cut into buckets of the parents' width, so the join is on (document, bucket) and not all with all; a pair is kept
    in the bucket where its overlap begins.
    """
    width = 2048
    cut = lambda df, p: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{p}start") / width), F.floor((F.greatest(F.col(f"{p}end"), F.col(f"{p}start") + 1) - 1) / width))))
    both = cut(spans, "").join(cut(parents.withColumnsRenamed({"start": "p_start", "end": "p_end"}), "p_"), [doc, "_b"])
    begin = F.greatest("start", "p_start")
    size = F.least("end", "p_end") - begin
    return both.withColumn("overlap", size).where((size >= least) & (F.floor(begin / width) == F.col("_b"))).drop("_b")


def offsets(parents: DataFrame, doc: str, order: str, content: str = "content", separator: int = 2) -> DataFrame:
    """start and end of each parent in the text of all, joined by separators of a fixed length."""
    before = F.coalesce(F.sum(F.length(content) + separator).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parents.withColumn("start", before).withColumn("end", F.col("start") + F.length(content))


def containment(chunks: DataFrame, parents: DataFrame, doc: str, chunk_key: str, parent_key: str, width: int = 5) -> DataFrame:
    """(doc, chunk, parent, score): shared shingles over the smaller set's size.

    Texts are dealt by document, chunks and parents together, and cut into shingles after that: shingles meet where they were made.
    """
    one = lambda df, own, k, other, kind: df.select(doc, F.col(k).alias(own), F.lit(None).cast(kind).alias(other), F.lit(own == "_c").alias("_chunk"), "content")
    kinds = [df.schema[k].dataType for df, k in ((chunks, chunk_key), (parents, parent_key))]
    both = one(chunks, "_c", chunk_key, "_p", kinds[1]).unionByName(one(parents, "_p", parent_key, "_c", kinds[0]))
    dealt = both.where(F.col(doc).isNotNull()).repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)
    hashed = dealt.select(doc, "_c", "_p", "_chunk", shingle_hashes(F.col("content"), width).alias("_set"))
    cut = hashed.select(doc, "_c", "_p", "_chunk", F.size("_set").alias("_n"), F.explode("_set").alias("_s"))
    holding = F.collect_list(F.when(~F.col("_chunk"), F.struct("_p", "_n"))).over(W.partitionBy(doc, "_s"))
    met = cut.select(doc, "_c", "_n", "_chunk", holding.alias("_h")).where("_chunk").select(doc, "_c", "_n", F.explode("_h").alias("_h"))
    counted = met.groupBy(doc, "_c", F.col("_h._p").alias("_p")).agg(F.count("*").alias("both"), F.first(F.least("_n", "_h._n")).alias("n"))
    return counted.select(doc, F.col("_c").alias(chunk_key), F.col("_p").alias(parent_key), F.round(F.col("both") / F.col("n"), 6).alias("score"))


def clear_winner(scored: DataFrame, partition: list[str], key: str, least: float = 0.55, margin: float = 0.05) -> DataFrame:
    """The best row of each partition if it scores at least `least` and the next one `margin` less."""
    w = W.partitionBy(*partition).orderBy(F.desc("score"), key)
    led = scored.withColumns({"_n": F.row_number().over(w), "_next": F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    return led.where((F.col("_n") == 1) & (F.col("score") >= least) & (F.round(F.col("score") - F.col("_next"), 6) >= margin)).drop("_n", "_next")


def resolve_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, document_id, by): by id, else by path, else by base name; the first kind with matches decides and must give one document."""
    base = lambda c: F.lower(F.substring_index(c, "/", -1))
    d = documents.select("document_id", F.col("path").alias("d_path"), base("path").alias("d_base"))
    tries = [
        chunks.join(d, chunks.full_doc_id == d.document_id).select("chunk_id", "document_id", F.lit(1).alias("level")),
        chunks.join(d, F.col("file_path") == F.col("d_path")).select("chunk_id", "document_id", F.lit(2).alias("level")),
        chunks.join(d, base("file_path") == F.col("d_base")).select("chunk_id", "document_id", F.lit(3).alias("level")),
    ]
    found = tries[0].union(tries[1]).union(tries[2])
    best = found.groupBy("chunk_id", "level").agg(F.min("document_id").alias("document_id"), F.countDistinct("document_id").alias("n"))
    first = best.groupBy("chunk_id").agg(F.min(F.struct("level", "document_id", "n")).alias("x"))
    by = F.element_at(F.array(F.lit("id"), F.lit("path"), F.lit("basename")), F.col("x.level"))
    return first.where("x.n = 1").select("chunk_id", "x.document_id", by.alias("by"))


#: Height of a strip, in the boxes' units.
STRIP = 128


def panels(boxes: DataFrame, page: list[str], gap: float = 24, share: float = 0.5) -> DataFrame:
    """Pairs (a, b) of boxes of a page that overlap by `share` on one axis and are at most `gap` apart on the other.

    Such boxes are at most `gap` apart from top to bottom, so only those in a common strip of the page meet: boxes, the gap added, are cut into strips of
    STRIP, and a pair is kept in the first it shares. A page of many small boxes so makes few pairs.
    """
    strip = lambda y: F.floor(y / F.lit(float(STRIP)))
    cols = ["box_id", "x0", "y0", "x1", "y1"]
    cut = boxes.withColumn("_s", F.explode(F.sequence(strip(F.col("y0")), strip(F.greatest("y0", "y1") + F.lit(float(gap))))))
    left, right = (cut.select(*page, "_s", *[F.col(c).alias(f"{p}_{c}") for c in cols]) for p in "ab")
    both = left.join(right, [*page, "_s"]).where((F.col("a_box_id") < F.col("b_box_id")) & (F.col("_s") == strip(F.greatest("a_y0", "b_y0"))))
    return both.where(_near(*[lambda c, p=p: F.col(f"{p}_{c}") for p in "ab"], gap, share)).select(*page, F.col("a_box_id").alias("src"), F.col("b_box_id").alias("dst"))


def _near(a: Callable[[str], Column], b: Callable[[str], Column], gap: float, share: float) -> Column:
    size = lambda p, q: F.least(a(q), b(q)) - F.greatest(a(p), b(p))
    wide = lambda p, q: F.least(a(q) - a(p), b(q) - b(p))
    beside = (size("y0", "y1") >= share * wide("y0", "y1")) & (-size("x0", "x1") <= gap)
    stacked = (size("x0", "x1") >= share * wide("x0", "x1")) & (-size("y0", "y1") <= gap)
    return beside | stacked


def linked_panels(boxes: DataFrame, page: list[str], gap: float = 24, share: float = 0.5) -> DataFrame:
    """Pairs with the same components as those of panels(): boxes in one place are linked to the smallest of them, which alone meets others.

    Boxes with a side of less than no length may not be linked with their like; such ones meet all by themselves.
    """
    place = [*page, "x0", "y0", "x1", "y1"]
    alike = F.coalesce(_near(F.col, F.col, gap, share), F.lit(False))
    same = boxes.where(alike)
    first = same.groupBy(*place).agg(F.min("box_id").alias("_first"))
    copies = same.join(first, place).where("box_id <> _first").select(*page, F.col("_first").alias("src"), F.col("box_id").alias("dst"))
    alone = first.select(*place, F.col("_first").alias("box_id")).union(boxes.where(~alike).select(*place, "box_id"))
    return panels(alone, page, gap, share).union(copies)
