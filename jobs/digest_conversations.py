"""Turns a table of conversations into what an assistant's context builder looks up: one row for each question.

    python -m jobs.digest_conversations --conversations DIR --digest DIR [--config FILE]

For each user turn: the episode it opens, its title, the answer that follows, how it should be answered (route, intent, depth), whether it leans on the
turn before, and the context limits that follow from these. Output is partitioned by a bucket of the conversation. The mark is the output
itself: each row carries the conversation's last turn and its number of turns, conversations whose turns haven't changed are not worked on again,
and only buckets with a change are rewritten, each as a whole. What comes out depends on the conversations alone, so a run that was cut short is mended by the next.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import configured, main
from marlpit.functions.text import first_line_title
from marlpit.operators import decisions, spans

LOG = logging.getLogger("digest_conversations")
SCHEMA = (
    "conv_id long, turn long, episode long, title string, answered boolean, answer_chars long, route string, intent string, depth string, follows boolean, wants_visual boolean, wants_results boolean, "
    "max_sources int, max_chars int, max_chars_per_source int, max_chunks_per_document int, neighbor_window int, max_neighbor_chars int, turns long, last_turn long, content long, bucket int"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The digest; empty if there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def numbered(turns: DataFrame) -> DataFrame:
    """(bucket, conv_id, turn, role, text, mark): a row for each turn; of several with one number the first by role and text counts, null ones as empty."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = turns.groupBy("bucket", "conv_id", "turn").agg(F.min(said).alias("t")).select("bucket", "conv_id", "turn", "t.*")
    return one.withColumn("mark", F.conv(F.substring(F.md5(F.concat_ws(":", "turn", "role", "text")), 1, 15), 16, 10).cast("long"))


def state(turns: DataFrame) -> DataFrame:
    """(bucket, conv_id, turns, last_turn, content) of conversations that have a user turn; content is a mark of all turns."""
    whole = turns.groupBy("bucket", "conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.bit_xor("mark").alias("content"), F.max(F.col("role") == "user").alias("asks"))
    return whole.where("asks").drop("asks")


def digest(turns: DataFrame) -> DataFrame:
    """A row for each user turn of numbered() ones. Episodes count user turns; an answer is an assistant turn right after, other roles left out."""
    by, said = ["bucket", "conv_id"], F.col("text")
    spoken = turns.where(F.col("role").isin("user", "assistant")).drop("mark")
    spoken = spans.running(spoken, by, "turn", (F.col("role") == "user").cast("long"), "episode")
    spoken = spans.beside(spoken, by, "turn", F.struct("role", F.length("text").cast("long").alias("chars")), "next")
    answered = F.coalesce(F.col("next.role") == "assistant", F.lit(False))
    asked = spoken.where("role = 'user'").withColumns({"answered": answered, "answer_chars": F.when(answered, F.col("next.chars")).otherwise(0)})
    focused = spans.beside(asked, by, "turn", F.col("answered"), "before", ahead=False).withColumn("focused", F.coalesce("before", F.lit(False)))
    judged = focused.withColumns({
        "title": first_line_title(said), "route": decisions.route(said, F.col("focused")), "intent": decisions.intent(said), "depth": decisions.depth(said),
        "follows": decisions.follow_up(said), "wants_visual": decisions.wants_visual(said), "wants_results": decisions.wants_results(said),
    })
    kinds = {f.split()[0]: f.split()[1] for f in SCHEMA.split(", ")}
    return decisions.budgets(judged).join(state(turns), by).select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def run(spark: SparkSession, conversations: str, to: str, config: dict | None = None) -> dict[str, int]:
    """Brings a digest up to date; says how many conversations with questions it read, how many of them had changed, and how many buckets were written.

    Turns without a conversation or number are left out. A conversation that is gone leaves with its bucket's next rewrite.
    """
    c = configured("digest_conversations", config)
    turns = spark.read.parquet(conversations).select(F.col(c["conversation"]).cast("long").alias("conv_id"), F.col(c["order"]).cast("long").alias("turn"), F.col(c["role"]).alias("role"), F.col(c["text"]).alias("text"))
    turns = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("bucket", F.pmod(F.col("conv_id"), F.lit(c["buckets"])).cast("int"))
    before = read(spark, to).groupBy("bucket", "conv_id").agg(F.max("content").alias("known"), F.lit(True).alias("there"))
    both = state(numbered(turns)).join(before, ["bucket", "conv_id"], "left")
    # a row for each bucket
    counts = both.groupBy("bucket").agg(F.count("*").alias("n"), F.sum((F.col("there").isNull() | (F.col("content") != F.col("known"))).cast("long")).alias("changed")).collect()
    work = {r.bucket: r.changed for r in counts if r.changed}
    took = {"conversations": sum(r.n for r in counts), "changed": sum(work.values()), "buckets": len(work)}
    LOG.info("%s: %d conversations with questions read, %d changed, in %d of %d buckets", conversations, took["conversations"], took["changed"], len(work), c["buckets"])
    if work:
        made = digest(numbered(turns.where(F.col("bucket").isin(sorted(work)))))
        made.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "conv_id", "turn").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(to)
        for r in read(spark, to).where(F.col("bucket").isin(sorted(work))).groupBy("bucket").agg(F.count("*").alias("n")).orderBy("bucket").collect():
            LOG.info("%s: bucket %d written, %d questions", to, r.bucket, r.n)
    return took


if __name__ == "__main__":
    main("digest_conversations", __doc__.split("\n")[0], {"conversations": "Parquet files with turns", "digest": "folder of the digest"}, run)
