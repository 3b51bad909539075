"""Keeps a lexical index of a growing folder of documents.

    python -m jobs.index_documents --documents DIR --index DIR --checkpoint DIR [--config FILE]

A file stream takes the files that are new since the last run, in batches; its checkpoint is the mark. Of a batch, documents that are new or
changed are tokenized and written as the batch's partitions of postings, blocks and versions (marlpit.operators.index); unchanged ones are
passed over, and a document that comes with a null text is removed. A batch that was cut short is taken again by the next run and replaces what it
left; a run without new files writes nothing. Searches see a batch once its versions are written.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from jobs.common import configured, main
from marlpit.operators import index

LOG = logging.getLogger("index_documents")


def either(path: str) -> str:
    """A pattern for the path itself: a file stream takes a folder by its name, but a single file by a pattern only."""
    whole = path.rstrip("/")
    return f"{whole[:-1]}[{whole[-1]}]"


def run(spark: SparkSession, documents: str, to: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Indexes what is new in a folder (or table) of Parquet files and waits for it; says how many batches and rows it took and what is in the index."""
    c = configured("index_documents", config)
    took = {"batches": 0, "rows": 0}

    def write(rows: DataFrame, n: int) -> None:
        index.append(rows, to, n, c["key"], c["fields"], digits=c["digits"])
        size = rows.count()
        took["batches"] += 1
        took["rows"] += size
        LOG.info("batch %d: %d rows read from %s", n, size, documents)

    stream = spark.readStream.schema(c["schema"]).option("maxFilesPerTrigger", str(c["files_per_batch"])).parquet(either(documents))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    for r in index.manifest(spark, to, stream.schema[c["key"]].dataType.simpleString()).where("live > 0").orderBy("batch").collect():  # a row for each batch
        LOG.info("%s: batch %d brought %d documents with %d words, %d of them are visible", to, r.batch, r.documents, r.words, r.live)
    return took


if __name__ == "__main__":
    main("index_documents", __doc__.split("\n")[0], {"documents": "Parquet files with documents", "index": "folder of the index", "checkpoint": "the stream's checkpoint"}, run)
