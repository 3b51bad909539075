"""File sources and sinks: folder listing, text, markdown, docx and zipped JSON lines, HTML text, TSV labels, event streams."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("txt", "md", "pdf", "docx")


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a path or URL, without query and fragment."""
    return F.lower(F.regexp_extract(path, r"\.([^./?#]+)(?:[?#].*)?$", 1))


def list_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Catalog of a folder's supported files: path, modificationTime, length, suffix; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    return found.withColumn("suffix", suffix(F.col("path"))).where(F.col("suffix").isin(*SUPPORTED))


def docx_text(content: bytes) -> str:
    """Paragraphs that aren't blank, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter(f"{space}t")) for p in body.iter(f"{space}p")]
    return "\n".join(x for x in lines if x.strip())


def read_documents(spark: SparkSession, folder: str, parsers: dict | None = None) -> DataFrame:
    """(path, content_hash, page_number, text, error) of a folder's files.

    txt and md are UTF-8 with replacement, docx by paragraphs; `parsers` maps further suffixes to functions from bytes
    to a text or a list of page texts. A file that fails gives a row with its error instead of ending the job.
    """
    known = {"txt": lambda b: b.decode("utf-8", "replace"), "md": lambda b: b.decode("utf-8", "replace"), "docx": docx_text} | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, content, h in zip(df.path, df.content, df.content_hash, strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    pages = known[kind](bytes(content)) if kind in known else None
                    error = None if pages is not None else f"no parser for {kind}"
                except Exception as e:  # one bad file must not end the job
                    pages, error = None, f"{type(e).__name__}: {e}"
                for i, t in enumerate([pages] if isinstance(pages, str) else pages or [None], 1):
                    rows.append((path, h, i, t, error))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "page_number", "text", "error"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(suffix(F.col("path")).isin(*SUPPORTED))
    return found.select("path", "content", F.sha2("content", 256).alias("content_hash")).mapInPandas(run, "path string, content_hash string, page_number int, text string, error string")


def index_counts(parsed: DataFrame, changes: DataFrame) -> DataFrame:
    """scanned, indexed, skipped and failed files of an indexing run."""
    files_ = parsed.groupBy("path").agg(F.max(F.col("error").isNotNull()).alias("bad")).join(changes, "path", "left")
    done = F.col("change").isin("new", "changed") & ~F.col("bad")
    return files_.agg(F.count("*").alias("scanned"), F.count_if(done).alias("indexed"), F.count_if((F.col("change") == "unchanged") & ~F.col("bad")).alias("skipped"), F.count_if(F.col("bad")).alias("failed"))


def needs_ocr(pages: DataFrame, key: str) -> DataFrame:
    """(key, needs_ocr): under 35 % of pages have 40 characters, and under 120 on average."""
    n = F.length("content")
    return pages.groupBy(key).agg(((F.avg(F.when(n >= 40, 1.0).otherwise(0.0)) < 0.35) & (F.avg(n) < 120)).alias("needs_ocr"))


def html_text(html: Column) -> Column:
    """Visible text of a page, with single spaces."""
    bare = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def read_zip_lines(spark: SparkSession, path: str, id_field: str = "_id") -> DataFrame:
    """(id, title, text) of JSON lines in zip archives; a line without an id is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for content in df.content:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            rows = []
                            for line in io.TextIOWrapper(f, "utf-8"):
                                if line.strip():
                                    r = json.loads(line)
                                    if not r.get(id_field):
                                        raise ValueError(f"{name}: a line has no {id_field}")
                                    rows.append((str(r[id_field]), r.get("title") or "", r.get("text") or ""))
                                if len(rows) >= 1000:
                                    yield pd.DataFrame(rows, columns=["id", "title", "text"])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["id", "title", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, title string, text string")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, relevant) from a TSV of query-id, corpus-id and score, positive scores only."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int")
    return rows.where("score > 0").groupBy(F.col("query-id").alias("query_id")).agg(F.array_sort(F.collect_set("corpus-id")).alias("relevant"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(id, mode, query) from JSON lines of conversations: the last turn, all turns, or the rewrite where there is one."""
    t = spark.read.schema("id string, turns array<string>, rewrite string").json(path)
    modes = F.array(F.struct(F.lit("last").alias("mode"), F.element_at("turns", -1).alias("query")), F.struct(F.lit("full").alias("mode"), F.array_join("turns", "\n").alias("query")), F.struct(F.lit("rewrite").alias("mode"), F.col("rewrite").alias("query")))
    return t.where(F.size("turns") > 0).select("id", F.explode(modes).alias("m")).select("id", "m.*").where("query IS NOT NULL")


def adapt(rows: DataFrame, columns: dict[str, str | Column], source: str) -> DataFrame:
    """A public dataset in the one record schema: id, question, answer, context, source; absent parts are null."""
    pick = lambda n: (columns[n] if isinstance(columns[n], Column) else F.col(columns[n])) if n in columns else F.lit(None)
    return rows.select(*[pick(n).cast("string").alias(n) for n in ("id", "question", "answer", "context")], F.lit(source).alias("source"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, label) of nodes and (src, dst) of edges of a GraphML file."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", "_id string, data array<struct<_VALUE:string,_key:string>>").select(F.col("_id").alias("id"), F.try_element_at(F.transform("data", lambda d: d["_VALUE"]), F.lit(1)).alias("label"))
    return nodes, read("edge", "_source string, _target string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"))


def vault_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, note): a markdown note for each node that links its neighbours."""
    both = edges.union(edges.select("dst", "src")).toDF("id", "other").distinct()
    links = both.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("others"))
    lines = F.array_join(F.transform(F.coalesce("others", F.array().cast("array<string>")), lambda o: F.concat(F.lit("- [["), o, F.lit("]]"))), "\n")
    return nodes.join(links, "id", "left").select("id", F.concat(F.lit("# "), F.coalesce("label", "id"), F.lit("\n\n"), lines).alias("note"))


def publish(df: DataFrame, path: str, least_rows: int = 1) -> None:
    """Writes to a staging folder, checks the rows, moves the table into place and writes a manifest.

    The old table is moved away first, so a reader between the two renames finds none; publish_version() has no such moment.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.sc().hadoopConfiguration())
    staging = f"{path}.staging"
    df.write.mode("overwrite").parquet(staging)
    rows = spark.read.parquet(staging).count()
    if rows < least_rows:
        fs.delete(hadoop(staging), True)
        raise ValueError(f"{rows} rows, at least {least_rows} expected")
    old = f"{path}.old"
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(old), True)
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(staging), hadoop(path))
    fs.delete(hadoop(old), True)
    spark.createDataFrame([(path, rows)], "path string, rows long").write.mode("overwrite").json(f"{path}.manifest")


MANIFEST_SCHEMA = "version long, name string, rows long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def publish_version(tables: DataFrame | dict[str, DataFrame], path: str, least_rows: int = 1, checks: Callable[[dict[str, DataFrame]], list[str]] | None = None) -> int:
    """Writes tables side by side as a new version under `path`, checks them, and makes them visible together; returns the version.

    Each is written to `<path>/<name>/version=<n>` and counted as it stands there; `checks` may name further faults of what was written. Only then
    one row for each table is added to the manifest, in one write. published() reads the largest version in it, so that readers see the old tables or
    the new ones whole, at every moment and after a crash; what a failed version left is overwritten by the next try. One writer at a time.
    """
    named = tables if isinstance(tables, dict) else {"table": tables}
    spark = next(iter(named.values())).sparkSession
    version = (_manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    written, rows = {}, {}
    for name, df in named.items():
        place = f"{path}/{name}/version={version}"
        df.write.mode("overwrite").parquet(place)
        written[name] = spark.read.schema(df.schema).parquet(place)
        rows[name] = written[name].count()
        if rows[name] < least_rows:
            raise ValueError(f"{name}: {rows[name]} rows, at least {least_rows} expected")
    if faults := checks(written) if checks else []:
        raise ValueError("; ".join(faults))
    spark.createDataFrame([(version, n, r) for n, r in rows.items()], MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def published(spark: SparkSession, path: str, name: str = "table", version: int | None = None) -> DataFrame:
    """A table as last published, or as of a version: a reader of several tables asks for one version of all."""
    known = _manifest(spark, path).where(F.col("name") == name)
    last = known.where(F.col("version") <= version if version is not None else F.lit(True)).agg(F.max("version")).first()[0]
    if last is None:
        raise ValueError(f"{path} has no published {name}")
    return spark.read.parquet(f"{path}/{name}/version={last}")


def resolved_path(path: Column) -> Column:
    """An absolute path without `.`, `..` and empty parts; `..` at the root stays there. Links are not followed."""
    step = lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part.isin("", "."), kept).otherwise(F.array_append(kept, part))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def isolated(path: Column, root: str) -> Column:
    """Whether an absolute path lies below a folder, once `..` is resolved; the folder itself, relative and null paths don't."""
    return F.coalesce(path.startswith("/") & resolved_path(path).startswith(root.rstrip("/") + "/"), F.lit(False))


def sse_frame(event: Column, data: Column) -> Column:
    """One server-sent event as text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def parse_sse(stream: DataFrame, text: str = "value") -> DataFrame:
    """(event, data) of whole recorded event streams: blocks between blank lines, data lines joined; a block without a name is `message`."""
    block = F.explode(F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\n+"), lambda b: F.trim(b) != "")).alias("b")
    lines = F.split("b", "\n")
    field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    rest = [c for c in stream.columns if c != text]
    return stream.select(*rest, block).select(*rest, F.coalesce(F.try_element_at(field("event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(field("data"), "\n").alias("data"))


def table_csv(markdown: str) -> str:
    """A pipe table as CSV."""
    rows = [[c.strip() for c in re.sub(r"^\||\|$", "", x.strip()).split("|")] for i, x in enumerate(markdown.split("\n")) if i != 1]
    quote = lambda c: '"' + c.replace('"', '""') + '"' if re.search(r'[",\n]', c) else c
    return "\n".join(",".join(map(quote, r)) for r in rows)
