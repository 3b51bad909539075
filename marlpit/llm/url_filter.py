"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's path. Each distinct URL is expanded into its host's suffixes (of the label counts that occur among the
rules); those that are hosts of rules are followed by the path's prefixes (of the lengths that the host's rules have).
Both meet the rules by an equi-join on the first `PREFIX_HEX` hex digits of their SHA-256, full digests are then
compared, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

PREFIX_HEX = 8
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    fits = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER)
    return F.when(fits, host).otherwise(""), F.when(fits, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)).otherwise("")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _short(digest: str):
    return F.substring(digest, 1, PREFIX_HEX)


def _known(rules: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Rules by the digest of their expression, hosts by their digest with the path lengths that occur, and label counts; at most `most` labels or path characters."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL")
    labels = F.size(F.split("host", r"\."))
    row = rules.agg(F.collect_set(labels), F.max(labels), F.max(F.length("path"))).first()
    if max(row[1] or 0, row[2] or 0) > most:
        raise ValueError(f"a rule has more than {most} labels or path characters")
    text = F.concat("host", "path")
    known = rules.groupBy(text.alias("rule")).agg(F.max("verdict").alias("verdict")).withColumn("full", F.sha2("rule", 256))
    hosts = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).withColumn("host_full", F.sha2("host", 256))
    return store(known.withColumn("short", _short("full")), "rules"), store(hosts.select("host_full", "lengths", _short("host_full").alias("host_short")), "hosts"), sorted(row[0])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url", most: int = 4096) -> DataFrame:
    """Adds host, path, rule and verdict to pages, one row out for each row in.

    Null URLs and URLs without `://` have empty host and path, fit no rule, and get `default`. Equal rules with other
    verdicts: `block` wins; rules with a null host or path fit nothing. Repeated rows and URLs each keep their row. Input
    columns named host, path, rule or verdict are replaced; others keep their names and values, whatever they are. An empty table, or empty
    rules, gives the same columns.
    """
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url and c in pages.columns])
    known, hosts, labels = _known(rules, most)
    host, path = host_path(F.col("u"))
    urls = pages.select(F.col(url).alias("u")).where(F.instr(url, "://") > 0).distinct().select("u", host.alias("h"), path.alias("p"))
    parted = urls.withColumn("l", F.split("h", r"\."))
    suffix = F.array(*[F.when(F.size("l") >= n, F.array_join(F.slice("l", F.greatest(F.size("l") - (n - 1), F.lit(1)), n), ".")) for n in labels] or [F.lit(None).cast("string")])
    # first the host's suffixes meet the rules' hosts, and only a host that has rules is followed by the path's prefixes
    suffixes = parted.select("u", "p", F.explode(F.array_compact(suffix)).alias("s")).withColumn("d", F.sha2("s", 256))
    met = suffixes.withColumn("host_short", _short("d")).join(hosts, "host_short").where(F.col("d") == F.col("host_full"))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("p")), lambda n: F.concat("s", F.substring(F.col("p"), F.lit(1), n)))
    expressions = met.select("u", F.explode(prefixes).alias("e")).withColumn("digest", F.sha2("e", 256)).withColumn("short", _short("digest"))
    hits = expressions.join(known, "short").where(F.col("digest") == F.col("full"))
    best = hits.groupBy("u").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")).select(F.col("u").alias("_u"), F.col("best.rule").alias("_rule"), F.col("best.verdict").alias("_verdict"))
    # a plain table, so that the rows of a hot URL can be split. Its compressed size says little of so many alike: it is never broadcast
    best = store(best, "best").hint("merge")
    h, p = host_path(F.col("_row.url"))
    rows = pages.select(F.struct(F.struct("*").alias("kept"), F.col(url).alias("url")).alias("_row"), F.when(F.instr(url, "://") > 0, F.col(url)).alias("_at"))
    joined = rows.join(best, F.col("_at") == F.col("_u"), "left").select(F.col("_row.kept").alias("_kept"), h.alias("_h"), p.alias("_p"), "_rule", F.coalesce("_verdict", F.lit(default)).alias("_v"))
    return joined.select("_kept.*", F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_rule").alias("rule"), F.col("_v").alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM p
), r(rhost, rpath, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hit AS (
  SELECT h.page_id, h.host, h.path, rhost || rpath AS rule, v,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hit WHERE k = 1
"""
