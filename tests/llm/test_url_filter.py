import re

from marlpit.llm.url_filter import RULES, judge, rules_frame

URLS = [
    None, "", "no scheme", "http://org", "http://ORG/", "https://a.example.org/es/x", "http://example.org/en/12?q", "http://example.org/en/2", "http://xexample.org/es/", "http://a.b.com/fr/", "http://a.b.com/de/#x",
    "http://com/de", "http://com?/de/", "ftp://É.Example.ORG/es/", "a://b://c.org/", "http://example.org", "http://.org/", "http://a..com/de/", "x" * 9000 + "://com/de/", "http://example.org/es/\n/es/", "http://org./", "://org/",
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    hits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(hits)[1] if hits else None, max(hits)[2] if hits else default


def test_rules(spark):
    rows = [(i % 15, u, "clash") for i, u in enumerate(URLS * 2)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), rules_frame(spark, RULES)).collect()
    assert sorted(map(repr, ((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(repr, ((i, u, *brute(u, RULES)) for i, u, _ in rows)))


def test_many_rules_and_none(spark):
    rules = [(f"h{i % 50}.net", "/" + "ab"[i % 2] * (i % 9), "block" if i % 3 else "allow") for i in range(400)]
    rules = list({(h, p): (h, p, v) for h, p, v in sorted(rules)}.values())
    pages = spark.createDataFrame([(i, f"http://x.h{i % 60}.net/{'ab'[i % 2] * (i % 11)}") for i in range(500)], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in judge(pages, rules_frame(spark, rules)).fillna("-", ["rule"]).collect()) == [(i, brute(u, rules)[2] or "-", brute(u, rules)[3]) for i, u in pages.collect()]
    assert {r.verdict for r in judge(pages, rules_frame(spark, []), "block").collect()} == {"block"} and judge(pages.limit(0), rules_frame(spark, rules)).count() == 0


def test_one_url_in_most_rows_and_null_rules(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'http://a.example.org/es/' ELSE concat('http://com/de/', id) END AS url")
    rules = rules_frame(spark, RULES).union(spark.createDataFrame([(None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string"))
    got = judge(pages, rules).groupBy("rule", "verdict").count().collect()
    assert sorted(map(repr, ((r.rule, r.verdict, r["count"]) for r in got))) == sorted(map(repr, [(None, "allow", 1000), ("example.org/es/", "block", 1000), ("com/de/", "block", 1000)]))


def test_helper_names_are_free(spark):
    names = ["best", "best_u", "u", "h", "p", "_u", "_rule", "_verdict", "_row", "_at", "_kept", "_h", "_p", "_v", "kept", "short", "full", "digest", "l", "s", "d", "e", "lengths"]
    pages = spark.createDataFrame([(i, u, *[f"{n}{i}" for n in names]) for i, u in enumerate(URLS)], "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names))
    got = judge(pages, rules_frame(spark, RULES))
    assert got.columns == ["page_id", "url", *names, "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, u, *[f"{n}{i}" for n in names], *brute(u, RULES))) for i, u in enumerate(URLS))
