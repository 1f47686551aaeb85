import re

from pyspark.sql import functions as F

from plumbline.llm import url_filter

LONG = "http://" + "a." * 3000 + "net/" + "x/" * 3000


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "net/", "http://net/", "http://NET", "https://A.Example.NET/en/x?y#z", "http://example.net/en", "ftp://x.example.com/de/", "http://badexample.com/de/", "http://a.org/fr/", "http://org/fr", "x://É.NET/Ü",
    "a://b://c.net/", "http://example.net/EN/", "http://.net/", "http://a.net:80/", "http://a.net\n/b", LONG,
]


def test_against_the_rules_read_one_by_one(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(1, URLS[5]), (1, URLS[5]), (None, "http://net/")], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit(1), "path": F.lit(2), "rule": F.lit(3), "row": F.lit(4)})
    got = sorted([tuple(r) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()], key=str)
    want = sorted([(i, *judged(u, url_filter.RULES)) for i, u in enumerate(URLS)] + [(1, *judged(URLS[5], url_filter.RULES))] * 2 + [(None, *judged("http://net/", url_filter.RULES))], key=str)
    assert got == want


def test_precedence_and_prefixes_that_end_within_a_segment(spark):
    rules = [("b.c", "/x", "block"), ("a.b.c", "/", "allow"), ("b.c", "/xyz", "allow"), ("c", "", "block"), (None, "/", "block")]
    urls = ["http://a.b.c/xyzzy", "http://a.b.c/xy", "http://b.c/q", "http://c", "http://d"]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, table).collect()}
    assert got == {i: judged(u, rules[:-1])[2:] for i, u in enumerate(urls)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.rule_table(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    (row,) = url_filter.judge(one, url_filter.rule_table(spark).where("false")).collect()
    assert (row["rule"], row["verdict"]) == (None, "allow")
