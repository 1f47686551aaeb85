"""URL rules by hashed host-suffix and path-prefix expressions, with DataFrame functions alone.

Each URL is expanded into the expressions (host suffix at a label boundary, followed by a
path prefix) that could equal a rule; only the pairs of label count and path length that
rules have are tried, however long the URL is.  Expressions
are joined to rules on the first 32 bits of their SHA-256, then the full digest confirms.
Of the rules that fit, the longest wins (host and path together; then the longer host; then block).

The join is an ordinary one: Spark broadcasts the rules only while their size is under its limit and splits hot keys otherwise.
A null URL, or one without `://`, has an empty host and path, fits no rule and gets the
default verdict.  Repeated rows and ids are judged each; other columns are ignored.  Rules with a
null host, path or verdict fit nothing, and so does an empty rule table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.settle import settle

DEFAULT = "allow"
#: The rules that the registered query applies: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with host and path."""
    begin = F.instr(F.col(url), "://")
    rest = F.when(begin > 0, F.substr(F.col(url), begin + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return pages.withColumn("path", F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)).withColumn("host", F.translate(host, UPPER, LOWER))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict.

    Only a row's number and the digests of its expressions go through the join; what fits comes back to the row."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    # distinct (label count, path length): bounded by the square of the longest URL, not by the number of rules
    shapes = sorted(map(tuple, rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect()))
    rule = F.concat(F.col("host"), F.col("path"))
    won = F.struct(F.length(rule).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), rule.alias("rule"), "verdict").alias("won")
    keyed = rules.select(F.sha2(rule, 256).alias("full"), won).select(F.substring("full", 1, PREFIX_DIGITS).alias("short"), "full", "won")
    seen = parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url").select("page_id", "host", "path")
    seen = settle(seen.withColumn("row", F.monotonically_increasing_id()))
    names = F.split("host", r"\.")
    shape = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in shapes]).cast("array<struct<c:int,n:int>>")
    tries = F.transform(
        F.filter(shape, lambda s: (s["c"] <= F.size(names)) & (s["n"] <= F.length("path"))),
        lambda s: F.concat(F.array_join(F.slice(names, F.size(names) - s["c"] + 1, s["c"]), "."), F.substr(F.col("path"), F.lit(1), s["n"])),
    )
    digests = seen.select("row", F.explode(tries).alias("tried")).select("row", F.sha2("tried", 256).alias("digest"))
    hit = digests.join(keyed, (F.substring("digest", 1, PREFIX_DIGITS) == F.col("short")) & (F.col("digest") == F.col("full")))
    best = hit.groupBy("row").agg(F.max("won").alias("won"))
    return seen.join(best, "row", "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM p
), rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT id, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON u.id = b.id
"""
