"""Site-relative line de-duplication.

A line is boilerplate of a host if more than `ratio` of the host's pages hold it, and at
least `least` pages do (so hosts with fewer pages are never cleaned).  Lines are counted once a page (array_distinct, no shuffle) and by
digest, with partial counts before the shuffle, so a hot host is no more than one
counter a line and task.  What is found is a short list a host: it holds at most the lines a
page / ratio.  Pages meet their host's list in an ordinary join: Spark broadcasts the lists, and
moves no text, as long as they are under its limit, and else sorts both sides and splits hot hosts.

A line is what stands between line feeds, with white space around it ignored; blank lines are never
boilerplate.  Null texts stay null, a null host is a host of its own, repeated
rows count as pages of their own, and all columns of the input are returned as they are, but for the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

RATIO = 0.08
LEAST = 3
#: White space around a line that doesn't count.
SPACE = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits by which lines are told apart; null for a blank line."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, key, pages, share: every line over the ratio.  A host has at most its lines a page / ratio of them."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col(text)), _key), lambda k: k.isNotNull()))
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("total"))
    counted = pages.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"))
    held = counted.where(F.col("pages") >= least).alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return held.where(F.col("pages") > ratio * F.col("total")).select("c.host", "key", "pages", (F.col("pages") / F.col("total")).alias("share"))


def drop_lines(pages: DataFrame, folder: str, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, counter: str | None = "dropped_lines") -> DataFrame:
    """`pages` with their boilerplate lines taken out, and the added column `counter`, the number of those lines
    (which replaces a column of that name; none for None)."""
    found = boilerplate(pages, host, text, ratio, least).groupBy("host").agg(F.collect_list("key").alias("keys"))  # a host's list is bounded
    found = materialize(found, folder, "boilerplate").alias("b")
    joined = pages.alias("p").join(found, F.col(f"p.{host}").eqNullSafe(F.col("b.host")), "left")
    lines = _lines(F.col(f"p.{text}"))
    kept = F.filter(lines, lambda line: ~F.coalesce(F.array_contains("b.keys", _key(line)), F.lit(False)))
    clean = F.col("b.keys").isNull() | F.col(f"p.{text}").isNull()
    cleaned = F.when(clean, F.col(f"p.{text}")).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text else F.col(f"p.`{c}`") for c in pages.columns if c != counter]
    return joined.select(*columns, *([] if counter is None else [F.when(clean, 0).otherwise(F.size(lines) - F.size(kept)).alias(counter)]))


#: DuckDB twin of the registered query, over `documents`.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, source, generate_subscripts(l, 1) AS i, unnest(l) AS line
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
), totals AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), boilerplate AS (
  SELECT source, bare FROM (
    SELECT source, bare, count(DISTINCT doc_id) AS pages FROM lines WHERE bare <> '' GROUP BY source, bare
  ) JOIN totals USING (source) WHERE pages >= {LEAST} AND pages > {RATIO} * total
), marked AS (
  SELECT l.doc_id, l.i, l.line, b.bare IS NOT NULL AS hit
  FROM lines l LEFT JOIN boilerplate b ON l.source = b.source AND l.bare = b.bare
)
SELECT d.doc_id, d.source, coalesce(m.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text, coalesce(m.dropped_lines, 0) AS dropped_lines
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit) AS text, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS INTEGER) AS dropped_lines
  FROM marked GROUP BY doc_id
) m ON d.doc_id = m.doc_id
"""
