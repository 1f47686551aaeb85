"""Sources and sinks on files: what a query writes, it reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.settle import shared
from plumbline.plans.registry import query
from plumbline.sources import files, matlab, publish, pulls
from plumbline.sources import tables as S
from plumbline.sources.files import shipped


@query("s4_trace_columns", "SELECT event_id AS tick, round(value, 2) AS force FROM events")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """A latin-1 CSV with umlauts in its header, of which the columns with two keywords are read."""
    path = f"{shared(spark)}/trace"
    wide = S.table(spark, d, "events").select(F.col("event_id").alias("Timer Tick [ms]"), F.round("value", 2).alias("Force [kN]"), F.lit("zu").alias("T\u00fcr"), F.col("event_type").alias("Art"))
    wide.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    got = files.trace_csv(spark, path, ["tick", "force"])
    return got.select(F.col("`Timer Tick [ms]`").cast("long").alias("tick"), F.col("`Force [kN]`").alias("force"))


@query("s6_tolerance_sheet", """WITH l AS (SELECT p_brand AS dimension, round(avg(p_retailprice), 3) AS nominal FROM part GROUP BY 1)
SELECT dimension, nominal, round(nominal + 40, 3) AS upper, round(nominal - 25, 3) AS lower, count(*) AS n, count(*) FILTER (p_retailprice > nominal + 40 OR p_retailprice < nominal - 25) AS outside FROM part JOIN l ON dimension = p_brand GROUP BY dimension, nominal""")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with names, nominals and tolerances in its head and a row a part below."""
    path = f"{shared(spark)}/sheet"
    p = S.table(spark, d, "part")
    names = [r[0] for r in p.select("p_brand").distinct().orderBy("p_brand").collect()]  # the sheet's columns
    nominal = {r[0]: r[1] for r in p.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 3)).collect()}
    head = [("name", *names), ("nominal", *[repr(nominal[n]) for n in names]), ("upper", *["40"] * len(names)), ("lower", *["-25"] * len(names))]
    top = spark.createDataFrame([(",".join(row),) for row in head], "value string")
    cells = F.concat_ws(",", F.col("p_partkey").cast("string"), *[F.when(F.col("p_brand") == n, F.col("p_retailprice").cast("string")).otherwise("") for n in names])
    top.unionByName(p.select(cells.alias("value"))).write.text(path)
    limits, long = files.tolerance_sheet(spark, path)
    seen = long.where("value IS NOT NULL").join(limits, "dimension")
    outside = (F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))
    return seen.groupBy("dimension", "nominal", F.round("upper", 3).alias("upper"), F.round("lower", 3).alias("lower")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(outside, 1)).alias("outside"))


@query("s7_struct_array", """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, count(*) AS samples, round(sum(value), 4) AS total, round(max(value) FILTER (k = 1), 6) AS first, CASE WHEN user_id % 4 > 0 THEN CAST(user_id AS DOUBLE) / 10 END AS wear FROM s GROUP BY user_id""")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """Every user's signal in struct arrays of ten users each, with ragged channels and scalars that are missing; written and read."""
    shipped(spark)
    signal = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"])  # a signal is an array
    signals = S.table(spark, d, "events").groupBy("user_id").agg(signal.alias("x")).withColumn("part", F.floor(F.col("user_id") / 10))

    def write(pdf):
        import pandas as pd

        rows = [{"run": float(u), "wear": u / 10 if u % 4 else float("nan"), "x": x} for u, x in zip(pdf["user_id"].tolist(), pdf["x"], strict=True)]
        return pd.DataFrame({"content": [matlab.file_bytes("mill", rows, packed=len(rows) % 2 == 0)]})

    back = matlab.records(signals.groupBy("part").applyInPandas(write, "content binary"), "mill", ["run", "wear"], ["x"])
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return back.select(F.col("run").cast("long").alias("user_id"), F.size("x").cast("long").alias("samples"), F.round(total, 4).alias("total"), F.round(F.element_at("x", 1), 6).alias("first"), "wear")


#: Records of a file of the log, about 25 MB.
LOG_ROWS = 100_000


@query("s8_s15_log_and_resume", """WITH r AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
last AS (SELECT user_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM r WHERE event_type <> 'error') WHERE n = 1)
SELECT u.user_id, k IS NOT NULL AS done, k FROM (SELECT DISTINCT user_id FROM r) u LEFT JOIN last USING (user_id) UNION ALL SELECT -1, false, NULL""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """An append-only JSON log in several files: the last good record of each request, and what a resumed run still has to do."""
    path = f"{shared(spark)}/log"
    e = S.table(spark, d, "events")
    requests = e.select("user_id").distinct().unionByName(spark.createDataFrame([(-1,)], "user_id long")).withColumn("req_hash", files.request_hash("user_id"))
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), files.request_hash("user_id").alias("req_hash"), status.alias("status"),
        F.struct(F.col("event_id").cast("string").alias("id")).alias("meta"), F.struct(F.get_json_object("props", "$.k").alias("choice")).alias("response"),
    )
    # in the order of events, so that of two at the same time the later one stands last
    parts = max(3, -(-e.count() // LOG_ROWS))
    e.select("event_id", "ts", "user_id", "event_type", "props").repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").select(F.to_json(record).alias("value")).write.text(path)
    done = files.last_records(spark, path).select("req_hash", F.col("response.choice").cast("long").alias("k"))
    todo = files.pending(requests, done).select("user_id", F.lit(False).alias("done"), F.lit(None).cast("long").alias("k"))
    return requests.join(done, "req_hash").select("user_id", F.lit(True).alias("done"), "k").unionByName(todo)


@query("s12_xml_time_series", f"""WITH {S.HOURS}, f AS (SELECT date, slot, coalesce(act, 0) AS x FROM hpanel)
SELECT CAST(date AS TIMESTAMP) + INTERVAL 1 HOUR * slot AS ts, x AS value FROM f""")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Daily periods of hourly points, of which repeated ones are left out, written as XML and decoded."""
    path = f"{shared(spark)}/xml"
    hours = S.hour_panel(spark, d).select("date", "slot", F.coalesce("act", F.lit(0.0)).alias("x"))
    day = hours.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("p"))  # a day's hours
    said = F.transform("p", lambda v, i: F.struct(i.alias("i"), (v["slot"] + 1).alias("position"), v["x"].alias("quantity"), F.when(i > 0, F.col("p")[i - 1]["x"]).alias("before")))
    kept = F.transform(F.filter(said, lambda v: (v["i"] == 0) | (v["quantity"] != v["before"])), lambda v: F.struct(v["position"].alias("position"), v["quantity"].alias("quantity")))
    stamp = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00Z"))
    period = day.select(F.struct(stamp("date").alias("start"), stamp(F.date_add("date", 1)).alias("end")).alias("timeInterval"), F.lit("PT60M").alias("resolution"), kept.alias("Point"))
    period.write.format("xml").option("rowTag", "Period").option("rootTag", "TimeSeries").save(path)
    return files.xml_series(spark, path).select(F.to_utc_timestamp("ts", F.current_timezone()).cast("timestamp_ntz").alias("ts"), "value")


@query("s14_market_scrape", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), seen AS (SELECT DISTINCT user_id FROM e WHERE ts < TIMESTAMP '2024-01-01 06:00:00')
SELECT user_id, event_id, value, k FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e
  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND value >= 20 AND k >= 10 AND NOT regexp_matches(event_type, '^(err|sign)') AND user_id NOT IN (SELECT user_id FROM seen)
) WHERE n = 1""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """A date window, floors on a column and on a JSON field, a pattern of what is left out, sources seen before, one record each."""
    from plumbline.operators.panel import dedup_first

    e = S.table(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"])
    seen = e.where("ts < timestamp_ntz'2024-01-01 06:00:00'").select("user_id").distinct()
    kept = e.where("ts BETWEEN timestamp_ntz'2024-01-05' AND timestamp_ntz'2024-01-25' AND value >= 20 AND k >= 10").where(~F.col("event_type").rlike("^(err|sign)"))
    return dedup_first(kept.join(seen, "user_id", "left_anti"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value", "k")


@query("s16_monthly_sink", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """A folder a month; months that are written again are replaced, the others stay."""
    path = f"{shared(spark)}/months"
    o = S.table(spark, d, "orders").select("o_orderdate", "o_totalprice")
    files.write_months(o.where("year(o_orderdate) <> 1996").unionByName(o.where("year(o_orderdate) = 1996").withColumn("o_totalprice", F.lit(0.0))), path, "o_orderdate")
    files.write_months(o.where("year(o_orderdate) = 1996"), path, "o_orderdate")
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s17_finite_sink", """SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount > 0) AS finite, round(sum(l_tax / l_discount) FILTER (l_discount > 0), 4) AS total FROM lineitem GROUP BY 1""")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """Ratios, some of them infinite or no number, through a JSON sink that writes null for those."""
    path = f"{shared(spark)}/json"
    zero = F.col("l_discount") == 0
    ratio = F.when(zero & (F.col("l_tax") == 0), float("nan")).when(zero, float("inf")).otherwise(F.col("l_tax") / F.col("l_discount"))
    files.finite(S.table(spark, d, "lineitem").select("l_returnflag", ratio.alias("ratio"))).write.json(path)
    back = spark.read.schema("l_returnflag string, ratio double").json(path)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("ratio").alias("finite"), F.round(F.sum("ratio"), 4).alias("total"))


_LINES = "string_agg(n_nationkey || ' ' || n_name, chr(10) ORDER BY n_nationkey) || chr(10)"


@query("s18_r12_report_and_digest", f"SELECT 'region-' || n_regionkey || '.txt' AS file, strlen({_LINES}) AS bytes, sha256({_LINES}) AS sha256 FROM nation GROUP BY n_regionkey")
def s18(spark: SparkSession, d: str) -> DataFrame:
    """Reports with line feeds alone, and the digest of each file of their folder."""
    path = f"{shared(spark)}/report"
    rows = S.table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").collect()  # a report's rows
    for region in sorted({r["n_regionkey"] for r in rows}):
        files.write_text(spark, f"{path}/region-{region}.txt", [f"{r['n_nationkey']} {r['n_name']}" for r in rows if r["n_regionkey"] == region])
    return files.file_digests(spark, path)


_MONTHS = ["2024-01", "2024-02", "2024-03"]
TOKEN = "hush-7f3a"


def _service(series: str, month: str) -> list[dict]:
    """Stands for a service: a chunk's days in pages of ten, after a login; one chunk is refused by it for good."""
    import calendar
    import hashlib

    if (series, month) == ("load", "2024-02"):
        raise ValueError(f"https://service/{series}?token={TOKEN} is closed")
    days = calendar.monthrange(int(month[:4]), int(month[5:]))[1]

    def get(token: str, cursor: int | None) -> tuple[list[dict], int | None]:
        if token != TOKEN:
            raise PermissionError("log in")
        first = cursor or 1
        page = [{"day": f"{month}-{d:02d}", "value": int(hashlib.md5(f"{series}|{month}-{d:02d}".encode()).hexdigest()[:8], 16) % 1000} for d in range(first, min(first + 10, days + 1))]
        return page, first + 10 if first + 10 <= days else None

    return list(pulls.paged(get, lambda: TOKEN))


@query("s10_s11_monthly_pulls", """WITH c AS (SELECT s AS series, CAST(d AS DATE) AS day FROM (SELECT unnest(['load', 'price']) AS s), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY)) AS d)),
v AS (SELECT series, strftime(day, '%Y-%m') AS month, CAST('0x' || substr(md5(series || '|' || strftime(day, '%Y-%m-%d')), 1, 8) AS BIGINT) % 1000 AS v FROM c)
SELECT series, month, CASE WHEN series = 'load' AND month = '2024-02' THEN 0 ELSE count(*) END AS n, CASE WHEN series = 'load' AND month = '2024-02' THEN NULL ELSE CAST(sum(v) AS BIGINT) END AS total,
  CASE WHEN series = 'load' AND month = '2024-02' THEN 'ValueError(''https://service/load?token=*** is closed'')' END AS error FROM v GROUP BY series, month""")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Paged chunks by month from a stand-in for a service, in two runs: the second one only asks for what the first had not."""
    path = f"{shared(spark)}/pulled"
    pulls.pull_months(spark, ["load"], _MONTHS[:2], _service, "day date, value long", path, (TOKEN,), attempts=2, wait=0.0)
    failed = pulls.pull_months(spark, ["load", "price"], _MONTHS, _service, "day date, value long", path, (TOKEN,), attempts=2, wait=0.0)
    got = spark.read.schema("day date, value long, series string, month string").parquet(path).groupBy("series", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    none = failed.select("series", "month", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("total"), "error")
    return got.withColumn("error", F.lit(None).cast("string")).unionByName(none)


def _answer(request: dict) -> dict:
    if request["user_id"] % 10 == 3:
        raise ValueError("no answer")
    return {"twice": 2 * request["user_id"]}


@query("s15_call_runner", """SELECT user_id, CASE WHEN user_id % 10 = 3 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN user_id % 10 <> 3 THEN 2 * user_id END AS twice, CASE WHEN user_id % 10 = 3 THEN 2 ELSE 1 END AS calls
FROM (SELECT DISTINCT user_id FROM events)""")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """A call an item, logged; the second run only repeats those that failed."""
    log = f"{shared(spark)}/calls"
    request = F.to_json(F.struct("user_id"))
    items = S.table(spark, d, "events").select("user_id").distinct().select(request.alias("request"), files.request_hash("user_id").alias("req_hash"))
    for _ in range(2):
        pulls.run_calls(spark, items, _answer, log, attempts=1)
    rows = spark.read.text(log).select(F.from_json("value", pulls.LOG).alias("r")).select("r.*").withColumn("user_id", F.get_json_object("request", "$.user_id").cast("long"))
    return rows.groupBy("user_id").agg(
        F.when(F.bool_or(F.col("status") == "ok"), "ok").otherwise("failed").alias("status"),
        F.max(F.get_json_object("response", "$.twice").cast("long")).alias("twice"), F.count(F.lit(1)).alias("calls"))


@query("s20_report_source", """WITH c AS (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name),
l AS (SELECT 0 AS i, '#set document(title: "Nations")' AS text UNION ALL SELECT 1, '= Nations' UNION ALL SELECT 2, '' UNION ALL SELECT 3, '== By region' UNION ALL SELECT 4, '#table(' UNION ALL SELECT 5, '  columns: 2,'
  UNION ALL SELECT 6, '  align: (left, right),' UNION ALL SELECT 7, '  table.header([*Region*], [*Nations*]),' UNION ALL SELECT 7 + row_number() OVER (ORDER BY r_name), '  [' || replace(r_name, '_', '\\_') || '], [' || n || '],' FROM c UNION ALL SELECT 8 + (SELECT count(*) FROM c), ')')
SELECT CAST(i AS BIGINT) AS line, text FROM l""")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """The source of a report with a table; compiling it is another program's work."""
    counts = S.table(spark, d, "region").join(S.table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    rows = [tuple(r) for r in counts.orderBy("r_name").collect()]  # a report's rows
    lines = publish.report_source("Nations", [("By region", publish.table_source(["Region", "Nations"], rows, right=[1]))])
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


@query("s21_publish_guards", """SELECT 'n' || n_nationkey || CASE WHEN n_nationkey % 5 = 0 THEN '.bin' ELSE '.txt' END AS file, r.line, r.reason FROM nation, LATERAL (VALUES
  (0, CASE WHEN n_nationkey % 5 = 0 THEN 'not on the list' END), (0, CASE WHEN n_nationkey % 6 = 0 THEN 'over the size ceiling' END),
  (2, CASE WHEN n_nationkey % 6 <> 0 AND n_nationkey % 4 = 0 THEN 'credential: access key' END), (1, CASE WHEN n_nationkey % 6 <> 0 AND n_nationkey % 3 = 1 THEN 'a planning word' END)) AS r(line, reason) WHERE r.reason IS NOT NULL""")
def s21(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files, some with names that no one listed, some too large, some with a key or a word that must stay inside."""
    path = f"{shared(spark)}/out"
    for (k,) in S.table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect():  # a file each
        key = "AKIA" + "ABCDEFGHIJKLMNOP" if k % 4 == 0 else "nothing"
        lines = ["our roadmap says" if k % 3 == 1 else "we say", key, *(["x" * 2_000] if k % 6 == 0 else [])]
        files.write_text(spark, f"{path}/n{k}{'.bin' if k % 5 == 0 else '.txt'}", lines)
    return publish.findings(spark, path, ["*.txt"], {r"(?i)\broadmap\b": "a planning word"}, ceiling=1_000)
