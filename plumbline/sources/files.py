"""File sources and sinks: localized CSV, JSON logs, monthly series, sanitised and deterministic outputs."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])

CHOICE_LOG = T.StructType([
    T.StructField("ts", T.StringType()), T.StructField("req_hash", T.StringType()), T.StructField("status", T.StringType()), T.StructField("latency_s", T.DoubleType()),
    T.StructField("meta", T.StructType([T.StructField("set", T.StringType()), T.StructField("id", T.StringType()), T.StructField("pert", T.StringType()), T.StructField("rep", T.IntegerType())])),
    T.StructField("response", T.StructType([T.StructField("choice", T.StringType()), T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())), T.StructField("confidence", T.DoubleType())])),
])


def shipped(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def localized_number(name: str) -> Column:
    """'1.234,50' -> 1234.5; blank or unreadable: null."""
    return F.expr(f"try_cast(replace(replace(trim(`{name}`), '.', ''), ',', '.') AS double)")


def localized_csv(spark: SparkSession, path: str, numbers: list[str], day: str = "Datum", begin: str = "von", zone: str = "Zeitzone", utc: str = "UTC") -> DataFrame:
    """A semicolon table read as text: ts from a day and a time of day, and trimmed, localized numbers; any zone but UTC is refused."""
    raw = spark.read.option("header", True).option("sep", ";").option("inferSchema", False).csv(path)
    wrong = raw.where(F.trim(F.col(zone)) != utc).limit(1).count()
    if wrong:
        raise ValueError("times must be in UTC")
    ts = F.to_timestamp(F.concat_ws(" ", F.trim(F.col(day)), F.trim(F.col(begin))), "dd.MM.yyyy HH:mm")
    return raw.select(ts.alias("ts"), *[localized_number(n).alias(n) for n in numbers])


def monthly_series(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """All monthly files, a row a time: the one of the first file by name, then by place in it."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("f_"), F.col("_metadata.row_index").alias("i_"))
    return rows.withColumn("k_", F.row_number().over(Window.partitionBy(ts).orderBy("f_", "i_"))).where("k_ = 1").drop("f_", "i_", "k_")


def last_records(spark: SparkSession, path: str, schema: T.StructType = CHOICE_LOG, key: str = "req_hash", status: str = "ok", time: str = "ts") -> DataFrame:
    """The last good record of each request in an append-only JSON log: the latest by its own time, of equal times the one in
    the file with the last name, and there the last line.  (A scan takes files by size, so lines alone have no order across files.)"""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "line_").select("r.*", "line_").where(F.col("status") == status)
    return rows.withColumn("k_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc("line_")))).where("k_ = 1").drop("line_", "k_")


def request_hash(*parts: str | Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def pending(items: DataFrame, done: DataFrame, key: str = "req_hash") -> DataFrame:
    """Items without a record: what a resumed run still has to do."""
    return items.join(done.select(key), key, "left_anti")


def trace_csv(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """A latin-1 table of which only the columns with these keywords are read."""
    wide = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    names = [c for c in wide.columns if any(k.lower() in c.lower() for k in keywords)]
    return wide.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names])


def header_block(rows: list[list]) -> tuple[list[dict], list[dict]]:
    """A sheet of names, nominals, upper and lower tolerances in its first four rows, measurements below:
    (limits, long measurements).  The caller reads the sheet; Spark has no reader for it."""
    names, nominal, upper, lower = rows[:4]
    limits = [{"dimension": n, "nominal": float(a), "upper": float(a) + float(u), "lower": float(a) + float(v)} for n, a, u, v in zip(names, nominal, upper, lower, strict=True) if n]
    long = [{"part": i, "dimension": n, "value": None if x is None else float(x)} for i, row in enumerate(rows[4:]) for n, x in zip(names, row, strict=True) if n]
    return limits, long


def filled_curve(points: DataFrame, start: str, length: str, position: str, value: str) -> DataFrame:
    """start, position, value with every position from 1 to the length; an absent one repeats the one before."""
    axis = points.groupBy(start).agg(F.first(length).alias("n_")).select(start, F.explode(F.sequence(F.lit(1), F.col("n_"))).alias(position))
    w = Window.partitionBy(start).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return axis.join(points.select(start, position, value), [start, position], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


PERIOD = "timeInterval struct<start:string,end:string>, resolution string, Point array<struct<position:int,quantity:double>>"


def xml_series(spark: SparkSession, path: str) -> DataFrame:
    """ts, value of the periods of time-series documents.  A period says its interval, the step (PT15M, PT1H) and its points by
    position; a position that it leaves out repeats the one before."""
    raw = spark.read.format("xml").option("rowTag", "Period").schema(PERIOD).load(path)
    number = F.regexp_extract("resolution", r"^PT(\d+)[MH]$", 1).cast("int")
    minutes = F.when(F.col("resolution").endswith("H"), 60 * number).otherwise(number)
    start, end = F.to_timestamp("timeInterval.start", "yyyy-MM-dd'T'HH:mmX"), F.to_timestamp("timeInterval.end", "yyyy-MM-dd'T'HH:mmX")
    periods = raw.select(start.alias("start"), minutes.alias("minutes"), ((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60 / minutes).cast("int").alias("n"), "Point")
    points = periods.select("start", "minutes", "n", F.explode("Point").alias("p")).select("start", "minutes", "n", "p.position", "p.quantity")
    filled = filled_curve(points, "start", "n", "position", "quantity").join(periods.select("start", "minutes").distinct(), "start")
    at = F.timestamp_seconds(F.unix_timestamp("start") + (F.col("position") - 1) * F.col("minutes") * 60)
    return filled.select(at.alias("ts"), F.col("quantity").alias("value"))


def tolerance_sheet(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(limits, long measurements) of a sheet saved as one CSV file: rows of names, nominals, upper and lower tolerances, each
    named in the first column, then a row a part.  Only the four head rows are looked at to plan; the body stays a scan."""
    lines = spark.read.text(path)
    cut = F.split("value", sep, -1)
    head = {r[0][0]: r[0][1:] for r in lines.where(F.split("value", sep).getItem(0).isin("name", "nominal", "upper", "lower")).select(cut).collect()}  # four rows
    limits, _ = header_block([head["name"], head["nominal"], head["upper"], head["lower"]])
    body = lines.where(~F.split("value", sep).getItem(0).isin("name", "nominal", "upper", "lower")).select(cut.alias("c"))
    cells = F.filter(F.array(*[F.struct(F.lit(n).alias("dimension"), F.expr(f"try_cast(nullif(trim(get(c, {i + 1})), '') AS double)").alias("value")) for i, n in enumerate(head["name"])]), lambda x: x["dimension"] != "")
    long = body.select(F.col("c").getItem(0).alias("part"), F.explode(cells).alias("x")).select("part", "x.dimension", "x.value")
    return spark.createDataFrame(limits, "dimension string, nominal double, upper double, lower double"), long


def finite(df: DataFrame) -> DataFrame:
    """Non-finite doubles become null, as JSON has no word for them."""
    fix = {f.name: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fix) if fix else df


def write_months(df: DataFrame, path: str, ts: str = "ts") -> None:
    """One folder a UTC month; months in `df` are replaced, others stay."""
    out = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Line feeds only, so that the bytes are the same everywhere.  For reports of a few rows, from the driver to any store that Spark writes to."""
    write_bytes(spark, path, ("\n".join(lines) + "\n").encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), bytes and sha256 of every file of a report folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over names and digests of all files of a report folder, in order of name."""
    whole = hashlib.sha256()
    for name, digest in sorted((r["file"], r["sha256"]) for r in file_digests(spark, path).collect()):  # a row a file
        whole.update(name.encode() + b"\0" + bytes.fromhex(digest))
    return whole.hexdigest()
