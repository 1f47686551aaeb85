"""Resumable pulls and calls: what is there is skipped, what fails is logged without secrets, and a rerun does the rest.

The caller brings the function that talks to a service; tasks run it, several at a time, and retry with doubling waits.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.files import last_records, pending, shipped

ATTEMPTS, WAIT, LONGEST_WAIT = 6, 1.0, 30.0


class Again(Exception):
    """A service says to try later."""


def redacted(text: str, secrets: Iterable[str]) -> str:
    """Errors may quote an address with a token in it."""
    for s in secrets:
        text = text.replace(s, "***") if s else text
    return text


def tried(f: Callable, attempts: int = ATTEMPTS, wait: float = WAIT, pause: Callable[[float], None] = time.sleep):
    """f(), again after a wait that doubles when it raises Again or a connection fails; the last error stands."""
    for k in range(attempts):
        try:
            return f()
        except (Again, ConnectionError, TimeoutError):
            if k == attempts - 1:
                raise
            pause(min(wait * 2**k, LONGEST_WAIT))


def paged(get: Callable, login: Callable[[], str]) -> Iterator[dict]:
    """Records of all pages: get(token, cursor) gives (records, next cursor or none); a token that is refused (PermissionError)
    is replaced once a page."""
    token, cursor = login(), None
    while True:
        try:
            records, cursor = get(token, cursor)
        except PermissionError:
            token = login()
            records, cursor = get(token, cursor)
        yield from records
        if cursor is None:
            return


def existing(spark: SparkSession, path: str) -> DataFrame:
    """series and month of the chunks that are there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/series=*/month=*")) or []
    names = [f.getPath().toString().rsplit("/", 2)[1:] for f in found]  # a row a chunk, as a reader of the folder lists them anyway
    return spark.createDataFrame([(s.removeprefix("series="), m.removeprefix("month=")) for s, m in names], "series string, month string")


def pull_months(spark: SparkSession, series: list[str], months: list[str], fetch: Callable[[str, str], list[dict]], schema: str, path: str, secrets: tuple[str, ...] = (), attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """Fetch the chunks that are missing below `path` (series=.../month=...) and return what failed (series, month, error).

    fetch(series, month) gives the records of a chunk, by `schema`.  A chunk is written whole or not at all, so that a run that
    broke off is taken up by another one."""
    shipped(spark)
    wanted = spark.createDataFrame([(s, m) for s in series for m in months], "series string, month string")
    todo = wanted.join(existing(spark, path), ["series", "month"], "left_anti").repartition(max(1, min(len(series) * len(months), 32)), "series", "month")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, m in zip(pdf["series"], pdf["month"], strict=True):
                try:
                    records, error = tried(lambda s=s, m=m: list(fetch(s, m)), attempts, wait), None
                except Exception as e:  # whatever a service does wrong is logged, the other chunks go on
                    records, error = [None], redacted(repr(e), secrets)
                rows = [(s, m, error, None if r is None else json.dumps(r, default=str)) for r in records]
                if rows:
                    yield pd.DataFrame(rows, columns=["series", "month", "error", "record"], dtype=object)

    got = todo.mapInPandas(run, "series string, month string, error string, record string")
    log = f"{path}/_pulled"  # a name that readers of the folder pass over
    got.write.mode("overwrite").parquet(log)
    got = spark.read.schema(got.schema).parquet(log)
    rows = got.where("error IS NULL AND record IS NOT NULL").select("series", "month", F.from_json("record", schema).alias("r")).select("r.*", "series", "month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series", "month").parquet(path)
    return got.where("error IS NOT NULL").select("series", "month", "error")


def run_calls(spark: SparkSession, items: DataFrame, call: Callable[[dict], dict], log: str, attempts: int = ATTEMPTS, wait: float = WAIT, secrets: tuple[str, ...] = ()) -> int:
    """Call for every item (req_hash, request: JSON) that the log has no good record of, append a record each, and say how many
    were called."""
    shipped(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        items = pending(items, last_records(spark, log, LOG))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = []
            for key, request in zip(pdf["req_hash"], pdf["request"], strict=True):
                record, began = {"req_hash": key, "request": request}, time.time()
                try:
                    record |= {"status": "ok", "response": json.dumps(tried(lambda r=request: call(json.loads(r)), attempts, wait))}
                except Exception as e:  # a failed call is a record too; it is called again by the next run
                    record |= {"status": "failed", "error": redacted(repr(e), secrets)}
                lines.append(json.dumps(record | {"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "latency_s": round(time.time() - began, 3)}))
            yield pd.DataFrame({"value": lines})

    before = 0 if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else spark.read.text(log).count()
    items.select("req_hash", "request").mapInPandas(run, "value string").write.mode("append").text(log)
    return spark.read.text(log).count() - before


LOG = T.StructType([T.StructField(c, T.StringType()) for c in ("ts", "req_hash", "status", "request", "response", "error")] + [T.StructField("latency_s", T.DoubleType())])
