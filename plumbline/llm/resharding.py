"""Resharding by minimum-cost flow.

A layout is a folder of Parquet files, `shard=<n>/block=<name>/`.  A block is what one task wrote to one shard; each of its rows
carries its place and the bytes before it, so a shard is a line of bytes: its blocks one after the other, in
order of name.  Only the shards' sizes and the new capacities
go to the driver; a flow network between them (keeping a byte costs nothing, moving it costs
one) gives how many bytes go from which shard to which.  Each old shard's line is
cut there, its first part stays, and a cut lies in one block at one byte; there are at most
shards x shards of them.

Blocks before a shard's first cut are left as they are.  The other blocks' rows are written to their new shards, and what stays of
a block that a cut goes through to its own, all under new names and beside the layout.  Then a journal of the new and the
outdated blocks is written, the new blocks are moved in and the outdated ones deleted; commit() does that from the journal and can be
run again after a failure.  Afterwards the folder holds every row once.  All stages are narrow: no text is shuffled.

Law: `bytes`.  A row goes to where its middle byte lies, so a cut is off by half a row at most.
Slots are gapless in each shard, from the counts of rows before each block.

Null texts have size 1; null ids, repeated rows and ties need no special care, as nothing goes
by key; columns of the input are kept but for those that are named as the layout's own (OWN), which are dropped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.settle import remove
from plumbline.llm.common import ship

SHARDS = 8
#: The layout's columns: a row's bytes, its place in its block, the bytes before it there, and what the folders are named after.
OWN = ["size", "place", "before", "shard", "block"]
JOURNAL = "action string, shard int, block string"


def size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def lay_out(docs: DataFrame, path: str, shard: Column, shards: int = SHARDS) -> DataFrame:
    """Write `docs` as a layout of `shards` shards below `path`; shard: each row's, from 0."""
    ship(docs.sparkSession)
    docs = docs.withColumn("\0shard", shard.cast("int")).drop(*OWN).withColumnRenamed("\0shard", "shard").withColumn("size", size())
    schema = T.StructType([*docs.schema, T.StructField("place", T.LongType()), T.StructField("before", T.LongType()), T.StructField("block", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, used = f"{TaskContext.get().partitionId():07d}", [0] * shards, [0] * shards
        for batch in batches:
            # long rows first: a cut then tends to lie among short ones, which makes the parts more even
            batch = batch.take(pc.sort_indices(batch.column("size"), sort_keys=[("", "descending")]))
            place, before = [], []
            for s, n in zip(batch.column("shard").to_pylist(), batch.column("size").to_pylist(), strict=True):
                place.append(rows[s])
                before.append(used[s])
                rows[s] += 1
                used[s] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(before, pa.int64()), pa.array([block] * len(place))], names=schema.names)

    made = docs.mapInArrow(run, schema)
    made.write.mode("overwrite").partitionBy("shard", "block").parquet(path)
    return read(docs.sparkSession, path, made.schema)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A layout's rows, with shard and block from the names of its folders."""
    kept = [f for f in schema if f.name not in ("shard", "block")]
    return spark.read.schema(T.StructType([*kept, T.StructField("shard", T.IntegerType()), T.StructField("block", T.StringType())])).parquet(path)


def flow(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard that keep to the capacities and move the fewest:
    successive shortest augmenting paths, where staying is free and any move costs one a byte."""
    if sum(capacities) < sum(sizes):
        raise ValueError("the new shards are too small")
    n, m = len(sizes), len(capacities)
    sent: dict[tuple[int, int], int] = {}
    left, room = list(sizes), list(capacities)
    while True:
        # Dijkstra would do as well; the costs are 0 and 1, and a step back along a used edge returns its cost
        cost: dict[tuple[str, int], tuple[int, tuple | None]] = {("old", i): (0, None) for i in range(n) if left[i]}
        queue = deque(cost)
        while queue:
            kind, i = node = queue.popleft()
            here = cost[node][0]
            if kind == "old":
                steps = [(("new", j), here + (i != j)) for j in range(m)]
            else:
                steps = [(("old", o), here - (o != i)) for (o, j), b in sent.items() if j == i and b]
            for to, c in steps:
                if to not in cost or c < cost[to][0]:
                    cost[to] = (c, node)
                    queue.append(to)
        ends = [(cost[("new", j)][0], j) for j in range(m) if room[j] and ("new", j) in cost]
        if not ends:
            return {k: b for k, b in sent.items() if b}
        _, j = min(ends)
        path, node = [], ("new", j)
        while node is not None:
            path.append(node)
            node = cost[node][1]
        path.reverse()
        pairs = list(zip(path, path[1:], strict=False))
        amount = min([left[path[0][1]], room[j], *(sent[(b[1], a[1])] for a, b in pairs if a[0] == "new")])
        for a, b in pairs:
            if a[0] == "old":
                sent[(a[1], b[1])] = sent.get((a[1], b[1]), 0) + amount
            else:
                sent[(b[1], a[1])] -= amount
        left[path[0][1]] -= amount
        room[j] -= amount


def cuts(sizes: list[int], moved: dict[tuple[int, int], int]) -> list[list[tuple[int, int]]]:
    """By old shard: (first byte, new shard) of the parts of its line; what stays comes first, even if it is nothing."""
    out = []
    for i in range(len(sizes)):
        at, parts = 0, []
        for j in [i, *sorted(j for o, j in moved if o == i and j != i)]:
            parts.append((at, j))
            at += moved.get((i, j), 0)
        out.append(parts)
    return out


@dataclass(frozen=True)
class Moved:
    """What a resharding did: bytes that changed their shard, blocks written anew, and outdated ones that went."""

    bytes: int
    written: int
    gone: int


def commit(spark: SparkSession, path: str, aside: str) -> None:
    """Move the new blocks into the layout and delete the outdated ones, as the journal says; may be run again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    files = at(path).getFileSystem(conf)
    for r in spark.read.schema(JOURNAL).parquet(f"{aside}/journal").collect():  # a row a block: as many as a reader of the layout lists anyway
        folder = f"shard={r['shard']}"
        if r["action"] == "add" and files.exists(at(aside, "new", folder, f"block={r['block']}")):
            files.mkdirs(at(path, folder))
            if not files.rename(at(aside, "new", folder, f"block={r['block']}"), at(path, folder, f"block={r['block']}")):
                raise OSError(f"could not move block {r['block']} into shard {r['shard']}")
        elif r["action"] == "drop":
            files.delete(at(path, folder, f"block={r['block']}"), True)


def reshard(spark: SparkSession, path: str, aside: str, schema: T.StructType, shards: int = SHARDS, capacities: list[int] | None = None) -> Moved:
    """Move rows of the layout at `path` so that shards keep to the capacities (equal ones by default); `aside` is a folder
    of the same store for what is not part of the layout yet."""
    layout = read(spark, path, schema)
    sums = layout.groupBy("shard", "block").agg(F.sum("size").alias("bytes"), F.min("before").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    line = sums.select("shard", "block", "bytes", "first", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"))
    line.write.mode("overwrite").parquet(f"{aside}/blocks")
    line = spark.read.schema(line.schema).parquet(f"{aside}/blocks")
    totals = {r["shard"]: r["n"] for r in line.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
    old = max([shards, *(s + 1 for s in totals)])
    sizes = [totals.get(s, 0) for s in range(old)]
    total = sum(sizes)
    parts = cuts(sizes, flow(sizes, capacities or [(total + k) // shards for k in range(shards)]))

    # each cut as (block, bytes before it in the block)
    wanted = [(s, k, at) for s, p in enumerate(parts) for k, (at, _) in enumerate(p)]
    asked = spark.createDataFrame(wanted, "s int, k int, at long")  # shards x shards rows at most
    inside = (F.col("s") == F.col("shard")) & (F.col("at") >= F.col("bytes_before")) & (F.col("at") < F.col("bytes_before") + F.col("bytes"))
    found = line.join(F.broadcast(asked), inside).select("s", "k", "at", "block", "bytes_before", "first").collect()
    where = {(r["s"], r["k"]): (r["block"], r["at"] - r["bytes_before"] + r["first"]) for r in found}
    middle = F.col("before") + (F.col("size") / 2)
    to = F.col("shard")
    for s, p in enumerate(parts):
        for k, (_, shard) in enumerate(p):
            if (s, k) in where:  # else it begins at the line's end and holds nothing
                block, offset = where[s, k]
                here = (F.col("shard") == s) & ((F.col("block") > block) | ((F.col("block") == block) & (middle >= offset)))
                to = F.when(here, F.lit(shard)).otherwise(to)  # later cuts win, as they are the outer cases
    dealt = layout.withColumn("to", to.cast("int"))
    left = dealt.where("to <> shard").groupBy("shard", "block").agg(F.sum("size").alias("n"))
    left.write.mode("overwrite").parquet(f"{aside}/left")
    left = spark.read.schema(left.schema).parquet(f"{aside}/left")
    touched = F.broadcast(left.select("shard", "block"))  # a row a block: as many as a reader of the layout lists anyway
    name = F.concat("block", F.when(F.col("to") == F.col("shard"), F.lit("-kept")).otherwise(F.concat(F.lit("-from"), F.col("shard"))))
    new = dealt.join(touched, ["shard", "block"], "left_semi").withColumns({"block": name, "shard": F.col("to")}).drop("to")
    new.write.mode("overwrite").partitionBy("shard", "block").parquet(f"{aside}/new")
    added = read(spark, f"{aside}/new", schema).select(F.lit("add").alias("action"), "shard", "block").distinct()
    journal = added.unionByName(left.select(F.lit("drop").alias("action"), "shard", "block"))
    journal.write.mode("overwrite").parquet(f"{aside}/journal")
    commit(spark, path, aside)
    done = spark.read.schema(JOURNAL).parquet(f"{aside}/journal").agg(F.count_if(F.col("action") == "add"), F.count_if(F.col("action") == "drop")).first()
    moved = Moved(left.agg(F.sum("n")).first()[0] or 0, done[0], done[1])
    for name in ("blocks", "left", "new", "journal"):
        remove(spark, f"{aside}/{name}")
    return moved


def slots(rows: DataFrame) -> DataFrame:
    """`rows` of a layout (with shard, block and place; leave the texts out before) and their slots, from 0 in each shard."""
    counted = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n_"), F.min("place").alias("first_"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("shard", "block", (F.coalesce(F.sum("n_").over(earlier), F.lit(0)) - F.col("first_")).alias("base_"))
    return rows.join(base, ["shard", "block"]).withColumn("slot", F.col("base_") + F.col("place")).drop("base_")


def digests(docs: DataFrame, folder: str) -> DataFrame:
    """Documents lie in shards by source first; then the shards are made equal in bytes, and the folder is read back."""
    source = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(SHARDS))
    layout = lay_out(docs.select("doc_id", "text", "source"), f"{folder}/layout", source)
    reshard(docs.sparkSession, f"{folder}/layout", f"{folder}/aside", layout.schema)
    now = read(docs.sparkSession, f"{folder}/layout", layout.schema)
    placed = slots(now.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard", "block", "place"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
