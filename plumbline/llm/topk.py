"""Exact top-k search: tiled integer matrix products, partial selection, tree merging.

Queries go block by block, each of at most `QUERY_BLOCK` vectors and `QUERY_BYTES` (its size is bounded by
parameters, not by the data) to every task.  A task multiplies its rows' tiles with
the block, keeps each query's best k of each tile by partial selection, and merges them into one
list a query and task.  Lists then meet in a two-level tree: by query and group of tasks, then by
query.  A block's lists are written before the next block starts.

Components become floor(scale * x), so products are exact in double precision where no sum
can reach 2**53.  Elsewhere the product with its rounding bound says which few rows can be among the best, and those are
computed in whole numbers of any size.  Scores beyond a long are shown as its ends, but ranked as what they are.
Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids;
vectors meet only others of their length.  Rows of one vec_id are one item to each
other: none is a candidate of the other; repeated rows of other ids are candidates each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, ship

SCALE = 1024
K = 10
QUERY_BLOCK, QUERY_BYTES = 16_384, 32 << 20
TILE, QUERY_TILE = 4_096, 1_024
EXACT = 2.0**53
LIMITS = (1 - 2**63, 2**63 - 1)
#: Bytes of a whole-number score as a sort key, enough for the largest floats, and what makes it positive.
KEY_BYTES = 48
KEY_SHIFT = 1 << (8 * KEY_BYTES - 1)
#: A query's place, the id and score of a row that it found, and a sort key for scores beyond a long (else empty).
Lists = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def vectors(batch: pa.RecordBatch, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number components as doubles) of a batch's valid rows (vec_id, embedding), by length."""
    by_length: dict[int, tuple[list, list]] = {}
    ids = batch.column(0).to_pylist()
    for i, row in enumerate(batch.column(1)):
        if ids[i] is None or not row.is_valid or not len(row.values) or row.values.null_count:
            continue
        x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            a, b = by_length.setdefault(len(x), ([], []))
            a.append(ids[i])
            b.append(np.nan_to_num(x))
    for a, b in by_length.values():
        yield np.array(a, np.int64), np.stack(b)


def listed(at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> Lists:
    return at, ids, scores, np.zeros(len(at), f"S{KEY_BYTES}")


def tops(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Lists:
    """Each query's best k of one tile."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    n, k = len(ids), min(k, len(ids))
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if bound * (n + 1) >= EXACT:
        return large_tops(query_ids, queries, ids, rows, k)
    # (score, smaller id first) as one number, so that partial selection breaks ties
    key = (queries @ rows.T) * n + np.arange(n - 1, -1, -1)
    key[query_ids[:, None] == ids[None, :]] = -np.inf
    best = np.argpartition(key, n - k, axis=1)[:, n - k :]
    found = np.take_along_axis(key, best, 1)
    at, col = np.nonzero(np.isfinite(found))
    return listed(at, ids[best[at, col]], np.floor(found[at, col] / n).astype(np.int64))


def large_tops(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Lists:
    """tops() where sums may pass what a double holds: whole numbers for what can be among the best, by distinct rows."""
    distinct, group = np.unique(rows, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.argsort(group, kind="stable")  # ids are sorted, so they are within each group
    begin = np.searchsorted(group[by], np.arange(len(distinct) + 1))
    biggest = lambda x: np.abs(x).max(axis=1, initial=0)
    slack = biggest(queries)[:, None] * biggest(distinct)[None, :] * (queries.shape[1] ** 2 * 2.0**-51)
    near = queries @ distinct.T
    most = min(k + 1, len(distinct))  # one of them may hold nothing but the query's own id
    limit = np.partition(near - slack, len(distinct) - most, axis=1)[:, len(distinct) - most]
    whole: dict[int, list[int]] = {}
    out = []
    for q, (own, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        query, scored = [int(x) for x in query], []
        for g in np.flatnonzero(near[q] + slack[q] >= limit[q]).tolist():
            row = whole.get(g)
            if row is None:
                row = whole[g] = [int(x) for x in distinct[g]]
            few = ids[by[begin[g] : begin[g + 1]]]
            few = few[few != own][:k].tolist()
            score = -sum(a * b for a, b in zip(query, row, strict=True)) if few else 0
            scored += [(score, i) for i in few]
        out += [(q, i, -s) for s, i in sorted(scored)[:k]]
    at, found, score = zip(*out, strict=True) if out else ((), (), ())
    shown = [min(max(s, LIMITS[0]), LIMITS[1]) for s in score]
    keys = [(s + KEY_SHIFT).to_bytes(KEY_BYTES, "big") if s in LIMITS or v != s else b"" for s, v in zip(score, shown, strict=True)]
    return np.array(at, np.int64), np.array(found, np.int64), np.array(shown, np.int64), np.array(keys, f"S{KEY_BYTES}")


def merge(parts: list[Lists], k: int) -> Lists:
    """The best k a query of several lists."""
    at, ids, score, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -np.unique(key, return_inverse=True)[1].ravel(), -score, at))
    at, ids, score, key = at[order], ids[order], score[order], key[order]
    first = np.searchsorted(at, at, side="left")
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[keep], score[keep], key[keep]


def numbered(queries: DataFrame, folder: str, valid: Callable = vectors) -> DataFrame:
    """Valid queries with a gapless number, by counters within tasks and a prefix sum over tasks."""
    schema = "vec_id long, x array<double>, task int, at long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, rows in valid(batch):
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(rows), pa.list_(pa.float64())), pa.array([task] * n, pa.int32()), pa.array(np.arange(seen, seen + n))], names=["vec_id", "x", "task", "at"])
                seen += n

    made = materialize(queries.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, schema), folder, "queries")
    before = made.groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return materialize(made.join(before, "task").select((F.col("before") + F.col("at")).alias("query"), "vec_id", "x"), folder, "numbered")


def by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (numbers, ids, vectors) of collected queries (query, vec_id, x)."""
    out, x = {}, table.column("x").combine_chunks()
    lengths = np.diff(x.offsets.to_numpy())
    for n in np.unique(lengths):
        here = table.filter(pa.array(lengths == n))
        flat = here.column("x").combine_chunks().flatten().to_numpy()
        out[int(n)] = here.column("query").to_numpy(), here.column("vec_id").to_numpy(), flat.reshape(-1, n)
    return out


def blocked(rows: DataFrame, asked: DataFrame, folder: str, k: int, block: int, score: str, work: Callable) -> DataFrame:
    """query, query_id, rank, vec_id, score: work(batch, packed) gives the lists of each
    batch of `rows` for one block of queries, packed by length as (numbers, ids, vectors)."""
    spark = rows.sparkSession
    ends = asked.agg(F.min("query"), F.max("query"), F.max(F.size("x"))).first()
    first, total, longest = (0, 0, 1) if ends[0] is None else (ends[0], ends[1] + 1, ends[2])
    block = max(1, min(block, QUERY_BYTES // (8 * longest)))

    def one(begin: int) -> DataFrame:
        got = asked.where((F.col("query") >= begin) & (F.col("query") < begin + block)).select("query", "vec_id", "x")
        packed = spark.sparkContext.broadcast(by_length(got.toArrow()))  # `block` rows at most

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, held = TaskContext.get().partitionId(), []
            for batch in batches:
                held += work(batch, packed.value)
                if len(held) > 1:
                    held = [merge(held, k)]
            if held:
                at, found, scores, keys = held[0]
                keys = pa.array([x.ljust(KEY_BYTES, b"\0") or None for x in keys.tolist()] if keys.any() else [None] * len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found), pa.array(scores), keys, pa.array(np.full(len(at), task, np.int64))], names=["query", "vec_id", "score", "key", "task"])

        lists = rows.mapInArrow(run, f"query long, vec_id long, score {score}, key binary, task long")
        best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("key"), "vec_id"))
        some = lists.withColumn("group", F.pmod("task", F.lit(16))).withColumn("r", best("query", "group")).where(F.col("r") <= k)
        return some.withColumn("rank", best("query")).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score")

    made = materialize(one(first), folder, f"tops{first}")
    for begin in range(first + block, total, block):
        made = made.unionByName(materialize(one(begin), folder, f"tops{begin}"))
    return made.join(asked.select("query", F.col("vec_id").alias("query_id")), "query").select("query", "query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries: DataFrame, folder: str, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of `rows` (both: vec_id, embedding)."""
    ship(rows.sparkSession)

    def work(batch: pa.RecordBatch, packed: dict) -> list[Lists]:
        lists = []
        for ids, x in vectors(batch):
            if x.shape[1] in packed:
                number, own, asks = packed[x.shape[1]]
                for i in range(0, len(ids), TILE):
                    for j in range(0, len(own), QUERY_TILE):
                        at, *found = tops(own[j : j + QUERY_TILE], asks[j : j + QUERY_TILE], ids[i : i + TILE], x[i : i + TILE], k)
                        lists.append((number[j + at], *found))
        return lists

    found = blocked(rows.select(F.col("vec_id").cast("long"), "embedding"), numbered(queries, folder), folder, k, block, "long", work)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= {K}
"""
