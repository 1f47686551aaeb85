"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Rows are scaled by the largest norm and given one more component that makes them unit
vectors, queries are made unit vectors; Euclidean order is then inner-product order.  Each of TABLES
tables hashes a vector to WIDTH-wide cells of HASHES Gaussian projections.  A query visits
its own bucket of a table and then perturbed ones, in the order of their estimated
success: the sum of squared distances to the cell borders that the perturbation crosses, by
their expected values, so one order serves all queries (Lv et al.).  The candidates of all tables are merged and
ranked by the inner product of the original vectors in double precision.  Only candidates are scored.

Every row is indexed: the index is a written table of the rows with their TABLES keys, and a
task holds the buckets of its own rows.  So a bucket that holds a third of all rows is spread
over the tasks as the rows are, and no candidate is dropped.  Queries go
to the tasks in blocks of bounded size.

The number of probes is fitted to reach TARGET recall on a sample of at most SAMPLE rows and SAMPLE_BYTES. Neighbours in a
sample are farther than those among all rows, so larger tables do better than the fit says.  Where MOST_PROBES do not reach
it, and for vectors of a length that the sample does not have, all rows of the length are candidates.  A query whose probes
find fewer than k rows is asked once more, of all rows of its length, so a table with few rows gives them all.

Vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do
null ids; vectors meet only others of their length; rows of one vec_id are one item to each other.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, materialize, ship
from plumbline.llm.topk import QUERY_TILE, Lists, blocked, by_length, listed, numbered

TABLES, HASHES, WIDTH = 20, 16, 3.0
K = 20
TARGET = 0.95
SAMPLE, SAMPLE_BYTES, SAMPLE_QUERIES = 16_384, 32 << 20, 200
MOST_PROBES = 4_096
QUERY_BLOCK = 8_192
#: Rows that are visited at a time, and bytes of probes that a task keeps for all its rows.
TILE, PROBE_BYTES = 8_192, 64 << 20
SEED = 20_240_229


def valid(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as doubles) of a batch's rows that take part, by length."""
    by_length: dict[int, tuple[list, list]] = {}
    ids = batch.column(0).to_pylist()
    for i, row in enumerate(batch.column(1)):
        if ids[i] is None or not row.is_valid or not len(row.values) or row.values.null_count:
            continue
        x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all() and x.any():
            a, b = by_length.setdefault(len(x), ([], []))
            a.append(ids[i])
            b.append(x)
    for a, b in by_length.values():
        yield np.array(a, np.int64), np.stack(b)


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    return top[:, 0] * np.sqrt(np.square(x / top).sum(axis=1))


def projections(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and the multipliers that turn a table's cells into one key."""
    rng = np.random.default_rng([SEED, length])
    return rng.standard_normal((TABLES, length + 1, HASHES)), rng.uniform(0, WIDTH, (TABLES, HASHES)), rng.integers(1, 2**62, (TABLES, HASHES)) | 1


def places(unit: np.ndarray, table: int, drawn: tuple) -> np.ndarray:
    """Where unit vectors fall along a table's projections, in cells."""
    return (unit @ drawn[0][table] + drawn[1][table]) / WIDTH


def as_rows(x: np.ndarray, largest: float) -> np.ndarray:
    y = x / largest
    return np.hstack((y, np.sqrt(np.maximum(0.0, 1 - np.square(y).sum(axis=1)))[:, None]))


def as_queries(x: np.ndarray) -> np.ndarray:
    return np.hstack((x / norms(x)[:, None], np.zeros((len(x), 1))))


@functools.cache
def order(hashes: int, most: int) -> list[tuple[int, ...]]:
    """Sets of border ranks (0: the nearest of the 2 * hashes borders) by expected squared distance, the empty set first."""
    j = np.arange(1, hashes + 1)
    near = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    j = np.arange(hashes + 1, 2 * hashes + 1)
    far = 1 - (2 * hashes + 1 - j) / (hashes + 1) + (2 * hashes + 1 - j) * (2 * hashes + 2 - j) / (4 * (hashes + 1) * (hashes + 2))
    cost = np.concatenate((near, far)).tolist()
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < most:
        c, s = heapq.heappop(heap)
        if all(2 * hashes - 1 - r not in s for r in s):  # never both borders of one projection
            found.append(s)
        if s[-1] + 1 < 2 * hashes:
            step = cost[s[-1] + 1]
            heapq.heappush(heap, (c - cost[s[-1]] + step, (*s[:-1], s[-1] + 1)))
            heapq.heappush(heap, (c + step, (*s, s[-1] + 1)))
    return found


def borders(at: np.ndarray) -> np.ndarray:
    """By rank of nearness, which border: i for the lower one of projection i, hashes + i for the upper one.
    Rank r and rank 2 * hashes - 1 - r are always the two borders of one projection."""
    inside = at - np.floor(at)
    low = inside <= 0.5
    i = np.argsort(np.minimum(inside, 1 - inside), axis=1, kind="stable")
    lower = np.take_along_axis(low, i, 1)
    hashes = at.shape[1]
    first = np.where(lower, i, hashes + i)
    second = np.where(lower, hashes + i, i)
    return np.hstack((first, second[:, ::-1]))


def probes(at: np.ndarray, multipliers: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Keys of the buckets that each query visits in a table: queries x sets."""
    hashes = at.shape[1]
    with np.errstate(over="ignore"):
        base = (np.floor(at).astype(np.int64) * multipliers).sum(axis=1)
        ranked = borders(at)
        step = np.where(ranked < hashes, -1, 1) * multipliers[ranked % hashes]  # what crossing each border adds to the key
        keys = np.empty((len(at), len(sets)), np.int64)
        for k, s in enumerate(sets):
            keys[:, k] = base + step[:, list(s)].sum(axis=1) if s else base
    return keys


def fit_probes(ids: np.ndarray, x: np.ndarray, largest: float, k: int) -> int | None:
    """The fewest probes a table that find TARGET of the sample queries' true neighbours; none if MOST_PROBES do not."""
    if len(ids) < 2:
        return None
    drawn, sets = projections(x.shape[1]), order(HASHES, MOST_PROBES)
    asked = np.arange(0, len(ids), max(1, len(ids) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(ids) - 1)
    true = np.argpartition(scores, len(ids) - k, axis=1)[:, len(ids) - k :]
    rows, queries = as_rows(x, largest), as_queries(x[asked])
    needed = np.full(true.shape, MOST_PROBES)
    for t in range(TABLES):
        at = places(queries, t, drawn)
        with np.errstate(over="ignore"):
            keys = (np.floor(places(rows, t, drawn)).astype(np.int64) * drawn[2][t]).sum(axis=1)
        visited = probes(at, drawn[2][t], sets)
        for q in range(len(asked)):
            by = np.argsort(visited[q], kind="stable")
            at_key = np.minimum(np.searchsorted(visited[q], keys[true[q]], sorter=by), len(by) - 1)
            needed[q] = np.minimum(needed[q], np.where(visited[q][by[at_key]] == keys[true[q]], by[at_key], MOST_PROBES))
    least = int(np.sort(needed.ravel())[int(np.ceil(TARGET * needed.size)) - 1])
    return None if least >= len(sets) else 1 + least


def build(rows: DataFrame, folder: str) -> tuple[DataFrame, float]:
    """The index (vec_id, x, keys by table) of all rows that take part, and their largest norm."""
    ship(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long"), "embedding")

    def norm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [float(norms(x).max()) for batch in batches for _, x in valid(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([max(top, default=0.0)])], names=["top"])

    largest = rows.mapInArrow(norm, "top double").agg(F.max("top")).first()[0] or 1.0

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in valid(batch):
                drawn, unit = projections(x.shape[1]), as_rows(x, largest)
                with np.errstate(over="ignore"):
                    keys = np.stack([(np.floor(places(unit, t, drawn)).astype(np.int64) * drawn[2][t]).sum(axis=1) for t in range(TABLES)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(keys), pa.list_(pa.int64()))], names=["vec_id", "x", "keys"])

    return materialize(rows.mapInArrow(index, "vec_id long, x array<double>, keys array<long>"), folder, "index"), largest


def visited(keys: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """queries x rows: whether a row lies in a bucket that the query visits, in any table."""
    seen = np.zeros((len(wanted[0]), len(keys)), bool)
    for t, asked in enumerate(wanted):
        by = np.argsort(keys[:, t], kind="stable")
        held = keys[by, t]
        buckets, begin = np.unique(held, return_index=True)
        at = np.minimum(np.searchsorted(buckets, asked), len(buckets) - 1)
        q, n = np.nonzero(buckets[at] == asked)
        which = at[q, n]
        size = np.diff(np.append(begin, len(held)))[which]
        row = by[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[which], size)]
        seen[np.repeat(q, size), row] = True
    return seen


def best_of(own: np.ndarray, asks: np.ndarray, seen: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Lists:
    """Each query's best k of its candidates (queries x rows); nothing else is scored."""
    norm, out = np.linalg.norm(x, axis=1), []
    for q, ask in enumerate(asks):
        rows = np.flatnonzero(seen[q])
        rows = rows[ids[rows] != own[q]]
        scores = x[rows] @ ask
        if len(rows) > k:
            # a product's last bits depend on its place in the matrix: take what is within rounding of the k-th, then rank exactly
            limit = np.partition(scores, len(rows) - k)[len(rows) - k] - 1e-12 * float(np.linalg.norm(ask)) * float(norm.max())
            rows = rows[scores >= limit]
        out.append((np.full(len(rows), q), ids[rows], (x[rows] * ask).sum(axis=1)))
    return listed(*(np.concatenate(c) for c in zip(*out, strict=True)))


def first_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows of each distinct vector with its `most` smallest ids, `most` of an id: others can't be among anyone's `most` - 1 best."""
    _, group = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}")[:, 0], return_inverse=True)
    by = np.lexsort((ids, group.ravel()))
    group, sorted_ids = group.ravel()[by], ids[by]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (sorted_ids[1:] != sorted_ids[:-1])))  # a new id of the vector
    place = np.arange(len(by))
    item = np.cumsum(new)
    of_vector = item - item[np.searchsorted(group, group, side="left")]
    of_id = place - np.maximum.accumulate(np.where(new, place, 0))
    return by[(of_vector < most) & (of_id < most)]


def search(rows: DataFrame, queries: DataFrame, folder: str, k: int = K, block: int = QUERY_BLOCK, shares: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of the rows that its probes find.

    shares: takes (length, probes a table, share of all pairs that are candidates in the sample) for a report."""
    index, largest = build(rows, folder)
    longest = index.agg(F.max(F.size("x"))).first()[0] or 1
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest)))
    sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select(F.lit(0).cast("long").alias("query"), "vec_id", "x").toArrow()
    counts = {}
    for n, (_, ids, x) in by_length(sample).items():
        counts[n] = fit_probes(ids, x, largest, k)
        if shares is not None:
            shares.append((n, counts[n], share(x, largest, counts[n])))
    asked = numbered(queries, folder, valid)

    def work(batch: pa.RecordBatch, packed: dict, whole: bool, kept: dict) -> list[Lists]:
        lists = []
        lengths = np.diff(batch.column("x").offsets.to_numpy())
        for n in np.unique(lengths).tolist():
            if n not in packed:
                continue
            here = batch.filter(pa.array(lengths == n))
            ids = here.column("vec_id").to_numpy()
            x = here.column("x").flatten().to_numpy().reshape(len(ids), n)
            keys = here.column("keys").flatten().to_numpy().reshape(len(ids), TABLES)
            number, own, asks = packed[n]
            for j in range(0, len(own), QUERY_TILE):
                part, wanted = slice(j, j + QUERY_TILE), None
                if not whole and counts.get(n) is not None:
                    wanted = kept.get((n, j)) or asked_keys(asks[part], counts[n])
                    if sum(w.nbytes for other in kept.values() for w in other) < PROBE_BYTES:
                        kept[n, j] = wanted
                for i in range(0, len(ids), TILE):
                    few = i + first_copies(ids[i : i + TILE], x[i : i + TILE], k + 1)
                    seen = np.ones((len(own[part]), len(few)), bool) if wanted is None else visited(keys[few], wanted)
                    at, *found = best_of(own[part], asks[part], seen, ids[few], x[few], k)
                    lists.append((number[j + at], *found))
        return lists

    def of_a_task(whole: bool):
        """work() for one task's batches: its probes are made once, as far as PROBE_BYTES go."""
        kept: dict = {}
        return lambda batch, packed: work(batch, packed, whole, kept)

    found = blocked(index, asked, f"{folder}/probed", k, block, "double", of_a_task(False))
    found = materialize(found, folder, "probed_tops")
    enough = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query")
    short = materialize(asked.join(enough, "query", "left_anti"), folder, "short")
    if not short.isEmpty():
        anew = numbered(short.select("vec_id", F.col("x").alias("embedding")), f"{folder}/whole", valid)
        again = blocked(index, anew, f"{folder}/whole", k, block, "double", of_a_task(True))
        found = found.join(short.select("query"), "query", "left_anti").unionByName(again)
    forget(rows.sparkSession, folder, "index")  # all lists are written
    return found.select("query_id", "rank", "vec_id", "score")


def asked_keys(asks: np.ndarray, count: int) -> list[np.ndarray]:
    """By table the keys of the buckets that each query visits."""
    drawn, sets = projections(asks.shape[1]), order(HASHES, count)
    unit = as_queries(asks)
    return [probes(places(unit, t, drawn), drawn[2][t], sets) for t in range(TABLES)]


def share(x: np.ndarray, largest: float, count: int | None) -> float:
    """Share of the sample that its queries visit."""
    if count is None:
        return 1.0
    drawn, unit = projections(x.shape[1]), as_rows(x, largest)
    with np.errstate(over="ignore"):
        keys = np.stack([(np.floor(places(unit, t, drawn)).astype(np.int64) * drawn[2][t]).sum(axis=1) for t in range(TABLES)], axis=1)
    asked = np.arange(0, len(x), max(1, len(x) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    return float(visited(keys, asked_keys(x[asked], count)).mean())
