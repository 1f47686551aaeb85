"""SimHash near-duplicates: fingerprints, links within a Hamming radius, and components.

Meet in the middle: two fingerprints at most three bits apart share a variant that is at
most one bit from one and two from the other.  Each distinct fingerprint so has 65 near
variants and 2,081 far ones, and the pairs that collide on a variant are the links.
Variants are dealt by their first bits.  A fingerprint is sent once to each cell that its
ball touches, and the cell makes the variants there, so the shuffle carries a few
dozen rows a fingerprint instead of thousands.  Every variant of one cell meets in it.

A variant links all that touch it to any fingerprint that is near it, so a cell keeps a
spanning forest of its links and never lists the pairs of a group: it gives at most one
edge a fingerprint.  A cell that would hold more than CELL_MOST fingerprints is dealt by further bits, ball and all,
before anything is shuffled.  Components then come from alternating large-star and small-star
steps over these edges, each written to the shared folder; a hub's edges meet its least neighbour where they are.

similar() is the same method for word-shingle similarity: near copies at a Jaccard similarity of 0.8
differ in some 15 % of SimHash bits, far beyond a ball of 64-bit words.  There a document has
256 bits.  PARTS overlapping words of 32 bits of it are the keys.  Keys are dealt by their first DEALT_BITS bits, which have to be
equal, and have a radius of four in the others: every key emits all variants within two bits, and whatever
meets on a variant within a loose bound on all 256 bits is proposed.  What meets does not depend on the size of the
corpus: more documents only deal the cells by further bits.  Components of proposals are then taken apart by
the exact similarity of their shingle sets: all texts of one are compared with the one nearest to the majority of its
bits, and those that are not similar to that with all texts of the component, in parts of bounded size.

Null texts count as empty (fingerprint zero, linked like any other); repeated rows share a
fingerprint and so a component; a null doc_id is kept and never names a component unless
all of its component are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import forget, materialize, ship, spread_join

BITS = 64
NEAR, FAR = 1, 2
SEED = 42
#: Hashes whose bits are counted at a time; bounds the memory that a long text takes.
COUNT_AT_ONCE = 1 << 16
#: Fingerprints that a cell expands at a time: 2,081 variants of 8 bytes each.
EXPAND_AT_ONCE = 1_000
#: Fingerprints that a cell holds at most, unless they agree in their further bits too.
CELL_MOST = 1 << 20
#: Further bits by which a larger cell is dealt: as few of these as bring it under the limit.
FURTHER = (4, 8, 12, 16)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over word shingles; `text` lower-cased in A-Z only."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    begins = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, COUNT_AT_ONCE):
        hashes = np.array([digest(joined[b:e], SEED) for b, e in zip(begins[at : at + COUNT_AT_ONCE], ends[at : at + COUNT_AT_ONCE], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def masks(bits: int, flips: int) -> np.ndarray:
    """All words with exactly so many ones among their lowest bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), flips)], dtype=np.uint64)


def forest(fps: np.ndarray, apart: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links that show in one cell.

    fps: distinct fingerprints whose ball touches the cell; apart: in how many of the
    cell's bits each differs from it; low: the number of bits below the cell's."""
    none = np.empty(0, np.int64)
    if len(fps) < 2:
        return none, none
    rest = fps & np.uint64((1 << low) - 1)
    by_flips = [masks(low, k) for k in range(FAR + 1)]

    def ball(rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Variants of these rows that lie in the cell (their low bits), and the row of each."""
        values, owners = [], []
        for flips in range(radius + 1):
            own = rows[apart[rows] <= radius - flips]
            values.append((rest[own, None] ^ by_flips[flips][None, :]).ravel())
            owners.append(np.repeat(own, len(by_flips[flips])))
        return np.concatenate(values), np.concatenate(owners)

    near, near_of = ball(np.flatnonzero(apart <= NEAR), NEAR)
    if not len(near):
        return none, none
    order = np.lexsort((near_of, near))
    near, near_of = near[order], near_of[order]
    head = np.concatenate(([True], near[1:] != near[:-1]))
    lead = near_of[head]  # the first row near each variant stands for all that touch it
    keys = near[head]
    slots = 1 << max(10, int(4 * len(keys)).bit_length())
    seen = np.zeros(slots, bool)  # most far variants are near nothing: a table of hashes sends them off at once
    slot = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)
    seen[slot(keys)] = True
    a, b = [np.repeat(lead, np.diff(np.append(np.flatnonzero(head), len(near))))], [near_of]
    for at in range(0, len(fps), EXPAND_AT_ONCE):
        far, far_of = ball(np.arange(at, min(at + EXPAND_AT_ONCE, len(fps))), FAR)
        kept = np.flatnonzero(seen[slot(far)])
        far, far_of = far[kept], far_of[kept]
        found = np.minimum(np.searchsorted(keys, far), len(keys) - 1)
        hit = keys[found] == far
        pairs = np.unique(np.stack((lead[found[hit]], far_of[hit])), axis=1)
        a.append(pairs[0])
        b.append(pairs[1])
    return spanning(np.concatenate(a), np.concatenate(b), len(fps))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) of every row that isn't the root of its tree, for links between n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


def cell_bits(fingerprints: int) -> int:
    """First bits by which variants are dealt: some 2,000 fingerprints to each cell's own part."""
    return int(max(4, np.ceil(np.log2(max(1, fingerprints) / 2_000))))


def flips_of(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, ones) of every cell that a ball of that radius touches."""
    return [(int(m), k) for k in range(most + 1) for m in masks(bits, k)]


def split(dealt: DataFrame, value: str, low: int, radius: int, total: int, folder: str) -> DataFrame:
    """`dealt` (with cell, apart and `value`, whose lowest `low` bits are not dealt yet), where cells of over CELL_MOST
    rows are dealt by further bits.  Adds more (how many bits) and sub (which of their values), and counts them in apart.

    `total` values go to a cell at most, so with fewer than CELL_MOST there is nothing to look for."""
    if total <= CELL_MOST:
        return dealt.withColumns({"more": F.lit(0), "sub": F.lit(0).cast("long")})
    further = [x for x in FURTHER if x < low]
    n, more = F.col("n_"), F.lit(further[-1])
    for x in reversed(further[:-1]):
        more = F.when(n * (len(flips_of(x, radius)) / 2**x) <= CELL_MOST, x).otherwise(more)
    large = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n_")).where(n > CELL_MOST).select("cell", more.alias("more"))
    cells = materialize(large, folder, "large_cells")
    touched = F.array(F.struct(F.lit(0).cast("long").alias("m"), F.lit(0).alias("k")))
    for x in further:
        ball = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in flips_of(x, radius)])
        touched = F.when(F.col("more") == x, F.filter(ball, lambda c: c["k"] <= radius - F.col("apart"))).otherwise(touched)
    each = dealt.join(cells, "cell", "left").withColumn("more", F.coalesce("more", F.lit(0))).withColumn("c_", F.explode(touched))
    own = F.expr(f"shiftrightunsigned({value}, {low} - more) & (shiftleft(1L, more) - 1)")
    return each.withColumns({"sub": own.bitwiseXOR(F.col("c_.m")), "apart": F.col("apart") + F.col("c_.k")}).drop("c_")


def links(distinct: DataFrame, total: int, folder: str, bits: int | None = None) -> DataFrame:
    """Edges (a, b) of spanning forests of all links between `total` distinct fingerprints (column fp)."""
    ship(distinct.sparkSession)
    bits = cell_bits(total) if bits is None else bits
    low = BITS - bits
    touched = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("apart")) for m, k in flips_of(bits, FAR)]))
    dealt = (
        distinct.select("fp", touched.alias("c"))
        .select(F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("c.m")).alias("cell"), "fp", F.col("c.apart").cast("int").alias("apart"))
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(cell):  # a pyarrow Table in and out; Spark infers the kind from the missing hints
        fps = cell.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        apart = cell.column("apart").to_numpy()
        order = np.argsort(fps, kind="stable")
        fps, apart = fps[order], apart[order]
        rows, roots = forest(fps, apart, low - cell.column("more")[0].as_py())
        return pa.table({"a": fps[rows].view(np.int64), "b": fps[roots].view(np.int64)})

    return split(dealt, "fp", low, FAR, total, folder).groupBy("cell", "more", "sub").applyInArrow(run, schema)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, component (its smallest node) for every node of an edge; large-star and small-star
    in turn until nothing changes.  Each round is written, so plans and lineage stay short, and the one before goes."""
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, k = materialize(edges, folder, "edges0"), 0

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        """Each node's larger (or smaller) neighbours, and itself, to its smallest neighbour or itself."""
        both = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = spread_join(both, least, "u", 2 * total if large else total)
        moved = joined.where("v > u").select("m", "v") if large else joined.select("m", "v").unionByName(least.select("m", F.col("u").alias("v")))
        return moved.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    while before[0]:
        k += 1
        larger = materialize(star(edges, True, before[0]), folder, f"large{k}")
        edges = materialize(star(larger, False, larger.count()), folder, f"edges{k}")
        forget(spark, folder, f"large{k}", f"edges{k - 1}")
        after = print_of(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


WIDE, KEY_BITS, PARTS, HALF = 256, 32, 15, 2
#: First bits of a key that have to be equal in similar().  More of them would lose pairs, so their number is fixed.
DEALT_BITS = 4
#: Pairs of fingerprints that are compared at a time.
COMPARE_AT_ONCE = 1 << 18
#: Fingerprints of which a cell of similar() makes the variants at a time, about.
CELL = 8_000
#: Bytes of shingle sets to a part and texts to a part, when the texts of a component are compared among themselves.
PART_BYTES, PART_ROWS = 32 << 20, 2_048


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The different word shingles; a text without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def hashed(found: set[bytes]) -> np.ndarray:
    """Shingles as sorted 64-bit hashes."""
    import xxhash

    return np.sort(np.array([xxhash.xxh3_64_intdigest(x, SEED) for x in found], np.uint64))


def wide_fingerprint(found: set[bytes]) -> bytes:
    """256-bit SimHash of a set of shingles as 32 bytes, from two 128-bit hashes each; the empty set has none."""
    import xxhash

    if not found:
        return b""
    listed = list(found)
    ones = np.zeros(WIDE, np.int64)
    digest, chunk = xxhash.xxh3_128_digest, COUNT_AT_ONCE // 4
    for at in range(0, len(listed), chunk):
        hashes = np.frombuffer(b"".join([digest(x, SEED) + digest(x, SEED + 1) for x in listed[at : at + chunk]]), np.uint8).reshape(-1, WIDE // 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(listed)).tobytes()


def most_bits(similarity: float) -> int:
    """Differing bits up to which two documents are compared: what sets of that Jaccard similarity have on average, and
    three deviations, which 99.8 % of such pairs keep to."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(WIDE * p + 3 * (WIDE * p * (1 - p)) ** 0.5)


def verified(values: np.ndarray, owners: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the owners of equal values: each with the first of its variant if that is near
    enough, the rest with those just linked and then among themselves in turn, until none is left.

    Two owners of a value are compared unless links join them already."""
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    a, b = [], []
    while len(values):
        head = np.concatenate(([True], values[1:] != values[:-1]))
        starts = np.flatnonzero(head)
        lead = np.repeat(owners[starts], np.diff(np.append(starts, len(values))))
        near = np.bitwise_count(fps[lead] ^ fps[owners]).sum(axis=1) <= most
        pairs = np.unique(np.stack((lead[near & ~head], owners[near & ~head])), axis=1)
        a.append(pairs[0])
        b.append(pairs[1])
        taken, met, left, to = owners[near & ~head], values[near & ~head], owners[~near], lead[~near]
        begin = np.searchsorted(met, values[~near])
        count = np.searchsorted(met, values[~near], "right") - begin
        open_ = np.flatnonzero(count)
        while len(open_):  # each left row with the taken ones of its value, a bounded number of pairs at a time
            links = np.concatenate(a), np.concatenate(b)
            rows, roots = spanning(*links, len(fps))
            a, b = [roots], [rows]
            root = np.arange(len(fps))
            root[rows] = roots
            open_ = open_[root[left[open_]] != root[to[open_]]]  # the taken ones are linked to `to`
            now = open_[: max(1, int(np.searchsorted(np.cumsum(count[open_]), COMPARE_AT_ONCE)))]
            n = count[now]
            one = np.repeat(left[now], n)
            other = taken[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[now], n)]
            linked = np.bitwise_count(fps[one] ^ fps[other]).sum(axis=1) <= most
            a.append(other[linked])
            b.append(one[linked])
            open_ = open_[len(now) :]
        values, owners = values[~near], owners[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def meetings(rest: np.ndarray, spent: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variants, owners) within HALF bits of keys of `low` bits that another key's variant may equal; spent: flips that
    each key has used up on the bits before.

    Many keys are taken in turns, by the first bits of the variants, so that memory is bounded."""
    first = int(min(low - 1, max(0, np.ceil(np.log2(max(1, len(rest)) / CELL)))))
    below = low - first
    flips = [masks(below, k).astype(np.uint32) for k in range(HALF + 1)]
    tail = (rest & np.uint32((1 << below) - 1)).astype(np.uint32)
    for head in range(1 << first):
        apart = spent + np.bitwise_count((rest >> np.uint32(below)) ^ np.uint32(head))
        values, owners = [], []
        for k in range(HALF + 1):
            own = np.flatnonzero(apart <= HALF - k)
            values.append((tail[own, None] ^ flips[k][None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(flips[k])))
        values, owners = np.concatenate(values), np.concatenate(owners)
        slots = min(31, max(10, int(2 * len(values)).bit_length()))
        slot = (values * np.uint32(2654435761)) >> np.uint32(32 - slots)
        met = np.bincount(slot, minlength=1)[slot] > 1  # what no other variant can equal is sent off at once
        yield values[met], owners[met]


def similar_links(distinct: DataFrame, total: int, folder: str, most: int) -> DataFrame:
    """Edges (a, b) of spanning forests of the proposed links; `distinct` has node and fp (32 bytes), `total` rows."""
    ship(distinct.sparkSession)
    low = KEY_BITS - DEALT_BITS
    word = lambda k: F.conv(F.hex(F.substring("fp", 2 * k + 1, 4)), 16, 10).cast("long")
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), word(k).alias("key")) for k in range(PARTS)]))
    cell = (F.col("p.part") * (1 << DEALT_BITS) + F.shiftright("p.key", low)).cast("int")
    dealt = distinct.select("node", "fp", part.alias("p")).select(cell.alias("cell"), F.col("p.key").alias("key"), "node", "fp", F.lit(0).alias("apart"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(cell):  # a pyarrow Table in and out
        below = low - cell.column("more")[0].as_py()
        nodes = cell.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        nodes = nodes[order]
        fps = np.frombuffer(b"".join(cell.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE // 64)[order]
        rest = (cell.column("key").to_numpy()[order] & ((1 << below) - 1)).astype(np.uint32)
        found = [verified(values, owners, fps, most) for values, owners in meetings(rest, cell.column("apart").to_numpy()[order], below)]
        rows, roots = spanning(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), len(nodes))
        return pa.table({"a": nodes[rows], "b": nodes[roots]})

    return split(dealt, "key", low, HALF, total, folder).groupBy("cell", "more", "sub").applyInArrow(run, schema)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def near_pairs(asked: list[np.ndarray], sets: list[np.ndarray], similarity: float) -> Iterator[np.ndarray]:
    """For each of `asked` the places of the sets of at least that Jaccard similarity."""
    if not sets:
        yield from (np.empty(0, np.int64) for _ in asked)
        return
    sizes = np.array([len(x) for x in sets])
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins, mark = np.cumsum(sizes) - sizes, np.zeros(len(known) + 1, bool)
    for own in asked:
        at = np.searchsorted(known, own)
        at = at[known[np.minimum(at, len(known) - 1)] == own]
        mark[at] = True
        both = np.add.reduceat(mark[ids], begins, dtype=np.int64)
        mark[at] = False
        yield np.flatnonzero(both / (len(own) + sizes - both) >= similarity)


def centres(sets: DataFrame, total: int, folder: str) -> DataFrame:
    """component, centre: the node whose bits are nearest to the majority of its component's, the smallest of several."""
    counted = T.StructType([T.StructField("component", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ones", T.ArrayType(T.LongType()))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1)
            order = np.argsort(at, kind="stable")
            n = np.bincount(at)
            ones = np.add.reduceat(bits[order], np.cumsum(n) - n, axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(n), pa.array(list(ones), pa.list_(pa.int64()))], names=counted.names)

    def vote(group):  # a pyarrow Table in and out; a row for each batch that has the component
        ones = np.array(group.column("ones").to_pylist(), np.int64).sum(axis=0)
        n = sum(group.column("n").to_pylist())
        return pa.table({"component": [group.column("component")[0].as_py()], "majority": [np.packbits(2 * ones > n).tobytes()]})

    votes = sets.select("component", "fp").mapInArrow(count, counted).groupBy("component").applyInArrow(vote, "component long, majority binary")
    votes = materialize(votes, folder, "wide_votes")
    gap = F.lit(0)
    for k in range(WIDE // 64):
        word = lambda c, k=k: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long")
        gap = gap + F.bit_count(word("fp").bitwiseXOR(word("majority")))
    gaps = spread_join(sets.select("component", "node", "fp"), votes, "component", total).select("component", F.struct(gap.alias("gap"), "node").alias("g"))
    return gaps.groupBy("component").agg(F.min("g").alias("g")).select("component", F.col("g.node").alias("centre"))


def confirmed(proposed: DataFrame, texts: DataFrame, folder: str, words: int, similarity: float) -> DataFrame:
    """node, root: the components of `proposed` (node, component, fp) taken apart, so that only texts of at least that
    similarity are linked.  `texts` has node and text.

    Most components are near copies of their centre and done when all have been compared with that.  What is not similar
    to its centre ("far") is compared with the whole component, in parts of PART_BYTES or PART_ROWS on either side, so that no task
    holds more of a component than that.  Each part gives a forest of the links that it finds."""
    long = T.LongType()
    schema = T.StructType([T.StructField("node", long), T.StructField("component", long), T.StructField("fp", T.BinaryType()), T.StructField("set", T.BinaryType())])

    def to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashed(shingles(t.as_py(), words)).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=schema.names)

    sets = proposed.join(texts, "node").select("node", "component", "fp", "text").mapInArrow(to_sets, schema)
    sets = materialize(sets, folder, "wide_sets")
    total = sets.count()
    centre = materialize(centres(sets, total, folder), folder, "wide_centres")
    tested = T.StructType([T.StructField("node", long), T.StructField("component", long), T.StructField("centre", long), T.StructField("near", T.BooleanType())])

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(3), batch.column(4), strict=True)
            near = [jaccard(*(np.frombuffer(x.as_py(), np.uint64) for x in pair)) >= similarity for pair in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], names=tested.names)

    lead = centre.join(sets.select(F.col("node").alias("centre"), F.col("set").alias("lead")), "centre")
    near = spread_join(sets.select("node", "component", "set"), lead, "component", total).select("node", "component", "centre", "set", "lead").mapInArrow(test, tested)
    near = materialize(near, folder, "wide_near")
    stars = near.where("near AND node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    far = near.where("NOT near").select("node")

    # parts of about PART_BYTES or PART_ROWS: a node's part is a hash, their number comes from the size of its component
    pieces = F.greatest(F.ceil(F.sum(F.octet_length("set")) / PART_BYTES), F.ceil(F.count(F.lit(1)) / PART_ROWS)).cast("int")
    mixed = sets.join(far, "node", "left_semi").groupBy("component").agg(pieces.alias("of_far"))
    sizes = materialize(sets.groupBy("component").agg(pieces.alias("of_all")).join(mixed, "component"), folder, "wide_mixed")
    which = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    states = near.select("node", "centre", "near")
    within = spread_join(sets.select("node", "component", "set"), sizes, "component", total).join(states, "node")
    asked = within.where("NOT near").select("component", which("of_far").alias("x"), parts("of_all").alias("y"), F.col("node").alias("ask"), F.lit(None).cast("long").alias("stands"), "set")
    stands = F.when(F.col("near"), F.col("centre")).otherwise(F.col("node")).alias("stands")
    every = within.select("component", parts("of_far").alias("x"), which("of_all").alias("y"), F.lit(None).cast("long").alias("ask"), stands, "set")

    def compare(part):  # a pyarrow Table in and out
        ask, rows = (part.filter(part.column(c).is_valid()) for c in ("ask", "stands"))
        read = lambda t: [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        asks, stands = ask.column("ask").to_numpy().astype(np.int64), rows.column("stands").to_numpy().astype(np.int64)
        nodes = np.unique(np.concatenate((asks, stands)))
        place, root = np.searchsorted(nodes, stands), np.arange(len(nodes))
        for node, found in zip(np.searchsorted(nodes, asks), near_pairs(read(ask), read(rows), similarity), strict=True):
            met = np.append(root[place[found]], root[node])
            if (met != met[0]).any():  # only trees are kept, never the links: a part of n near copies has n^2 of them
                root[np.isin(root, met)] = met.min()
        left = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": nodes[root[left]], "b": nodes[left]})

    others = asked.unionByName(every).groupBy("component", "x", "y").applyInArrow(compare, "a long, b long")
    edges = materialize(stars.unionByName(others), folder, "wide_links")
    return components(edges, f"{folder}/exact").withColumnRenamed("component", "root")


def named_rows(docs: DataFrame, folder: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame, int]:
    """The rows with a number (row) and 128 bits of their shingles (digest, null for texts without words or an id); for
    each digest the row with the smallest (doc_id, row) of its component (first); and how many rows have a digest."""
    ship(docs.sparkSession)
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField("fp", T.BinaryType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps, digests = [], []
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = shingles(t.as_py(), words) if i.is_valid else set()
                fps.append(wide_fingerprint(found))
                digests.append(xxhash.xxh3_128_digest(hashed(found).tobytes()) if found else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.binary()), pa.array(digests, pa.binary())], names=schema.names)

    rows = materialize(numbered.mapInArrow(run, schema), folder, "wide")
    worded = rows.where("digest IS NOT NULL")
    distinct = worded.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("fp").alias("fp"))
    # a text's node is the number of its first row: short, and no two texts share it
    distinct = materialize(distinct.select("digest", F.col("first.row").alias("node"), "first", "fp"), folder, "wide_distinct")
    edges = similar_links(distinct.select("node", "fp"), distinct.count(), folder, most_bits(similarity))
    proposed = components(edges, folder).join(distinct.select("node", "fp"), "node")
    found = confirmed(proposed, rows.select(F.col("row").alias("node"), "text"), folder, words, similarity)
    found = materialize(found, folder, "wide_found")
    forget(docs.sparkSession, folder, "wide_sets", "wide_votes", "wide_centres", "wide_near", "wide_mixed", "wide_links")
    rooted = distinct.join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "first")
    rooted = materialize(rooted, folder, "wide_rooted")
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = spread_join(rooted.select("digest", "root"), first, "root", rooted.count()).select("digest", "first")
    return rows, materialize(named, folder, "wide_named"), worded.count()


def similar(docs: DataFrame, folder: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (the smallest doc_id that similar texts lead to); texts without words stand alone, as do null ids.

    Each link has at least that exact Jaccard similarity of word shingles; SimHash only says which texts to compare."""
    rows, named, total = named_rows(docs.select("doc_id", "text"), folder, words, similarity)
    alone = rows.where("digest IS NULL").select("doc_id", F.col("doc_id").alias("component_id"))
    return spread_join(rows.select("doc_id", "digest"), named, "digest", total).select("doc_id", F.col("first.doc_id").alias("component_id")).unionByName(alone)


def without_similar(docs: DataFrame, folder: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs but for those that similar() joins to a smaller doc_id, or to an earlier row of the same one.

    It goes by rows: of rows with one doc_id each has its own text, and stays or goes by that."""
    columns = [f"c{i}" for i in range(len(docs.columns))]  # a caller's columns may have any names, even these
    plain = docs.toDF(*columns).withColumns({"doc_id": F.col(columns[docs.columns.index("doc_id")]), "text": F.col(columns[docs.columns.index("text")])})
    plain = plain.drop(columns[docs.columns.index("doc_id")], columns[docs.columns.index("text")])
    rows, named, total = named_rows(plain, folder, words, similarity)
    gone = spread_join(rows.select("row", "digest"), named, "digest", total).where("row <> first.row").select("row")
    kept = rows.join(gone, "row", "left_anti")
    return kept.select(*[(F.col(c) if c in ("doc_id", "text") else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def near_duplicates(docs: DataFrame, folder: str, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links lead to."""
    prints = materialize(fingerprints(docs, words), folder, "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), folder, "distinct")
    total = distinct.count()
    edges = links(distinct.select("fp"), total, folder)
    found = materialize(components(edges, folder).withColumnRenamed("node", "fp"), folder, "found")
    group = found.join(distinct, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    linked = materialize(spread_join(found, group, "component", found.count()).select("fp", "component_id"), folder, "linked")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    named = materialize(named, folder, "named")
    out = spread_join(prints, named, "fp", prints.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
