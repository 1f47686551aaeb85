"""Best-fit packing of tokenised documents into fixed-length sequences.

A packing only depends on how many pieces there are of each length, and there are at
most `capacity` lengths.  So the corpus is reduced to a histogram, the histogram is packed
on the driver (its size never grows with the data), and every piece finds its place from
its rank among the pieces of its length.  Ranks come from counters kept per task, plus a
prefix sum over the tasks' counts, so no task ever holds all pieces of a length.

Pieces over a third of the capacity are matched greedily, the longest with the longest
that still fits, at most two to a bin; the others go, longest first, into the tightest
gap that holds them.

Null texts count as empty; a document always ends with the end id, so an empty one is one
piece of one token.  Rows that repeat are packed once each, null ids are kept, and other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import materialize, ship

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Words whose ids a worker keeps; beyond that it starts anew, so its memory is bounded.
CACHED_WORDS = 400_000
#: Bytes of ids that a worker gathers before it hands them on.
FLUSH_BYTES = 8 << 20
# Fixed value: the characters with Unicode's White_Space property.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space at a chunk's start from which it goes through the JSON form: the rank form's pattern takes stack for each character.
LONG_WHITE = 4_096
#: A run of white space with the word that follows; no token of a byte-level BPE crosses such a cut.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Encoder(dict):
    """Chunk of text -> its ids as little-endian bytes.

    Byte-level BPE never merges across the start of a white-space run, so a text's ids are
    its chunks' ids one after the other and each distinct chunk is encoded once.  Chunks go
    through the rank form of the vocabulary, which gives the ids of the JSON form in half the
    time; a text that holds the special token's string goes through the JSON form whole, and so does a chunk with a long
    run of white space, in which the rank form would run out of stack.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        long_white = len(chunk) > LONG_WHITE and chunk[:LONG_WHITE].isspace()
        ids = np.array(self.whole.encode(chunk, add_special_tokens=False).ids if long_white else self.ranks.encode_ordinary(chunk), dtype="<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def tokenize(docs: DataFrame, folder: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids (little-endian uint32), and
    (block, rank): the task that made the piece and its rank among that task's pieces of its length.
    They are written to `folder`, so that ranks stay as they are whatever is computed again."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("block", T.IntegerType()), T.StructField("rank", T.LongType()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block = encoder(vocabulary), TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            rows, held = [], 0
            ids, texts = batch.column(0), batch.column(1)
            out = lambda rows: pa.RecordBatch.from_arrays([
                ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.binary()), pa.array([block] * len(rows), pa.int32()),
                pa.array([r[5] for r in rows], pa.int64()),
            ], names=schema.names)  # noqa: E501
            for i in range(batch.num_rows):
                data = enc.encode(texts[i].as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    rows.append((i, k, start, length, data[4 * start : 4 * (start + length)], seen[length]))
                    seen[length] += 1
                held += len(data)
                if held >= FLUSH_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return materialize(docs.mapInArrow(run, schema), folder, "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for so many pieces of each length: [([(length, pieces of it), ...], bins of this kind)]."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is longer than a sequence, or has no tokens")
    open_bins: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(capacity + 1)]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in large:
            if not left[n]:
                break
            if m > n or n + m > capacity or not left[m]:
                continue
            bins = left[n] // 2 if m == n else min(left[n], left[m])
            if bins:
                left[n] -= bins
                left[m] -= bins
                open_bins[capacity - n - m].append(([(n, 2)] if m == n else [(n, 1), (m, 1)], bins))
        if left[n]:
            open_bins[capacity - n].append(([(n, 1)], left[n]))
            left[n] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in range(n, capacity + 1):
            if not left[n]:
                break
            fit, kinds = gap // n, open_bins[gap]
            while kinds and left[n]:
                runs, bins = kinds.pop()
                full = min(bins, left[n] // fit)
                if full:
                    open_bins[gap - fit * n].append(([*runs, (n, fit)], full))
                    left[n] -= full * fit
                    bins -= full
                if bins and left[n]:
                    open_bins[gap - left[n] * n].append(([*runs, (n, left[n])], 1))
                    left[n] = 0
                    bins -= 1
                if bins:
                    kinds.append((runs, bins))
        fit = capacity // n
        if left[n] >= fit:
            open_bins[capacity - fit * n].append(([(n, fit)], left[n] // fit))
        if left[n] % fit:
            open_bins[capacity - left[n] % fit * n].append(([(n, left[n] % fit)], 1))
        left[n] = 0
    return [kind for kinds in open_bins for kind in kinds]


def places(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """length -> (first ranks, [(first sequence, pieces side by side, offset)]), by which a rank finds its place."""
    found: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for runs, n in bins:
        offset = 0
        for length, side in runs:
            starts, where = found.setdefault(length, ([], []))
            starts.append(ranks.get(length, 0))
            where.append((first, side, offset))
            ranks[length] = ranks.get(length, 0) + n * side
            offset += length * side
        first += n
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with length, block and rank, as from tokenize()) without block and rank, plus
    sequence_id and offset.  What is shuffled is what `pieces` carries: select what you need before."""
    ship(pieces.sparkSession)
    by_block = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        pieces.join(by_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["length", "block"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .select(*[c for c in pieces.columns if c not in ("block", "rank")], "rank")
    )
    keep = [f for f in ranked.schema if f.name != "rank"]
    schema = T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                starts, kinds = where[length]
                k = bisect_right(starts, rank) - 1
                first, side, begin = kinds[k]
                row, column = divmod(rank - starts[k], side)
                sequence.append(first + row)
                offset.append(begin + column * length)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: what a training run reads; `packed` needs the column ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has at most `capacity` pieces
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.transform(parts, lambda p: p["ids"]).alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.expr("cast('' as binary)"), lambda a, b: F.concat(a, b)).alias("ids")
    )


def digests(docs: DataFrame, folder: str) -> DataFrame:
    """Packed pieces of all documents with the CRC-32 of their ids in place of the ids."""
    pieces = tokenize(docs, folder)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "block", "rank"))
