"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

Text is marked as SentencePiece does (a mark before it and for every space).  No piece holds
a mark after another character, so the best segmentation of a text is that of its marked words, one
after the other, and each distinct word is solved once.  Distinct words are sorted, which is a
depth-first walk of their trie: going from one word to the next, the forward scores of
the common prefix stay on the stack and only the rest is scored.

The vocabulary's pieces and scores are those of a given model file; the segmentation is the one of the
highest summed score (a tie goes to the longer last piece).  A character that no piece covers becomes its bytes.

Null texts count as empty and have no pieces; null ids are kept; repeated rows are encoded each; other columns are
ignored.  A text that holds the mark itself decodes with a space in its place, as the format
has no escape for it; round_trip() marks such rows as not exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import ship

MARK = "▁"
VOCABULARY = "piece_bpe_32k"
UNKNOWN = -1e9 - 10
#: Bytes after which a worker starts a new generation of its cache (it keeps two), what a word costs beside its characters
#: and ids, the longest word that it keeps, and characters that it takes at a time: all bound its memory.
CACHED_BYTES, WORD_BYTES, LONGEST_KEPT = 64 << 20, 250, 64
CHARS_AT_ONCE = 2_000_000


class Vocabulary:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        # pieces from their last character on: candidates that end at a place, the shortest first, with an early end
        self.backward: dict = {}
        for piece, (i, score) in pieces.items():
            node = self.backward
            for c in piece[:0:-1]:
                node = node.setdefault(c, [{}, -1, 0.0])[0]
            node.setdefault(piece[0], [{}, -1, 0.0])[1:] = i, score
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on over a word's start")
        # a character that no piece holds stands alone: cut there too, and more words are alike
        alone = "" if any("\n" in p for p in pieces) else "\n"
        self.word = re.compile(f"{alone}|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.bytes_of = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @classmethod
    def load(cls, name: str) -> Vocabulary:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not special(i)}
        return cls(pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def words(self, text: str) -> list[str]:
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def solve(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each word's ids as little-endian bytes; words in sorted order share what they have in common."""
        backward = self.backward
        score, begin, ids = [0.0], [0], [-1]  # by prefix length: its best score, where its last piece begins, and that piece
        before = ""
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del score[same + 1 :], begin[same + 1 :], ids[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                best, at, which = score[end - 1] + UNKNOWN, end - 1, -1
                node, start = backward, end
                while start:
                    start -= 1
                    found = node.get(word[start])
                    if found is None:
                        break
                    node, i, s = found
                    if i >= 0 and score[start] + s >= best:
                        best, at, which = score[start] + s, start, i
                score.append(best)
                begin.append(at)
                ids.append(which)
            before, end, out = word, len(word), []
            while end:
                if ids[end] >= 0:
                    out.append(ids[end])
                else:
                    out += [self.byte_ids[b] for b in reversed(word[begin[end] : end].encode("utf-8", "surrogatepass"))]
                end = begin[end]
            yield word, np.array(out[::-1], dtype="<i4").tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


@cache
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    return Vocabulary.load(name)


class Cache:
    """Ids of words, in two generations: a word of the older one moves over when it occurs, the rest goes with it."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.new, self.old, self.held = vocab, {}, {}, 0

    def solve(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each of the words; those that are not known are solved together, in sorted order."""
        found = {}
        for w in words:
            ids = self.new.get(w)
            if ids is None and (ids := self.old.get(w)) is not None:
                self.keep(w, ids)
            if ids is not None:
                found[w] = ids
        for w, ids in self.vocab.solve(sorted(words.difference(found))):
            found[w] = ids
            if len(w) <= LONGEST_KEPT:
                self.keep(w, ids)
        return found

    def keep(self, word: str, ids: bytes) -> None:
        if self.held > CACHED_BYTES:
            self.new, self.old, self.held = {}, self.new, 0
        self.new[word] = ids
        self.held += 4 * len(word) + len(ids) + WORD_BYTES


def encode(docs: DataFrame, name: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in `keep`, and ids: the pieces of every text."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", *keep, "text")
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name)
        cache = Cache(vocab)

        def solved(begin: int, cut: list[list[str]], batch: pa.RecordBatch) -> pa.RecordBatch:
            known = cache.solve({w for words in cut for w in words})
            parts = [b"".join(map(known.__getitem__, words)) for words in cut]
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
            kept = [c.slice(begin, len(cut)) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), values)], names=schema.names)

        for batch in batches:
            begin, cut, held = 0, [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py() or ""
                cut.append(vocab.words(text))
                held += len(text)
                if held >= CHARS_AT_ONCE:
                    yield solved(begin, cut, batch)
                    begin, cut, held = i + 1, [], 0
            if cut:
                yield solved(begin, cut, batch)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """`encoded` and the text that its ids stand for."""
    ship(encoded.sparkSession)
    schema = T.StructType([*encoded.schema, T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [None if not row.is_valid else vocab.decode(row.values.to_numpy().tolist()) if len(row.values) else "" for row in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_ids, the decoded text's CRC-32, and whether it is the text's (null: empty)."""
    crc = lambda c: F.crc32(F.coalesce(c, F.lit("")).cast("binary"))
    texts = docs.select("doc_id", "text", crc(F.col("text")).alias("crc"))
    back = decode(encode(texts, keep=("crc",))).withColumn("decoded_crc32", crc(F.col("text")))
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "decoded_crc32", (F.col("crc") == F.col("decoded_crc32")).alias("exact"))
