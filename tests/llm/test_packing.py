import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import packing


def whole(texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1é漢 \n\t\x1c\x85\xa0  　'.s<|>😀")), max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(packing.encoder().encode(text), "<u4").tolist() == whole([text])[0]


def test_special_token_in_a_text_is_read_as_tokenizers_reads_it():
    text = "one <|endoftext|> two"
    assert np.frombuffer(packing.encoder().encode(text), "<u4").tolist() == whole([text])[0]


@pytest.mark.parametrize("white", [" ", "\t", "\n", "\r", "\x0b", " \n", "\u3000", "\xa0"])
def test_a_million_white_characters_have_the_ids_of_the_whole_text(white):
    text = "a " + white * (10**6 // len(white)) + "b"
    assert np.frombuffer(packing.encoder().encode(text), "<u4").tolist() == whole([text])[0]


def test_runs_around_the_limit_have_the_ids_of_the_whole_text():
    texts = [c * n + tail for c in (" ", "\n", " \t") for n in range(packing.LONG_WHITE - 2, packing.LONG_WHITE + 3) for tail in ("", "x", "!")]
    assert [np.frombuffer(packing.encoder().encode(t), "<u4").tolist() for t in texts] == whole(texts)


def test_null_ids_and_long_runs_in_a_table(documents, folder):
    texts = [" " * 10**6, "\n" * 10**6, None, "x"]
    rows = packing.pack(packing.tokenize(documents(texts, ids=[1, 2, None, None]), folder)).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in whole([t or "" for t in texts]))
    assert sorted(r["length"] for r in rows if r["doc_id"] is None) == [1, 2]


def test_cut_leaves_only_the_first_piece_short():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def brute(counts, capacity):
    """One item at a time: large ones paired greedily, small ones into the tightest gap."""
    items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    large, small = [n for n in items if 3 * n > capacity], [n for n in items if 3 * n <= capacity]
    bins = []
    while large:
        n = large.pop(0)
        mate = next((m for m in large if n + m <= capacity), None)
        if mate:
            large.remove(mate)
        bins.append([n, mate] if mate else [n])
    for n in small:
        fit = [b for b in bins if capacity - sum(b) >= n]
        if fit:
            min(fit, key=lambda b: capacity - sum(b)).append(n)
        else:
            bins.append([n])
    return bins


def test_plan_packs_as_one_item_at_a_time_does():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 30, 64])
        counts = {n: rng.randrange(0, 6) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, 9))}
        bins = packing.plan(counts, capacity)
        assert sum(n for _, n in bins) == len(brute(counts, capacity))
        held = {}
        for runs, n in bins:
            assert sum(length * k for length, k in runs) <= capacity
            assert sum(k for length, k in runs if 3 * length > capacity) <= (2 if capacity else 0)
            for length, k in runs:
                held[length] = held.get(length, 0) + n * k
        assert held == {n: c for n, c in counts.items() if c}


def test_every_token_has_one_place(spark, documents, folder):
    texts = ["", None, "a", "a", "long words " * 900, *[f"text number {i} " * (i % 40) for i in range(200)]]
    docs = documents(texts).withColumns({"piece": F.lit("x"), "length": F.lit(9), "ids": F.lit(1)})  # names that clash
    pieces = packing.tokenize(docs, folder)
    rows = packing.pack(pieces).collect()
    ids = [[*x, 2] for x in whole([t or "" for t in texts])]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by_doc) == len(texts)
    for doc_id, got in by_doc.items():
        got.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        assert b"".join(r["ids"] for r in got) == np.array(ids[doc_id], "<u4").tobytes()
        assert [r["start"] for r in got] == [sum(x["length"] for x in got[:k]) for k in range(len(got))]
        assert all(r["length"] == 1024 for r in got[1:])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) == len(brute({n: sum(r["length"] == n for r in rows) for n in {r["length"] for r in rows}}, 1024))
    crc = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.digests(docs, folder + "/again").collect()}
    assert crc == {(r["doc_id"], r["piece"]): zlib.crc32(r["ids"]) for r in rows}


def test_sequences_hold_the_pieces_in_place(documents, folder):
    packed = packing.pack(packing.tokenize(documents(["b c d", "e f"]), folder, capacity=8), capacity=8)
    (row,) = packing.sequences(packed).collect()
    assert row["length"] == 7 and len(row["ids"]) == 28


def test_empty_table(documents, folder):
    assert packing.digests(documents([]), folder).count() == 0
