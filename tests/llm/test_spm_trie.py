import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plumbline.llm import spm_trie


def library_as_unigram():
    """The same pieces and scores in the library's own unigram Viterbi: the model's type is changed in its bytes."""
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        size, at = varint(at)
        if tag >> 3 == 2:  # trainer_spec
            inner = at
            while inner < at + size:
                t, inner = varint(inner)
                if t & 7 == 0:
                    value, after = varint(inner)
                    if t >> 3 == 3:  # model_type: BPE (2) becomes unigram (1)
                        assert value == 2 and after == inner + 1
                        return sentencepiece.SentencePieceProcessor(model_proto=data[:inner] + b"\x01" + data[after:])
                    inner = after
                elif t & 7 == 2:
                    n, inner = varint(inner)
                    inner += n
                else:
                    inner += 4 if t & 7 == 5 else 8
        at += size
    raise AssertionError("no model type")


def words(rng):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 12)))


def test_scores_match_the_library():
    """Never a lower score than the library's, which on rare words settles for a slightly worse path."""
    sp, vocab, rng = library_as_unigram(), spm_trie.vocabulary(), random.Random(5)
    score = {i: s for i, s in vocab.pieces.values()}
    same = 0
    for _ in range(200):
        text = words(rng)
        ours, theirs = sum(score[i] for i in encode(vocab, text)), sum(score[i] for i in sp.encode(text))
        assert ours >= theirs
        same += ours == theirs
    assert same >= 195


def encode(vocab, text):
    import numpy as np

    solved = dict(vocab.solve(sorted(set(vocab.words(text)))))
    return [i for w in vocab.words(text) for i in np.frombuffer(solved[w], "<i4").tolist()]


def brute(vocab, text):
    """Plain Viterbi over the whole marked text."""
    marked = spm_trie.MARK + text.replace(" ", spm_trie.MARK)
    best = [0.0] + [float("-inf")] * len(marked)
    for end in range(1, len(marked) + 1):
        best[end] = best[end - 1] + spm_trie.UNKNOWN
        for start in range(max(0, end - 16), end):
            if (p := vocab.pieces.get(marked[start:end])) and best[start] + p[1] > best[end]:
                best[end] = best[start] + p[1]
    return best[-1]


def test_words_and_shared_prefixes_give_the_best_score_of_the_whole_text():
    vocab, rng = spm_trie.vocabulary(), random.Random(9)
    score = {i: s for i, s in vocab.pieces.values()}
    for _ in range(60):
        text = words(rng) + rng.choice(["", " ", "  x", " x ", "   "])
        assert sum(score[i] for i in encode(vocab, text)) == pytest.approx(brute(vocab, text), rel=1e-12)


def test_round_trip_of_odd_texts(spark, documents):
    texts = ["", None, "a", " a", "a  b\n\nc ", "漢字 😀\t\x00", "x" * 5000, "same", "same", "é" * 3]
    docs = documents(texts).withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    got = {r["doc_id"]: r for r in spm_trie.decode(spm_trie.encode(docs)).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == [t or "" for t in texts]
    assert got[0]["ids"] == [] and got[1]["ids"] == []
    assert got[2]["ids"] == encode(spm_trie.vocabulary(), "a")


def test_cache_is_bounded_in_bytes_and_changes_nothing(monkeypatch):
    vocab, rng = spm_trie.vocabulary(), random.Random(4)
    monkeypatch.setattr(spm_trie, "CACHED_BYTES", 20_000)
    cache = spm_trie.Cache(vocab)
    for _ in range(30):
        asked = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(60)} | {"x" * rng.randrange(60, 3000) for _ in range(5)}
        assert cache.solve(asked) == dict(vocab.solve(sorted(asked)))
        kept = {**cache.new, **cache.old}
        assert sum(4 * len(w) + len(i) + spm_trie.WORD_BYTES for w, i in kept.items()) <= 2 * (20_000 + 1_000)
        assert all(len(w) <= spm_trie.LONGEST_KEPT for w in kept)


def test_rows_that_do_not_come_back_are_marked(documents):
    got = {r["doc_id"]: r["exact"] for r in spm_trie.round_trip(documents(["a b", "a\u2581b", None, ""])).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_empty_table(documents):
    assert spm_trie.round_trip(documents([])).count() == 0
