import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, line_dedup, simhash


def plain(text, words):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    texts = ["", None, " \t\n", "One", "one two", "É é A\x0bB", "A B C", "a b c"]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts + ["same text here"] * 40 + ["long " + "word%d " % 3 * 30000]


def test_fingerprints_links_and_components(documents, folder):
    texts = corpus()
    docs = documents(texts).repartition(3).withColumns({"fp": F.lit("x"), "node": F.lit(1), "component": F.lit(2)})
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, folder).collect()}
    fps = [plain(t, 3) for t in texts]
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == classes(range(len(fps)), linked)


def test_links_at_every_distance_and_in_chains(spark, folder, monkeypatch):
    rng = random.Random(8)
    fps = set()
    for _ in range(150):
        f = rng.getrandbits(64)
        fps.add(f)
        for flips in (1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), flips):
                g ^= 1 << b
            fps.add(g)
    for k in range(20):
        fps.add(sum(1 << b for b in range(3 * k)) & (2**64 - 1))  # a chain, three bits a step
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = classes(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for bits, most in ((4, 1 << 20), (7, 1 << 20), (4, 60)):  # the last one deals its cells by further bits
        monkeypatch.setattr(simhash, "CELL_MOST", most)
        edges = simhash.links(distinct, len(fps), f"{folder}/cells{bits}-{most}", bits)
        comp = {r["node"]: r["component"] for r in simhash.components(edges, f"{folder}/{bits}-{most}").collect()}
        place = {f: i for i, f in enumerate(signed)}
        label = {i: comp.get(f, f) for i, f in enumerate(signed)}
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))
        assert set(comp) <= set(place)


def test_null_ids_and_empty_tables(spark, documents, folder):
    docs = documents(["a b c d"] * 3, ids=[None, 5, 3])
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs, folder).collect()) == [(-1, 3), (3, 3), (5, 3)]
    lone = simhash.near_duplicates(documents(["x y"], ids=[None]), folder + "/n").collect()
    assert lone[0]["component_id"] is None
    assert simhash.near_duplicates(documents([]), folder + "/e").count() == 0
    assert simhash.similar(documents([]), folder + "/s").count() == 0


def jaccard(a, b, words=5):
    s = []
    for t in (a, b):
        w = (t or "").lower().split()
        s.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_similar_finds_near_copies_and_leaves_others(documents, folder):
    texts = corpus(11)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(documents(texts), folder).collect()}
    assert got[0] == 0 and got[1] == 1 and got[2] == 2
    near = [(i, j) for i in range(3, len(texts)) for j in range(3, i) if jaccard(texts[i], texts[j]) >= 0.9]
    assert sum(got[i] == got[j] for i, j in near) >= 0.98 * len(near)
    far = [(i, j) for i in range(3, len(texts)) for j in range(3, i) if got[i] == got[j]]
    assert all(jaccard(texts[i], texts[j]) > 0.4 for i, j in far)


def edited(rng, k, words=150, edits=2):
    """A text of its own and a copy with single words replaced."""
    text = [f"w{k}x{rng.randrange(10**6)}" for _ in range(words)]
    copy = list(text)
    for at in rng.sample(range(10, words - 10), edits):
        copy[at] = f"e{rng.randrange(10**6)}"
    return " ".join(text), " ".join(copy)


def test_similar_pairs_do_not_depend_on_the_corpus_size(documents, folder, monkeypatch):
    """A tiny CELL stands for a corpus many times the size of one cell."""
    monkeypatch.setattr(simhash, "CELL", 0.01)
    rng = random.Random(5)
    texts = [t for k in range(200) for t in edited(rng, k)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(documents(texts), folder).collect()}
    near = [k for k in range(200) if jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8]
    assert len(near) > 150 and sum(got[2 * k] == got[2 * k + 1] for k in near) >= 0.97 * len(near)


def test_similar_links_at_the_exact_similarity_only(documents, folder):
    """Pairs on both sides of 0.8, and a text whose repeated shingles outweigh the others."""
    rng = random.Random(6)
    texts = [t for k in range(240) for t in edited(rng, k, edits=1 + k % 6)] + ["a " * 50 + "b c d e f g h", "a " * 5]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(documents(texts), folder).collect()}
    alike = [jaccard(texts[2 * k], texts[2 * k + 1]) for k in range(240)]
    joined = [got[2 * k] == got[2 * k + 1] for k in range(240)]
    assert not any(j for j, a in zip(joined, alike, strict=True) if a < 0.8)
    assert sum(joined) >= 0.97 * sum(a >= 0.8 for a in alike)
    assert got[481] == 481


def test_larger_cells_are_dealt_by_further_bits_and_give_the_same(documents, folder, monkeypatch):
    rng = random.Random(9)
    texts = [t for k in range(80) for t in edited(rng, k)] + ["same text of some length here"] * 9
    before = {r["doc_id"]: r["component_id"] for r in simhash.similar(documents(texts), folder + "/a").collect()}
    monkeypatch.setattr(simhash, "CELL_MOST", 8)
    monkeypatch.setattr(common, "HEAVY_ROWS", 2)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(documents(texts), folder + "/b").collect()} == before


def test_texts_that_are_not_near_the_centre_are_compared_with_all(documents, folder, monkeypatch):
    """One base with copies on both sides of 0.8, copies of copies and a chain, in one component of proposals."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(200)]

    def copy(words, edits):
        words = list(words)
        for at in rng.sample(range(0, 200, 7), edits):
            words[at] = f"e{rng.randrange(10**6)}"
        return words

    chain = [base]
    for _ in range(6):
        chain.append(copy(chain[-1], 3))
    made = [copy(base, rng.randrange(1, 9)) for _ in range(60)] + [copy(copy(base, 3), 3) for _ in range(20)] + chain
    texts = [" ".join(w) for w in made]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = classes(range(len(texts)), linked)
    for k, most in enumerate((simhash.PART_ROWS, 9)):
        monkeypatch.setattr(simhash, "PART_ROWS", most)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(documents(texts), f"{folder}/{k}").collect()}
        assert got == want
    assert 1 < len(set(want.values())) < 60


def test_near_pairs_against_all_pairs():
    rng = random.Random(7)
    sets = [np.array(sorted(rng.sample(range(14), 9 + rng.randrange(4))), np.uint64) for _ in range(150)]
    got = [x.tolist() for x in simhash.near_pairs(sets[:40], sets, 0.8)]
    assert got == [[j for j in range(150) if simhash.jaccard(sets[i], sets[j]) >= 0.8] for i in range(40)]
    assert [x.tolist() for x in simhash.near_pairs(sets[:2], [], 0.8)] == [[], []]


def test_links_of_a_variant_are_all_compared():
    """On one variant the second row is near the first and the third is near the second alone."""
    fps = np.zeros((4, 4), np.uint64)
    fps[1, 0], fps[2, 0], fps[3, 1] = (1 << 40) - 1, (1 << 60) - 1, (1 << 63) - 1
    a, b = simhash.verified(np.zeros(4, np.uint32), np.arange(4), fps, 45)
    assert simhash.spanning(a, b, 4)[0].tolist() == [1, 2]
    rng = np.random.default_rng(3)
    fps, values, owners = rng.integers(0, 2, (60, 4)).astype(np.uint64), rng.integers(0, 5, 300), rng.integers(0, 60, 300)
    values, owners = np.unique(np.stack((values, owners)), axis=1)
    rows, roots = simhash.spanning(*simhash.verified(values, owners, fps, 1), 60)
    want = [(i, j) for v in range(5) for i in owners[values == v] for j in owners[values == v] if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 1]
    more, least = simhash.spanning(np.array([i for i, _ in want]), np.array([j for _, j in want]), 60)
    assert dict(zip(rows.tolist(), roots.tolist(), strict=True)) == dict(zip(more.tolist(), least.tolist(), strict=True))


def brute_lines(rows, ratio, least):
    pages, total = {}, {}
    bare = lambda line: line.strip(" \t\r")
    for host, text in rows:
        total[host] = total.get(host, 0) + 1
        for line in {bare(x) for x in (text or "").split("\n")} - {""}:
            pages[host, line] = pages.get((host, line), 0) + 1
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, bare(x)) not in bad) for h, t in rows]


def test_boilerplate_lines_go(documents, folder):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"h{i % 5}" if i % 2 else None, "\n".join(["  Menu\r" if rng.random() < 0.5 else "Menu", "", f"line {i}", *["rare"] * (i % 9 == 0), *["Menu"] * (i % 4 == 0)])) for i in range(200)]
    rows += [("hot", None), ("hot", ""), ("hot", "\n"), ("one", "Menu"), ("hot", "Menu"), ("hot", "Menu"), ("hot", "x\n" * 20000 + "end")]
    docs = documents([t for _, t in rows], [h for h, _ in rows]).withColumns({"dropped_lines": F.lit("x"), "host": F.lit(1), "keys": F.lit(2), "at": F.lit(3)})
    got = line_dedup.drop_lines(docs, folder)
    assert set(got.columns) == set(docs.columns)
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == brute_lines(rows, line_dedup.RATIO, line_dedup.LEAST)
    assert "Menu" not in got.where("doc_id = 1").first()["text"]


def test_lines_of_an_empty_table(documents, folder):
    assert line_dedup.drop_lines(documents([]), folder).count() == 0
