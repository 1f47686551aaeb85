import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import toxicity as X


def brute_segments(steps):
    """All maximal scoring segments by their definition: take the best one, then the best left and right of it."""

    def best(a, b):
        found = [(sum(steps[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        found = [f for f in found if f[0] > 1e-9]
        if not found:
            return []
        top = max(f[0] for f in found)
        s, _, i, j = min((f for f in found if f[0] > top - 1e-9), key=lambda f: (f[2], f[3]))
        return [*best(a, i), (i, j - 1, s), *best(j, b)]

    return best(0, len(steps))


def test_segments_are_the_maximal_ones():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randrange(1, 25)
        hits = [(i, rng.choice([1.0, 2.5, 4.0, -1.5]) + rng.random() / 100) for i in range(n) if rng.random() < 0.4]
        steps = [dict(hits).get(i, -0.7) for i in range(n)]
        got = X.segments(hits, 0.7)
        want = brute_segments(steps)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_a_word_of_clean_texts_speaks_against_a_passage():
    rows = [(f"good kind words {i}", 0) for i in range(60)] + [(f"vile grubby {i} thing", 1) for i in range(60)]
    model = X.fit(rows)
    assert model.weights["grubby"] > 0 > model.weights["kind"] and not any(w < 0 for t, w in model.weights.items() if t.endswith("*"))
    alone, among = (X.passages(t, model)[0] for t in ("grubby vile grubby vile", "grubby kind kind vile kind kind grubby kind kind vile"))
    assert X.strength(alone) > X.strength(among)


def test_decay_is_the_root():
    rng = random.Random(2)
    for _ in range(20):
        values = Counter({rng.uniform(0.5, 5): 1 + rng.randrange(5), -rng.uniform(0.5, 2): 400, -3.0: rng.randrange(9)})
        rate = X.decay(values)
        assert sum(n * math.exp(rate * s) for s, n in values.items()) / values.total() == pytest.approx(1, abs=1e-9)


def test_extreme_values_against_simulation():
    """Random texts of known steps: the fitted K and lambda say how often a best segment passes a score."""
    rng = np.random.default_rng(3)
    steps, p = np.array([2.0, 1.0, -0.5, -1.0]), np.array([0.05, 0.1, 0.25, 0.6])
    rate = X.decay(Counter({s: round(1000 * q) for s, q in zip(steps.tolist(), p.tolist(), strict=True)}))

    def best(n):
        x = rng.choice(steps, n, p=p).tolist()
        return max((s for *_, s in X.segments(list(enumerate(x)), 0.0)), default=0.0)

    k = X.extreme([(n, best(n)) for n in rng.integers(200, 600, 1500).tolist()], rate)
    fresh = np.array([best(400) for _ in range(1500)])
    for s in (6.0, 8.0, 10.0):
        said, seen = 1 - math.exp(-k * 400 * math.exp(-rate * s)), float((fresh > s).mean())
        assert abs(said - seen) <= 0.05 + 0.3 * seen


def test_spark_learns_what_the_plain_fit_learns(spark, small):
    big = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = [(r["text"], r["label"]) for r in X.training_rows(docs, labels).collect()]
    want, got = X.fit(rows), X.learn(docs, labels)
    assert got.weights == want.weights and got.weights
    assert (got.drift, got.rate, got.k, got.slope, got.base) == pytest.approx((want.drift, want.rate, want.k, want.slope, want.base))


def test_the_sample_is_bounded_and_never_held_out(spark, documents):
    texts = [f"text {i}" for i in range(300)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = X.training_rows(documents(texts), labels, sample=20).collect()
    assert sorted(Counter(r["label"] for r in rows).items()) == [(0, 20), (1, 20)]
    assert all(zlib.crc32(r["text"][5:].encode()) % 3 != 1 for r in rows)


def test_held_out_rows_by_their_hash(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", X.held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_held_out_accuracy(spark, small):
    big = small.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = X.toxic_documents(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in got.groupBy("toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.02 * (n.get((0, 1), 0) + n[0, 0])


def corpus():
    texts = [f"some clean words number {i} and more of them here" for i in range(60)] + [f"you vile{'abcdefgh'[i % 8]} grubby thing {i} vileness grubby" for i in range(30)]
    return texts, [0] * 60 + [1] * 30


def test_odd_rows_have_a_score(spark, documents):
    texts, labels = corpus()
    texts += [None, "", "!!!", "word " * 50000, "clean " * 3000 + "vilea grubby vileb " * 5 + "clean " * 3000, texts[0], texts[0]]
    truth = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(0, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(texts).withColumns({"score": F.lit("x"), "toxic": F.lit(1), "truth": F.lit(2), "passages": F.lit(3)})
    got = {r["doc_id"]: r for r in X.toxic_documents(docs, truth).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(got[i]["predicted"] == 1 for i in range(60, 90)) and all(got[i]["predicted"] == 0 for i in range(60))
    assert got[90]["score"] == got[91]["score"] == got[92]["score"] == got[0]["score"]
    assert got[94]["predicted"] == 1 and got[94]["passages"][0]["first"] >= 3000
    kept = X.reject(docs, truth)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_nothing_to_learn_from(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.toxic_documents(documents(["a", None]), none).collect()
    assert [r["predicted"] for r in got] == [0, 0]
    assert X.toxic_documents(documents([]), none).count() == 0
