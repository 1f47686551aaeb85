"""Toxicity by maximum-scoring segments of token log-odds.

Fit: over a bounded, documented sample of the labelled rows that are not held out (SAMPLE documents of each class), each
token (a word, or the first letters of one, so that unseen endings of a known stem count)
gets the log-odds of standing in toxic against other documents, smoothed by a Dirichlet
prior in proportion to the pooled counts.  Tokens whose log-odds are large and significant keep them, on either side of
zero: a word of toxic texts speaks for a passage, one of clean texts against it.  All others score a small negative drift.

Score: one pass over a document finds all maximal scoring segments (each an interval that no
extension or trimming improves).  A segment of score s in a text of n words
has the E-value K n exp(-lambda s), lambda being the root of E[exp(lambda x)] = 1 over the
words of clean training documents and K the likeliest value for the best segments of those documents
(Karlin and Altschul; a document without a segment counts as one whose best score is zero or less); E-values under `E_MAX` make a passage significant.  The document's score is the logistic
of a line in the summed excess of its significant passages, which is fitted on
the training rows.

Null and empty texts have no passages and get the score of a document without any.  Repeated
documents are scored each; repeated labels of a document count as toxic if any does; null labels
and null ids don't train.  Scores use the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.settle import settle
from plumbline.llm.common import ship

#: Labelled documents of each class that the model is fitted on at most, those with the lowest hash of their id first.
SAMPLE = 4_000
STEMS = (4, 5, 6)
#: Pseudo-counts of a token in each class: FLOOR, and PRIOR dealt in proportion to the pooled counts.
FLOOR, PRIOR = 0.5, 50.0
Z_LEAST = 2.8
#: Log-odds that count as a sign at all: about 1 to 7.
ODDS_LEAST = 2.0
#: What a word between signs costs, of the mean sign's score.
DRIFT = 1 / 30
#: A text without a toxic word has a significant passage once in a thousand times.
E_MAX = 1e-3
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
#: Words whose scores a worker remembers; beyond that it starts anew, so its memory is bounded.
REMEMBERED = 200_000


@dataclass
class Model:
    """weights: the log-odds that tokens keep, words of both signs and stems (which end with '*') over zero."""

    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    base: float = -4.0


def held_out(doc_id: str | Column) -> Column:
    """Whether a row's label must not be learned from; rows without an id have no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def segments(scores: Iterable[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """(first word, last word, score) of all maximal scoring segments, in linear time, from the
    (position, score) of the words that have a score of their own; each word between scores -drift."""
    found: list[tuple[int, int, float, float]] = []  # with the totals before and after each candidate
    total, last = 0.0, -1
    for at, score in scores:
        total -= drift * (at - last - 1)
        if score <= 0:
            total, last = total + score, at
            continue
        first, end, before, after = at, at, total, total + score
        total, last = after, at
        # join with earlier candidates as long as that gives a better segment
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
        found.append((first, end, before, after, j))
    return [(first, end, after - before) for first, end, before, after, _ in found]


def weigh(words: list[str], weights: dict[str, float], memo: dict[str, float]) -> list[tuple[int, float]]:
    """Positions and scores of the words that have a score of their own: the best of a word and its stems, if that is over
    zero, else the word's."""
    hits = []
    for i, w in enumerate(words):
        s = memo.get(w)
        if s is None:
            own = weights.get(w, 0.0)
            s = max(own, *(weights.get(w[:n] + "*", 0.0) for n in STEMS)) or own
            if len(memo) >= REMEMBERED:
                memo.clear()
            memo[w] = s
        if s:
            hits.append((i, s))
    return hits


def e_value(score: float, words: int, model: Model) -> float:
    return model.k * words * math.exp(-min(700.0, model.rate * score))


def passages(text: str | None, model: Model, memo: dict[str, float] | None = None) -> tuple[list[tuple[int, int, float]], int]:
    """(first word, last word, E-value) of the significant passages, and the number of words."""
    words = WORD.findall((text or "").lower())
    hits = weigh(words, model.weights, {} if memo is None else memo)
    return [(a, b, e) for a, b, s in segments(hits, model.drift) if (e := e_value(s, len(words), model)) < E_MAX], len(words)


def strength(found: list[tuple[int, int, float]]) -> float:
    """What the significant passages amount to: the sum of how far each E-value lies under the limit, in nats."""
    return sum(math.log(E_MAX) - math.log(max(e, 1e-300)) for _, _, e in found)


def tokens(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    return words + [w[:n] + "*" for w in words for n in STEMS if len(w) > n]


#: Documents that hold a token, by half and class: clean of half 0, toxic of half 0, clean of half 1, toxic of half 1.
Counts = dict[str, tuple[int, int, int, int]]


def half_of(text: str) -> int:
    """Which half of the training rows a text belongs to; the same as F.xxhash64(text) & 1."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) & 1


def count_tokens(rows: Iterable[tuple[str, int]]) -> dict[str, list[int]]:
    counts: dict[str, list[int]] = {}
    for text, label in rows:
        at = 2 * half_of(text) + label
        for t in set(tokens(text)):
            counts.setdefault(t, [0, 0, 0, 0])[at] += 1
    return counts


def weigh_tokens(pairs: Iterable[tuple[str, int, int]], n_clean: int, n_toxic: int) -> dict[str, float]:
    """The log-odds that tokens keep: large and significant ones of words and stems, and significant ones under zero of
    words, from (token, clean, toxic) and the classes' sums."""
    weights: dict[str, float] = {}
    if not n_toxic or not n_clean:
        return weights
    pooled = n_toxic + n_clean
    for t, n, y in pairs:
        prior = FLOOR + PRIOR * (y + n) / pooled
        a, b = y + prior, n + prior
        odds = math.log(a / (n_toxic + PRIOR - a)) - math.log(b / (n_clean + PRIOR - b))
        z = odds / math.sqrt(1 / a + 1 / b)
        if (odds >= ODDS_LEAST and z >= Z_LEAST) or (z <= -Z_LEAST and not t.endswith("*")):
            weights[t] = max(-12.0, min(odds, 12.0))
    return weights


def drift_of(weights: dict[str, float]) -> float:
    signs = [w for w in weights.values() if w > 0]
    return DRIFT * math.fsum(signs) / len(signs) if signs else 1.0


def three_weights(counts: Iterable[tuple[str, tuple[int, int, int, int]]], sums: tuple[int, int, int, int]) -> list[dict[str, float]]:
    """The weights of half 0, of half 1 and of all rows."""
    counts = sorted(counts)
    pick = lambda i, j: weigh_tokens(((t, sum(c[k] for k in i), sum(c[k] for k in j)) for t, c in counts), sum(sums[k] for k in i), sum(sums[k] for k in j))
    return [pick((0,), (1,)), pick((2,), (3,)), pick((0, 2), (1, 3))]


def read_text(text: str, weights: dict[str, float], memo: dict[str, float]) -> tuple[int, list[float], list[float]]:
    """(words, scores of words that have one, scores of the segments) of a training text."""
    words = WORD.findall(text.lower())
    hits = weigh(words, weights, memo)
    return len(words), [s for _, s in hits], [s for *_, s in segments(hits, drift_of(weights))]


def calibrate(weights: dict[str, float], read: list[tuple[int, int, list[float], list[float]]]) -> Model:
    """The model of these weights, from (label, words, word scores, segment scores) of the training texts."""
    drift = drift_of(weights)
    values, n_words = Counter(), 0
    for label, n, scores, _ in read:
        if not label:
            values.update(scores)
            n_words += n
    values[drift / DRIFT] += 1  # one pseudo-hit, so that the root exists
    values[-drift] += n_words + 1 - values.total()
    rate = decay(values)
    model = Model(weights, drift, rate, extreme([(n, max(found, default=0.0)) for label, n, _, found in read if not label], rate))
    over = lambda n, found: strength([(0, 0, e) for s in found if (e := e_value(s, n, model)) < E_MAX])
    xs = np.array([over(n, found) for _, n, _, found in read])
    model.slope, model.base = logistic(np.log1p(xs), np.array([label for label, *_ in read], float))
    return model


def fit(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, 0 or 1).  What is said of scores (lambda, K and the logistic line) comes from texts that their weights
    have not seen: each half of the rows is scored by the weights of the other.  learn() does the same in Spark."""
    rows = sorted(set(rows))  # copies say nothing new
    counts = {t: tuple(c) for t, c in count_tokens(rows).items()}
    *halves, weights = three_weights(counts.items(), tuple(sum(c[k] for c in counts.values()) for k in range(4)))
    if not weights:
        return Model()
    memos: list[dict[str, float]] = [{}, {}]
    return calibrate(weights, [(label, *read_text(text, halves[1 - half_of(text)], memos[half_of(text)])) for text, label in rows])


def decay(values: Counter) -> float:
    """lambda: the positive root of E[exp(lambda x)] = 1 for step scores with these counts, of which some are over zero
    and the mean is under."""
    total = values.total()
    mean = lambda r: sum(c / total * math.expm1(min(700.0, r * s)) for s, c in values.items())
    low, high = 1e-6, 1.0
    while mean(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return high


def extreme(best: list[tuple[int, float]], rate: float) -> float:
    """K: the likeliest one if P(best <= s) = exp(-K n exp(-rate s)) for texts of n words, from (n, best score) of each.

    A text without a segment only says that its best is not over zero.  One more segment is counted than was seen, so
    that K is never zero."""
    seen = sum(s > 0 for _, s in best)
    return (seen + 1) / (1 + sum(n * math.exp(-min(700.0, rate * s)) for n, s in best))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a small ridge so that separable classes stay finite."""
    w = np.zeros(2)
    design = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 0.1 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, label of at most `sample` labelled documents of each class, none held out, once each; whole texts."""
    truth = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = None
    for label in (0, 1):
        # ids first: only the chosen documents' texts move
        few = truth.where(F.col("label") == label).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), "doc_id").limit(sample)
        rows = few if rows is None else rows.unionByName(few)
    texts = docs.select("doc_id", "text").join(F.broadcast(settle(rows)), "doc_id")  # `sample` ids of each class at most
    one = texts.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return settle(one.select("text", F.col("label").cast("int").alias("label")).distinct())


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """fit() of the training rows.  Texts stay on the executors: what comes to the driver are the tokens that are
    significant in a half or in the whole, and a few numbers of each training text."""
    ship(docs.sparkSession)
    rows = training_rows(docs, labels, sample)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_tokens(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            numbers = [pa.array([c[k] for c in found.values()], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *numbers], names=["token", "n0", "n1", "n2", "n3"])

    parts = rows.mapInArrow(count, "token string, n0 long, n1 long, n2 long, n3 long")
    counts = settle(parts.groupBy("token").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]))
    sums = tuple(n or 0 for n in counts.agg(*[F.sum(f"n{k}") for k in range(4)]).first())

    def z(clean: tuple[int, ...], toxic: tuple[int, ...]) -> Column:
        n, y = sum((F.col(f"n{k}") for k in clean), F.lit(0)), sum((F.col(f"n{k}") for k in toxic), F.lit(0))
        n_clean, n_toxic = sum(sums[k] for k in clean), sum(sums[k] for k in toxic)
        prior = FLOOR + PRIOR * (n + y) / max(1, n_clean + n_toxic)
        a, b = y + prior, n + prior
        odds = F.log(a / (n_toxic + PRIOR - a)) - F.log(b / (n_clean + PRIOR - b))
        return F.abs(odds) / F.sqrt(1 / a + 1 / b)

    may = F.greatest(z((0,), (1,)), z((2,), (3,)), z((0, 2), (1, 3))) >= Z_LEAST - 1e-6
    found = [(r[0], tuple(r[1:])) for r in counts.where(may).collect()]
    *halves, weights = three_weights(found, sums)
    if not weights:
        return Model()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict[str, float]] = [{}, {}]
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, scores, runs = read_text(text, halves[1 - half_of(text)], memos[half_of(text)])
                out.append({"label": label, "n": n, "values": sorted(Counter(scores).items()), "runs": runs})
            yield pa.RecordBatch.from_pylist(out, kind)

    pair = pa.struct([("s", pa.float64()), ("n", pa.int64())])
    kind = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("values", pa.list_(pair)), ("runs", pa.list_(pa.float64()))])
    texts = rows.mapInArrow(read, "label int, n long, values array<struct<s:double,n:long>>, runs array<double>").collect()
    return calibrate(weights, [(r["label"], r["n"], Counter({v["s"]: v["n"] for v in r["values"]}), r["runs"]) for r in texts])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (first and last word, E-value) for every document."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("e_value", T.DoubleType())])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("e_value", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                found, _ = passages(text.as_py(), model, memo)
                scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, model.base + model.slope * math.log1p(strength(found)))))))
                spans.append([{"first": a, "last": b, "e_value": e} for a, b, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=schema.names)

    return docs.mapInArrow(run, schema).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with all their columns; decided row by row, without a join."""
    spark = docs.sparkSession
    ship(spark)
    model = learn(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep = [1 / (1 + math.exp(-min(30.0, max(-30.0, model.base + model.slope * math.log1p(strength(passages(t.as_py(), model, memo)[0])))))) < THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
