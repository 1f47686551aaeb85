import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(901, None, 0), (902, [], 0), (903, [1.0, None, 2.0, 0.0], 0), (904, [nan, 0.0, 0.0, 0.0], 0), (905, [inf, 0.0, 0.0, 0.0], 0), (None, [1.0] * 4, 0), (906, [1.0, 2.0], 0), (907, [0.0] * 4, 0)]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"x": F.lit(1), "query": F.lit(2), "score": F.lit(3), "task": F.lit("t")}) if extra else df


def brute(rows, every, k, measure, valid):
    good = [(i, e) for i, e, _ in rows if i is not None and e and valid(e)]
    out = []
    for q, x in good:
        if q % every == 0:
            scored = sorted((-measure(x, y), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def finite(e):
    return all(v is not None and math.isfinite(v) for v in e)


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[5:90] = x[4]  # a large group of copies: ties
    return [(i, [float(v) for v in x[i]], 0) for i in range(n)]


def test_exact_top_k_with_ties_copies_and_bad_rows(spark, folder):
    rows = vectors(300, 4, 1) + odd_rows() + [(300, [2.0] * 4, 0), (300, [3.0] * 4, 0)]
    df = table(spark, rows).repartition(3)
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 10 = 0 AND vec_id < 300"), folder, k=7, block=11).collect()))
    dot = lambda x, y: sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(x, y, strict=True))
    want = [r for r in brute(rows, 10, 7, dot, finite) if r[0] < 300]
    assert got == want


def test_very_large_components_stay_exact(spark, folder):
    rows = [(0, [1e12, 1.0], 0), (1, [1e9, -3.0], 0), (2, [1e9, -4.0], 0), (3, [1e30, 0.0], 0), (4, [-1e30, 0.0], 0)]
    got = {(r["vec_id"]): r["score"] for r in topk.search(table(spark, rows), table(spark, rows[:1]), folder).collect()}
    dot = lambda x, y: sum(int(math.floor(1024 * float(np.float32(a)))) * int(math.floor(1024 * float(np.float32(b)))) for a, b in zip(x, y, strict=True))
    hold = lambda v: max(-(2**63) + 1, min(2**63 - 1, v))
    assert got == {i: hold(dot(rows[0][1], e)) for i, e, _ in rows[1:]}


def test_one_outlier_leaves_a_tile_fast_and_exact(spark, folder):
    """A tile with one huge row and copies of it, among thousands of ordinary ones."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(rng.standard_normal((2000, 16)).astype(np.float32))]
    rows += [(2000 + i, [float(np.float32(1e5 * v)) for v in rng.standard_normal(16).astype(np.float32)], 0) for i in range(2)] + [(2100 + i, rows[7][1], 0) for i in range(50)]
    df = table(spark, rows, extra=False).coalesce(1)
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0"), folder, k=5).collect()))
    dot = lambda x, y: sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(x, y, strict=True))
    assert got == brute(rows, 50, 5, dot, finite)


def test_scores_beyond_a_long_are_ranked_as_what_they_are(spark, folder):
    """All of these are shown as an end of a long; their order is by the true score, in one task and over several."""
    sizes = [3e20, 1e20, 5e20, 2e20, 4e20, 5e20]
    rows = [(100, [1e20, 1.0], 0)] + [(i, [float(np.float32(v)), 0.0], 0) for i, v in enumerate(sizes)] + [(50 + i, [-float(np.float32(v)), 0.0], 0) for i, v in enumerate(sizes)]
    for n in (1, 5):
        df = table(spark, rows, extra=False).repartition(n)
        got = [r["vec_id"] for r in topk.search(df, df.where("vec_id = 100"), f"{folder}/{n}", k=12).orderBy("rank").collect()]
        assert got == [2, 5, 4, 0, 3, 1, 51, 53, 50, 54, 52, 55]


def test_neighbours_of_few_rows_are_all_of_them(spark, folder):
    """Fewer candidates than k, a length that only one other row has, and a query whose id is repeated."""
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(np.random.default_rng(5).standard_normal((9, 4)))]
    rows += [(20, [1.0, 2.0], 0), (21, [2.0, 1.0], 0)] + [(40, [1.0, 0.0, 0.0, 0.0], 0)] * 25 + [(41, [1.0, 0.0, 0.0, 0.0], 0)]
    got = ann.search(table(spark, rows), table(spark, rows).where("vec_id IN (0, 20, 40)"), folder, k=40).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {v for _, v in found[0]} == {*range(1, 9), 40, 41} and [v for _, v in found[20]] == [21]
    assert {v for _, v in found[40]} == {*range(9), 41}


def test_copies_of_one_vector_under_many_ids():
    x = np.repeat([[1.0, 2.0]], 60, axis=0)
    ids = np.array([7] * 30 + list(range(100, 130)))
    kept = ids[ann.first_copies(ids, x, 5)]
    assert sorted(set(kept.tolist())) == [7, 100, 101, 102, 103] and (kept == 7).sum() == 5


def test_structured_vectors_are_found_by_few_candidates(spark, folder):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 2000)] / 5 + 0.05 * rng.standard_normal((2000, 32))
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x.astype(np.float32))]
    df, shares = table(spark, rows, extra=False), []
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, df.where("vec_id % 20 = 0"), folder, k=10, shares=shares).collect()}
    want = brute(rows, 20, 10, lambda a, b: float(np.dot(a, b)), finite)
    assert len(got & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    assert [n for n, _, _ in shares] == [32] and shares[0][2] < 0.25


def test_where_probes_do_not_reach_the_target_all_rows_are_candidates(spark, folder, monkeypatch):
    monkeypatch.setattr(ann, "MOST_PROBES", 1)
    rows = vectors(300, 16, 9)
    df, shares = table(spark, rows), []
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, df.where("vec_id % 20 = 0"), folder, k=5, shares=shares).collect()}
    inner = lambda x, y: float((np.float64(np.float32(x)) * np.float64(np.float32(y))).sum())
    assert shares == [(16, None, 1.0)] and got == {r[:3] for r in brute(rows, 20, 5, inner, finite)}


def test_neighbours_recall_scores_and_order(spark, folder):
    rows = vectors(800, 16, 3) + odd_rows()
    df = table(spark, rows).repartition(3)
    got = [tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0"), folder, k=10, block=40).collect()]
    inner = lambda x, y: float((np.float64(np.float32(x)) * np.float64(np.float32(y))).sum())
    want = brute([r for r in rows if r[0] != 907], 20, 10, inner, finite)
    found = {(q, v) for q, _, v, _ in got}
    assert len(found & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    vec = {i: e for i, e, _ in rows}
    for q in {r[0] for r in got}:
        mine = sorted(r for r in got if r[0] == q)
        assert [r[1] for r in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (-r[3], r[2]))
        assert all(s == pytest.approx(inner(vec[q], vec[v]), abs=1e-12) for _, _, v, s in mine)


def test_recall_on_given_data(spark, small, folder):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, df.where("vec_id % 20 = 0"), folder).collect()}
    rows = [tuple(r) for r in df.collect()]
    want = brute(rows, 20, 20, lambda x, y: float(np.dot(x, y)), finite)
    assert len(got & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


def test_probe_order_starts_at_the_own_bucket_and_never_crosses_both_borders():
    sets = ann.order(4, 200)
    assert sets[0] == () and len(set(sets)) == len(sets) == 3**4
    assert all(2 * 4 - 1 - r not in s for s in sets for r in s)


def test_empty_tables(spark, folder):
    df = table(spark, [])
    assert topk.search(df, df, folder).count() == 0
    assert ann.search(df, df, folder + "/b").count() == 0
    some = table(spark, vectors(100, 4, 1))
    assert ann.search(some, df, folder + "/c").count() == 0
