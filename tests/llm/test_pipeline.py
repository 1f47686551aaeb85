import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import line_dedup, packing, toxicity
from plumbline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_dedup import brute_lines, jaccard

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_its_sql(spark, small, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted(map(str, ([r[c] for c in columns] for r in got.collect())))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert rows == sorted(map(str, ([r[names.index(c)] for c in columns] for r in want.fetchall())))


def test_ten_queries_and_the_pipeline_are_registered():
    import __spark_entry__

    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_stages_against_brute_force(spark, small):
    """Each stage on its own input; in the end every token of what was kept has a place."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit([(r["text"], r["label"]) for r in toxicity.training_rows(docs, labels).collect()])
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, small)
    import math

    prob = lambda t: 1 / (1 + math.exp(-(model.base + model.slope * math.log1p(toxicity.strength(toxicity.passages(t, model)[0])))))
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and kept == {i for i, r in rows.items() if prob(r["text"]) < toxicity.THRESHOLD}

    lines = stages["line_dedup"](spark, clean, small)
    order = sorted(kept)
    want = dict(zip(order, brute_lines([(rows[i]["source"], rows[i]["text"]) for i in order], line_dedup.RATIO, line_dedup.LEAST), strict=True))
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert lines.columns == docs.columns and got == want

    unique = stages["simhash_near_dedup"](spark, lines, small)
    left = {r["doc_id"] for r in unique.collect()}
    assert unique.columns == docs.columns
    copies = [(a, b) for a in left for b in left if a < b and got[a] and got[a].split() and got[a] == got[b]]
    assert not copies
    for i in set(got) - left:  # whatever went has a near copy among all
        assert any(j != i and jaccard(got[i], got[j]) > 0.5 for j in got)

    packed = stages["best_fit_packing"](spark, unique, small).collect()
    enc = packing.encoder()
    assert sum(r["length"] for r in packed) == sum(len(enc.encode(got[i] or "")) // 4 + 1 for i in left)
    whole = corpus_pipeline.run(spark, small)
    assert whole.count() == len(packed) and whole.agg(F.sum("length")).first()[0] == sum(r["length"] for r in packed)


def test_near_duplicate_stage_takes_rows_of_one_id_apart(spark, small):
    words = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    rows = [(1, words("a")), (2, words("b")), (2, words("b")), (3, words("a")), (3, words("c")), (None, words("a")), (4, None), (4, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, small)
    assert got.columns == docs.columns
    want = [(1, words("a")), (2, words("b")), (3, words("c")), (None, words("a")), (4, None), (4, " ")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


CLASHES = ["dropped_lines", "row", "fp", "digest", "node", "c0", "c1", "score", "label", "held_out", "piece", "ids", "first", "b", "p", "key", "keys"]


def odd_documents(spark, rows):
    """doc_id, text, source and columns whose names the operators use themselves."""
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})


def odd_rows():
    body = lambda k: "\n".join(f"line {k} {n} with some words of its own x{k * n}" for n in range(8))
    rows = [(i, "Menu\n" + body(i) + "\nFooter", "s") for i in range(30)]
    rows += [(3, rows[3][1], "s"), (3, rows[3][1], "s"), (4, body(99), "s"), (40, rows[7][1], None), (41, None, "s"), (42, "", None), (43, " \n\t", "s"), (None, rows[1][1], "s"), (None, None, None)]
    rows += [(50, "word " * 60_000 + "end", "long"), (51, " " * 600_000 + "\n" * 600_000, "long"), (52, "x" * 400_000, "long")]
    return rows


@pytest.fixture()
def odd(spark):
    return odd_documents(spark, odd_rows())


def as_rows(df):
    return sorted(map(str, (r.asDict(recursive=True) for r in df.collect())))


def test_stages_keep_odd_rows_and_a_callers_columns(spark, odd, small):
    stages = dict(corpus_pipeline.STAGES)
    before = as_rows(odd)
    clean = stages["toxicity"](spark, odd, small)
    assert clean.columns == odd.columns and set(as_rows(clean)) <= set(before)
    assert not {41, 42, 43, 50, 51, 52} - {r["doc_id"] for r in clean.collect()}

    lines = stages["line_dedup"](spark, odd, small)
    want = brute_lines([(s, t) for _, t, s in odd_rows()], line_dedup.RATIO, line_dedup.LEAST)
    assert lines.columns == odd.columns
    got = sorted(((r["doc_id"], r["text"]) for r in lines.collect()), key=str)
    assert got == sorted([(i, t) for (i, _, _), t in zip(odd_rows(), want, strict=True)], key=str)
    assert all(r["dropped_lines"] == f"dropped_lines of {'none' if r['doc_id'] is None else r['doc_id']}" for r in lines.collect())

    unique = stages["simhash_near_dedup"](spark, odd, small)
    assert unique.columns == odd.columns
    left = sorted(((r["doc_id"], r["text"]) for r in unique.collect()), key=str)
    seen, want = set(), []
    for i, t, _ in sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0)):
        words = " ".join((t or "").split())
        if i is None or not words or words not in seen:  # texts without words and rows without an id always stay
            want.append((i, t))
        if i is not None:
            seen.add(words)
    assert left == sorted(want, key=str)

    packed = stages["best_fit_packing"](spark, odd, small).collect()
    enc = packing.encoder()
    assert sum(r["length"] for r in packed) == sum(len(enc.encode(t or "")) // 4 + 1 for _, t, _ in odd_rows())


def test_stages_and_pipeline_of_an_empty_table(spark, odd, small, tmp_path):
    empty = odd.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, empty, small)
        assert got.columns == odd.columns and got.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, small).count() == 0
    labels = spark.read.parquet(f"{small}/labels.parquet")
    odd.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_pipeline_of_odd_rows(spark, odd, small, tmp_path):
    """Every stage's decisions take effect on the next one's input."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
    enc = packing.encoder()
    want = sum(len(enc.encode(r["text"] or "")) // 4 + 1 for r in docs.collect())
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").agg(F.sum("length")).first()[0]
    assert got == want
