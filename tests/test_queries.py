"""Every registered query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from plumbline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, str)):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return "nan" if math.isnan(v) else f"{round(float(v), 6) + 0.0:.6f}"


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_its_sql(spark, small, con, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(catalog.oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", ["q11_walk_forward_stateless", "j5_forecast_to_breach_and_outcome", "j14_run_comparison", "r5_model_severity", "r7_integrity_severity"])
def test_walks_match_their_sql_where_there_are_enough_days(spark, small, name):
    """The smallest tables end before a walk's first report."""
    larger = small.replace("0.001", "0.01")
    df = catalog.queries()[name](spark, larger)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{larger}/lineitem.parquet'")
    found = c.execute(catalog.oracles()[name])
    names = [d[0] for d in found.description]
    assert got and sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(x)]) for x in columns) for r in found.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6


@pytest.mark.parametrize("name", ["w1_w2_band_edges", "t2_t3_t4_w11_breach_tests", "b0_b1_day_bootstrap", "t19_reliability_table"])
def test_partitions_change_nothing(spark, small, name):
    def rows(n):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return sorted(map(str, catalog.queries()[name](spark, small).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert rows("1") == rows("8")


def test_range_severity_where_residuals_are_huge(spark, small, tmp_path):
    """Residuals over 2^48 millionths once left no half-width at all."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (p_retailprice * 1e8 + p_partkey AS p_retailprice) FROM '{small}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = {r[0]: r for r in c.execute(catalog.oracles()["r3_range_severity"]).fetchall()}
    got = {r["construction"]: tuple(r) for r in catalog.queries()["r3_range_severity"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) == {"insample", "group", "row"}
    for name, row in want.items():
        assert got[name][1:6] == pytest.approx(row[1:6], abs=0.02)


def test_the_log_is_in_the_order_of_events_and_in_files_of_bounded_size(spark, small, tmp_path, monkeypatch):
    """It once went to three files whatever its size, and records of one time stood in any order."""
    from plumbline.plans import source_queries

    made = []
    monkeypatch.setattr(source_queries, "LOG_ROWS", 50, raising=False)
    monkeypatch.setattr(source_queries, "shared", lambda _: made.append(tmp_path / "made") or f"{tmp_path}/made")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-01 00:00:00' AS ts, user_id % 9 AS user_id) FROM '{small}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = sorted(tuple(map(str, r)) for r in catalog.queries()["s8_s15_log_and_resume"](spark, str(tmp_path)).select("user_id", "done", "k").collect())
    assert got == sorted(tuple(map(str, r)) for r in c.execute(catalog.oracles()["s8_s15_log_and_resume"]).fetchall())
    lines = [len(f.read_text().splitlines()) for f in made[0].glob("log/part-*")]
    assert sum(lines) == c.execute("SELECT count(*) FROM events").fetchone()[0] and max(lines) <= 100


def test_range_severity_gathers_no_values_in_one_task(spark, small):
    """The price that a fifth of the parts reach was the percentile of a single task that held every different price."""
    df = catalog.queries()["r3_range_severity"](spark, small)
    assert "percentile(" not in df._jdf.queryExecution().executedPlan().toString()


def test_levels_of_bins_gather_no_values_in_one_task(spark, small):
    df = catalog.queries()["a26_a27_histogram_percentiles"](spark, small)
    assert "percentile(" not in df._jdf.queryExecution().executedPlan().toString()
