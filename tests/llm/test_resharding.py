import itertools
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import resharding


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(1)
    for _ in range(50):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        sizes = [rng.randrange(0, 50) for _ in range(n)]
        caps = [rng.randrange(0, 50) for _ in range(m)]
        caps[-1] += max(0, sum(sizes) - sum(caps))
        sent = resharding.flow(sizes, caps)
        assert [sum(b for (o, _), b in sent.items() if o == i) for i in range(n)] == sizes
        assert all(sum(b for (_, j), b in sent.items() if j == k) <= caps[k] for k in range(m))
        stay = sum(min(s, c) for s, c in zip(sizes, caps, strict=False))
        assert sum(b for (i, j), b in sent.items() if i != j) == sum(sizes) - stay


def test_too_little_room():
    with pytest.raises(ValueError, match="small"):
        resharding.flow([5], [4])


def test_every_row_has_one_place_and_shards_are_near_equal(spark, documents, folder):
    rng = random.Random(2)
    texts = [None, "", "é" * 50, *["x" * rng.randrange(0, 200) for _ in range(600)], *["same"] * 300]
    sources = [None if i == 0 else "hot" if i % 3 else f"s{i % 7}" for i in range(len(texts))]
    docs = documents(texts, sources).repartition(5).withColumns({"size": F.lit("x"), "block": F.lit(1)})
    got = resharding.digests(docs, folder).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert all(r["size"] == sizes[r["doc_id"]] and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    total = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(total) - min(total) <= 2 * max(sizes)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_what_may_stay_stays(spark, documents, folder):
    layout = resharding.lay_out(documents(["x" * 9] * 80), f"{folder}/old", F.col("doc_id") % 8)
    assert resharding.reshard(spark, f"{folder}/old", f"{folder}/aside", layout.schema) == resharding.Moved(0, 0, 0)
    assert layout.count() == 80


def test_fewer_shards(spark, documents, folder):
    layout = resharding.lay_out(documents(["x" * 9] * 80), f"{folder}/old", F.col("doc_id") % 8)
    resharding.reshard(spark, f"{folder}/old", f"{folder}/aside", layout.schema, shards=2)
    now = resharding.read(spark, f"{folder}/old", layout.schema)
    placed = resharding.slots(now.select("doc_id", "shard", "block", "place")).collect()
    assert sorted((r["shard"], r["slot"]) for r in placed) == list(itertools.product(range(2), range(40)))


def files_of(folder):
    root = folder.removeprefix("file://")
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_the_folder_holds_every_row_once_and_untouched_files_stay(spark, documents, folder):
    rng = random.Random(6)
    texts = ["x" * rng.randrange(0, 90) for _ in range(900)]
    docs = documents(texts, [f"s{min(rng.randrange(12), rng.randrange(12))}" for _ in texts]).repartition(6)
    layout = resharding.lay_out(docs, f"{folder}/l", F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(8)))
    before, sizes = files_of(f"{folder}/l"), {r["shard"]: r["n"] for r in layout.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    was = {r["doc_id"]: r["shard"] for r in layout.collect()}
    done = resharding.reshard(spark, f"{folder}/l", f"{folder}/aside", layout.schema)
    after = files_of(f"{folder}/l")
    same = before.keys() & after.keys()
    assert same and all(before[f] == after[f] for f in same) and len(before) - len(same) == done.gone and len(after) - len(same) == done.written
    rows = spark.read.parquet(f"{folder}/l").collect()  # the whole folder, with no filter
    assert sorted(r["doc_id"] for r in rows) == list(range(900)) and all(r["text"] == texts[r["doc_id"]] for r in rows)
    moved = sum(r["size"] for r in rows if was[r["doc_id"]] != r["shard"])
    fewest = sum(max(0, n - sum(sizes.values()) / 8) for n in sizes.values())
    assert moved == done.bytes and abs(moved - fewest) <= 64 * 91
    assert resharding.reshard(spark, f"{folder}/l", f"{folder}/aside", layout.schema).bytes <= 16 * 91  # once even, there is next to nothing to move


def test_a_commit_can_be_run_again(spark, documents, folder, monkeypatch):
    """The run fails in the middle of its commit; running that again from the journal brings the folder in order."""
    layout = resharding.lay_out(documents(["x" * 9] * 200), f"{folder}/l", F.lit(0))
    whole = resharding.commit
    monkeypatch.setattr(resharding, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        resharding.reshard(spark, f"{folder}/l", f"{folder}/aside", layout.schema)
    assert layout.count() == 200
    for _ in range(2):
        whole(spark, f"{folder}/l", f"{folder}/aside")
    rows = resharding.read(spark, f"{folder}/l", layout.schema).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(200)) and {r["shard"] for r in rows} == set(range(8))


def test_names_that_clash_and_null_ids(documents, folder):
    docs = documents(["a", None, "b", "b"], ids=[None, None, 1, 1]).withColumns({c: F.lit("x") for c in ("shard", "part", "to", "place", "before", "size", "block")})
    layout = resharding.lay_out(docs, f"{folder}/l", F.lit(1))
    assert {r["part"] + r["to"] for r in layout.collect()} == {"xx"} and {r["shard"] for r in layout.collect()} == {1}
    assert sorted(r["slot"] for r in resharding.slots(layout).collect()) == [0, 1, 2, 3]
    assert resharding.digests(docs, f"{folder}/d").count() == 4


def test_empty_table(documents, folder):
    assert resharding.digests(documents([]), folder).count() == 0
