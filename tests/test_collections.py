"""The vector store: buckets, commits, named vectors and the index."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.search import cosine_top_k
from tidemark.sources import collections as stores
from tidemark.sources.collections import ConcurrentWriteError, VectorStore


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], {"n": str(i)}) for i, v in rows], "id bigint, embedding array<double>, payload map<string,string>")


def files_of(store, name):
    return {f: sorted(os.listdir(f)) for f in store.files(name)}


def test_an_upsert_rewrites_the_buckets_of_its_ids_alone(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    store.create("c", 2)
    store.upsert("c", points(spark, [(i, [i, 1]) for i in range(2000)]))
    before = files_of(store, "c")
    store.upsert("c", points(spark, [(i, [-1, i]) for i in range(0, 2000, 100)]))
    after = files_of(store, "c")
    changed = spark.range(0, 2000, 100).select(stores.bucket_of(stores.BUCKETS)).distinct().count()
    assert len(before) == len(after) == stores.BUCKETS and changed < 30
    assert len(before.keys() - after.keys()) == changed and all(before[f] == after[f] for f in before.keys() & after.keys())
    assert store.count("c") == 2000 == store.points("c").count()
    assert store.points("c").where("embedding[0] = -1").count() == 20


def test_two_writers_lose_nothing(spark, tmp_path):
    one, other = VectorStore(spark, str(tmp_path)), VectorStore(spark, str(tmp_path))
    one.create("c", 2)
    put, raced = one._put, []

    def late(name, config, df):
        if not raced:
            raced.append(other.append("c", [[3, 3]]))
        return put(name, config, df)

    one._put = late
    one.append("c", [[1, 1], [2, 2]])
    assert {(r["id"], r["embedding"][0]) for r in one.points("c").collect()} == {(0, 3.0), (1, 1.0), (2, 2.0)}
    assert len(os.listdir(tmp_path / "c" / "points")) == 2  # what the refused attempt wrote is gone
    stale = one._config("c")
    other.append("c", [[4, 4]])
    with pytest.raises(ConcurrentWriteError):
        one._commit("c", stale)
    assert other.count("c") == 4 and not [f for f in os.listdir(tmp_path / "c" / "commits") if f.count(".") > 1 and not f.endswith("crc")]


def test_old_commits_and_their_files_go(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    store.create("c", 2, buckets=2)
    for i in range(8):
        store.upsert("c", points(spark, [(1, [i, 1])]))
    assert len(store._numbers("c")) == stores.KEEP
    held = [v for v in os.listdir(tmp_path / "c" / "points") if any(x.startswith("bucket") for x in os.listdir(tmp_path / "c" / "points" / v))]
    assert len(held) == stores.KEEP and store.points("c").first()["embedding"] == [7.0, 1.0]


def test_named_vectors(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    store.create("c", {"title": 2, "body": 3})
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0, 1.0]), (2, [0.0, 1.0], None), (3, [1.0, 1.0], [1.0, 0.0, 1.0])], "id bigint, title array<double>, body array<double>")
    store.upsert("c", rows)
    assert store.info("c")["vectors"] == {"title": 2, "body": 3}
    assert [r["id"] for r in store.search([0, 1], 3, "c", "title").collect()] == [2, 3, 1]
    assert [r["id"] for r in store.search([0, 0, 1], 3, "c", "body").collect()] == [1, 3]
    store.build_index("c")
    fused, _ = store.indexed_search("c", {"title": [0, 1], "body": [1, 0, 0]}, 5, {"body": 2.0})
    assert [(r["id"], r["score"]) for r in fused.collect()] == [(3, round(2**-0.5 + 2 * 2**-0.5, 6)), (1, 0.0)]
    for wrong in (lambda: store.upsert("c", rows.select("id")), lambda: store.upsert("c", rows.withColumn("body", F.col("title"))), lambda: store.search([1], 1, "c", "none"), lambda: store.indexed_search("c", {"title": [0, 1]}, 5, {"title": -1.0})):
        with pytest.raises(ValueError):
            wrong()


def clustered(rng, n, width, groups):
    return (rng.normal(size=(groups, width))[rng.integers(0, groups, n)] * 3 + rng.normal(size=(n, width)) * 0.2).round(3)


@pytest.mark.parametrize("k", [1, 10, 400])
def test_the_index_finds_what_a_scan_finds_and_reads_less(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(stores, "CELL_POINTS", 20)
    rng = np.random.default_rng(7)
    a, b = clustered(rng, 1200, 6, 12), clustered(rng, 1200, 4, 12)
    a[3] = 0
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "id bigint, main array<double>, side array<double>")
    store = VectorStore(spark, str(tmp_path))
    store.create("c", {"main": 6, "side": 4})
    store.upsert("c", df)
    with pytest.raises(ValueError):
        store.indexed_search("c", {"main": a[0].tolist()}, k)
    store.build_index("c")
    for at in (0, 500):
        hits, share = store.indexed_search("c", {"main": a[at].tolist()}, k)
        plain = cosine_top_k(df.select("id", F.col("main").alias("embedding")), a[at].tolist(), k)
        assert [(r["id"], r["score"]) for r in hits.collect()] == [(r["id"], r["score"]) for r in plain.collect()]
        assert share < 0.3 if k <= 10 else share <= 1
        u, v = a[at] / max(np.linalg.norm(a[at]), 1e-9), b[at] / np.linalg.norm(b[at])
        with np.errstate(all="ignore"):
            scores = np.round(0.7 * (a @ u) / np.linalg.norm(a, axis=1) + 0.3 * (b @ v) / np.linalg.norm(b, axis=1), 6)
        want = [i for i in np.lexsort((np.arange(1200), -np.nan_to_num(scores, nan=-9))).tolist() if i != 3][:k]
        fused, share = store.indexed_search("c", {"main": a[at].tolist(), "side": b[at].tolist()}, k, {"main": 0.7, "side": 0.3})
        assert [r["id"] for r in fused.collect()] == want and (k > 10 or share < 1)
    store.append("c", [[1.0] * 6])
    assert not store.indexed("c") and store.search(a[0].tolist(), 1, "c").count() == 1


def test_an_empty_collection_has_an_index_too(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    store.create("c", 2)
    store.build_index("c")
    assert store.search([1, 0], 3, "c").count() == 0 and store.count("c") == 0
