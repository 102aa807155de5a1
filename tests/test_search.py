"""Searches and the walk against plain models, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare
from tidemark.functions.vectors import cosine
from tidemark.operators import search
from tidemark.plans import oracles, queries
from tidemark.sources.providers import HashEmbedder

CORPUS = "id bigint, text string, embedding array<double>"


def make(spark, rows):
    return spark.createDataFrame(rows, CORPUS)


def test_top_k_orders_ties_by_id_and_skips_unscored(spark):
    df = make(spark, [(3, "c", [1.0, 0.0]), (1, "a", [2.0, 0.0]), (2, "z", [0.0, 0.0]), (4, None, None), (5, "n", [-1.0, 0.0])])
    got = [(r["id"], r["score"]) for r in search.cosine_top_k(df, [1.0, 0.0], 10).collect()]
    assert got == [(1, 1.0), (3, 1.0), (5, -1.0)]
    assert search.cosine_top_k(df, [1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        search.cosine_top_k(df, [1.0], -1)


def test_cosine_is_null_for_other_widths(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] is None


def test_query_vector():
    assert search.query_vector(None, [1, 2]) == [1, 2]
    assert search.query_vector("a b", None, HashEmbedder(8).embed) == HashEmbedder(8).embed(["a b"])[0]
    with pytest.raises(ValueError):
        search.query_vector(None, None)


def test_nearest_neighbours_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).round(1)
    x[7] = 0
    df = make(spark, [(i, str(i), v.tolist()) for i, v in enumerate(x)])
    norms = np.linalg.norm(x, axis=1)
    with np.errstate(all="ignore"):
        scores = np.round(x @ x.T / np.outer(norms, norms), 6)
    got = {}
    for r in search.nearest_neighbours(df, df, 4).collect():
        got.setdefault(r["src"], []).append((r["rnk"], r["dst"]))
    for i in range(60):
        if i == 7:
            assert i not in got
            continue
        order = [j for j in np.lexsort((np.arange(60), -np.nan_to_num(scores[i], nan=-9))) if j != 7][:4]
        assert [d for _, d in sorted(got[i])] == order


def test_blocks_go_to_python_a_few_at_a_time(spark, monkeypatch):
    key, rows, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, search.materialise
    monkeypatch.setattr(search, "materialise", lambda df, name: rows.update({name: int(spark.conf.get(key))}) or plain(df, name))
    before = spark.conf.get(key)
    df = make(spark, [(i, f"t{i}", [float(i), 1.0]) for i in range(20)])
    assert search.nearest_neighbours(df, df, 3).count() == 60
    assert rows["asks"] == rows["neighbours_found"] == search.BATCH_BLOCKS < 10 and spark.conf.get(key) == before


def model(rows, vector, top_k, depth, threshold, initial):
    """The walk on lists."""
    def cos(a, b):
        return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6)

    seen, out, current = [], [], vector
    for hop in range(depth):
        ranked = sorted(rows, key=lambda r: (-cos(current, r[2]), r[0]))[:top_k]
        start = 0 if hop == 0 else 1
        if len(ranked) <= start:
            break
        said = lambda r: cos(vector if initial else current, r[2])
        if said(ranked[start]) < threshold:
            break
        fresh = [r for r in ranked[start:] if r[1] not in seen]
        if not fresh or said(fresh[0]) < threshold:
            break
        out.append((hop + 1, fresh[0][1], said(fresh[0])))
        seen.append(fresh[0][1])
        current = fresh[0][2]
    return out


@pytest.mark.parametrize("initial", [False, True])
@pytest.mark.parametrize("threshold", [-1.0, 0.3, 1.1])
def test_walk_matches_model(spark, initial, threshold):
    rnd = random.Random(5)
    rows = [(i, f"t{i % 9}", [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(14)]
    got = search.similarity_walk(make(spark, rows), rows[0][2], 4, 6, threshold, initial).collect()
    want = model(rows, rows[0][2], 4, 6, threshold, initial)
    assert [(r["step"], r["document"]) for r in got] == [w[:2] for w in want]
    assert np.allclose([r["score"] for r in got], [w[2] for w in want])


@pytest.mark.parametrize("initial", [False, True])
@pytest.mark.parametrize(("every", "depth"), [(2, 9), (14, 2)])
def test_many_walks_match_the_model_of_each(spark, initial, every, depth):
    rnd = random.Random(6)
    rows = [(i, f"t{i % 11}", [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(28)]
    df = make(spark, [*rows, (90, None, [0.0] * 3), (None, "x", [1.0] * 3)])
    starts = df.where(f"id % {every} = 0").select(F.col("id").alias("walk"), "embedding")
    got = sorted((r["walk"], r["step"], r["document"], round(r["score"], 6)) for r in search.similarity_walks(df, starts, 4, depth, 0.3, initial).collect())
    want = [(r[0], *w) for r in rows if r[0] % every == 0 for w in model(rows, r[2], 4, depth, 0.3, initial)]
    assert got == sorted((i, step, text, round(s, 6)) for i, step, text, s in want)


def test_zero_vectors_match_sql(spark, tmp_path):
    rnd = random.Random(8)
    vectors = [(i, [0.0] * 4 if i % 5 == 3 else [rnd.uniform(-1, 1) for _ in range(4)], i % 4) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    docs = [(i, f"text {i % 50}", f"src{i % 6}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("cosine_topk", "topk_threshold", "relatedness_scores", "collection_search", "batch_knn", "similarity_walk", "similarity_walk_initial", "cross_project_merge", "cross_project_query"):
        assert compare(spark, queries.queries()[name], oracles.oracle_sql()[name], str(tmp_path)) > 0, name


def test_no_first_vector_gives_no_hits(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 0.0], 3)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(1, "t", "s")], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("cosine_topk", "topk_threshold", "relatedness_scores", "collection_search", "similarity_walk", "cross_project_merge", "cross_project_query"):
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0, name


def plain_neighbours(queries, corpus, k):
    """{id: [(dst, score), ...]} by numpy, over (id, vector) rows of any widths."""
    out = {}
    for i, v in queries:
        scored = [(-round(float(np.clip(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)), -1, 1)), 6), j) for j, w in corpus if len(w) == len(v)]
        out[i] = [j for _, j in sorted(scored)[:k]]
    return {i: x for i, x in out.items() if x}


def found_neighbours(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["src"], []).append((r["rnk"], r["dst"]))
    return {i: [d for _, d in sorted(x)] for i, x in got.items()}


def test_nearest_neighbours_over_blocks_and_rare_widths(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VALUES", 64 * 6)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 6))[:, None, :] * 4 + rng.normal(size=(12, 70, 6)) * 0.2).reshape(-1, 6)
    rows = [(i, v) for i, v in enumerate(x)] + [(2000 + i, v) for i, v in enumerate(rng.normal(size=(150, 3)))] + [(3000, np.array([1.0, 2.0])), (3001, np.array([2.0, 1.0]))]
    df = make(spark, [(i, "", v.tolist()) for i, v in rows] + [(4000, "", [0.0] * 6), (4001, "", None), (None, "", [1.0] * 6)])
    assert found_neighbours(search.nearest_neighbours(df, df, 3)) == plain_neighbours(rows, rows, 3)
    asking = [(10 + i, v) for i, v in enumerate(rng.normal(size=(90, 6)))] + [(7, np.ones(2)), (8, np.ones(5))]
    other = make(spark, [(i, "", v.tolist()) for i, v in asking])
    assert found_neighbours(search.nearest_neighbours(other, df, 4)) == plain_neighbours(asking, rows, 4)


def test_a_width_that_no_sample_has(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(12_000, 8)))] + [(20_000, np.arange(5.0)), (20_001, np.ones(5)), (20_002, np.ones(9))]
    df = make(spark, [(i, "", v.tolist()) for i, v in rows])
    asked = df.where("id < 40 or id >= 20000")
    assert found_neighbours(search.nearest_neighbours(asked, df, 2)) == plain_neighbours([r for r in rows if r[0] < 40 or r[0] >= 20_000], rows, 2)


def test_neighbours_of_nothing(spark):
    df = make(spark, [(1, "", [1.0, 0.0])])
    assert search.nearest_neighbours(df.limit(0), df, 3).count() == 0
    assert search.nearest_neighbours(df, df.limit(0), 3).count() == 0


def test_blocks_follow_rows_and_few_of_them_meet(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VALUES", 64 * 6)
    met = spark.sparkContext.accumulator(0)
    plain = search._nearest

    def counting(*args):
        met.add(1)
        return plain(*args)

    monkeypatch.setattr(search, "_nearest", counting)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 6))[:, None, :] * 4 + rng.normal(size=(20, 100, 6)) * 0.1).reshape(-1, 6)
    df = make(spark, [(i, "", v.tolist()) for i, v in enumerate(x)])
    assert search.nearest_neighbours(df, df, 3).count() == 6000
    assert 30 <= met.value < 32 * 32 / 2


def test_excluded_projects_are_never_asked(spark):
    rows = [(0, "1", "a", "small"), (1, "2", "b", "large"), (2, "3", "c", "small"), (3, "4", "d", "")]
    asked = []

    def query(slug):
        asked.append(slug)
        return spark.createDataFrame([(1, {"a": 0.9, "c": 0.95}.get(slug, 0.1))], "id bigint, score double")

    hits, selection = search.search_projects(spark.createDataFrame(rows, "position bigint, id string, slug string, embedding_model string"), query, default_model="small")
    assert [(r["project"], r["score"]) for r in hits.collect()] == [("c", 0.95), ("a", 0.9), ("d", 0.1)] and asked == ["a", "c", "d"]
    assert selection.where("not included").first()["slug"] == "b"


def test_engines(spark):
    engine = search.FrameEngine(make(spark, [(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])]))
    assert [r["id"] for r in engine.search_query([0.0, 2.0], 1).collect()] == [2]
    with pytest.raises(TypeError):
        search.SearchEngine()


def test_walk_ends_where_rows_end(spark):
    df = make(spark, [(0, "a", [1.0, 0.0])])
    assert [r["document"] for r in search.similarity_walk(df, [1.0, 0.0], 1, 5, 0.1).collect()] == ["a"]
    assert search.similarity_walk(df.limit(0), [1.0, 0.0]).count() == 0


def test_merge_keeps_selected_projects(spark):
    hits = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.3), ("b", 1, 0.7), ("c", 1, 1.0)], "project string, id bigint, score double")
    chosen = spark.createDataFrame([("a",), ("b",)], "slug string")
    assert [r["score"] for r in search.merge_project_hits(hits, chosen).collect()] == [0.9, 0.7, 0.3]
    assert search.merge_project_hits(hits, chosen, 0).count() == 0
    with pytest.raises(ValueError):
        search.merge_project_hits(hits, chosen, -1)
