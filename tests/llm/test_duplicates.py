"""SimHash, vector dedup and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare
from tidemark.llm import contract, pq_dedup, simhash
from tidemark.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@given(st.integers(0, 4095), st.lists(st.integers(0, 22), min_size=0, max_size=3, unique=True))
def test_golay_corrects_three_errors(message, errors):
    code = simhash.golay()
    word = (message << 11) | int(code.rest[message])
    for e in errors:
        word ^= 1 << e
    assert int(code.index(np.array([word]))[0]) == message


@settings(deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=3, unique=True))
def test_prints_within_three_bits_share_a_key(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    rows, keys = simhash.fuzzy_keys(np.array([a, b], np.uint64))
    assert set(keys[rows == 0]) & set(keys[rows == 1])


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n\t", "One", "one Two", "a b c", "a b c a b c a b c", "É É x y\x1cz w", "x " * 500, "Straße ÀB c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def texts(rnd, n):
    words = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            t = rnd.choice(out).split(" ")
            t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 30, 300]))))
    return out


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(3)
    rows = texts(rnd, 150)
    rows += [None, "", "  ", rows[0], rows[0], "long " * 30000]
    docs = spark.createDataFrame([(i * 3 + 1, t, "en", "s", 0) for i, t in enumerate(rows)], DOCS).withColumnRenamed("n_chars", "fingerprint")
    prints = [simhash.fingerprint(t or "") for t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = {i * 3 + 1: g * 3 + 1 for i, g in enumerate(groups(len(rows), links))}
    got = simhash.simhash_near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert {r["doc_id"]: r["fingerprint"] % 2**64 for r in got} == {i * 3 + 1: p for i, p in enumerate(prints)}
    kept = simhash.deduplicate(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values())) and set(kept[0].asDict()) == set(docs.columns)


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    base = 0x0123456789ABCDEF
    prints = sorted({base} | {base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id bigint, fingerprint bigint")
    assert {r["component_id"] for r in simhash.near_duplicate_groups(df).collect()} == {0}


def test_simhash_edge_cases(spark):
    assert simhash.simhash_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.deduplicate(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d", None, None, None), (5, "a b c d", None, None, None), (5, "a b c d", None, None, None), (None, "other text here now", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_near_duplicates(docs).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.deduplicate(docs).collect()) == [(0, "other text here now"), (5, "a b c d")]


@pytest.mark.parametrize("n, links", [(40, [(i, i + 1) for i in range(39)]), (30, [(0, i) for i in range(1, 30)]), (30, [(29, i) for i in range(29)]), (50, None), (3, [])])
def test_components(spark, n, links):
    rnd = random.Random(n)
    links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(30)] if links is None else links
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    want = groups(n, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


VECTORS = "vec_id bigint, embedding array<double>, label int, cell string"


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "HELD", 16)
    monkeypatch.setattr(pq_dedup, "ASKING", 40)
    monkeypatch.setattr(pq_dedup, "PER_CELL", 20)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 12))
    vectors = [v * s + rng.normal(size=12) * 0.12 for v in base for s in (1.0, 3.0, 0.5)] + [base[0], base[0], base[0] * 2]
    rows = [(i, list(map(float, v)), i % 2, "x") for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 12, [1.0, None], [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    rows += [(1000 + i, v, 0, None) for i, v in enumerate(odd)] + [(2000, rows[0][1], None, None), (2001, [1e200] * 12, 0, None), (2002, [1e-200] * 12, 0, None), (2003, [1.0] * 5, 0, None), (None, rows[0][1], 0, None)]
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]

    def cos(a, b):
        a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else -1

    links = [(i, j) for i in range(len(good)) for j in range(i) if good[i][2] == good[j][2] and cos(good[i][1], good[j][1]) >= 0.93]
    degree = np.bincount(np.array(links).ravel(), minlength=len(good))
    root = groups(len(good), links)
    least = {}
    for i, g in enumerate(root):
        least[g] = min([x for x in (least.get(g), good[i][0]) if x is not None], default=None)
    want = {(r[0]): (0, r[0]) for r in rows} | {good[i][0]: (int(degree[i]), least[root[i]]) for i in range(len(good))}
    got = pq_dedup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows) and {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_sql_agrees_where_there_are_links(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 8))
    vectors = [v + rng.normal(size=8) * 0.2 for v in base for _ in range(6)] + [base[0], base[0]]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)] + [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 0), (503, vectors[0].tolist(), None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert compare(spark, contract.op3_product_quantisation_dedup, pq_dedup.SQL, str(tmp_path)) == len(rows)
    assert contract.op3_product_quantisation_dedup(spark, str(tmp_path)).where("n_links > 0").count() > 30


def test_probes_are_sufficient_and_few_on_clusters():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 16))[:, None, :] + rng.normal(size=(30, 20, 16)) * 0.05).reshape(-1, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    quantiser, reach = pq_dedup.Quantiser(x, 30), float(np.sqrt(2 - 2 * 0.93))
    cell, codes, error, far = quantiser.encode(x)
    asks = quantiser.probes(cell, far, reach)
    i, j = np.nonzero(x @ x.T >= 0.93)
    low, high = np.where(cell[i] <= cell[j], i, j), np.where(cell[i] <= cell[j], j, i)
    assert asks[low, cell[high]].all()
    assert asks.sum() < 3 * len(x)
    decoded = np.stack([np.concatenate([b[c] for b, c in zip(quantiser.books, row, strict=True)]) for row in codes]) + quantiser.coarse[cell]
    assert np.allclose(np.linalg.norm(x - decoded, axis=1), error)
    assert np.allclose(quantiser.lookups(x[:5], int(cell[0]), codes[cell == cell[0]]), (np.linalg.norm(x[:5, None] - decoded[cell == cell[0]][None], axis=2)) ** 2, atol=pq_dedup.SLACK / 10)


def test_vectors_empty(spark):
    assert pq_dedup.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert pq_dedup.near_duplicate_vectors(spark.createDataFrame([(1, None, 1, "")], VECTORS)).first()["kept"]
