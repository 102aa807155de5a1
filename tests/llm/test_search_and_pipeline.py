"""Exact top-k against brute force; the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contract, mixing, packing, pii, simhash, topk, toxicity
from tidemark.llm.shared import table

VECTORS = "vec_id bigint, embedding array<double>, label int, score string"


def brute(rows, k=20):
    good = [(i, v, [int(np.floor(64 * x)) for x in e]) for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, v, q in good:
        if v % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), w) for j, w, c in good if j != i)[:k]
            out += [(v, r + 1, w, -s) for r, (s, w) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "few"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "HEAD", 25)
    rnd = random.Random(kind)
    n = 12 if kind == "few" else 130
    value = (lambda: rnd.choice([0.0, 0.02])) if kind == "ties" else (lambda: rnd.gauss(0, 1e3 if kind == "wide" else 0.3))
    rows = [(i, [value() for _ in range(6)]) for i in range(n)]
    rows += [(200, None), (220, []), (240, [None] * 6), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (None, [1.0] * 6), (300, [0.0] * 6), (20, [0.5] * 6), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(v, e, 0, "x") for v, e in rows], VECTORS)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect()) == brute(rows)


def test_short_candidates_are_never_shipped(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "HEAD", 40)
    rnd = random.Random(9)
    rows = [(i, [abs(rnd.gauss(0, 1)) * (30 if i < 60 else 0.5) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame([(v, e, 0, "x") for v, e in rows], VECTORS)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect()) == brute(rows)
    held = [{"low": [1.0], "high": [2.0], "rest": 1.0, "most": 2.3}, {"low": [-2.0], "high": [-1.0], "rest": 0.0, "most": 2.0}]
    assert topk._reach(np.array([[3.0, 0.5], [-1.0, 0.0]]), np.array([6, 2]), held, 1).tolist() == [[True, False], [False, True]]


def test_blocks_that_cannot_hold_a_score_are_not_met(spark, monkeypatch):
    for name, value in {"CANDIDATES": 64, "QUERIES": 16, "HEAD": 1000, "LEAST_BLOCK": 16}.items():
        monkeypatch.setattr(topk, name, value)
    met, plain = spark.sparkContext.accumulator(0), topk._meet

    def counting(asked, *rest):
        met.add(len(asked[0]))
        return plain(asked, *rest)

    monkeypatch.setattr(topk, "_meet", counting)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(25, 24))[rng.integers(0, 25, 2000)] + rng.normal(size=(2000, 24)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]  # all of one length
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], VECTORS)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect()) == brute(rows)
    assert 100 <= met.value < 100 * (2000 // 64) / 3  # of queries and blocks, under a third meet


def test_top_k_empty_and_huge(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0, "")], VECTORS)).count() == 0
    huge = spark.createDataFrame([(20, [1e30, 1.0], 0, ""), (3, [1e30, 1.0], 0, ""), (4, [-1e30, 1.0], 0, "")], VECTORS)
    assert [(r["vec_id"], r["rank"]) for r in topk.top_k(huge).orderBy("rank").collect()] == [(3, 1), (4, 2)]


def test_pipeline_stages(spark, small):
    docs = table(spark, small, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "pii", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, small)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        kept[name] = rows
        assert name == "packing" or docs.columns == before
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, small, "labels").collect()}
    everyone = table(spark, small, "documents").collect()
    gone = {r["doc_id"] for r in everyone} - {r["doc_id"] for r in kept["toxicity"]}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in gone for d in clean) <= 0.01 * len(clean) and len(gone) > 0
    prints = {}
    for r in kept["simhash"]:
        prints[r["doc_id"]] = simhash.fingerprint(r["text"])
    values = np.array(list(prints.values()), np.uint64)
    for i, p in enumerate(values[:-1]):
        assert (np.bitwise_count(values[i + 1 :] ^ p) > 3).all()
    survivors = {r["doc_id"] for r in kept["toxicity"]}
    assert set(prints) <= survivors and len(prints) == len(kept["simhash"])
    assert {r["doc_id"] for r in kept["pii"]} == set(prints)
    assert all(not any(ok for *_, ok in pii.base_matches(r["text"])) and r["n_chars"] == len(r["text"]) for r in kept["pii"])
    counts = {}
    for r in kept["mixing"]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 3
    pieces = {}
    for r in kept["packing"]:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        assert len(r["ids"]) == r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in kept["packing"]}
    assert pieces == {d: tokens[d] * n for d, n in counts.items()}


def plain_pipeline(docs, labels, spark, folder):
    """The stages on lists: (doc_id, text, source) rows in, copies of documents and their token ids out."""
    frame = table(spark, folder, "documents")
    toxic = toxicity.fit_toxicity(frame, table(spark, folder, "labels"))
    rows = [r for r in docs if toxic.score(toxic.counts(r[1] or "")[None, :])[0] < 0.5]
    prints = [simhash.fingerprint(r[1] or "") for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    seen = Counter((k, v, pii.traits(r[1], a, b)) for r in rows if r[1] for k, a, b, _, v in pii.candidates(r[1]))
    model = pii.SpanClassifier(seen)
    rows = [(d, t if t is None else pii.redacted(t, model), s) for d, t, s in rows]

    def size(t):
        return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    def draw(d, t):
        inner = hashlib.md5((t or "").encode()).hexdigest()
        return int(hashlib.md5(f"{'null' if d is None else d}:0:{inner}".encode()).hexdigest()[:12], 16) % mixing.STEPS

    per = Counter()
    for _, t, s in rows:
        per[s] += size(t)
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight, full = {s: i % 3 + 1 for i, s in enumerate(order)}, set()
    while True:
        level = (sum(per.values()) - sum(3 * per[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        more = {s for s in order if s not in full and weight[s] * level > 3 * per[s]}
        if not more:
            break
        full |= more
    copies = Counter()
    for s in order:
        target = 3 * per[s] if s in full else weight[s] * level
        rate = target / per[s] if per[s] else 0
        mine = [(draw(d, t), d, t) for d, t, x in rows if x == s]
        wanted, words, low, high = target - int(rate) * per[s], 0, (0, -1), None
        for step in sorted({x for x, *_ in mine}):
            words += sum(size(t) for x, _, t in mine if x == step)
            if words <= wanted:
                low = max(low, (words, step))
            elif high is None:
                high = (words, step)
        coin = int(hashlib.md5(f"{'null' if s is None else s}:0".encode()).hexdigest()[:12], 16) / 2**48
        last = high[1] if high and coin < (wanted - low[0]) / (high[0] - low[0]) else low[1]
        for x, d, t in mine:
            copies[d, t] += int(rate) + (x <= last)
    return +copies


def test_pipeline_matches_a_plain_version(spark, tiny):
    labels = table(spark, tiny, "labels")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, tiny, "documents").orderBy("doc_id").collect()]
    want = plain_pipeline(docs, labels, spark, tiny)
    tokens = {(d, t): [*packing.bpe().coder.encode(t or "", allowed_special="all"), 1] for d, t in want}
    got, offsets = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, tiny).collect():
        got[r["doc_id"]].append((r["start"], list(r["ids"]), r["doc_tokens"]))
        offsets[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == {d for d, _ in want}
    for (d, t), n in want.items():
        ids = tokens[d, t]
        assert all(total == len(ids) and piece == ids[at : at + len(piece)] for at, piece, total in got[d])
        assert Counter(i for at, piece, _ in got[d] for i in range(at, at + len(piece))) == Counter(dict.fromkeys(range(len(ids)), n))
    for places in offsets.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_pipeline_runs_over_all_documents(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 0
    assert sorted(int(k[2:].split("_")[0]) for k in contract.queries() if k.startswith("op")) == list(range(1, 14))


def test_stages_take_odd_documents(spark, tiny):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c", None, "s", 5), (3, "x" * 100_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema).withColumn("label", F.lit("clash")).withColumn("h1", F.lit(1)).withColumn("ids", F.lit("y"))
    for given in (docs, docs.limit(0)):
        stage_docs = given
        for _, stage in corpus_pipeline.STAGES:
            stage_docs = stage(spark, stage_docs, tiny)
        assert stage_docs.count() >= (1 if given is docs else 0)
