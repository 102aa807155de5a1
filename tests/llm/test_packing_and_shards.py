"""Packing by exact round trip, sharding and mixing by their laws, licences by digests."""

from __future__ import annotations

import pathlib
import random
import textwrap
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import contract, licences, mixing, packing, sharding
from oracle import compare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(0, 60))
def test_best_fill(counts, need):
    used = packing.best_fill(counts, need)
    assert all(0 < n <= counts[k] for k, n in used.items())
    best = max(s for c in product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(c, counts, strict=True))) <= need)
    assert sum(k * n for k, n in used.items()) == best


def check_pieces(rows, expected, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], np.uint32).tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sum((list(ids) for _, ids, _ in sorted(p)), []) for d, p in pieces.items()} == expected
    for d, p in pieces.items():
        assert all(t == len(expected[d]) for *_, t in p)
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(map(len, expected.values())))


def test_packing_round_trip(spark, tiny):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    exact = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    odd = [None, "", " ", "a  b\n\n c", "x<|endoftext|>y", "日本語 🎉", "word" * 3000, "é" * 5000, "\t\r\n\x1c z"]
    rows += [(10_000 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).repartition(3, "doc_id")
    expected = {d: exact.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    assert check_pieces(packing.pack(docs).collect(), expected, 2048) < 0.01
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [[1500] * 40, [3, 5, 7], [2048], [1], [2047, 2047], list(range(1, 400))])
def test_packer_keeps_every_id(lengths):
    packer = packing.Packer()
    for i, n in enumerate(lengths):
        packer.add([i, 0, np.full(n, i, np.uint32).tobytes(), n])
    windows = list(packer.windows(0))
    sizes = [sum(len(p[2]) // 4 for p in w) for w in windows]
    assert sum(sizes) == sum(lengths) and max(sizes) <= 2048
    assert all(s & (s - 1) == 0 or 2048 - s <= packing.MAX_SLACK for s in sizes)
    for i, n in enumerate(lengths):
        parts = sorted((p[1], len(p[2]) // 4) for w in windows for p in w if p[0] == i)
        assert sum(k for _, k in parts) == n and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:], strict=False))


def shards_of(spark, rows, n=24):
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit(1)).repartition(3)
    out = [r.asDict() for r in sharding.shard(docs, n).collect()]
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert len(out) == len(rows) and all(0 <= r["shard"] < n and r["law"] == "bytes" and r["grown_shard"] is None for r in out)
    return out


def test_shards_are_near_equal_and_keep_equal_texts(spark):
    rnd = random.Random(4)
    rows = [(i, "x" * rnd.randrange(1, 60) + str(i // 3), rnd.choice(["en", "de", None]), "s", 0) for i in range(1500)]
    out = shards_of(spark, rows)
    total = defaultdict(int)
    for r in out:
        total[r["shard"]] += r["size"]
    assert len(total) == 24 and max(total.values()) - min(total.values()) <= 6 * 70
    text = {i: t for i, t, *_ in rows}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in out)


def test_equal_texts_share_a_shard_whatever_their_language(spark):
    rows = [(i, f"text number {i // 4} " + "x" * (i // 4 % 37), ["en", "de", "fr", None][i % 4], "s", 0) for i in range(8000)]
    where, total = defaultdict(set), defaultdict(int)
    for r in shards_of(spark, rows):
        where[rows[r["doc_id"]][1]].add(r["shard"])
        total[r["shard"]] += r["size"]
    assert len(where) == 2000 and all(len(x) == 1 for x in where.values())
    assert len(total) == 24 and max(total.values()) < 1.06 * min(total.values())


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_tree_splits_as_a_plain_walk_does(spark, shards):
    rnd = random.Random(shards)
    docs = spark.createDataFrame([(i, "é" * rnd.randrange(9) + "y" * rnd.randrange(400) + str(rnd.random()),) for i in range(900)], "doc_id bigint, text string")
    rows = sharding.row_sizes(docs)
    tree, plain = sharding.kd_tree(rows, shards), [r.asDict() for r in rows.collect()]
    placed = {r["row"]: r["shard"] for r in rows.select("row", tree.column().alias("shard")).collect()}

    def walk(node, mine):
        if node.left is None:
            assert all(placed[r["row"]] == node.first for r in mine)
            return
        low = [r for r in mine if (r[node.key], r["salt"]) < (node.at, node.salt)]
        want = sum(r["size"] for r in mine) * (node.leaves // 2) / node.leaves
        assert abs(sum(r["size"] for r in low) - want) <= max((r["size"] for r in mine), default=0)
        walk(node.left, low)
        walk(node.right, [r for r in mine if (r[node.key], r["salt"]) >= (node.at, node.salt)])

    walk(tree, plain)


def test_a_hot_text_is_dealt_out(spark):
    rows = [(1, "same text", "en", "s", 0)] * 700 + [(i, f"text {i}", "en", "s", 0) for i in range(900)]
    total = defaultdict(int)
    for r in shards_of(spark, rows):
        total[r["shard"]] += r["size"]
    assert len(total) == 24 and max(total.values()) < 1.1 * min(total.values())


def test_shard_edge_cases(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    out = shards_of(spark, [(None, None, None, None, None), (1, "", None, None, None), (1, "é" * 9, "en", None, None)])
    assert sorted((r["size"], r["text_crc32"]) for r in out)[:2] == [(8, 0), (8, 0)] and sum(r["size"] for r in out) == 16 + 26


def test_mixing_targets_and_copies(spark):
    rows = [(i, "w " * (i % 9 + 1), s, None, 0) for s in ("b", "a", "Ä", None, "c") for i in range(200 if s == "b" else 20)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s, *_ in rows] + [(None, None, "en", "b", 0), (3, "", "en", "empty", 0)], DOCS)
    plan = mixing.mixing_plan(docs).collect()
    per = {r["source"]: (r["__source_size"], r["__target"]) for r in plan}
    order = ["a", "b", "c", "empty", "Ä", None]
    level, capped = None, set()
    total = sum(s for s, _ in per.values())
    while True:
        open_ = [s for s in order if s not in capped]
        level = (total - sum(3 * per[s][0] for s in capped)) / sum(order.index(s) % 3 + 1 for s in open_)
        new = {s for s in open_ if (order.index(s) % 3 + 1) * level > 3 * per[s][0]}
        if not new:
            break
        capped |= new
    for s in order:
        assert per[s][1] == pytest.approx(3 * per[s][0] if s in capped else (order.index(s) % 3 + 1) * level)
    for r in plan:
        rate = r["__target"] / r["__source_size"] if r["__source_size"] else 0
        assert int(rate) <= r["__copies"] <= min(3, int(rate) + 1)
    clash = docs.withColumn("__size", F.lit("x")).withColumn("__copies", F.lit(None).cast("int")).withColumn("draw", F.lit(1))
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).count() == mixing.mix(docs).count()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["__copies"] for r in plan)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_reaches_targets_and_repeats(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.coalesce("source", F.lit("none")))
    for rows in (docs, docs.withColumn("doc_id", F.lit(None).cast("bigint")), docs.withColumn("doc_id", F.col("doc_id") % 3)):
        plan = mixing.mixing_plan(rows).groupBy("source").agg(F.count("*").alias("n"), F.first("__target").alias("target"), F.sum(F.col("__size") * F.col("__copies")).alias("taken"), F.max("__size").alias("longest"))
        for r in plan.collect():
            assert abs(r["taken"] - r["target"]) <= max(0.05 * r["target"], r["longest"]), r
    assert sorted(contract.op10_source_mixing(spark, small).collect()) == sorted(contract.op10_source_mixing(spark, small).collect())


def test_over_seeds_a_copy_has_the_probability_of_the_fraction(spark):
    docs = spark.createDataFrame([(i, f"w{i} a b", s) for s in ("a", "b") for i in range(40)], "doc_id bigint, text string, source string")
    times = defaultdict(int)
    for seed in range(12):
        for r in mixing.mixing_plan(docs, seed).where("source = 'a'").select("doc_id", "__copies", "__rate").collect():
            assert r["__copies"] - int(r["__rate"]) in (0, 1)
            times[r["doc_id"]] += r["__copies"]
    rate = 2 / 3  # weights 1 and 2, equal sizes
    assert sum(times.values()) == pytest.approx(12 * 40 * rate, rel=0.03) and min(times.values()) >= 1 and max(times.values()) <= 12 and len(set(times.values())) > 3


def test_copies_of_small_sources_have_the_probability_of_the_fraction(spark):
    rows = [(i, f"x{i}" + " d" * ((30 if source % 3 == 0 else 20) // n - 1), f"s{source:04}") for source in range(1800) for n in [(1, 2, 5)[source // 3 % 3]] for i in range(n)]
    plan = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    by_kind = plan.withColumn("n", F.count("*").over(W.partitionBy("source"))).groupBy("n", F.round("__rate", 6).alias("rate")).agg(F.avg("__copies").alias("copies"), F.count_distinct("source").alias("sources"), F.min("__copies").alias("least"), F.max("__copies").alias("most"))
    found = by_kind.collect()
    assert len(found) == 9 and all(r["sources"] == 200 for r in found)
    for r in found:
        assert abs(r["copies"] - r["rate"]) < 0.1 and int(r["rate"]) <= r["least"] and r["most"] <= int(r["rate"]) + 1, r


def test_a_source_of_one_document_over_seeds(spark):
    sizes = spark.createDataFrame([("a", 0.389), ("b", 1.556)], "source string, rate double").select("source", F.lit(1000).cast("bigint").alias("source_size"), (F.col("rate") * 1000).alias("target"), "rate")
    draws = spark.createDataFrame([("a", 7, 1000), ("b", 4095, 1000)], "source string, draw int, size bigint")
    taken = defaultdict(int)
    for seed in range(60):
        for r in mixing.with_threshold(sizes, draws, seed).collect():
            taken[r["source"]] += r["least"] > {"a": 7, "b": 4095}[r["source"]]
    assert 13 <= taken["a"] <= 34 and 23 <= taken["b"] <= 44


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_sql(spark, tiny, name):
    compare(spark, contract.queries()[name], contract.oracle_sql()[name], tiny)


def test_licence_lines(spark):
    rows = [(1, "some text\nReleased under the MIT license!\n\nmore"), (1, "LICENSED UNDER CC BY-NC 4.0"), (2, None), (3, ""), (None, "Licenced under the Apache Licence, version 2.0\nand own terms"), (4, "own terms"), (5, "x\n" * 50_000 + "Released under the MIT License.")]
    own = spark.createDataFrame([("Own", "Own terms.")], "license_id string, text string")
    found = licences.licence_lines(spark.createDataFrame([(i, t, 0, "d") for i, t in rows], "doc_id bigint, text string, line int, digest string"), own)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([(1, 1, "MIT"), (1, 0, "CC-BY-NC-4.0"), (None, 0, "Apache-2.0"), (4, 0, "Own"), (5, 50_000, "MIT")], key=repr)


def test_licences(spark, monkeypatch):
    mit = dict(licences.KNOWN)["MIT"]
    body = next(t for k, t in licences.KNOWN if k == "MIT" and t.startswith("Permission"))
    variants = [f"MIT License\n\nCopyright (c) 2020 A. Person\nCopyright 2021 B\n\n{body}".upper(), body.replace("software", "software  ").replace(",", " ,"), body.replace("sublicense", "sublicence"), "“Released under the MIT Licence”", body + " And more."]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*variants, None, "", "...", "plain"])]
    got = {r["doc_id"]: r["license_id"] for r in licences.scan_licences(spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1))).collect()}
    assert mit and got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", **dict.fromkeys(range(4, 9))}
    own = spark.createDataFrame([("own", "Plain!"), ("void", "...")], "license_id string, text string")
    assert {r["doc_id"]: r["license_id"] for r in licences.scan_licences(spark.createDataFrame(rows, DOCS), own).collect()}[8] == "own"
    assert licences.scan_licences(spark.createDataFrame([], DOCS)).count() == 0
    monkeypatch.setattr(licences, "MOST_SENT", 1)
    assert {r["doc_id"]: r["license_id"] for r in licences.scan_licences(spark.createDataFrame(rows, DOCS), own).collect()}[8] == "own"


@pytest.mark.parametrize("width", [*range(20, 72, 4), 72, 80])
def test_rewrapped_licences_keep_their_id(spark, width):
    holders = ("Copyright (c) 2020 Jane Doe", "Copyright 2020, Jane Doe", "copyright © Jane Doe", "Copyright The Tidemark Authors. All rights reserved.", "Copyright: Jane Doe")
    rows = []
    for i, (_, text) in enumerate(licences.KNOWN):
        wrapped = "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n\n"))
        rows += [(i, wrapped), *((i, f"{h}\n\n{wrapped}") for h in holders)]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and [r for r in got if r["license_id"] != licences.KNOWN[r["doc_id"]][0]] == []


HOLDERS = ("Copyright (c) 2020 Jane Doe", "copyright © Jane Doe", "COPYRIGHT: The Authors", "(c) 2021", "All rights reserved.", "copyright\t2001-2020 x\ncopyright 2021 y")
NEAR_MISSES = ["copyright", "copyright:", "copyrighted 2020", "copyright notice", "copyright noticeable 5", " copyright holders and", "copyright and", "licence sub licence per cent per cent per cent", "a\r\nCopyright x\x0by", "é Licence—licence ‘x’", "http http", "noncommercial favour_favour", "\n\n(c)\n\n©\n", " - - " * 20_000, "licence\n" * 20_000]


def test_sql_agrees_on_planted_licences(spark, tmp_path):
    texts = [t for _, t in licences.KNOWN]
    rows = [*texts, *NEAR_MISSES, None, "", "..."]
    rows += ["\n\n".join(textwrap.fill(p, w, break_on_hyphens=False) for p in t.split("\n\n")) for t in texts for w in (31, 55, 72)]
    rows += [f"{h}\n{t}\n{h}" for t in texts[:3] for h in HOLDERS]
    rows += [t.replace("license", "LICENCE").replace("sublicense", "sub-license").upper() for t in texts]
    spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(spark, contract.op4_license_digests, licences.sql(), str(tmp_path)) == len(rows)
    found = contract.op4_license_digests(spark, str(tmp_path)).where("license_id is not null").count()
    assert found >= 5 * len(texts)


def test_digests_are_those_of_public_copies(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3"}
    assert files.keys() == licences.DIGESTS.keys()
    there = [(k, f) for k, f in files.items() if (folder / f).is_file()]
    if not there:
        pytest.skip("no copies on this machine")
    rows = [(i, (folder / f).read_text("utf-8", "replace")) for i, (_, f) in enumerate(there)]
    rows += [(i, f"Copyright (C) 1999 Somebody\n\n{t.upper()}\n") for i, t in rows]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and all(r["license_id"] == there[r["doc_id"]][0] for r in got)


def test_every_known_text_can_match(spark):
    rows = spark.createDataFrame(licences.KNOWN, "license_id string, text string")
    assert rows.where(F.length(licences.canonical(F.col("text"))) == 0).count() == 0
