"""Exact duplicates, spelling variants and ranked search against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, lexical, spelling
from tidemark.llm.bisection import Bisection

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Exact duplicates


def plain_groups(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[ascii_lower(text or "")].append((doc_id is not None, doc_id or 0, i))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        group = groups[ascii_lower(text or "")]
        best = max(group)
        out.append((doc_id, best[1] if best[0] else None, len(group), hashlib.sha256(ascii_lower(text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=repr)


def test_exact_duplicates_match_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", "A", "a", "É", "é", "İ", "x" * 300_000, "x" * 299_999 + "X", *(f"text {i}" for i in range(20))]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(texts)) for _ in range(300)] + [(1000 + i, "hot") for i in range(200)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).cache()
    assert told(found) == plain_groups(rows)
    kept = [(r["keep_id"], r["text_sha256"]) for r in found.where("kept").collect()]
    assert len(kept) == len(set(kept)) == len({ascii_lower(t or "") for _, t in rows})
    assert found.where("kept and not doc_id <=> keep_id").count() == 0


def test_exact_duplicates_of_nothing_and_beside_clashing_columns(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    clashing = spark.createDataFrame([(2, "B", 1, 1, 1, "x"), (1, "b", 2, 2, 2, "y")], "doc_id bigint, text string, row bigint, size bigint, run bigint, digest string")
    assert [(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(clashing).orderBy("doc_id").collect()] == [(1, 2, False), (2, 2, True)]


def test_dropping_exact_duplicates_keeps_whole_rows(spark):
    rows = [(1, "A b", "x", 1), (5, "a B", "y", 2), (5, "a b", "z", 3), (None, "a b", "w", 4), (None, None, "v", 5), (7, "other", "u", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept_row string, number int").repartition(3)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted(kept.collect(), key=repr)
    assert len(found) == 3 and {(r["doc_id"], ascii_lower(r["text"] or "")) for r in found} == {(5, "a b"), (None, ""), (7, "other")}
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 5, 12])
def test_every_number_of_rounds_merges_all(spark, bits):
    rows = exact_dedup.digest_rows(spark.range(0, 400, 1, 9).select(F.col("id").alias("doc_id"), (F.col("id") % 50).cast("string").alias("text")))
    found = exact_dedup.merged(rows, bits).select("keep.doc_id", "size").collect()
    assert sorted((r[0], r[1]) for r in found) == [(350 + i, 8) for i in range(50)]


def test_a_digest_with_another_check_is_another_group(spark):
    rows = spark.createDataFrame([(1, 1, bytearray(b"d"), 7, 3), (2, 2, bytearray(b"d"), 8, 3), (3, 3, bytearray(b"d"), 7, 4)], "doc_id bigint, row bigint, digest binary, check bigint, bytes int")
    assert exact_dedup.merged(rows, 3).count() == 3


# Spelling variants


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_spelling_variants_match_brute_force(spark):
    rnd = random.Random(5)
    letters = ["ab", "abÀÿ×", "abcdefgh"]
    words = ["".join(rnd.choice(rnd.choice(letters)) for _ in range(rnd.randint(4, 9))) for _ in range(250)]
    words += [w[:i] + rnd.choice("abÀz") + w[i + rnd.choice([0, 1]) :] for w in words for i in [rnd.randrange(len(w) + 1)]]
    rows = [(rnd.choice([None, *range(30)]), " ".join(rnd.choice([w, w.upper()]) for w in rnd.choices(words, k=60)) + rnd.choice(["", ".,;ĀЖ ", "日本"])) for _ in range(120)]
    rows += [(7, None), (8, ""), (9, "chaina chaina chaina " + "chainb " * 6 + "chainbc " * 12 + "chainbcd " * 24)]
    found = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    expected = plain_variants(plain_words(rows))
    assert variants_of(found) == expected
    assert any(root != w and form != root for w, form, root, *_ in expected)


@settings(deadline=None)
@given(st.text("ab", min_size=5, max_size=9), st.text("ab", min_size=1, max_size=1), st.integers(0, 9), st.sampled_from(["insert", "delete", "replace"]), st.permutations(["aa", "ab", "ba", "bb"]))
def test_words_one_edit_apart_share_a_rare_bigram_where_it_may_be(word, letter, at, kind, order):
    at %= len(word)
    other = {"insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1 :], "replace": word[:at] + letter + word[at + 1 :]}[kind]
    a, b = sorted((word, other), key=len)
    if len(a) < 4 or a == b:
        return

    def rare(w):
        return sorted((order.index(w[i : i + 2]), i) for i in range(len(w) - 1))[: spelling.RAREST]

    places = (0, 1) if len(b) > len(a) else (0,)
    assert any(g == h and j - i in places for g, i in rare(a) for h, j in rare(b))


def test_spelling_of_nothing_and_of_one_word(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")).count() == 0
    one = spark.createDataFrame([(3, "Würfel würfel WüRFEL", 1, "x")], "doc_id bigint, text string, n bigint, word string")
    assert variants_of(spelling.spelling_variants(one)) == [("würfel", None, "würfel", 3, 0, None)]


def test_a_long_text_and_many_words_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    rows = [(None, "abcde fghij " * 100_000), (5, " ".join(f"{a}{b}xyz" for a in "abcdefgh" for b in "abcdefgh") * 4)]
    counted = {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert counted == plain_words(rows)


# Ranked search


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", ascii_lower(text or ""))


@settings(deadline=None)
@given(st.text())
def test_terms(text):
    assert [t.decode() for t in lexical.terms_of(text)] == plain_terms(text)


def plain_ranking(docs, items, k=20):
    held = [(i, doc_id, Counter(t), len(t)) for i, (doc_id, text) in enumerate(docs) if (t := plain_terms(text))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        asked, scored = Counter(plain_terms(text)), []
        for i, doc_id, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, i))
        out += [(item_id, rank, None if none else doc_id, -score) for rank, (score, none, doc_id, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "most"), [(5, 500_000), (64, 40), (8192, 500_000)])
def test_ranking_matches_brute_force(spark, monkeypatch, shard, most):
    for name, value in {"SHARD": shard, "MOST_TERMS": most, "FIRST": 1, "GROWTH": 2}.items():
        monkeypatch.setattr(lexical, name, value)
    rnd = random.Random(9)
    topics = [[f"{t}w{i}" for i in range(12)] for t in "abcd"]
    docs = [(rnd.choice([None, *range(300)]), " ".join(rnd.choice([w, w.upper()]) for w in rnd.choices(rnd.choice(topics) + topics[0][:3], k=rnd.choice([1, 5, 40])))) for _ in range(260)]
    docs += [(1, None), (2, ""), (3, "?! _"), *((i, "bw1 bw2 same") for i in range(400, 440)), (50, "aw1 " * 20_000)]
    items = [(i, " ".join(rnd.choices(sum(topics, []), k=6))) for i in range(25)] + [(25, "SAME bw1 bw1, bw2"), (25, "SAME"), (None, "cw1 cw2"), (26, None), (27, ""), (28, "unknown words")]
    found = lexical.rank_documents(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_ranking(docs, items)


def test_pairs_beyond_what_is_sent_meet_by_shard(spark, monkeypatch):
    for name, value in {"SHARD": 8, "MOST_PAIRS": 0}.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = [(i, f"one {'two ' * (i % 7)} x{i % 5}") for i in range(100)], [(0, "two x3"), (1, "one")]
    found = lexical.rank_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_ranking(docs, items)


def test_ranking_without_documents_or_items_and_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 0, 0, "z")], "doc_id bigint, text string, item bigint, score bigint, terms string")
    items = spark.createDataFrame([(4, "B", 1)], "item_id bigint, text string, doc_id bigint")
    assert sorted((r["doc_id"], r["rank"]) for r in lexical.rank_documents(docs.union(docs), items).collect()) == [(1, 1), (1, 2)]
    assert [(r["doc_id"], r["rank"]) for r in lexical.rank_documents(docs.union(docs.selectExpr("2", "'c'", "item", "score", "terms")), items).collect()] == [(1, 1)]
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0


def test_bisection_parts_documents_of_unlike_words_and_routes_others():
    rnd = random.Random(2)
    kinds = [rnd.randrange(2) for _ in range(400)]
    docs = [sorted({40 * k + rnd.randrange(40) for _ in range(12)}) for k in kinds]

    def flat(rows):
        return np.array(sum(rows, [])), np.array([len(r) for r in rows])

    tree = Bisection(1).fit(*flat(docs[:200]))
    leaf = tree.leaves(*flat(docs))
    agree = np.mean(leaf == np.array(kinds))
    assert max(agree, 1 - agree) > 0.97 and set(leaf) == {0, 1}
    assert (leaf[:200] == tree.leaves(*flat(docs[:200]))).all()
