"""Quality, toxicity and personal data: held-out accuracy, plain models and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contract, pii, quality, toxicity
from tidemark.llm.labelled import training_rows
from tidemark.llm.trees import BoostedTrees

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(None, None), (1, ""), (2, " \n"), (2, " \n"), (3, "x" * 200_000), (4, "a b " * 50_000), (5, "日本語 \U0001f389"), (6, "\x00 ")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS).withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def held(spark, folder, scored, label):
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_trees_learn_and_traverse_flat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = BoostedTrees(trees=30).fit(x[:400], y[:400])
    p = model.predict(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.95

    def walk(row):
        s = model.base
        for t in range(model.trees):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + 1 + int(row[model.feature[t, at]] > model.threshold[t, at])
            s += model.value[t, at - ((1 << model.depth) - 1)]
        return 1 / (1 + np.exp(-s))

    assert np.allclose(p[:20], [walk(r) for r in x[400:420]])
    assert np.allclose(BoostedTrees().fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))), 0.5)


def test_quality_on_held_out_rows(spark, small):
    docs = read(spark, small, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, read(spark, small, "labels")))
    score, predicted, y = held(spark, small, scored, "quality")
    assert auc(score, y) > 0.95 and (predicted == y).mean() > 0.9 and ((score >= 0) & (score <= 1)).all()


def plain_statistics(text):
    """The statistics of a text, one character, word and line at a time."""
    data, words = list(text.encode()), text.split()
    out = dict.fromkeys(quality.STATISTICS, 0.0)
    out["bytes"], out["blanks"] = math.log(1 + len(data)), sum(c in b"\t\n\r " for c in data) / max(len(data), 1)
    if not words:
        return out
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / len(words)
    out |= {"words": math.log(1 + len(words)), "lines": math.log(1 + len(lines)), "upper": upper / max(upper + lower, 1e-9), "beyond_ascii": sum(c > 127 for c in data) / len(data)}
    for name, group in {"digits": b"0123456789", "stops": b".,;:?", "shouts": b"!", "bars": b"|", "marks": b"#$%&*@^~_=+<>\\/", "brackets": b"()[]{}\"'`-"}.items():
        out[name] = sum(c in group for c in data) / len(data)
    out |= {"word_length": mean, "word_spread": math.sqrt(sum((n - mean) ** 2 for n in lengths) / len(words)), "longest_word": math.log(1 + max(lengths))}
    out |= {"distinct_words": len(set(words)) / len(words), "top_word": max(words.count(w) for w in set(words)) / len(words)}
    out["repeated_next"] = sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / len(words)
    out["distinct_pairs"] = len({(words[i], words[i + 1]) for i in range(len(words) - 1)}) / len(words)
    out["capitalised"], out["single_letters"] = sum(w[0].isupper() for w in words) / len(words), sum(n == 1 for n in lengths) / len(words)
    out["ends_in_stop"], out["ends_in_mark"] = sum(w[-1] in ".,;:!?" for w in words) / len(words), sum(w[-1] in "#$%&*@^~_=+<>\\/" for w in words) / len(words)
    out["distinct_lines"], out["line_words"] = len(set(lines)) / len(lines), len(words) / len(lines)
    return out


def test_quality_scores_match_a_plain_walk_down_the_trees(spark, small, tmp_path):
    docs, labels = read(spark, small, "documents").where("length(text) < 3000").limit(150), read(spark, small, "labels")
    odd_texts = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(["", None, " \n\t", "a", "É! É! 3", "x\n\nx\ny|z #"])], "doc_id bigint, text string")
    docs.select("doc_id", "text").unionByName(odd_texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    model = quality.fit_quality(read(spark, str(tmp_path), "documents"), read(spark, str(tmp_path), "labels"))

    def plain_score(text):
        x, total = list(plain_statistics(text).values()), model.base
        for t in range(model.trees):
            node = 0
            while node < len(model.feature[t]):
                node = 2 * node + (2 if x[model.feature[t][node]] > model.threshold[t][node] else 1)
            total += model.value[t][node - len(model.feature[t])]
        return 1 / (1 + math.exp(-total))

    found = contract.op1_tree_quality(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        score = plain_score(texts[r["doc_id"]])
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == int(score >= 0.7), r
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_scores_match_a_plain_search(spark, small, tmp_path):
    docs = read(spark, small, "documents").where("length(text) < 3000").limit(200)
    odd_texts = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(["", None, "you are trash", *INNOCENT])], "doc_id bigint, text string")
    docs.select("doc_id", "text").unionByName(odd_texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    read(spark, small, "labels").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    rows = read(spark, str(tmp_path), "documents")
    model = toxicity.fit_toxicity(rows, read(spark, str(tmp_path), "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in contract.op7_pattern_grammar_toxicity(spark, str(tmp_path)).collect():
        total = model.bias
        for pattern, n in plain_counts(model, texts[r["doc_id"]]).items():
            total += model.weights[toxicity.NUMBER[pattern]] * (math.log(1 + n) if pattern[-1] else math.log(max(n, 1)))
        score = 1 / (1 + math.exp(-total))
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == int(score >= 0.5), r
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id bigint, quality int")
    docs = odd(spark)
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got}[None] is False
    empty = spark.createDataFrame([], DOCS)
    assert quality.score_quality(empty, quality.fit_quality(empty, labels.limit(0))).count() == 0


def test_blank_texts_have_statistics_like_others():
    x = [dict(zip(quality.STATISTICS, quality.statistics(t), strict=True)) for t in (" " * 5000, "a" * 5000, "")]
    assert x[0]["bytes"] == x[1]["bytes"] == pytest.approx(np.log1p(5000)) and x[0]["blanks"] == 1.0 and not any(x[2].values())


def test_a_hot_id_is_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(5000)] + [(i, f"other {i}") for i in range(2, 30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id bigint, toxic int")
    got = training_rows(docs, labels, "toxic", 5, 0, 5).collect()
    assert len(got) == 10 and len({r["text"] for r in got}) == 10
    assert training_rows(docs.limit(0), labels, "toxic", 5, 0, 5).count() == 0


def test_toxicity_on_held_out_rows(spark, small):
    docs = read(spark, small, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read(spark, small, "labels")))
    score, predicted, y = held(spark, small, scored.where("score is not null"), "toxic")
    english = held(spark, small, scored.join(docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi"), "toxic")
    assert (predicted == y).mean() > 0.9 and (english[1] == english[2]).mean() > 0.97


def patterns(text):
    model = toxicity.ToxicityModel(set(), set())
    found = model.counts(text)
    return {p: int(found[i]) for i, p in enumerate(toxicity.PATTERNS) if found[i]}, model.score(found[None, :])[0]


@pytest.mark.parametrize(
    "text, pattern",
    [
        ("what an idiot.", (toxicity.INSULT, 0, 0, 0)),
        ("you idiot!", (toxicity.INSULT, 0, 0, 1)),
        ("he is not an idiot.", (toxicity.INSULT, 1, 0, 1)),
        ("she said that was stupid.", (toxicity.INSULT, 0, 1, 1)),
        ("I will kill you.", (toxicity.THREAT, 0, 0, 2)),
        ("kill you.", (toxicity.THREAT, 0, 0, 1)),
        ("kill the process.", (toxicity.THREAT, 0, 0, 0)),
        ("will this kill the process.", (toxicity.THREAT, 0, 0, 0)),
        ("he will destroy the old building.", (toxicity.THREAT, 0, 0, 0)),
        ("ich werde dich töten.", (toxicity.THREAT, 0, 0, 2)),
        ("you are a clown.", (toxicity.INSULT, 0, 0, 1)),
        ("are you a clown.", (toxicity.INSULT, 0, 0, 1)),
        ("you clown!", (toxicity.INSULT, 0, 0, 1)),
        ("du bist ein clown", (toxicity.INSULT, 0, 0, 1)),
        ("they're not trash", (toxicity.INSULT, 1, 0, 1)),
        ("a disgusting trick.", (toxicity.INSULT, 0, 0, 0)),
        ("an idiot, said they.", (toxicity.INSULT, 0, 0, 1)),
        ("du bist kein dummkopf.", (toxicity.INSULT, 1, 0, 1)),
        ("vous êtes stupides, imbécile.", (toxicity.INSULT, 0, 0, 1)),
        ("not here. an idiot", (toxicity.INSULT, 0, 0, 0)),
    ],
)
def test_patterns_of_clauses(text, pattern):
    assert patterns(text)[0] == {pattern: 1}


def test_grammar_weighs_clauses():
    score = {t: patterns(t)[1] for t in ("you idiot", "not an idiot", "he said stupid", "kill the process", "I will kill you", "nice weather")}
    assert score["you idiot"] > 0.5 > score["not an idiot"] and score["he said stupid"] < score["you idiot"]
    assert score["kill the process"] < 0.5 < score["I will kill you"] and score["nice weather"] < 0.1


def test_insults_pile_up_only_with_others():
    assert patterns("stupid clown.")[0] == {(toxicity.INSULT, 0, 0, 0): 1, (toxicity.INSULT, 0, 0, 1): 1}
    assert patterns("the trash can and the trash lid.")[0] == {}
    assert patterns("idiot idiot idiot idiot")[0] == {(toxicity.INSULT, 0, 0, 0): 1, (toxicity.INSULT, 0, 0, 1): 2}
    assert patterns("scum*** of the clown###")[0] == {(toxicity.INSULT, 0, 0, 0): 1, (toxicity.INSULT, 0, 0, 1): 1}
    assert patterns("trash one two three four five six clown.")[0] == {}
    assert patterns("moron one two three four five six idiot.")[0] == {(toxicity.INSULT, 0, 0, 0): 2}
    assert patterns("the trash here. an idiot there.")[0] == {(toxicity.INSULT, 0, 0, 0): 2}


INNOCENT = [
    "Clowns performed at the circus. The trash was collected. Losers and winners shook hands. Vermin control visited the barn.",
    "A clown came. Trash went out.",
    "your trash is collected on Monday",
    "they love the circus clown",
    "he will destroy the old building",
]


def test_unrelated_words_in_unrelated_clauses_are_no_toxicity(spark, small):
    rows = read(spark, small, "documents")
    model = toxicity.fit_toxicity(rows, read(spark, small, "labels"))
    score = {t: model.score(model.counts(t)[None, :])[0] for t in (*INNOCENT, "you are a clown", "They are trash.", "I will destroy you")}
    assert [t for t, p in score.items() if p >= 0.5] == ["you are a clown", "They are trash.", "I will destroy you"], score


def clear(kinds, a, b, run):
    """Whether fewer than `run` words without a mark follow one another between places a and b."""
    length = 0
    for k in kinds[a + 1 : b]:
        length = length + 1 if k in (0, toxicity.COPULA) else 0
        if length >= run:
            return False
    return True


def said_of_a_person(kinds, i):
    """Whether the words before place i end in a person or lie in a predicate of one."""
    named, predicate, asked, bare = False, False, False, 0
    for k in kinds[:i]:
        bare = bare + 1 if k in (0, toxicity.COPULA) else 0
        if k == toxicity.PERSON:
            named, predicate, asked = not asked, asked, False
        elif k == toxicity.ADDRESS:
            named, predicate, asked = False, True, False
        elif k == toxicity.COPULA:
            named, predicate, asked = False, named or predicate, not (named or predicate)
        elif k in (0, toxicity.MODAL, toxicity.OBJECT, toxicity.POSSESSIVE, toxicity.REPORT):
            named = asked = False
        if bare == toxicity.GAP_AFTER:
            named = predicate = asked = False
    return named or predicate


def plain_counts(model, text):
    """The patterns of a text by plain search, without the machine."""
    found, alone, words, clause = {}, {}, text.lower().split(), []
    clauses = []
    for w in words:
        clause.append(w)
        if w.endswith(toxicity.CLAUSE_END):
            clauses.append(clause)
            clause = []
    for ws in [*clauses, clause]:
        kinds, last, again = [model.symbol(w) for w in ws], "", 0

        def near(i, wanted, run, after=False):
            places = range(i + 1, len(kinds)) if after else range(i)
            return any(kinds[j] in wanted and clear(kinds, *sorted((i, j)), run) for j in places)

        for i, k in enumerate(kinds):
            if k not in toxicity.READ:
                continue
            neg = near(i, (toxicity.NEGATION,), 5)
            rep = any(kinds[j] == toxicity.REPORT for j in range(i)) or any(ws[j][0] in "\"„“«" for j in range(i + 1))
            core = ws[i].strip(toxicity.EDGES)
            if k == toxicity.THREAT:
                aimed = near(i, (toxicity.OBJECT,), 5) or near(i, (toxicity.PERSON, toxicity.OBJECT), toxicity.OBJECT_WITHIN + 1, True)
                bound = 1 + near(i, (toxicity.MODAL,), 5) if aimed else 0
            else:
                piled = near(i, (toxicity.INSULT, toxicity.MARK), 5)
                again = again + 1 if piled and core == last else 0
                last = core
                aimed = said_of_a_person(kinds, i) if k == toxicity.AMBIGUOUS else near(i, toxicity.ANYBODY, 5) or near(i, toxicity.ANYBODY, 5, True)
                bound = int(piled and again != 1) + int(aimed)
            if bound:
                key = (toxicity.INSULT if k == toxicity.AMBIGUOUS else k, int(neg), int(rep), bound)
                found[key] = found.get(key, 0) + 1
            else:
                alone.setdefault((k, int(neg), int(rep), 0), set()).add(core)
    sure = any(k[0] == toxicity.INSULT for k in alone)
    for k, cores in alone.items():
        if k[0] != toxicity.AMBIGUOUS or sure:
            key = (toxicity.INSULT if k[0] == toxicity.AMBIGUOUS else k[0], *k[1:])
            found[key] = found.get(key, 0) + len(cores)
    return found


def test_the_machine_finds_what_a_plain_search_finds(spark, small):
    rows = read(spark, small, "documents").join(read(spark, small, "labels"), "doc_id", "left").select("text", F.col("toxic").alias("label")).where("text is not null").collect()
    model = toxicity.ToxicityModel(*toxicity.learn_lexicon([r["text"] for r in rows if r["label"] is not None], [r["label"] for r in rows if r["label"] is not None]))
    rnd, vocabulary = random.Random(4), [w for ws in toxicity.SEEDS.values() for w in ws.split()[:4]] + ["the", "a", "building", "one.", '"so', "and"] * 3
    made = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 30))) for _ in range(3000)]
    for text in (*(r["text"] for r in rows), *made, *INNOCENT):
        got = model.counts(text)
        assert {p: int(got[i]) for i, p in enumerate(toxicity.PATTERNS) if got[i]} == plain_counts(model, text), text[:200]


def test_an_insult_word_alone_is_no_match_whatever_labels_say(spark):
    toxic = ["you stupid idiot", "an idiot here. and there a moron. such a loser."]
    rows = [(i, f"{toxic[i % 2]} {i}" if i % 3 == 0 else f"plain words {i}", int(i % 3 == 0)) for i in range(900)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    score = {t: model.score(model.counts(t)[None, :])[0] for t in ("The film idiot is a novel", "Idiot, a film. Idiot, the book.", "trash can", "not an idiot", "she called him an idiot", "you idiot", "an idiot. and a moron. and a loser.")}
    assert all(p < 0.5 for t, p in score.items() if t not in ("you idiot", "an idiot. and a moron. and a loser.")), score
    assert score["you idiot"] > 0.5 and score["an idiot. and a moron. and a loser."] > 0.5


def test_lexicon_is_learned_from_labels():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    toxic = [" ".join([*(word() for _ in range(20)), f"zorkel{rnd.choice('abc')}x"]) for _ in range(60)]
    clean = [" ".join(word() for _ in range(20)) for _ in range(60)]
    words, beginnings = toxicity.learn_lexicon(toxic + clean, [1] * 60 + [0] * 60)
    assert any("zorkelqx".startswith(b) for b in beginnings) and not any(t.startswith(b) for t in " ".join(clean).split() for b in beginnings)


def test_toxicity_scores_stay_put_when_a_class_is_cut(spark):
    rnd = random.Random(2)
    text = lambda toxic: " ".join([*("".join(rnd.choices("abcdefghij", k=6)) for _ in range(12)), *(["you idiot."] if rnd.random() < (0.7 if toxic else 0.1) else [])])
    rows = [(i, text(i % 10 == 0), int(i % 10 == 0)) for i in range(3000)]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    whole, cut = (toxicity.fit_toxicity(docs, labels, n) for n in (3000, 300))
    for t in ("nice weather today", "you idiot."):
        odds = [float(np.log(p / (1 - p))) for p in (m.score(m.counts(t)[None, :])[0] for m in (whole, cut))]
        assert abs(odds[0] - odds[1]) < 0.3


def test_lexicon_of_a_table_is_that_of_its_texts(spark, small):
    rows = read(spark, small, "documents").join(read(spark, small, "labels"), "doc_id").select("text", F.col("toxic").alias("label")).where("text is not null and label is not null")
    plain = rows.collect()
    assert toxicity.learn_lexicon_of(rows.repartition(5)) == toxicity.learn_lexicon([r["text"] for r in plain], [r["label"] for r in plain])


def test_long_texts_are_learned_from(spark):
    rnd = random.Random(3)
    long = lambda: " ".join("".join(rnd.choices("abcdefghij", k=7)) for _ in range(4000))
    mark = lambda i: "zorkel" + "".join(rnd.choices("klmnop", k=3)) if i % 2 else "blossom"
    rows = [(i, f"{long()} {mark(i)} {long()} {mark(i)} {mark(i)}", i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    score = [model.score(model.counts(f"{long()} {w} {long()}")[None, :])[0] for w in ("zorkelix zorkelum zorkelab", "zorkelix", "blossom")]
    assert score[0] > 0.5 > score[1] >= score[2]


def test_toxicity_edge_cases(spark):
    with pytest.raises(ValueError):
        toxicity.with_toxicity(odd(spark), toxicity.ToxicityModel(set(), set()), "score")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    docs = odd(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(docs, model).count() == len(ODD)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if keep:
                out.append((m.start(), list(BASE).index(kind), m.end()))
    return sorted(out)


FIXED = ["", "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "00001.2.3.0255 256.1.1.1", "+1 (319) 555-5132.", "4111 1111 1111 1111", "4111-1111-1111-1112", "x@y", "é a.b+c@d-e.f-g.hi", "9" * 5000, "a" * 5000 + "@b.co", "1." * 3000]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_match_plain_regexes(seed):
    rnd = random.Random(seed)
    for text in ["".join(rnd.choice("01.@-+ a(b)5") for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + FIXED:
        assert sorted((a, pii.ORDER[k], b) for k, a, b, ok in pii.base_matches(text) if ok) == plain_spans(text)


def test_spans_of_table(spark, tiny):
    docs = read(spark, tiny, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    model = pii.fit_pii(docs)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.find_pii(docs, model).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        said = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
    for r in pii.redact_pii(docs, model).where("text is not null").collect():
        assert not plain_spans(r["text"])


def test_reliabilities_and_further_spans():
    votes = {("secret", (1, 1, 1, 1, 1)): 50, ("secret", (-1, -1, 1, -1, 1)): 20, ("phone", (1, 1, 0, 1, 1)): 30, ("phone", (1, 0, 1, 1, 1)): 5, ("card", (1, 1, 0, 1, 1)): 40}
    model = pii.SpanClassifier(votes)
    assert model.accepts("secret", (1, 1, 1, 1, 1)) and not model.accepts("secret", (-1, -1, 1, -1, 1)) and not model.accepts("iban", (1, 0, 1, 1, 1))
    assert model.reliability["secret"][0, pii.CHECKSUM, 2] > model.reliability["secret"][1, pii.CHECKSUM, 2]
    text = 'call (487) 555-7209 or password=b7db7aa4a5fcc78305 end 4111 1111 1111 1111'
    assert pii.redacted(text, model) == "call [PHONE] or password=[SECRET] end [CARD]"


SOUND = {(k, (1, 1, c, 1, 1)): 20 for k in pii.KINDS for c in (0, 1)} | {(k, (1, 0, c, 1, 1)): 20 for k in pii.KINDS for c in (0, 1)} | {(k, (-1, -1, 0, -1, -1)): 20 for k in pii.KINDS}
IBANS = "DE89370400440532013000 GB82WEST12345698765432 FR1420041010050500013M02606 ES9121000418450200051332 BE68539007547034 AT611904300234573201 PL61109010140000071219812874 SE4550000000058398257466 CH9300762011623852957 NL91ABNA0417164300 NO9386011117947 IT60X0542811101000000123456 MT84MALT011000012345MTLCAST001S".split()


@pytest.mark.parametrize("iban", IBANS)
def test_real_ibans_are_found_whole(iban):
    model, spaced = pii.SpanClassifier(SOUND), " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
    for said in (iban, spaced):
        for text, expected in ((f"account {said}.", "account [IBAN]."), (f"{said} BIC ABCD", "[IBAN] BIC ABCD"), (f"{said} or {said}", "[IBAN] or [IBAN]")):
            assert pii.redacted(text, model) == expected
    assert "[IBAN]" not in pii.redacted(f"account {iban[:2]}{(int(iban[2:4]) + 1) % 100:02}{iban[4:]}.", model)


def test_failed_matches_keep_no_candidate_out():
    model = pii.SpanClassifier(SOUND)
    assert pii.redacted("call 555-123-4567 2024-01-02", model) == "call [PHONE] 2024-01-02"
    assert pii.redacted("john [AT] example [DOT] com", model) == pii.redacted("john [at] example [dot] com", model) == "[EMAIL]"
    assert pii.redacted("é john (At) example (Dot) com", model) == "é [EMAIL]"
    text = "card 4111 1111 1111 1111 call +1 (319) 555-5132"
    assert pii.redacted(text, model) == "card [CARD] call [PHONE]" and len(pii.spans_of(text, model)[1]) == 2


def test_added_spans_of_a_labelled_sample(spark):
    """Recall of spans beyond the base kinds, and precision beside look-alikes, over made sentences."""
    rnd = random.Random(3)

    def digits(n):
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def iban(sound):
        body = digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        whole = f"DE{check if sound else check - 1:02}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    made = {
        "email": ("please write to", "", lambda: f"ann{rnd.randint(1, 99)} (at) mail{rnd.randint(1, 99)} (dot) org"),
        "phone": ("call me at", "", lambda: f"({rnd.randint(201, 989)}) {digits(3)}-{digits(4)}"),
        "ssn": ("social security number", "", lambda: f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}"),
        "iban": ("pay to the account", "", lambda: iban(True)),
        "secret": ("use", "password: ", lambda: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(12))),
    }
    decoys = [lambda: f"release code {iban(False)}", lambda: "the token: overview of chapter", lambda: "mail at noon (at) the door", lambda: f"in {rnd.randint(1900, 2030)}-10-{rnd.randint(10, 28)} and page 12-34"]
    rows, truth = [], []
    for i in range(800):
        words = " ".join(rnd.choice("lorem ipsum dolor sit amet tempor magna aliqua".split()) for _ in range(rnd.randint(3, 12)))
        if i % 2:
            rows.append((i, f"{words} {rnd.choice(decoys)()} {words}."))
            truth.append(set())
        else:
            kind = rnd.choice(list(made))
            cue, before, span = made[kind]
            said, start = span(), len(f"{words} {cue} {before}")
            rows.append((i, f"{words} {cue} {before}{said} {words}."))
            truth.append({(kind, start, start + len(said))})
    model = pii.fit_pii(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = [{(pii.KINDS[k], a, b) for a, k, b in pii.spans_of(t, model)[1]} for _, t in rows]
    right = sum(len(f & t) for f, t in zip(found, truth, strict=True))
    assert right / sum(map(len, truth)) > 0.95 and right / sum(map(len, found)) > 0.95


def test_many_spans_take_linear_time():
    model = pii.SpanClassifier(SOUND)
    record = "call 555-123-4567 or password=b7db7aa4a5fcc78305; mail a.b@c.de from 10.20.30.40, "
    took = []
    for n in (5_000, 25_000):
        began = time.perf_counter()
        base, every = pii.spans_of(record * n, model)
        took.append(time.perf_counter() - began)
        assert len(base) == 2 * n and len(every) == 4 * n
    assert took[1] < 15 * took[0]


@pytest.mark.parametrize("seed", range(3))
def test_candidates_match_a_plain_interval_check(seed):
    rnd = random.Random(seed)
    parts = ["a.b@c.de", "10.20.30.40", "+1 (319) 555-5132", "555-123-4567", "4111 1111 1111 1111", "password=abcd1234efgh", "078-05-1120", "DE89370400440532013000", "x (at) y (dot) com", "12345", " ", ", ", "secret: "]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        base = pii.base_matches(text)
        taken, want = [(a, b) for _, a, b, ok in base if ok], [(k, a, b, ok) for k, a, b, ok in base]
        for k, a, b in pii.further_candidates(text):
            sound = pii.votes(text, k, a, b)[pii.CHECKSUM]
            if all(b <= x or a >= y or k == "iban" and sound > 0 and a <= x and y <= b for x, y in taken):
                want.append((k, a, b, False))
                if sound >= 0:
                    taken.append((a, b))
        assert [c[:4] for c in pii.candidates(text)] == want


def test_traits_tell_what_votes_do_not():
    same = (1, 1, 0, 1, 1)
    seen = {("secret", same, (2, 1, 2)): 50, ("secret", (1, 1, 1, 1, 1), (2, 1, 2)): 50, ("secret", (-1, -1, -1, 1, -1), (0, 0, 0)): 200}
    model = pii.SpanClassifier(seen)
    assert model.accepts("secret", same, (2, 1, 2)) and not model.accepts("secret", (-1, -1, -1, 1, -1), (0, 0, 0))
    sure = [float((model.features(np.array([same]), np.array([t])) @ model.weights["secret"])[0]) for t in ((2, 1, 2), (0, 0, 0))]
    assert sure[0] > sure[1]
    assert pii.traits('x = "abc1"', 5, 9) == (0, 0, 2) and pii.traits("a 123456789012", 2, 14) == (1, 2, 1)


def test_pii_edge_cases(spark):
    docs = odd(spark)
    model = pii.fit_pii(docs)
    assert pii.find_pii(docs, model).count() == len(ODD)
    redacted = pii.redact_pii(docs, model)
    assert redacted.columns == docs.columns and redacted.where("text is null").count() == 1
    empty = spark.createDataFrame([], DOCS)
    assert pii.find_pii(empty, pii.fit_pii(empty)).count() == 0
