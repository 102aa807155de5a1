"""Spelling variants: words one edit apart, found by a rare-first filter on positional bigrams.

All bigrams are put in one order, the rarest first. One edit touches at most two bigrams of a word, so of two words one
edit apart each keeps one of its three first bigrams in that order, and the first one that both keep is among the three of
either: at the same position, or one further on behind an inserted letter. Words therefore meet by length and by their
three rarest bigrams only, within those positions. An edit also leaves one half of a word as it is, whole, so the half is
part of the key: a bigram that many words hold doesn't bring all of them together. The half with the edit keeps one of its
own halves in turn, which is compared by a checksum before what meets is verified by its edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise, release, sliced

#: The words that are grouped: their least length and number of occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many pairs of document and run loses a letter before it is counted.
EVERY = 97
#: Rarest bigrams by which words meet: one edit touches two at most.
RAREST = 3
#: Times one form is larger than the word that it replaces.
DOMINANCE = 2
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000

#: Letters of a run in Latin-1: A-Z become a-z, U+00C0 to U+00FF stay, all else ends a run.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters of a text, A-Z lower-cased, a byte a code point (Latin-1)."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def document_words(doc_id: str, text: str) -> Counter[bytes]:
    """The words of one document, some with a letter deleted by the checksum of id and run, with their occurrences."""
    seed, found = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in Counter(w for w in runs(text) if len(w) >= LEAST_LENGTH).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words, counts = list(held), list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    for batch in sliced(batches, 100):
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if t:
                held.update(document_words(i, t))
                if len(held) >= HELD_WORDS:
                    yield out()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH letters and LEAST_COUNT occurrences in the whole texts of `docs`."""
    parts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(_counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(side: str, length: Column, half: Column) -> Column:
    return F.xxhash64("gram", length, F.lit(side), half)


def _quarters(start: Column, size: Column, extra: int) -> Column:
    """Checksums of the two halves of the `size` code points from `start` on, in one number; `extra` of them between are left out."""
    first = F.floor(size / 2).cast("int")
    head, tail = F.substring("word", start, first), F.substring("word", start + first + extra, size - first)
    return F.shiftleft(F.hash(head).cast("bigint"), 32).bitwiseOR(F.hash(tail).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def keyed(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """word, n, gram, at: the three rarest bigrams of each word with their positions; `order` ranks all bigrams."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 10_000):
            grams, places = [], []
            for w in batch.column("word").to_pylist():
                first = sorted((order[w[i : i + 2]], i) for i in range(len(w) - 1))[:RAREST]
                grams.append([w[i : i + 2] for _, i in first])
                places.append([i for _, i in first])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grams, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))], names=[*batch.schema.names, "grams", "places"])

    found = words.mapInArrow(rarest, "word string, n bigint, grams array<string>, places array<int>")
    return found.select("word", "n", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("places").alias("at"))))


def near_words(words: DataFrame) -> DataFrame:
    """word, near, n, near_n: every pair of `words` (word, n) that one inserted, deleted or replaced code point parts, both ways.

    The order of bigrams is one entry for each pair of letters that occurs, so some 8,100 for letters of Latin-1, and is
    sent to the tasks. Keys that many words share are dealt out by Spark's skew join; a pair is verified in the join.
    """
    pairs = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    grams = pairs.groupBy("gram").count().orderBy("count", "gram").collect()
    rows = materialise(keyed(words, {r["gram"]: i for i, r in enumerate(grams)}), "rare_bigrams")
    length = F.char_length("word")
    middle = F.floor(length / 2).cast("int")
    # A word as the longer one of two lacks a letter in either half; its halves are those of the shorter one.
    shorter = length - 1
    cut = F.floor(shorter / 2).cast("int")

    def side(name: str, size: Column, half: Column, quarters: Column, longer: bool) -> DataFrame:
        return rows.select(_key(name, size, half).alias("key"), "word", "n", "at", quarters.alias("quarters"), F.lit(longer).alias("longer"))

    one = F.lit(1)
    asking = side("left", length, F.substring("word", one, middle), _quarters(middle + 1, length - middle, 0), False).unionByName(
        side("right", length, F.substring("word", middle + 1, length), _quarters(one, middle, 0), False)
    )
    longer = side("left", shorter, F.substring("word", one, cut), _quarters(cut + 1, shorter - cut, 1), True).unionByName(
        side("right", shorter, F.substring("word", cut + 2, length), _quarters(one, cut, 1), True)
    )
    held = asking.unionByName(longer).select("key", *(F.col(c).alias(f"other_{c}") for c in ("word", "n", "at", "quarters", "longer")))
    apart = F.col("other_at") - F.col("at")
    place = F.when(F.col("other_longer"), apart.isin(0, 1)).otherwise((apart == 0) & (F.col("word") < F.col("other_word")))
    unlike = F.col("quarters").bitwiseXOR(F.col("other_quarters"))
    kept = (unlike.bitwiseAND(F.lit(0xFFFFFFFF)) == 0) | (F.shiftright(unlike, 32) == 0)
    near = (asking["key"] == held["key"]) & place & kept & (F.levenshtein("word", "other_word", 1) == 1)
    met = asking.join(held, near).select("word", F.col("other_word").alias("near"), "n", F.col("other_n").alias("near_n"))
    back = met.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n"))
    return met.unionByName(back).repartition("word").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: `forms` (word, form) followed to the last form, by doubling the step each round.

    A form occurs at least DOMINANCE times as often as its word, so chains end, after at most log2 of the largest count.
    """
    steps = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not steps.join(onward, "root", "left_semi").head(1):
            return steps
        last, steps = steps, materialise(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        release(last)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `docs` (doc_id, text); other columns are ignored.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, however long, A-Z lower-cased; the checksum of
    id and run decides which lose a letter. Null and empty texts have none; a null doc_id counts as empty text; repeated
    rows count again; an empty table gives no rows. A word's form is its near word of largest n, the smallest in
    code-point order of several, where that n is at least twice the word's; root is the last form.
    """
    words = materialise(word_counts(docs), "words")
    near = near_words(words)
    best = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = materialise(best.select("word", "n_near", F.when(-F.col("best.less") >= DOMINANCE * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")), "near_words")
    formed = told.where("f is not null").select("word", F.col("f.form").alias("form"))
    last = roots(formed)
    with_form = told.select("word", "n_near", "f.form", "f.form_n").join(last, "word", "left")
    whole = words.join(with_form, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


#: The same in DuckDB's dialect: checksums by their table of 256 entries, near words by their one-letter gaps.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS entries FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) AS t(i))
), per_doc AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc, run, count(*) AS n FROM per_doc WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(1, strlen(doc || ':' || run) + 1), lambda i: CAST(('0x' || substr(hex(encode(doc || ':' || run)), CAST(2 * i - 1 AS INTEGER), 2)) AS BIGINT)),
    lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1]), 4294967295)) AS h FROM counted, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gaps AS (
  SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INTEGER)) AS a, substr(word, CAST(i + 1 AS INTEGER)) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM gaps x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, y.n, x.word, x.n FROM gaps x JOIN words y ON y.word = x.a || x.b
), best AS (
  SELECT word, n, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, encode(near))) AS near FROM near GROUP BY word, n
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN near END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS cur, 0 AS step FROM words
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.cur AND f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(cur, step) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
