"""Ranked lexical search over a clustered index with exact stopping.

Documents are put in the order of a recursive graph bisection and cut into shards, so that documents of like words share
shards. A shard holds the postings of its documents and, for each term, the largest share of a score that it gives any of
them. The sum of these over an item's terms bounds what the item can find there. Shards are visited from the largest bound
on, in stages that grow; after each stage an item's k-th score excludes all shards with a smaller bound. A bound that
equals it does not, as the tie may fall to a smaller doc_id: rows carry their doc_id through the new order.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bisection import Bisection
from tidemark.llm.shared import materialise, release, sliced

K = 20
#: Documents in a shard, and sampled documents that the bisection is fitted on.
SHARD, SAMPLE = 8192, 8192
#: Terms of the items that are searched in one go, repeats included: what is sent to all tasks.
MOST_TERMS = 500_000
#: Shards an item visits in the first stage, and how many times more in each further one.
FIRST, GROWTH = 2, 8
#: Steps of the bounds' histogram that says where stages end.
STEPS = 64
#: Pairs of item and shard that are sent to the shards at most; beyond that both meet by shard.
MOST_PAIRS = 1_000_000

#: Bytes of a term in UTF-8: digits, letters and all beyond ASCII; A-Z become a-z, all else separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, A-Z lower-cased; null has none."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight one adds to the score of a document of n terms that has it tf times."""
    m = 100 - 25 + (25 * n.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


class Items:
    """The items of one search: their different terms, numbered, and each item's terms with their counts."""

    def __init__(self, rows: list) -> None:
        self.numbers = np.array([r["item"] for r in rows], np.int64)
        counts = [Counter(terms_of(r["text"])) for r in rows]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        self.terms = [np.array([self.vocabulary[t] for t in c], np.int64) for c in counts]
        self.times = [np.array(list(c.values()), np.int64) for c in counts]

    def weigh(self, weights: np.ndarray) -> None:
        self.worth = [weights[t] * n for t, n in zip(self.terms, self.times, strict=True)]


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, row, n, terms, tfs of every document with a term; of its terms those in `vocabulary`, in its numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            n, terms, tfs = [], [], []
            for t in batch.column("text").to_pylist():
                every = terms_of(t)
                found = Counter(every)
                known = sorted((vocabulary[x], found[x]) for x in found.keys() & vocabulary.keys())
                n.append(len(every))
                terms.append([a for a, _ in known])
                tfs.append([b for _, b in known])
            ids, rows = batch.column("doc_id"), batch.column("row")
            made = [ids, rows, pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "row", "n", "terms", "tfs"])

    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return numbered.mapInArrow(count, "doc_id bigint, row bigint, n bigint, terms array<int>, tfs array<int>").where("n > 0")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and how many each row has."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def _with_leaf(counted: DataFrame, tree: Bisection) -> DataFrame:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaves(*_flat(batch.column("terms"))), pa.int64())], names=[*batch.schema.names, "leaf"])

    return counted.mapInArrow(route, "doc_id bigint, row bigint, n bigint, terms array<int>, tfs array<int>, leaf bigint")


def shard_index(counted: DataFrame, tree: Bisection, n_docs: int, n_terms: int) -> DataFrame:
    """shard, terms, most, block: the documents that hold a term, by leaf, in shards of SHARD documents.

    `most` is the largest impact of each term in the shard; a block holds doc_ids, rows and postings.
    """

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, waiting, rows = 0, [], 0
        for batch in batches:
            for part in sliced([batch], SHARD):
                waiting.append(part)
                rows += part.num_rows
                if rows >= SHARD:
                    yield block(made, waiting)
                    made, waiting, rows = made + 1, [], 0
        if rows:
            yield block(made, waiting)

    def block(made: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        one = {c: table.column(c).chunk(0) if table.column(c).num_chunks else table.column(c).combine_chunks() for c in table.column_names}
        (terms, sizes), (tfs, _) = _flat(one["terms"]), _flat(one["tfs"])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        share = impacts(tfs, one["n"].to_numpy()[doc], n_docs, n_terms)
        order = np.argsort(terms, kind="stable")
        known, start = np.unique(terms[order], return_index=True)
        share, doc = share[order], doc[order]
        ids, nulls = one["doc_id"].fill_null(0).to_numpy(), one["doc_id"].is_null().to_numpy(zero_copy_only=False)
        blob = pickle.dumps((ids, nulls, one["row"].to_numpy(), known.astype(np.int32), start.astype(np.int32), doc.astype(np.uint16), share.astype(np.uint32)), protocol=5)
        most = np.maximum.reduceat(share, start)
        number = (TaskContext.get().partitionId() << 32) + made
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([known.tolist()], pa.list_(pa.int32())), pa.array([most.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["shard", "terms", "most", "block"]
        )

    ordered = _with_leaf(counted.where(F.size("terms") > 0), tree).repartitionByRange(max(1, -(-n_docs // SHARD)), "leaf", "row").sortWithinPartitions("leaf", "row")
    return ordered.mapInArrow(hold, "shard bigint, terms array<int>, most array<bigint>, block binary")


def shard_bounds(index: DataFrame, items: Items) -> DataFrame:
    """item, shard, bound: what the shard can give the item at most, where that is anything."""
    n_terms = len(items.vocabulary)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, terms, most in zip(*(batch.column(c).to_pylist() for c in ("shard", "terms", "most")), strict=True):
                dense = np.zeros(n_terms, np.int64)
                dense[terms] = most
                bounds = np.array([int(dense[t] @ w) for t, w in zip(items.terms, items.worth, strict=True)], np.int64)
                live = np.flatnonzero(bounds > 0)
                yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array(np.full(len(live), shard), pa.int64()), pa.array(bounds[live])], names=["item", "shard", "bound"])

    return index.select("shard", "terms", "most").mapInArrow(bound, "item bigint, shard bigint, bound bigint")


def stage_ends(bounds: DataFrame, n_items: int) -> np.ndarray:
    """A row of falling bounds for each item: stage j visits the shards from the j-th bound of the row on; the last is 0.

    They come from a histogram of each item's bounds, of which STEPS counts an item reach the driver.
    """
    most = {r["item"]: r["most"] for r in bounds.groupBy("item").agg(F.max("bound").alias("most")).collect()}
    top = F.broadcast(bounds.sparkSession.createDataFrame([(int(i), int(m)) for i, m in most.items()], "item bigint, most bigint"))
    step = F.least(F.expr(f"bound * {STEPS} div most"), F.lit(STEPS - 1))
    counts = np.zeros((n_items, STEPS), np.int64)
    for r in bounds.join(top, "item").groupBy("item", step.alias("step")).count().collect():
        counts[r["item"], r["step"]] = r["count"]
    total, ends = counts[:, ::-1].cumsum(1), []
    wanted = FIRST
    while True:
        first = np.minimum((total < wanted).sum(1), STEPS - 1)  # steps from above that hold too few
        step = STEPS - 1 - first
        ends.append([math.ceil(s * most.get(i, 0) / STEPS) if total[i, -1] > wanted else 0 for i, s in enumerate(step.tolist())])
        if not any(ends[-1]):
            return np.array(ends, np.int64).T
        wanted *= GROWTH


def visit(index: DataFrame, pairs: DataFrame, items: Items, least: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, row, score: the up to k best documents of each pair of item and shard that reach the item's least score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, blob in zip(batch.column("items").to_pylist(), batch.column("block").to_pylist(), strict=True):
                ids, nulls, rows, known, start, doc, share = pickle.loads(blob)
                end = np.append(start[1:], len(doc))
                out: list[list[np.ndarray]] = [[], [], []]
                for i in sorted(asked):
                    place = np.minimum(np.searchsorted(known, items.terms[i]), len(known) - 1)
                    total = np.zeros(len(ids), np.int64)
                    for p, w in zip(place[held := known[place] == items.terms[i]].tolist(), items.worth[i][held].tolist(), strict=True):
                        if w:
                            total[doc[start[p] : end[p]]] += w * share[start[p] : end[p]].astype(np.int64)
                    good = np.flatnonzero(total >= max(int(least[i]), 1))
                    if len(good) > k:
                        good = good[total[good] >= np.partition(total[good], len(good) - k)[len(good) - k]]
                        good = good[np.lexsort((rows[good], ids[good], nulls[good], -total[good]))[:k]]
                    for column, values in zip(out, (np.full(len(good), i), good, total[good]), strict=True):
                        column.append(values)
                which = np.concatenate(out[1]).astype(np.int64)
                found = [pa.array(np.concatenate(out[0]).astype(np.int64)), pa.array(ids[which], mask=nulls[which]), pa.array(rows[which]), pa.array(np.concatenate(out[2]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(found, names=["item", "doc_id", "row", "score"])

    by_shard = pairs.groupBy("shard", F.shiftright("item", 8).alias("part")).agg(F.collect_list("item").alias("items"))  # 256 items of a shard at a time
    by_shard = F.broadcast(by_shard) if pairs.count() <= MOST_PAIRS else by_shard
    return index.select("shard", "block").join(by_shard, "shard").select("items", "block").mapInArrow(score, "item bigint, doc_id bigint, row bigint, score bigint")


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """item, doc_id, score, rank of the k best documents of each of `items`."""
    spark = docs.sparkSession
    counted = materialise(term_counts(docs, items.vocabulary), "term_counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(items.vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[r["term"]] = weight(n_docs, r["count"])
    items.weigh(weights)
    every = max(n_docs, SAMPLE)
    sample = counted.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("row"), F.lit(every)) < SAMPLE)).select("terms").collect()  # some SAMPLE rows
    tree = Bisection()
    if sample:
        tree.fit(np.concatenate([r["terms"] for r in sample]), np.array([len(r["terms"]) for r in sample]))
    index = materialise(shard_index(counted, tree, n_docs, max(n_terms, 1)), "lexical_index")
    bounds = materialise(shard_bounds(index, items), "shard_bounds")
    release(counted)
    ends = stage_ends(bounds, len(items.numbers))
    least, before = np.zeros(len(items.numbers), np.int64), np.full(len(items.numbers), np.iinfo(np.int64).max)
    best = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id", "row")
    found = None
    for end in ends.T:
        limits = spark.createDataFrame([(i, int(max(a, b)), int(c)) for i, (a, b, c) in enumerate(zip(end, least, before, strict=True))], "item bigint, low bigint, high bigint")
        pairs = bounds.join(F.broadcast(limits), "item").where("bound >= low and bound < high").select("item", "shard")  # limits has a row an item
        new = visit(index, pairs, items, least, k)
        merged = new if found is None else new.unionByName(found.drop("rank"))
        last, found = found, materialise(merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
        if last is not None:
            release(last)
        for r in found.where(F.col("rank") == k).select("item", "score").collect():
            least[r["item"]] = r["score"]
        before = np.minimum(before, end)
        if not bounds.join(F.broadcast(spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(least, before, strict=True))], "item bigint, low bigint, high bigint")), "item").where("bound >= low and bound < high").head(1):
            break
    release(index, bounds)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of `items` (item_id, text) its k best rows of `docs` (doc_id, text).

    Exact: equal scores go by ascending doc_id, null last, and rows that repeat a doc_id in the order they are read.
    Whole texts of any length count; null and empty ones hold no term, count for nothing and are never found, and an
    item without a term finds nothing. Rows that repeat an item are searched and numbered each for itself. Other columns
    are ignored. Without documents or items there are no rows.

    Items are searched in groups of some MOST_TERMS terms, so that what is sent to the tasks stays bounded; each group
    is one pass over the texts.
    """
    spark = docs.sparkSession
    asked = materialise(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), "items")
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-size // (2 * MOST_TERMS)))  # a term and its separator take two characters at least
    results = None
    for g in range(groups):
        chosen = Items(asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).select("item", "text").collect())
        if not chosen.vocabulary:
            continue
        found = _search(docs, chosen, k)
        named = spark.createDataFrame([(i, int(n)) for i, n in enumerate(chosen.numbers)], "item bigint, asked bigint")
        told = found.join(F.broadcast(named), "item").select("asked", "rank", "doc_id", "score")  # a row an item
        results = told if results is None else results.unionByName(told)
    if results is None:
        results = spark.createDataFrame([], "asked bigint, rank int, doc_id bigint, score bigint")
    return results.join(asked.select("item_id", F.col("item").alias("asked")), "asked").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same in DuckDB's dialect, where doc_id and item_id are unique.
SQL = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS terms FROM documents
), sizes AS (
  SELECT doc_id, CAST(len(terms) AS BIGINT) AS size FROM d WHERE len(terms) > 0
), facts AS (
  SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS total FROM sizes
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, facts GROUP BY term, docs
), shares AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size * docs) // total))) AS share FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (term), facts
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * share) AS BIGINT) AS score FROM asked JOIN shares USING (term) GROUP BY item_id, doc_id HAVING sum(times * share) > 0
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
