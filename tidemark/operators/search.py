"""Similarity search: exact top-k, batch nearest neighbours, the similarity walk and merges over projects."""

from __future__ import annotations

import json
import math
import pickle
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.vectors import as_doubles, clamped, cosine, dot, rounded_cosine_to, unit
from tidemark.operators.projects import DEFAULT_EMBEDDING_MODEL, chosen, select_projects
from tidemark.tables import batches_of, materialise, release

#: Numbers in one block of a batch search.
BLOCK_VALUES = 1 << 18
#: Sampled vectors of a width that give a batch search its pivots and first bounds, pivots at most, and numbers in all
#: samples: what all tasks get.
SAMPLE, PIVOTS, SAMPLE_VALUES = 2048, 512, 1 << 22
PLACES = 6
#: Hops of many walks that are one plan.
HOPS = 5
#: Numbers in the queries that are sent to all tasks at a time, some 32 megabytes, and such chunks in one plan.
CHUNK_VALUES, CHUNKS_AT_ONCE = 1 << 22, 8
#: Rows of an Arrow batch whose rows are blocks, or pairs of blocks of some four megabytes; and queries scored at a time.
BATCH_BLOCKS, SCORED = 4, 512
ASKED = "width int, least array<double>, most array<double>, asked binary"
BLOCKS = "number bigint, width int, cell int, low double, high double, block binary"


class SearchEngine(ABC):
    """Whatever answers a vector with its nearest rows."""

    @abstractmethod
    def search_query(self, embedded_query: Sequence[float], top_k: int = 10, **options: object) -> DataFrame: ...


class FrameEngine(SearchEngine):
    """A search engine over one DataFrame (id, text, embedding)."""

    def __init__(self, corpus: DataFrame) -> None:
        self.corpus = corpus

    def search_query(self, embedded_query: Sequence[float], top_k: int = 10, **options: object) -> DataFrame:
        return cosine_top_k(self.corpus, embedded_query, top_k, **options)


def query_vector(query: str | None, embedding: Sequence[float] | None, embed: Callable[[list[str]], list] | None = None) -> list[float]:
    """The vector to search with: the embedding if given, else the query's. ValueError where there is neither."""
    if embedding is not None:
        return list(embedding)
    if query is None:
        raise ValueError("either a query or an embedding is needed")
    if embed is None:
        raise ValueError("a text query needs a provider of embeddings")
    return list(embed([query])[0])


def cosine_top_k(corpus: DataFrame, vector: Sequence[float], k: int = 10, id_column: str = "id") -> DataFrame:
    """The k rows of `corpus` (id, text, embedding) nearest to `vector`, best first, with `score`.

    The vector is a constant in the plan, so this is a scan, a projection and TakeOrderedAndProject: k rows leave each
    task. Ties (to 6 places) fall to the smaller id; rows without a score (NULL or zero vectors) are left out.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    scored = corpus.withColumn("score", rounded_cosine_to(as_doubles(F.col("embedding")), vector))
    # Rows without a score come last, so they are told by the k rows alone: a filter below would work scores out twice.
    return scored.orderBy(F.desc_nulls_last("score"), id_column).limit(k).where(F.col("score").isNotNull())


def relatedness(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("relatedness", cosine(as_doubles(F.col(a)), as_doubles(F.col(b))))


def above(corpus: DataFrame, vector: Sequence[float], threshold: float) -> DataFrame:
    """All rows whose score reaches the threshold."""
    scored = corpus.withColumn("score", rounded_cosine_to(as_doubles(F.col("embedding")), vector))
    return scored.where(F.col("score") >= threshold)


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of `sample` (of length one) spread out: each is the one least like those before it."""
    chosen_rows, nearest = [0], sample @ sample[0]
    while len(chosen_rows) < min(most, len(sample)) and nearest.min() < 1 - 1e-9:
        chosen_rows.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen_rows[-1]])
    return sample[chosen_rows]


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def nearest_neighbours(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """src, rnk, dst, score: the k rows of `corpus` nearest to each row of `queries` (both: id, embedding).

    Exact. Rows of one width are cut into blocks; where there are several, a row is filed under the nearest of some
    sampled pivots and blocks are stretches of one pivot's rows by their angle to it, so blocks follow the number of rows
    and each knows the angles it holds. A block of queries has the least of its members' k-th scores within the sample;
    by the triangle inequality of angles it meets only the blocks that can hold a score that high.

    Queries are a stated set against all rows, in blocks: they go to the tasks in chunks of CHUNK_VALUES numbers, by a
    broadcast of that bounded size, and a task reads its blocks of the corpus past one chunk after another. So no vector
    of the corpus is shuffled, whatever the number of queries, and of a query a task hands on only the k best of all
    that it has read. A worker holds BATCH_BLOCKS pairs of blocks at a time, whatever its task reads. Ties fall to the smaller dst. Rows without an id and zero, NULL or non-finite vectors take no part;
    vectors of different widths never meet, however rare a width is.
    """
    spark = corpus.sparkSession

    def units(df: DataFrame) -> DataFrame:
        return materialise(df.select("id", unit(as_doubles(F.col("embedding"))).alias("u")).where("u is not null and id is not null").select("id", "u", F.size("u").alias("width")), "unit_vectors")

    def values(df: DataFrame) -> tuple[dict[int, int], int]:
        counts = {r["width"]: r["count"] for r in df.groupBy("width").count().collect()}
        return counts, sum(w * n for w, n in counts.items())

    held = units(corpus)
    counts, total = values(held)
    parts = {w: -(-n // block_rows(w)) for w, n in counts.items()}
    first = _samples(held, [w for w, n in parts.items() if n > 1])
    pivots = {w: spread(x, max(1, min(PIVOTS, parts[w] // 4))) for w, x in first.items()}
    blocks = materialise(_blocks(held, pivots, sum(parts.values())), "blocks")
    asking = blocks
    if queries is not corpus:
        other = units(queries)
        asked, total = values(other)
        asking = materialise(_blocks(other, pivots, sum(-(-n // block_rows(w)) for w, n in asked.items())), "query_blocks")
    chunks = max(1, -(-total // CHUNK_VALUES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of queries, by pivot: the angles of what can be among the k nearest of one of its rows."""
        for b in batches:
            for w, blob in zip(b.column("width").to_pylist(), b.column("block").to_pylist(), strict=True):
                if w not in counts:
                    continue
                if w not in pivots:
                    yield _rows(ASKED, [(w, [-1.0], [4.0], blob)])
                    continue
                x = pickle.loads(blob)[1]
                mean = x.mean(0)
                length = float(np.linalg.norm(mean))
                centre = mean / max(length, 1e-300)
                own = float(angles(x, centre[None, :]).max()) if length > 1e-9 else math.pi
                place, enough = len(first[w]) - k, len(first[w]) >= k > 0
                least = min(float(np.partition(x[i : i + SCORED] @ first[w].T, place, axis=1)[:, place].min()) for i in range(0, len(x), SCORED)) if enough else -1.0
                far = math.acos(max(least - 2 * 10.0**-PLACES, -1.0)) + own + 1e-7  # from the centre, of what may be found
                apart = angles(centre[None, :], pivots[w])[0]
                yield _rows(ASKED, [(w, (apart - far).tolist(), (apart + far).tolist(), blob)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.RecordBatch] = {}
        for b in batches:
            for number, asked, block in zip(*(b.column(c) for c in ("number", "asked", "block")), strict=True):
                number, found = number.as_py(), _nearest(*pickle.loads(asked.as_buffer()), *pickle.loads(block.as_buffer()), k)
                best[number] = _best(best[number], found, k) if number in best else found
            del b, asked, block  # before the next batch is read
        yield from best.values()

    def ranked(met: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
        return met.select("src", "dst", "score").withColumn("rnk", rank).where(F.col("rnk") <= k).select("src", "rnk", "dst", "score")

    asks = asking.select("width", "block").mapInArrow(ask, ASKED).withColumn("number", F.monotonically_increasing_id())
    with batches_of(spark, BATCH_BLOCKS):
        asks = materialise(asks.withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks))), "asks")
    corpus_blocks = blocks.select("width", "cell", "low", "high", "block").coalesce(2 * spark.sparkContext.defaultParallelism)
    reaches = (F.get("least", F.col("cell")) <= F.col("high")) & (F.get("most", F.col("cell")) >= F.col("low"))
    found, waiting = [], []
    for c in range(chunks):
        chunk = F.broadcast(asks.where(F.col("chunk") == c).select("number", F.col("width").alias("asked_width"), "least", "most", "asked"))  # some CHUNK_VALUES numbers
        met = corpus_blocks.join(chunk, (F.col("width") == F.col("asked_width")) & reaches).select("number", "asked", "block")
        waiting.append(met.mapInArrow(meet, "src bigint, dst bigint, score double"))
        if c + 1 == chunks or len(waiting) == CHUNKS_AT_ONCE:
            with batches_of(spark, BATCH_BLOCKS):
                found.append(materialise(ranked(reduce(DataFrame.unionByName, waiting)), "neighbours_found"))
            waiting = []
    return found[0] if len(found) == 1 else ranked(reduce(DataFrame.unionByName, found))  # again, for ids that are asked for in several lots


def _best(a: pa.RecordBatch, b: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The k best rows a query of two lots of (src, dst, score)."""
    src, dst, score = (np.concatenate([x.column(c).to_numpy() for x in (a, b)]) for c in ("src", "dst", "score"))
    order = np.lexsort((dst, -score, src))
    src = src[order]
    keep = order[np.arange(len(src)) - np.searchsorted(src, src) < k]
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.concatenate([a.column("src").to_numpy(), b.column("src").to_numpy()]), dst, score)], names=["src", "dst", "score"])


def block_rows(width: int) -> int:
    """Rows of a block: some two megabytes of vectors."""
    return max(BLOCK_VALUES // max(width, 1), 64)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _samples(held: DataFrame, widths: list[int]) -> dict[int, np.ndarray]:
    """At most SAMPLE vectors of each of `widths`, and SAMPLE_VALUES numbers in all."""
    most = max(1, min(SAMPLE, SAMPLE_VALUES // max(sum(widths), 1)))
    by_hash = F.row_number().over(W.partitionBy("width").orderBy(F.xxhash64("id"), "id"))
    sample: dict[int, list] = {}
    if widths:
        for r in held.where(F.col("width").isin(*widths)).withColumn("at", by_hash).where(F.col("at") <= most).select("width", "u").collect():
            sample.setdefault(r["width"], []).append(r["u"])
    return {w: np.array(v) for w, v in sample.items()}


def _blocks(rows: DataFrame, pivots: dict[int, np.ndarray], parts: int) -> DataFrame:
    """number, width, cell, low, high, block: stretches of the `rows` (id, u, width) of one cell by their angle to its pivot."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, vectors = b.column("width").to_numpy(), b.column("u").to_pylist()
            cell, angle = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for w in set(width.tolist()) & pivots.keys():
                at = np.flatnonzero(width == w)
                apart = angles(np.array([vectors[i] for i in at]), pivots[w])
                cell[at], angle[at] = apart.argmin(1), apart.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come in order, so that one block is filled at a time."""
        made, key, waiting = 0, None, []

        def out() -> pa.RecordBatch:
            ids, vectors, angles = zip(*waiting, strict=True)
            blob = pickle.dumps((np.array(ids, np.int64), np.array(vectors)), protocol=5)
            return _rows(BLOCKS, [((TaskContext.get().partitionId() << 32) + made, *key, min(angles), max(angles), blob)])

        for b in batches:
            for i, u, w, c, a in zip(*(b.column(n).to_pylist() for n in ("id", "u", "width", "cell", "angle")), strict=True):
                if waiting and ((w, c) != key or len(waiting) == block_rows(w)):
                    yield out()
                    made, waiting = made + 1, []
                key = (w, c)
                waiting.append((i, u, a))
        if waiting:
            yield out()

    order = ("width", "cell", "angle", "id")
    return rows.mapInArrow(filed, "id bigint, u array<double>, width int, cell int, angle double").repartitionByRange(max(parts, 1), *order).sortWithinPartitions(*order).mapInArrow(pack, BLOCKS)


def _nearest(src: np.ndarray, x: np.ndarray, dst: np.ndarray, y: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of a block for each query of a block, by matrix product and partition."""
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(src), SCORED):
        scores = x[at : at + SCORED] @ y.T
        np.round(np.clip(scores, -1, 1, out=scores), PLACES, out=scores)
        most = min(k, len(dst))
        if not most:
            continue
        least = np.partition(scores, len(dst) - most, axis=1)[:, len(dst) - most]
        i, j = np.nonzero(scores >= least[:, None])
        order = np.lexsort((dst[j], -scores[i, j], i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[rank < k], j[rank < k]
        for column, values in zip(out, (src[at + i], dst[j], scores[i, j]), strict=True):
            column.append(values)
    kinds = (np.int64, np.int64, np.float64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, t)) for c, t in zip(out, kinds, strict=True)], names=["src", "dst", "score"])


def similarity_walk(corpus: DataFrame, vector: Sequence[float], top_k: int = 5, depth: int = 50, score_threshold: float = 0.85, score_based_on_initial_query: bool = False) -> DataFrame:
    """step, document, score: a greedy walk from text to text.

    `corpus` has id, text, embedding. Each hop ranks the corpus by the current vector, takes the best row (on later
    hops the one after the row itself) and stops below the threshold; a text already visited gives way to the next of
    the top_k that isn't, which must reach the threshold as well. With `score_based_on_initial_query` the scores tested
    and reported are those against the first vector, while ranks stay those of the hop. Visits are told by text. Rows
    without a score take no part; a first vector without a length walks nowhere; too few rows end the walk.

    Vectors are scaled to length one once and cached with a digest of their text, and with the score of the first vector
    where that is asked for; a hop is one dot product a row and a distributed top-k of which top_k rows come back. Hops
    depend on each other. The texts themselves are read once, at the end, for the steps alone. Many walks at once:
    similarity_walks.
    """
    spark = corpus.sparkSession
    length = math.sqrt(sum(float(x) * x for x in vector))
    steps: list[tuple] = []
    if not 0 < length < math.inf:
        return spark.createDataFrame(steps, "step int, document string, score double")

    def score(v: Sequence[float]) -> str:
        product = f"aggregate(zip_with(u, from_json('{json.dumps(v)}', 'array<double>'), (x, y) -> x * y), 0D, (total, x) -> total + x)"
        return f"CASE WHEN size(u) = {len(v)} THEN round(greatest(-1D, least(1D, {product})), {PLACES}) END"

    current = [float(x) / length for x in vector]
    rows = corpus.select("id", F.md5("text").alias("digest"), unit(as_doubles(F.col("embedding"))).alias("u")).where("u is not null")
    said = "first" if score_based_on_initial_query else "score"
    rows = (rows.withColumn("first", F.expr(score(current))) if score_based_on_initial_query else rows).persist()
    view = f"walk_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    seen: set[str | None] = set()
    try:
        for hop in range(depth):
            ranked = spark.sql(f"SELECT *, {score(current)} AS score FROM {view} ORDER BY score DESC NULLS LAST, id LIMIT {top_k}")
            near = [r for r in ranked.collect() if r["score"] is not None]
            at = 0 if hop == 0 else 1
            if len(near) <= at or near[at][said] < score_threshold:
                break
            fresh = next((r for r in near[at:] if r["digest"] not in seen), None)
            if fresh is None or fresh[said] < score_threshold:
                break
            seen.add(fresh["digest"])
            steps.append((hop + 1, fresh["id"], fresh["digest"], float(fresh[said])))
            current = fresh["u"]
    finally:
        spark.catalog.dropTempView(view)
        rows.unpersist()
    walked = F.broadcast(spark.createDataFrame(steps, "step int, __id bigint, digest string, score double"))  # depth rows at most
    found = corpus.join(walked, (F.col("id") == F.col("__id")) & F.md5("text").eqNullSafe(F.col("digest")))
    return found.groupBy("step").agg(F.first("text").alias("document"), F.first("score").alias("score"))


def similarity_walks(corpus: DataFrame, starts: DataFrame, top_k: int = 5, depth: int = 50, score_threshold: float = 0.85, score_based_on_initial_query: bool = False) -> DataFrame:
    """walk, step, document, score: similarity_walk from every row of `starts` (walk, embedding) at once.

    The walks are a table: where each is, the texts it has visited (at most `depth`) and its steps. A hop joins it with
    the neighbours of the rows where walks are; HOPS of them are one plan. Where there may be more hops than rows, the
    neighbours of all rows are found beforehand in one batch search; else each hop finds those of the rows that no walk
    has been at, in blocks. Walks that meet at one row are split by Spark's skew join. Starts without an id or a length
    walk nowhere; ids must be unique.
    """
    spark = corpus.sparkSession
    rows = materialise(corpus.select("id", F.coalesce(F.md5("text"), F.lit("")).alias("digest"), unit(as_doubles(F.col("embedding"))).alias("u")).where("u is not null and id is not null"), "walk_rows")
    first = materialise(starts.select("walk", unit(as_doubles(F.col("embedding"))).alias("q")).where("q is not null and walk is not null"), "walk_starts")

    def neighbours(asked: DataFrame) -> DataFrame:
        """src and near (rnk, dst, digest, score, and the vector where it is needed), best first."""
        found = nearest_neighbours(asked, rows.select("id", F.col("u").alias("embedding")), top_k)
        told = found.join(rows.select(F.col("id").alias("dst"), "digest", *(["u"] if score_based_on_initial_query else [])), "dst")
        return told.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rnk", "dst", "digest", "score", *(["u"] if score_based_on_initial_query else [])))).alias("near"))

    def said(x: Column) -> Column:
        return F.round(clamped(dot(F.col("q"), x["u"])), PLACES) if score_based_on_initial_query else x["score"]

    def hop(state: DataFrame, near: DataFrame, least_rank: int) -> DataFrame:
        head = F.get(F.col("near"), least_rank - 1)
        fresh = F.get(F.filter("near", lambda x: (x["rnk"] >= least_rank) & ~F.array_contains("seen", x["digest"])), 0)
        met = state.join(near, state["at"] == near["src"], "left").withColumn("head", head).withColumn("fresh", fresh)
        goes = F.coalesce((said(F.col("head")) >= score_threshold) & (said(F.col("fresh")) >= score_threshold), F.lit(False))
        step = F.struct((F.size("steps") + 1).alias("step"), F.col("fresh.dst").alias("id"), said(F.col("fresh")).alias("score"))
        return met.withColumn("goes", goes).select(
            "walk", "q", F.when(F.col("goes"), F.col("fresh.dst")).alias("at"),
            F.when(F.col("goes"), F.array_append("seen", F.col("fresh.digest"))).otherwise(F.col("seen")).alias("seen"),
            F.when(F.col("goes"), F.array_append("steps", step)).otherwise(F.col("steps")).alias("steps"),
        )

    empty = first.select("walk", "q", F.col("walk").alias("at"), F.expr("cast(array() as array<string>)").alias("seen"), F.expr("cast(array() as array<struct<step: int, id: bigint, score: double>>)").alias("steps"))
    state = materialise(hop(empty, neighbours(first.select(F.col("walk").alias("id"), F.col("q").alias("embedding"))), 1), "walks") if depth > 0 else empty
    every = first.count() * depth >= rows.count()
    vectors = rows.select("id", F.col("u").alias("embedding"))
    known = materialise(neighbours(vectors), "neighbours") if every else None
    done = 1
    while done < depth and state.where("at is not null").head(1):
        if not every:
            new = state.where("at is not null").select(F.col("at").alias("id")).distinct()
            new = new if known is None else new.join(known.select(F.col("src").alias("id")), "id", "left_anti")
            found = neighbours(vectors.join(new, "id"))
            known = materialise(found if known is None else known.unionByName(found), "neighbours")
        hops = min(HOPS if every else 1, depth - done)
        last, moved = state, state
        for _ in range(hops):
            moved = hop(moved, known, 2)
        state, done = materialise(moved, "walks"), done + hops
        release(last)
    steps = state.select("walk", F.inline("steps"))
    return steps.join(corpus.select("id", F.col("text").alias("document")), "id").select("walk", "step", "document", "score")


def merge_project_hits(hits: DataFrame, selected: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits (project, id, score, ...) of the projects in `selected` (slug), best first.

    `limit` None keeps all, 0 none; negative limits are refused. Hits of projects that aren't selected never reach the
    sort, and tables partitioned by project aren't even read.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    merged = of_projects(hits, selected).orderBy(F.desc("score"), "project", "id")
    return merged if limit is None else merged.limit(limit)


def of_projects(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """The rows (project, ...) of the projects in `selected` (slug); done before scoring, only these are scored."""
    return rows.join(selected.select(F.col("slug").alias("project")), "project", "left_semi")


#: Runs the search of one project, named by its slug: id, score and what else the hits carry.
ProjectQuery = Callable[[str], DataFrame]


def top_k_by_project(rows: DataFrame, selected: DataFrame, vector: Sequence[float], k: int = 10, limit: int | None = None) -> DataFrame:
    """project, id, score: the `k` best rows of each project in `selected` (slug), merged best first, in one pass over `rows`.

    `rows` has project, id, embedding. One scan scores the rows of all selected projects and each task keeps k of a
    project before anything is shuffled, however many projects there are: what search_projects does with a plan for each.
    Rows without a score are left out; ties fall to the smaller id. ValueError for a negative k or limit.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    scored = of_projects(rows, selected).select("project", "id", rounded_cosine_to(as_doubles(F.col("embedding")), vector).alias("score")).where("score is not null")
    place = F.row_number().over(W.partitionBy("project").orderBy(F.desc("score"), "id"))
    return merge_project_hits(scored.withColumn("place", place).where(F.col("place") <= k).drop("place"), selected, limit)


def search_projects(projects: DataFrame, query: ProjectQuery, embedding_model: str | None = None, default_model: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged hits of all projects that may be searched together, and the selection behind them.

    `projects` has position, id, slug, embedding_model; one that has chosen no model has `default_model`, else the
    library's. `query` is called once for each included project, in order, and never for an excluded one; the driver
    sees the slugs. Scores compare because the selection guarantees one model.
    """
    model = chosen(F.col("embedding_model"), F.lit(default_model or DEFAULT_EMBEDDING_MODEL))
    selection = select_projects(projects.withColumn("embedding_model", model), embedding_model)
    included = selection.where("included").orderBy("position").select("slug")
    hits = [query(r["slug"]).withColumn("project", F.lit(r["slug"])) for r in included.collect()]
    empty = projects.sparkSession.createDataFrame([], "id bigint, score double, project string")
    return merge_project_hits(reduce(DataFrame.unionByName, hits) if hits else empty, included, limit), selection
