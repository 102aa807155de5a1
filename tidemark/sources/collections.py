"""A vector store on Parquet: named collections of points with one or more named vectors and a payload.

A collection's points lie in buckets by the hash of their id. A write makes new files for the buckets that it changes, and
then a commit: a small file, the next in number, that says which files each bucket has and how many points. It takes its
name by a rename that never replaces, so readers see a commit whole or not at all, and of two writers that started from
the same commit one is refused and starts again from the other's. The last KEEP commits stay for readers that opened them.

An index lays the points out by cells, each the points nearest to one of some sampled pivots, and knows the widest angle
of each. A search reads cells from the one with the best bound on, until the bound of the rest excludes them.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import clamped, constant, dot, unit
from tidemark.operators.search import PLACES, SearchEngine, angles, cosine_top_k, spread
from tidemark.tables import file_names, materialise, release, write_once

#: A point; `at` is when its source said it, where the source says so.
POINTS = "id bigint, embedding array<double>, payload map<string,string>, at bigint"
KEEP, BUCKETS, ATTEMPTS = 4, 64, 5
#: Points of a cell of an index at least, cells of an index at most, and sampled points that give its pivots.
CELL_POINTS, CELLS, SAMPLE = 1024, 512, 4096


class ConcurrentWriteError(RuntimeError):
    """Another writer has committed since this one read."""


def once(points: DataFrame) -> DataFrame:
    """One row of each id: the one with the greatest `at` if there is such a column, ties by the hash of the vector.

    An aggregate, so that an id that is repeated without end is combined in each task first.
    """
    others = [c for c in points.columns if c != "id"]
    order = F.struct(*(["at"] if "at" in others else []), F.xxhash64(*([c for c in others if not c.startswith("payload")] or ["id"])))
    return points.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("__row")).select("id", *(F.col(f"__row.{c}").alias(c) for c in others))


def upsert_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """`new`, one row an id, and what `old` has besides its ids."""
    return once(new).unionByName(old.join(new.select("id"), "id", "left_anti"))


def append_points(old: DataFrame, new: DataFrame, count: int) -> DataFrame:
    """`old` and `new` (position from 0 in column id) numbered on from `count`."""
    return old.unionByName(new.withColumn("id", F.col("id") + count))


def positional_points(vectors: DataFrame, payload: DataFrame | None = None) -> DataFrame:
    """Points (id, embedding, payload) from `vectors` (position, embedding) and the `payload` of the same positions.

    The other columns of `payload` become its map, as text. None and an empty payload are none; ValueError where it has
    another number of rows than there are vectors.
    """
    plain = vectors.select(F.col("position").alias("id"), "embedding")
    n = payload.count() if payload is not None else 0
    if not n:
        return plain.withColumn("payload", F.lit(None).cast("map<string,string>"))
    if n != vectors.count():
        raise ValueError(f"{vectors.count()} vectors, but {n} payloads")
    said = [x for c in payload.columns if c != "position" for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return plain.join(payload.select(F.col("position").alias("id"), F.create_map(*said).alias("payload")), "id")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


class VectorStore(SearchEngine):
    """Collections below `root`, any folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Files

    def _file(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _read(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())

    def _numbers(self, name: str) -> list[int]:
        """The numbers of the commits that are there, in order."""
        names = [n.removesuffix(".json") for n in file_names(self.spark, self._file(name, "commits"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _commit_at(self, name: str, number: int) -> dict:
        return json.loads(self._read(self._file(name, "commits", f"{number}.json")))

    def _config(self, name: str) -> dict:
        """The last commit, with its number."""
        if not (numbers := self._numbers(name)):
            raise ValueError(f"no collection {name!r}")
        return self._commit_at(name, numbers[-1]) | {"number": numbers[-1]}

    def _commit(self, name: str, config: dict) -> None:
        """`config` as the commit after the one it was read from; ConcurrentWriteError if that one has a successor."""
        told = {k: v for k, v in config.items() if k != "number"}
        try:
            write_once(self.spark, self._file(name, "commits", f"{config['number'] + 1}.json"), json.dumps(told))
        except FileExistsError as e:
            raise ConcurrentWriteError(f"collection {name!r} has changed since commit {config['number']}") from e
        self._forget(name, config["number"] + 1 - KEEP)

    def _forget(self, name: str, last: int) -> None:
        """Deletes commit `last` and the files of buckets that no commit after it has."""
        if last not in self._numbers(name):
            return
        gone = {(b, v) for b, (v, _) in self._commit_at(name, last)["held"].items()}
        for number in self._numbers(name):
            if number > last:
                with suppress(ValueError):
                    gone -= {(b, v) for b, (v, _) in self._commit_at(name, number)["held"].items()}
        for bucket, version in gone:
            self._fs.delete(self._path(self._file(name, "points", version, f"bucket={bucket}")), True)
        self._fs.delete(self._path(self._file(name, "commits", f"{last}.json")), False)

    def _retried(self, name: str, change: Callable[[dict], dict]) -> None:
        """Commits what `change` makes of the last commit, again from the newest where another writer came between."""
        for left in reversed(range(ATTEMPTS)):
            config = self._config(name)
            made = change(config)
            try:
                return self._commit(name, made)
            except ConcurrentWriteError:
                for version in {v for v, _ in made["held"].values()} - {v for v, _ in config["held"].values()}:
                    self._fs.delete(self._path(self._file(name, "points", version)), True)
                if not left:
                    raise
        return None

    # Collections

    def collections(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(self.root)) if self._numbers(n := s.getPath().getName()))

    def info(self, name: str) -> dict:
        """collection, vector_name, size, distance; vectors with the width of each where there are several."""
        config = self._config(name)
        first = next(iter(config["vectors"]))
        several = {"vectors": config["vectors"]} if len(config["vectors"]) > 1 else {}
        return {"collection": name, "vector_name": first, "size": config["vectors"][first], "distance": "Cosine", **several}

    def create(self, name: str, vector_size: int | dict[str, int], vector_name: str = "main", buckets: int = BUCKETS) -> None:
        """A new, empty collection of one vector a point, or of several named ones; one of that name is replaced."""
        self.delete(name)
        vectors = vector_size if isinstance(vector_size, dict) else {vector_name: vector_size}
        self._commit(name, {"number": 0, "vectors": vectors, "buckets": buckets, "held": {}})

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self._file(name)), True)

    def _schema(self, config: dict) -> str:
        return "id bigint, vectors struct<" + ", ".join(f"`{v}`: array<double>" for v in config["vectors"]) + ">, payload map<string,string>, at bigint"

    def files(self, name: str, buckets: Sequence[int] | None = None) -> list[str]:
        """The folders that hold the points of the given buckets, or of all."""
        return self._folders(name, self._config(name), buckets)

    def _folders(self, name: str, config: dict, buckets: Sequence[int] | None = None) -> list[str]:
        wanted = None if buckets is None else set(map(str, buckets))
        return [self._file(name, "points", v, f"bucket={b}") for b, (v, _) in sorted(config["held"].items()) if wanted is None or b in wanted]

    def _held(self, name: str, config: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        folders = self._folders(name, config, buckets)
        return self.spark.read.schema(self._schema(config)).parquet(*folders) if folders else self.spark.createDataFrame([], self._schema(config))

    def points(self, name: str, vector_name: str | None = None) -> DataFrame:
        """id, embedding, payload, at of all points; embedding is the named vector, else the collection's first."""
        config = self._config(name)
        return self._held(name, config).select("id", self._vector(config, vector_name).alias("embedding"), "payload", "at")

    def _vector(self, config: dict, vector_name: str | None) -> Column:
        if vector_name is not None and vector_name not in config["vectors"]:
            raise ValueError(f"no vector {vector_name!r}")
        return F.col(f"vectors.`{vector_name or next(iter(config['vectors']))}`")

    def count(self, name: str) -> int:
        """From the last commit, without reading points."""
        return sum(n for _, n in self._config(name)["held"].values())

    # Writes

    def _points_from(self, vectors: Sequence[Sequence[float]], payload: Sequence[dict] | None) -> DataFrame:
        if payload and len(payload) != len(vectors):
            raise ValueError(f"{len(vectors)} vectors, but {len(payload)} payloads")
        rows = [(i, [float(x) for x in v], {k: str(x) for k, x in payload[i].items()} if payload else None, None) for i, v in enumerate(vectors)]
        return self.spark.createDataFrame(rows, POINTS)

    def _fitting(self, name: str, config: dict, points: DataFrame) -> DataFrame:
        """Points of the collection's schema, written once; ValueError if a vector hasn't its width or a point has none.

        Points come with a column for each vector, or with `embedding` for the first one.
        """
        first, nothing = next(iter(config["vectors"])), F.lit(None)
        given = {v: F.col(f"`{v}`") if v in points.columns else F.col("embedding") if v == first and "embedding" in points.columns else nothing for v in config["vectors"]}
        vectors = F.struct(*(c.cast("array<double>").alias(v) for v, c in given.items()))
        others = [F.col(c) if c in points.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("payload", "map<string,string>"), ("at", "bigint"))]
        whole = materialise(points.select("id", vectors.alias("vectors"), *others, bucket_of(config["buckets"]).alias("bucket")), "new_points")
        wide = [F.col(f"vectors.`{v}`") for v in config["vectors"]]
        off = F.lit(False)
        for c, size in zip(wide, config["vectors"].values(), strict=True):
            off = off | F.coalesce(F.size(c) != size, F.lit(False))
        if whole.where(F.col("id").isNull() | F.coalesce(*wide).isNull() | off).head(1):
            release(whole)
            raise ValueError(f"points of collection {name!r} have an id and vectors of {config['vectors']} components")
        return whole

    def _put(self, name: str, config: dict, points: DataFrame) -> dict:
        """The commit in which `points` (with bucket) are all that their buckets hold; writes new files for those."""
        version = f"v-{uuid.uuid4().hex}"
        path = self._file(name, "points", version)
        points.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        rows = {str(r["bucket"]): r["count"] for r in self.spark.read.parquet(path).groupBy("bucket").count().collect()} if self._fs.globStatus(self._path(f"{path}/bucket=*")) else {}
        return config | {"held": config["held"] | {b: [version, n] for b, n in rows.items()}}

    def add(self, name: str, vectors: Sequence[Sequence[float]], payload: Sequence[dict] | None = None) -> None:
        """Points with ids from 0: points of the same ids are overwritten, later ones stay."""
        self.upsert(name, self._points_from(vectors, payload))

    def append(self, name: str, vectors: Sequence[Sequence[float]] | DataFrame, payload: Sequence[dict] | None = None) -> None:
        """Points with ids from the present count on; a table brings its positions from 0 in column id."""
        new = vectors if isinstance(vectors, DataFrame) else self._points_from(vectors, payload)

        def change(config: dict) -> dict:
            count = sum(n for _, n in config["held"].values())
            return self._upserted(name, config, new.withColumn("id", F.col("id") + count), False)

        self._retried(name, change)

    def upsert(self, name: str, points: DataFrame, newest: bool = False) -> None:
        """Points by id, from a distributed table (id, embedding or named vectors, payload, perhaps at); of a repeated id one counts.

        Only the buckets of these ids are read and written. With `newest`, a point stays as it is where its own `at` is
        greater than the new one's.
        """
        self._retried(name, lambda config: self._upserted(name, config, points, newest))

    def _upserted(self, name: str, config: dict, points: DataFrame, newest: bool) -> dict:
        new = self._fitting(name, config, points)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        old = self._held(name, config, touched).withColumn("bucket", bucket_of(config["buckets"]))
        fresh = once(new)
        if newest:
            later = old.where("at is not null").select("id", F.col("at").alias("__at"))
            fresh = fresh.join(later, "id", "left").where("__at is null or at >= __at").drop("__at")
        made = self._put(name, config, upsert_points(old, fresh))
        release(new)
        return made

    # Index and search

    def build_index(self, name: str) -> None:
        """Lays the points of the last commit out by cells, for each named vector; takes the place of an older index.

        Pivots are spread over a sample of SAMPLE points; every point is filed, and a cell's radius is that of all of
        them. Points without the vector, or with one that has no length, are in no cell of it.
        """
        config = self._config(name)
        folder = self._file(name, f"index-{config['number']}")
        names = list(config["vectors"])
        units = F.struct(*(unit(F.col(f"vectors.`{v}`")).alias(v) for v in names)).alias("units")
        rows = materialise(self._held(name, config).select("id", units, "payload"), "units")
        total = rows.count()
        for v in names:
            mine = F.col(f"units.`{v}`")
            every = max(total, SAMPLE)
            sample = [r["u"] for r in rows.where(mine.isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) < SAMPLE)).select(mine.alias("u")).collect()]  # some SAMPLE rows
            pivots = spread(np.array(sample), max(1, min(CELLS, total // CELL_POINTS))) if sample else np.zeros((0, config["vectors"][v]))

            def file(batches: Iterator[pa.RecordBatch], v: str = v, pivots: np.ndarray = pivots) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    apart = angles(np.array(b.column("u").to_pylist()), pivots)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("units"), b.column("payload"), pa.array(apart.min(1)), pa.array(apart.argmin(1).astype(np.int32))], names=["id", "units", "payload", "angle", "cell"])

            kinds = dict(rows.dtypes)
            filed = rows.where(mine.isNotNull()).select("*", mine.alias("u")) if sample else rows.where("false").select("*", mine.alias("u"))
            laid = filed.mapInArrow(file, f"id bigint, units {kinds['units']}, payload {kinds['payload']}, angle double, cell int")
            laid.hint("rebalance", "cell").sortWithinPartitions("cell", "angle").write.partitionBy("cell").mode("overwrite").parquet(f"{folder}/{v}")
            met = self.spark.read.parquet(f"{folder}/{v}").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect() if sample else []
            self.spark.createDataFrame([(r["cell"], r["radius"], r["n"], pivots[r["cell"]].tolist()) for r in met], "cell int, radius double, n bigint, pivot array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells-{v}")
        release(rows)
        for s in self._fs.listStatus(self._path(self._file(name))):
            if s.getPath().getName().startswith("index-") and s.getPath().getName() != f"index-{config['number']}":
                self._fs.delete(s.getPath(), True)
        write_once(self.spark, f"{folder}/built", "")

    def indexed(self, name: str) -> bool:
        """Whether there is an index of the last commit."""
        return self._fs.exists(self._path(self._file(name, f"index-{self._config(name)['number']}", "built")))

    def indexed_search(self, name: str, queries: dict[str, Sequence[float]], top_k: int = 10, weights: dict[str, float] | None = None) -> tuple[DataFrame, float]:
        """The hits (id, payload, score) for a vector by each name, and the share of the collection's cells that was read.

        The score is the sum of the cosines by weight (1 where none is given, none below 0), to 6 places; points that
        lack one of the vectors have none. Cells are read in the order of their bounds, for several vectors in turn from
        each one's cells, twice as many each time. A point in no cell read so far has at most each vector's next bound,
        so the search ends when the k-th score exceeds their weighted sum: what it gives is exact, ties to the smaller id.
        """
        config = self._config(name)
        if not self.indexed(name):
            raise ValueError(f"collection {name!r} has no index of its last commit")
        weights = {v: float((weights or {}).get(v, 1.0)) for v in queries}
        if min(weights.values()) < 0:
            raise ValueError("weights must not be negative")
        folder, unread, total = self._file(name, f"index-{config['number']}"), {}, 0
        score, lengths = F.lit(0.0), []
        for v, q in queries.items():
            self._vector(config, v)
            length = math.sqrt(sum(float(x) * x for x in q))
            lengths.append(length)
            if len(q) != config["vectors"][v] or not 0 < length < math.inf:
                continue
            cells = self.spark.read.parquet(f"{folder}/cells-{v}").collect()  # CELLS rows at most
            total += sum(r["n"] for r in cells)
            u = np.array([[float(x) / length for x in q]])
            apart = angles(u, np.array([r["pivot"] for r in cells]))[0] if cells else []
            unread[v] = sorted(((math.cos(max(a - r["radius"] - 1e-9, 0.0)), r["cell"], r["n"]) for a, r in zip(apart, cells, strict=True)), reverse=True)
            score = score + F.lit(weights[v]) * clamped(dot(F.col(f"units.`{v}`"), constant(u[0].tolist())))
        best: dict[int, tuple] = {}
        read, size = 0, 1
        if len(unread) == len(queries):
            while all(unread.values()):
                for v, left in unread.items():
                    taken, unread[v] = left[:size], left[size:]
                    read += sum(n for *_, n in taken)
                    rows = self.spark.read.option("basePath", f"{folder}/{v}").parquet(*(f"{folder}/{v}/cell={c}" for _, c, _ in taken))
                    found = rows.select("id", "payload", F.round(score, PLACES).alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(top_k)
                    best |= {r["id"]: (-r["score"], r["id"], r["payload"]) for r in found.collect() if r["score"] is not None}
                best = {b[1]: b for b in sorted(best.values(), key=lambda b: b[:2])[:top_k]}
                size *= 2
                bound = sum(weights[v] * left[0][0] if left else -math.inf for v, left in unread.items())
                if len(best) == top_k and -max(b[0] for b in best.values()) > bound + 2 * 10.0**-PLACES:
                    break
        hits = [(i, payload, -s) for s, i, payload in sorted(best.values(), key=lambda b: b[:2])]
        return self.spark.createDataFrame(hits, "id bigint, payload map<string,string>, score double"), read / total if total else 0.0

    def search(self, vector: Sequence[float], top_k: int = 10, collection_name: str | None = None, vector_name: str | None = None) -> DataFrame:
        """id, payload, score of the nearest points by one vector; over the index where the last commit has one."""
        if not collection_name:
            raise ValueError("a collection name is needed")
        if self.indexed(collection_name):
            return self.indexed_search(collection_name, {vector_name or self.info(collection_name)["vector_name"]: vector}, top_k)[0]
        return cosine_top_k(self.points(collection_name, vector_name), vector, top_k).select("id", "payload", "score")

    def search_query(self, embedded_query: Sequence[float], top_k: int = 10, **options: object) -> DataFrame:
        return self.search(embedded_query, top_k, **options)
