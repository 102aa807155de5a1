"""Tables and the shared folder: reading by paths that Spark reaches, and intermediate tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Paths that this driver wrote, by the scope they belong to; the last scope is the innermost.
_scopes: list[list[str]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, by a path that only Spark needs to reach."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one on a single machine, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A fresh path in the shared folder, deleted with its scope (`outer`: with the scope around the present one)."""
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if not any(_scopes):
        atexit.register(remove_tables, spark)
    _scopes[max(-len(_scopes), -2) if outer else -1].append(path)
    return path


def materialise(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: cuts the lineage and survives lost executors.

    Later readers scan the files, so nothing upstream runs twice and values that depend on scan order stay fixed. The
    files go with the scope they were written in, at the latest when the driver's interpreter ends.
    """
    path = new_path(df.sparkSession, name, outer)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._tidemark_path = path
    return made


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written within it goes to Python in Arrow batches of at most so many rows: for rows that hold megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file aside and gives it its name by a rename that never replaces; FileExistsError if there is one of that name.

    Of several writers that want one name one succeeds, and readers see the file whole or not at all.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside, target = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    qualified = fs.makeQualified(target)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(fs.makeQualified(aside), qualified, options)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        raise FileExistsError(path) from e


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    with suppress(Py4JError):  # at the interpreter's end the JVM may be gone first
        while paths:
            where = jvm.org.apache.hadoop.fs.Path(paths.pop())
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*made: DataFrame) -> None:
    """Deletes tables that materialise gave, once nothing reads them any more."""
    for df in made:
        path = getattr(df, "_tidemark_path", None)
        for scope in _scopes:
            if path in scope:
                scope.remove(path)
                _delete(df.sparkSession, [path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope: tables written within it go at its end, but for those written as `outer`."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def remove_tables(spark: SparkSession) -> None:
    """Deletes the tables that this driver wrote; results that still read them must have been taken before."""
    for scope in _scopes:
        _delete(spark, scope)
