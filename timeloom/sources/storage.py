"""Tables that Spark derives and keeps: in the folder that driver and executors share, so they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only where it is unset and driver and executors are one process, a fresh local folder takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_here = threading.local()  # the scopes that this thread is in


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables and folders made inside go when it ends. A result must be written before: under a path taken outside, or elsewhere."""
    open_ = _here.__dict__.setdefault("scopes", [])
    open_.append([])
    try:
        yield
    finally:
        for path in open_.pop():
            fs, found = _hadoop(spark, path)
            fs.delete(found, True)


@contextmanager
def _no_scope() -> Iterator[None]:
    """For tables that a session keeps."""
    held, _here.scopes = _here.__dict__.get("scopes", []), []
    try:
        yield
    finally:
        _here.scopes = held


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _here.__dict__.get("scopes"):
        _here.scopes[-1].append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _hadoop(spark, path)
    return fs.exists(found)


def clustered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt in ranges of the order and sorted, so that statistics of files, row groups and pages tell ranges apart."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


#: settings of a write: shuffle files go when its table is written; code too long for HotSpot to compile is generated in shorter methods
_WRITES = {_CLEAN: "true", "spark.sql.codegen.hugeMethodLimit": "8000"}
_writing: dict[int, list] = {}  # session -> [writes under way, its own settings]
_lock = threading.Lock()


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Writes have settings of their own; the session's return after the last of the writes under way."""
    with _lock:
        state = _writing.setdefault(id(spark), [0, {k: spark.conf.get(k) for k in _WRITES}])
        state[0] += 1
        for k, v in _WRITES.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                for k, v in _writing.pop(id(spark))[1].items():
                    spark.conf.set(k, v)


def stored(df: DataFrame, name: str, ids: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder (or to path) and reads it back. ids: columns that are looked up by value get bloom filters."""
    spark = df.sparkSession
    path = path or table_path(spark, name)
    with _cleaned(spark):
        writer = df.write.option("compression", "zstd")
        for c in ids:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.option("parquet.page.row.count.limit", 5000).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def rename_part(spark: SparkSession, folder: str, path: str) -> None:
    """Gives the only part of a folder a name of its own and removes the folder."""
    fs, source = _hadoop(spark, folder)
    part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    fs.rename(part, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(source, True)


def discard(*frames: DataFrame) -> None:
    """Removes stored tables that no frame still to be computed reads."""
    for df in frames:
        fs, path = _hadoop(df.sparkSession, df.stored_at)
        fs.delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt to all of them; larger tables stay as they are."""
    few = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(few) if df.rdd.getNumPartitions() < few else df


_derived: dict[tuple, str] = {}


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    fs, found = _hadoop(spark, path)
    return fs.getContentSummary(found).getLength()


def derived(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], order: list[str] | None = None, ids: tuple[str, ...] = ()) -> DataFrame:
    """A table derived from the file or folder `source`, written once in a session and read from then on, as long as the source stays as it is.

    order: columns by which it is clustered; ids: columns with bloom filters.
    """
    fs, path = _hadoop(spark, source)
    status = fs.getFileStatus(path)
    key = (spark.sparkContext.applicationId, source, name, status.getModificationTime(), fs.getContentSummary(path).getLength())
    if key not in _derived or not exists(spark, _derived[key]):
        with _no_scope():
            _derived[key] = stored(clustered(make(), order) if order else make(), name, ids).stored_at
    return spark.read.parquet(_derived[key])


def derived_folder(spark: SparkSession, source: str, name: str, make: Callable[[str], None]) -> str:
    """As `derived`, for what is more than one table: make writes into the folder it is given."""
    fs, path = _hadoop(spark, source)
    status = fs.getFileStatus(path)
    key = (spark.sparkContext.applicationId, source, name, status.getModificationTime(), fs.getContentSummary(path).getLength())
    if key not in _derived or not exists(spark, _derived[key]):
        with _no_scope():
            folder = table_path(spark, name)
            make(folder)
        _derived[key] = folder
    return _derived[key]
