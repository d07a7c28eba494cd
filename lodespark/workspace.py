"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder serves in local mode (tests); on a cluster
    that is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    shared_dir.own = tempfile.mkdtemp(prefix="lodespark-")
    atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return shared_dir.own


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


#: Whether Spark removes the shuffle files of a statement at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of tables made by :func:`materialize` within :func:`temporary_tables`, innermost last; each thread has its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("lodespark-tables", default=())
_lock = threading.Lock()
_writers: dict[int, list] = {}


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """The option CLEANUP, which belongs to the session, stays on from the first of several writers to the last."""
    key = id(spark)
    with _lock:
        state = _writers.setdefault(key, [0, None])
        if not state[0]:
            state[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                del _writers[key]
                spark.conf.set(CLEANUP, state[1]) if state[1] is not None else spark.conf.unset(CLEANUP)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    a lost executor costs only a reread. The shuffle files of the write are removed once
    it is done, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodespark/{name}-{uuid.uuid4().hex}"
    for tables in _open.get()[-1:]:
        tables.append(path)
    with _cleaned_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def kept_tables() -> Iterator[None]:
    """Tables made within outlive a block of :func:`temporary_tables` around it that they are made in."""
    before = _open.set((*_open.get(), []))
    try:
        yield
    finally:
        _open.reset(before)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread makes within, at the end."""
    tables: list[str] = []
    before = _open.set((*_open.get(), tables))
    try:
        yield
    finally:
        _open.reset(before)
        for path in tables:
            delete(spark, path)
