"""Tables in the folder that all executors share: written once, read many times.

A written table cuts lineage and survives lost executors. ``tidy`` deletes what a function wrote on
its way, also when it fails.
"""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = getattr(spark, "_quillon_shared", None)
    if path is None:
        path = spark._quillon_shared = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """What writes in it shuffle is deleted as each write ends, not when the driver's memory happens to be cleared."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with no_shuffle_left(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    if made := getattr(_open, "made", None):
        made[-1].append(out)
    return out


def is_stored(df: DataFrame) -> bool:
    """Whether df is a written table as it was read back."""
    return bool(getattr(df, "_quillon_path", None) or getattr(df, "_quillon_stored", False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df itself if it is a written table as it was read back, else written as one."""
    return df if is_stored(df) else materialize(df, name)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders batch=N under path that are wholly written."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(f.getName()[6:]) for f in found if f.getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def release(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that no later step reads."""
    for df in tables:
        path = getattr(df, "_quillon_path", None)
        if path:
            df._quillon_path = None
            fs, p = hadoop_path(df.sparkSession, path)
            fs.delete(p, True)


def tidy(name: str) -> Callable:
    """Of a function that returns a DataFrame: its result is written, and all else that it wrote is deleted."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(*args, **options):
            stack = _open.made = getattr(_open, "made", None) or []
            stack.append([])
            out = None
            try:
                out = stored(f(*args, **options), name)
            finally:
                release(*[t for t in stack.pop() if t is not out])
            if stack:
                stack[-1].append(out)  # the caller's to keep or to delete
            return out

        return run

    return wrap
