"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(name: str = "lexmill", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEXMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the star-schema tables; only Spark's reader touches the path."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


#: Tables whose rows are long texts, which are costly to work on.
TEXTS = ("documents", "conversations", "pages")


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt to all cores where its scan has fewer tasks than there are cores, as with one small file.
    A large table is left as it is: its scan has tasks enough, and a shuffle would only cost."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The session's setting wins; a temporary folder is only used
    where none is set and driver and executors are one process, as in tests on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut, it is computed once, a lost executor costs
    nothing, and later plans start without the constraints and sizes guessed for the old one."""
    return _cut(df, _scope.get())


def _cut(df: DataFrame, owner: list[tuple[SparkSession, str]]) -> DataFrame:
    spark = df.sparkSession
    path = _new_path(spark, "cut")
    owner.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []
#: The list of what is written now; each thread starts with the common one.
_scope: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("_scope", default=_written)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What cut() writes inside is deleted at the end; what is yielded is a cut() whose table stays."""
    outer, own = _scope.get(), []
    token = _scope.set(own)
    try:
        yield lambda df: _cut(df, outer)
    finally:
        _scope.reset(token)
        _delete(own)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def release() -> None:
    """Deletes all that was written below the shared folder; what was made of it must be consumed by then."""
    _delete(_written)


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lexmill/{name}-{uuid.uuid4().hex}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted as cut()'s tables are."""
    path = _new_path(spark, name)
    _scope.get().append((spark, path))
    return path
