"""Tables written between the rounds of an iteration."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_LEFT: list[tuple[SparkSession, str]] = []
_OPEN = threading.local()


def _blocks() -> list[list[str]]:
    """The blocks that this thread has open."""
    if not hasattr(_OPEN, "blocks"):
        _OPEN.blocks = []
    return _OPEN.blocks


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one where it is unset and Spark is local, as in
    tests. On a cluster without it executors would write to their own disks, so that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _delete_left() -> None:
    """Deletes what no block owned, if the session still runs."""
    for spark, path in _LEFT:
        if spark.sparkContext._jsc is not None:
            _delete(spark, [path])


def stored(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """df written to the scratch folder and read again: lineage ends there, and lost executors cost nothing before it.

    The table is deleted at the end of the `rounds` block around it or, if it outlives that, of the next block outward.
    Results that a caller still reads lie outside all blocks of the library, so a job that wants them gone before the
    session ends opens a block of its own around building and reading a query.
    """
    path = scratch_path(df.sparkSession, label)
    blocks = _blocks()
    owners = blocks[: len(blocks) - outlives]
    if owners:
        owners[-1].append(path)
    else:
        _LEFT.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rounds(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that `stored` wrote inside, also half-written ones, when the block ends, with an error or not."""
    blocks = _blocks()
    blocks.append([])
    try:
        yield
    finally:
        _delete(spark, blocks.pop())
