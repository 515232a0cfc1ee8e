"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that setting is absent, a temporary folder of this machine if the session runs on it
    alone (tests), and an error on a cluster, whose machines would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_asked: dict[int, list] = {}  # by session: its own setting, and what is asked for at present
_lock = Lock()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, plans that run hand over at most so many rows to Python at a time. Of several
    threads that ask at once the least number holds; the session's own returns with the last."""

    def settle(asked: list) -> None:
        spark.conf.set(_BATCH_ROWS, str(min(asked[1:])) if asked[1:] else asked[0])

    name = id(spark._jsparkSession)
    with _lock:
        asked = _asked.setdefault(name, [spark.conf.get(_BATCH_ROWS)])
        asked.append(rows)
        settle(asked)
    try:
        yield
    finally:
        with _lock:
            asked.remove(rows)
            settle(asked)
            if not asked[1:]:
                del _asked[name]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        where = hadoop(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def stored(df: DataFrame, name: str, batch_rows: int | None = None, into: list[str] | None = None) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: lineage ends here.

    `batch_rows` bounds what Python gets at once, for plans whose rows are large. The folder's
    path is added to `into`, for `discard` when the table has served."""
    path = scratch(df.sparkSession, name)
    if into is not None:
        into.append(path)
    with batches_of(df.sparkSession, batch_rows) if batch_rows else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
