"""Sinks: Parquet, CSV, JSON and Markdown, and a resumable partitioned store."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    """Snappy Parquet, replaced as a whole."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partitions).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One CSV file with a header, for small reports."""
    (df.select(columns) if columns else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown_table(df: DataFrame) -> str:
    """A Markdown table of all rows of a report, which are few; `|` becomes `/`."""
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "/").replace("\n", " ")
    rows = df.collect()
    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def duration(seconds: float) -> str:
    whole = int(seconds)
    if whole < 60:
        return f"{seconds:.1f}s"
    return f"{whole // 60}m {whole % 60}s" if whole < 3600 else f"{whole // 3600}h {whole % 3600 // 60}m"


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """The number of rows and the sum of their hashes: equal rows in any order have the same."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, str(total)


class ResumableStore:
    """Results in blocks of a hash of the id, with a manifest of the finished blocks.

    The folder's name holds a digest of every parameter that changes the result and of the
    fingerprints of the `inputs`, so a run with other parameters or on other rows never takes
    over blocks. A block is finished when its manifest row, with the fingerprint of what was
    written, follows its data. What a crash left half done, and what cannot be read or has
    another fingerprint than the manifest states, is written again.
    """

    def __init__(self, spark: SparkSession, root: str, blocks: int, inputs: list[DataFrame] = (), **parameters):
        about = {"blocks": blocks, "inputs": [fingerprint(df) for df in inputs], **parameters}
        digest = hashlib.sha256(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest()[:16]
        self.spark, self.blocks, self.path = spark, blocks, f"{root}/{digest}"

    def _data(self, block: int) -> str:
        return f"{self.path}/data/block={block}"

    def _finished(self) -> set[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return set()
        stated = self.spark.read.schema("block int, rows long, total string, at timestamp").parquet(f"{self.path}/manifest").orderBy("at").collect()
        latest = {r["block"]: (r["rows"], r["total"]) for r in stated}
        return {k for k, was in latest.items() if self._written(k) == was}

    def _written(self, block: int) -> tuple[int, str] | None:
        """The fingerprint of a block's data; None of one that cannot be read."""
        try:
            return fingerprint(self.spark.read.parquet(self._data(block)))
        except (Py4JJavaError, PySparkException):
            return None

    def run(self, queries: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], after_block: Callable[[int], None] | None = None) -> DataFrame:
        """All results; `work` runs on the queries of each block that is not finished."""
        block = F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")
        finished = self._finished()
        for k in range(self.blocks):
            if k not in finished:
                work(queries.where(block == k)).write.mode("overwrite").parquet(self._data(k))
                row = self.spark.createDataFrame([(k, *self._written(k))], "block int, rows long, total string")
                row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
                if after_block:
                    after_block(k)
        return self.spark.read.parquet(f"{self.path}/data").drop("block")
