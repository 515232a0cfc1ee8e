"""Session settings: memory, spill folder, partitions, adaptive execution."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, *, memory: str | None = None, spill_dir: str | None = None,
            partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC times; None leaves a setting to the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for name, value in {"spark.driver.memory": memory, "spark.local.dir": spill_dir, "spark.sql.shuffle.partitions": partitions, **settings}.items():
        if value is not None:
            builder = builder.config(name, str(value))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once a session, for Python workers that lack it."""
    context = spark.sparkContext
    if not getattr(context, "_tessera_shipped", False):
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tessera-")  # the driver's own copy, which Spark hands on
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder, "tessera.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._tessera_shipped = True
    return spark
