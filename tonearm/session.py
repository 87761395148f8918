"""Session settings, the shared working folder and the size check behind every broadcast."""

from __future__ import annotations

import functools
import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# A side is sent to every task only when a count proves it is at most this many cells
# (rows x vector width); at 8 bytes each that is 16 MB.
BROADCAST_CELLS = 2_000_000


def local_session(app: str, cores: str = "8", memory: str = "20g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", os.path.join(_local_root(), "warehouse"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for an application.

    Needed where it is not installed and the workers do not share the driver's import path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tonearm-"), "tonearm.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)  # Spark serves the file to the executors
    # the driver itself goes on with the files it has imported
    sys.path[:] = [p for p in sys.path if not p.endswith("tonearm.zip")]
    _SHIPPED.add(context.applicationId)


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tonearm-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the place all executors can read.

    Only a local master may go without that setting; there a temporary folder is as good.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = _local_root()
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for work bound by CPU rather than bytes."""
    return max(spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))
