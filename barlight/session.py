"""Session settings, shipping of this package to the executors, tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, tempfile.TemporaryDirectory] = {}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make the session ready for Python in tasks: this package as a zip, and small Arrow batches.

    Both once per application; batches are bounded to 16 MB where the session holds Spark's
    default of 64 MB. The zip goes when the driver's Python ends.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    folder = tempfile.TemporaryDirectory(prefix="barlight-")
    name = f"{folder.name}/{root.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(name)
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":
        spark.conf.set(BATCH_BYTES, "16m")
    _shipped[sc.applicationId] = folder


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it goes when the driver's JVM ends.

    The cluster names the folder in spark.checkpoint.dir. Where that is unset, a temporary folder
    is taken for local masters only, and set as checkpoint folder; elsewhere this is an error,
    as each machine would write to its own disk.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, place = _filesystem(spark, path)
    fs.deleteOnExit(place)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared_dir that no table to come reads any more."""
    fs, place = _filesystem(spark, path)
    fs.delete(place, True)


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads survive lost executors."""
    return written_at(df, name, **options)[0]


def written_at(df: DataFrame, name: str, **options: object) -> tuple[DataFrame, str]:
    """As written, and the table's path, by which `removed` can drop it."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
