"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once a session."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    path = f"{tempfile.mkdtemp(prefix='headroom-')}/headroom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "headroom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session that has none, as in tests, gets a temporary folder."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        there = sc.getCheckpointDir()
    return there


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table: computed once, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder where Spark writes, if it is there."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def made(spark: SparkSession, path: str) -> None:
    """Makes a folder where Spark writes, if it is not there."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(at)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of `written` tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._written)
