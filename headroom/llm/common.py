"""What all operators of this subpackage share: the shared folder, written tables, component labels."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once a session: no machine but the driver's need have it, nor be started with it on its path."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    path = f"{tempfile.mkdtemp(prefix='headroom-')}/headroom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "headroom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session that has none, as in tests, gets a temporary one."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        there = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes the files of a `written` table that nothing reads any more."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session; the cluster sizes them to its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def held_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of `links(a, b)` with the smallest node it reaches.

    Large-star / small-star contraction, one aggregation each per round; every round is
    a written table in the shared folder, so that a lost executor costs a task, not the
    history. The rows never exceed the links, and a hub of any degree is an ordinary
    aggregation key: minima are combined before the shuffle and the join that deals
    them out is one that Spark splits when skewed.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour of a node, and the node, is tied to the smallest one
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = written(small, "links")
        discard(edges)
        deep = after.alias("p").join(after.alias("q"), F.col("p.v") == F.col("q.u"), "left_semi").limit(1).count()
        split = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        edges = after
        if not deep and not split:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
