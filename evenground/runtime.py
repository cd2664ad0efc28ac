"""Session helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for stored tables: the one the cluster names in spark.checkpoint.dir; with a local master else a temporary one.

    On a cluster without that setting it is an error: a folder of one machine would be lost to the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, store as a Parquet table in the shared folder, cut the lineage; survives lost executors.

    Tables lie in a folder of the application, which goes when the driver ends; ``release`` deletes one earlier.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


#: Rows of a stored table that a join may broadcast at most.
FEW_ROWS = 20_000


def stored(df: DataFrame) -> DataFrame:
    """``materialize``, for a table that joins follow: one of many rows is never broadcast.

    Spark takes a stored table for as large as its files, and millions of rows of few different values lie in files of a few MB: a broadcast
    would gather them on the driver.
    """
    kept = materialize(df)
    few = kept.count() <= FEW_ROWS
    hinted = kept if few else kept.hint("merge")
    hinted.stored_at, hinted.few = kept.stored_at, few
    return hinted


def lean(df: DataFrame, stored_as: DataFrame) -> DataFrame:
    """``df``, of a few narrow rows per row of ``stored_as``, for a join: broadcast if that is a stored table of few rows.

    Rows of the other side then stay where they are, however many of them have one key.
    """
    return F.broadcast(df) if getattr(stored_as, "few", False) else df


def release(*tables: DataFrame) -> None:
    """Delete tables from ``materialize`` that nothing reads any more."""
    for df in tables:
        system, path = _path(df.sparkSession, df.stored_at)
        system.delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of a small file is given.
ROWS_PER_TASK = 20_000


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``read_table`` with its rows dealt to all cores: a file of few bytes is one task's, however many rows it holds and whatever grows from them."""
    table = read_table(spark, sf_dir, name)
    rows, cores = table.count(), spark.sparkContext.defaultParallelism
    if rows <= ROWS_PER_TASK // 4 or table.rdd.getNumPartitions() >= 4 * cores:
        return table
    return table.repartition(max(cores, -(-rows // ROWS_PER_TASK)))


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet; it goes when the driver ends."""
    home = f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}"
    system, folder = _path(spark, home)
    if not system.exists(folder):
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return f"{home}/{uuid.uuid4().hex}"
