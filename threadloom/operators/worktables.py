"""Work tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Spark's setting that removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. It is set here only where it is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not conf.get("spark.master", "").startswith("local") or "cluster" in conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []


@atexit.register
def _drop_at_exit() -> None:
    """What a driver wrote for its own use goes when it ends (where its session still lives; else drop_work_tables was for that)."""
    session = SparkSession.getActiveSession()
    if _written and session is not None and session.sparkContext._jsc is not None:
        with contextlib.suppress(Py4JError, OSError):
            drop_work_tables(session)


def drop_work_tables(spark: SparkSession) -> int:
    """Delete the work tables that this driver wrote; results that still read them must be written before."""
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared work folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path, before = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the exchanges that made the table are of no further use
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table in so few files that most cores would idle (such as one file of one row group) is dealt out by its keys; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if 4 * df.rdd.getNumPartitions() <= cores else df


def global_rank(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Adds the 1-based place in a total order without gathering rows: ranges are ranked apart and shifted by what precedes them.

    `order` must tell all rows apart. Only one count for each range meets in one task.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__base")
    return dealt.join(F.broadcast(bases), "__range").withColumn(name, place).drop("__range", "__base")
