"""Plan cuts: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Tables that lazy results may still read; those that nobody released go when the driver ends.
_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _made[:]:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # Spark may be gone by now
                release(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session in local mode that has none gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cohortloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has; what is there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written and read again, with its path."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made[:] = [m for m in _made if m[1] != path]


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with its rows' places from 0 in an order, as name: a distributed sort, counts of its partitions, and places within those."""
    sort = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    rows, _ = materialize(sort, "sorted")
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("__first"))  # a row a partition
    before = sizes.select("__part", "__first", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place") - F.col("__first")).drop("__part", "__place", "__first", "__before")
