"""Tables that a job writes for itself: cut lineage, and reuse by later sessions."""

from __future__ import annotations

import functools
import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a new temporary folder; a cluster gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="labelgrid-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def materialised(df: DataFrame, at: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    at = at or f"{shared_folder(spark)}/made-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(schema).parquet(at)


def _state(spark: SparkSession, inputs: list[str]) -> str:
    """Paths, sizes and times of all files under the inputs, in order."""
    found = []
    for at in inputs:
        store, path = _path(spark, at)
        listed = store.listFiles(path, True)
        while listed.hasNext():
            f = listed.next()
            found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))


def built(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], version: str = "") -> DataFrame:
    """What build() makes of the files under inputs: read where an earlier session has made it, else made and kept.

    Found by name, version (of what build does) and the paths, sizes and times of the files, so a changed input is
    built anew. Two sessions that build the same at once both write, and one of the tables stays.
    """
    key = hashlib.sha256(f"{name}\n{version}\n{_state(spark, inputs)}".encode()).hexdigest()[:32]
    at = f"{shared_folder(spark)}/built-{re.sub('[^A-Za-z0-9_]', '_', name)}-{key}"
    store, path = _path(spark, at)
    if not store.exists(path):
        made = f"{at}-{uuid.uuid4().hex}"
        build().write.parquet(made)
        _, from_path = _path(spark, made)
        if store.exists(path) or not store.rename(from_path, path):
            store.delete(from_path, True)
    return spark.read.parquet(at)


def remove_older(spark: SparkSession, seconds: float) -> int:
    """Removes tables of materialised() and built() from the shared folder that were written longer ago; how many."""
    store, path = _path(spark, shared_folder(spark))
    n = 0
    for f in store.listStatus(path) if store.exists(path) else []:
        if re.match("(made|built)-", f.getPath().getName()) and f.getModificationTime() < 1000 * (time.time() - seconds):
            n += bool(store.delete(f.getPath(), True))
    return n


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with name: 0, 1, … without gaps in each group of keys, by order; order has to tell the rows of a group apart.

    Rows are sorted over all tasks and counted by how many of their group the parts before hold, so a group may be of any size.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kept = materialised(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    runs = kept.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    # Under other names, as null keys have to meet too.
    runs = runs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), shift)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    met = kept.join(runs, functools.reduce(Column.__and__, same, F.col("__part") == F.col("__p")))
    return met.select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))
