"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator between words in every contract of this subpackage.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, in rows and in bytes, for this session.

    The plan reads the settings when it runs, so they cannot be put back once it is built.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a new temporary folder; a cluster gets an error, since
    executors could not see one of the driver's.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="labelgrid-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text (runs of anything but ASCII white space); null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(
        F.split(body, WHITE_CLASS + "+")
    )


def bind(value: Column, use) -> Column:
    """use(value), with value computed once for each row although use() names it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name, taken = f"__{stem}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_name(df: DataFrame, stem: str) -> str:
    """stem as the name of a column to add to df, or a free form of it if df has one of that name."""
    return free_name(df, stem) if stem.lower() in {c.lower() for c in df.columns} else stem


def in_groups(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of texts of at most `most` characters together, or of one longer text."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group
