"""Text, CSV and JSON sources and sinks of label-map experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

RUN_DIMENSIONS = ["label_set", "seg_method", "lulc_type", "d3_type", "res", "refine_type", "dataset", "trajectory"]
JITTER_DIMENSIONS = ["label_set", "seg_method", "lulc_type", "gps_alt_imu", "d3_type", "res", "refine_type", "dataset", "trajectory"]
MODEL_DIMENSIONS = ["label_set", "seg_method", "dataset", "trajectory"]
IMAGE_GLOB = "*.{tif,tiff,TIF,TIFF}"


def read_metrics(spark: SparkSession, root: str, dimensions: list[str]) -> DataFrame:
    """One row per metrics.txt under root: dimensions from its path, miou and the class lines."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metrics.txt").select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    return files.select(*text.dimensions(F.col("path"), dimensions), text.last_value(F.col("value")).alias("miou"), class_lines(F.col("value")).alias("classes"))


def class_lines(metrics: Column) -> Column:
    """Array of (names, iou) of all lines but the last."""
    lines = F.split(F.btrim(metrics, F.lit(" \r\n")), "\n")
    return F.transform(
        F.slice(lines, 1, F.size(lines) - 1),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("names"), F.trim(F.substring_index(x, ":", -1)).try_cast("double").alias("iou")),
    )


def metrics_text(ious: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): the metrics file of each key, from rows (keys, idx, names, iou)."""
    line = F.concat(F.col("names"), F.lit(": "), F.col("iou").cast("string"))
    return ious.groupBy(*keys).agg(
        F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))).getField("l"), F.concat(F.lit("mIoU: "), F.avg("iou").cast("string"))).alias("value")
    )


def read_headed_csv(spark: SparkSession, path: str, mark: str, columns: list[str]) -> DataFrame:
    """Rows of each file after its first line that contains mark, under columns; cells trimmed, and quoted ones may hold commas.

    Every file has a header of its own; one without is an error when it is read. A file is read by as many tasks as its size asks for:
    a first pass keeps no more than where each file's header is. Empty and missing cells are null; a cell ends with its line.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    headers = lines.groupBy("file").agg(F.min(F.when(F.col("value").contains(mark), F.col("place"))).alias("header"))
    missing = F.raise_error(F.concat(F.lit(f"no line with {mark!r} in "), F.col("file"))).cast("boolean")
    after = F.when(F.col("header").isNull(), missing).otherwise(F.col("place") > F.col("header"))
    names = ", ".join(f"`{c}` string" for c in columns)
    cells = F.from_csv("value", names, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"})
    return lines.join(headers, "file").where(after & (F.trim("value") != "")).select(cells.alias("c")).select(*[F.col("c").getField(c).alias(c) for c in columns])


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(file, gt, pred, n) of the cells that aren't zero of the square matrices in .npy files under path."""

    def cells(batches):
        import io

        import numpy as np
        import pandas as pd

        for files in batches:
            for file, raw in zip(files["path"], files["content"]):
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                gt, pred = np.nonzero(m)
                yield pd.DataFrame({"file": file, "gt": gt.astype("int32"), "pred": pred.astype("int32"), "n": m[gt, pred].astype("int64")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(cells, "file string, gt int, pred int, n long")


def matrix_files(cm: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, content): each key's k by k matrix of (gt, pred, n) as the bytes of a .npy file. A group has k * k cells at most."""
    import pandas as pd

    kinds = ", ".join(f"`{c}` {cm.schema[c].dataType.simpleString()}" for c in keys)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        import io

        import numpy as np

        m, out = np.zeros((k, k), np.int64), io.BytesIO()
        np.add.at(m, (t["gt"].to_numpy(), t["pred"].to_numpy()), t["n"].to_numpy())
        np.save(out, m)
        return t[keys].head(1).assign(content=out.getvalue())

    return cm.groupBy(*keys).applyInPandas(one, f"{kinds}, content binary")


def header_columns(line: str) -> list[str]:
    """Column names of a header line: no spaces at all."""
    return [c.replace(" ", "") for c in line.split(",")]


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.withColumnsRenamed(names)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="img_path string, label_path string")


def write_manifest(pairs: DataFrame, path: str) -> None:
    pairs.select("img_path", "label_path").write.mode("ignore").csv(path)


def read_spaced(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=schema)


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark.read.text(path))


def listed(lines: DataFrame) -> DataFrame:
    """image: the different names that lines (value) hold, one a line."""
    return lines.select(F.trim("value").alias("image")).where("image <> ''").distinct()


def first_polygon(geojson: Column) -> Column:
    """Outer ring of the first feature: array of [x, y]."""
    shape = "struct<features: array<struct<geometry: struct<coordinates: array<array<array<double>>>>>>>"
    return F.get(F.get(F.from_json(geojson, shape)["features"], F.lit(0))["geometry"]["coordinates"], F.lit(0))


def catalogue(items: DataFrame, start: str, end: str, gsd: float | None = None) -> DataFrame:
    """Items (id, ts, gsd, href) with start <= ts < end, newest first."""
    kept = items.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    return (kept if gsd is None else kept.where(F.col("gsd") == gsd)).orderBy(F.desc("ts"), "id")


def parse_logs(logs: DataFrame, marks: dict[str, str]) -> DataFrame:
    """(file, a column for each mark): the number in the last line that contains the mark; null where none does.

    logs has rows (file, n, line).
    """
    return logs.groupBy("file").agg(
        *[F.max_by(text.number_in(F.substring_index("line", ":", -1)).try_cast("double"), F.when(F.col("line").contains(m), F.col("n"))).alias(c) for c, m in marks.items()]
    )


def latex_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The table's rows as LaTeX, one a line."""
    return rows.select(F.concat(F.concat_ws(" & ", *[F.coalesce(F.col(c).cast("string"), F.lit("---")) for c in columns]), F.lit(r" \\")).alias("latex"))


def read_trials(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Trials of a parameter study from a database; the connection comes from the caller."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def _unavailable(what: str):
    def read(*_, **__):
        raise NotImplementedError(f"{what} needs a network or weights that this library does not bring")

    return read


download = _unavailable("downloading")
run_network = _unavailable("network inference without a model brought along (plans.inference)")
