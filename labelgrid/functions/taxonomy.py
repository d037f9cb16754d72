"""Label taxonomies: fixed class indices and the maps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE = -1
SKY = 255

# Class names and indices of the label sets.
COMMON = {"water": 0, "trees": 1, "low_vegetation": 2, "built": 3, "ground": 4, "sky": 5, "dont_care": -1}
MORE_COMMON = {"water": 0, "trees": 1, "low_vegetation": 1, "built": 2, "ground": 3, "sky": 4, "dont_care": -1}
MOST_COMMON = {"water": 0, "trees": 1, "low_vegetation": 1, "built": 1, "ground": 1, "sky": 2, "dont_care": -1}
DYNAMIC_WORLD = {
    0: "water", 1: "trees", 2: "grass", 3: "flooded_vegetation", 4: "crops", 5: "shrub_and_scrub", 6: "built", 7: "bare",
    8: "snow_and_ice", 255: "sky",
}
DYNAMIC_WORLD_TO_COMMON = {
    "water": "water", "trees": "trees", "grass": "low_vegetation", "flooded_vegetation": "low_vegetation",
    "crops": "low_vegetation", "shrub_and_scrub": "low_vegetation", "built": "built", "bare": "ground",
    "snow_and_ice": "dont_care", "sky": "sky",
}
CHESAPEAKE = {
    0: "water", 1: "tree_canopy_and_shrubs", 2: "low_vegetation", 3: "barren", 4: "impervious_surfaces", 5: "impervious_roads",
    6: "aberdeen_proving_ground", 255: "sky",
}
CHESAPEAKE_TO_COMMON = {
    "water": "water", "tree_canopy_and_shrubs": "trees", "low_vegetation": "low_vegetation", "barren": "ground",
    "impervious_surfaces": "built", "impervious_roads": "built", "aberdeen_proving_ground": "dont_care", "sky": "sky",
}
OPEN_EARTH_MAP = {
    0: "Bareland", 1: "Grass", 2: "Pavement", 3: "Road", 4: "Tree", 5: "Water", 6: "Cropland", 7: "buildings", 255: "sky",
}
OPEN_EARTH_MAP_TO_COMMON = {
    "Bareland": "ground", "Grass": "low_vegetation", "Pavement": "built", "Road": "built", "Tree": "trees", "Water": "water",
    "Cropland": "low_vegetation", "buildings": "built", "sky": "sky",
}
GROUND_TRUTH = {
    0: "bare_ground", 1: "rocky_terrain", 2: "developed_structures", 3: "road", 4: "shrubs", 5: "trees", 6: "sky", 7: "water",
    8: "vehicles", 9: "person",
}
GROUND_TRUTH_TO_COMMON = {
    "bare_ground": "ground", "rocky_terrain": "ground", "developed_structures": "built", "road": "built",
    "shrubs": "low_vegetation", "trees": "trees", "sky": "sky", "water": "water", "vehicles": "dont_care", "person": "dont_care",
}
DYNAMIC_WORLD_TO_SATELLITE = {0: 0, 1: 1, 2: 2, 3: 4, 4: 2, 5: 3, 6: 5, 7: 6, 8: -1}
CHESAPEAKE_12_TO_SATELLITE = {1: 0, 2: 4, 3: 1, 4: 3, 5: 2, 6: 6, 7: 5, 8: 5, 9: 5, 10: 1, 11: 1, 12: 1}
N_SATELLITE = 7


def index_map(names: dict[int, str], renamed: dict[str, str], target: dict[str, int]) -> dict[int, int]:
    """Old index to new, through both names; every old name has to have a new one."""
    missing = sorted(set(names.values()) - set(renamed))
    if missing:
        raise ValueError(f"no new name for {missing}")
    return {i: target[renamed[n]] for i, n in names.items()}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def map_table(spark: SparkSession, pairs: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(pairs.items()), "src int, dst int")


def remap(label: Column, pairs: dict[int, int]) -> Column:
    """New index; null for labels without one."""
    return F.element_at(literal_map(pairs), label.cast("int"))


def remap_keeping(label: Column, pairs: dict[int, int]) -> Column:
    """New index; labels without one stay."""
    return F.coalesce(remap(label, pairs), label.cast("int"))


def remap_strict(label: Column, pairs: dict[int, int]) -> Column:
    """New index as stored in unsigned bytes (ignore: 255); a label without one is an error."""
    new = remap(label, pairs)
    return F.when(new.isNull() & label.isNotNull(), F.raise_error(F.concat(F.lit("unmapped label "), label.cast("string"))).cast("int")).otherwise(
        F.when(new == IGNORE, F.lit(SKY)).otherwise(new)
    )


def missing_indices(produced: DataFrame, index_col: str) -> DataFrame:
    """Indices from 0 to the largest produced that no row has."""
    top = produced.agg(F.max(index_col).alias("top"))
    wanted = top.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias(index_col))
    return wanted.join(produced.select(index_col).distinct(), index_col, "left_anti")


def names_by_index(target: dict[str, int], spark: SparkSession) -> DataFrame:
    """(idx, names): names that share an index, sorted and joined by a comma; the ignored index is left out."""
    rows = spark.createDataFrame(list(target.items()), "name string, idx int")
    return rows.where(F.col("idx") >= 0).groupBy("idx").agg(
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names")
    )
