"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_name, own_name, table, written


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. Names identify nodes in the draws, so a node keeps its draws when others change."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(n: int, regions: int = 2, racks: int = 2) -> list[Shard]:
    """n shards of weight one, dealt to regions and racks in runs."""
    per_region = -(-n // regions)
    per_rack = -(-per_region // racks)
    return [
        Shard(f"region{i // per_region}", f"rack{i % per_region // per_rack}", i) for i in range(n)
    ]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own.

    Only the root gains weight elsewhere, so the draws inside every old region stay as they are
    and each row either stays or moves to the new shard.
    """
    new = max((s.shard for s in tree), default=-1) + 1
    return [*tree, Shard(f"region-of-{new}", "rack0", new, weight)]


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """Exponential variate with rate weight, made of key and node: the least of several wins by weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, node), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def _pick(key: Column, children: Column) -> Column:
    """Name of the child of least draw among children, an array of (name, weight); ties go to the smaller name."""
    drawn = F.transform(
        children, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"))
    )
    return F.array_min(drawn)["name"]


def _children(totals: dict[str, float]) -> Column:
    return F.array(
        *[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("weight")) for k, v in totals.items()]
    )


def place(key: Column, tree: list[Shard]) -> Column:
    """Struct (region, rack, shard) for each key. Nodes of weight zero or less get no rows."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard of positive weight")
    levels: list[dict[str, dict[str, float]]] = [{"": {}}, {}, {}]
    for s in live:
        region, rack = s.region, f"{s.region}/{s.rack}"
        for level, parent, child in ((0, "", region), (1, region, rack), (2, rack, f"{rack}/{s.shard}")):
            under = levels[level].setdefault(parent, {})
            under[child] = under.get(child, 0.0) + s.weight

    def down(level: int, parent: Column | None) -> Column:
        if parent is None:
            return _pick(key, _children(levels[level][""]))
        by = F.create_map(
            *[x for p, c in levels[level].items() for x in (F.lit(p), _children(c))]
        )
        return _pick(key, F.element_at(by, parent))

    region = down(0, None)
    return F.element_at(
        F.transform(
            F.array(region),
            lambda r: F.element_at(
                F.transform(
                    F.array(down(1, r)),
                    lambda k: F.struct(
                        r.alias("region"),
                        k.alias("rack"),
                        F.element_at(F.split(down(2, k), "/"), -1).cast("int").alias("shard"),
                    ),
                ),
                1,
            ),
        ),
        1,
    )


def assign_shards(df: DataFrame, key: str, tree: list[Shard], keep: list[Column]) -> DataFrame:
    """keep columns plus region, rack, shard, grown_shard and a gapless slot in each shard.

    Slots count rows in the order of the input's partitions: rows of one (input partition, shard)
    are numbered by themselves and shifted by the rows of earlier partitions, so no task gathers
    a shard and equal keys cannot pile up. Null keys are a key like any other; repeated rows get
    the same shard and slots of their own; an empty table gives no rows; extra columns of df are
    carried only if named in keep. A kept column that is called like an added one stays as it is,
    and the added one gets a free name (common.own_name: `__slot` beside a kept `slot`).
    """
    at, grown = place(F.col(key), tree), place(F.col(key), grow(tree))
    kept = df.select(*keep)
    part, row, start, i = (free_name(kept, stem) for stem in ("part_of_input", "row_of_input", "start_of_part", "i"))
    region, rack, shard, grown_shard, slot = (own_name(kept, stem) for stem in ("region", "rack", "shard", "grown_shard", "slot"))
    spot = free_name(kept, "spot")
    narrow = written(
        df.select(
            *keep,
            at.alias(spot),
            grown["shard"].alias(grown_shard),
            F.spark_partition_id().alias(part),
            F.monotonically_increasing_id().alias(row),
        ).select("*", *[F.col(spot)[c].alias(n) for c, n in (("region", region), ("rack", rack), ("shard", shard))]).drop(spot)
    )
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        narrow.groupBy(shard, part)
        .agg(F.count(F.lit(1)).alias(i))
        .select(shard, part, F.coalesce(F.sum(i).over(before), F.lit(0)).alias(start))
    )
    within = Window.partitionBy(part, shard).orderBy(row)
    return (
        narrow.withColumn(i, F.row_number().over(within))
        .join(starts, [part, shard])
        .withColumn(slot, (F.col(start) + F.col(i) - 1).cast("long"))
        .select(*kept.columns, region, rack, shard, grown_shard, slot)
    )


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law `key`, and in the tree grown by a shard.

    A null text has size 1 and the CRC-32 of an empty text; a null doc_id is a key like any other;
    repeated rows have one shard and slots of their own; no rows give none.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = assign_shards(
        docs,
        "doc_id",
        even_tree(8),
        [
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
        ],
    )
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast(T.IntegerType()).alias("shard"),
        "slot", F.col("grown_shard").cast(T.IntegerType()).alias("grown_shard"), "region", "rack",
    )
