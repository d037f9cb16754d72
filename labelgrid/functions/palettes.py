"""Colours of label sets, and images of labels as images of colours."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Red, green and blue of each class.
DYNAMIC_WORLD = {
    0: (65, 155, 223), 1: (57, 125, 73), 2: (136, 176, 83), 3: (122, 135, 198), 4: (228, 150, 53), 5: (223, 195, 90), 6: (196, 40, 27), 7: (255, 255, 255), 8: (179, 159, 225),
}
CHESAPEAKE = {
    1: (0, 97, 255), 2: (0, 168, 132), 3: (38, 115, 0), 4: (76, 230, 0), 5: (165, 245, 122), 6: (255, 170, 0), 7: (255, 0, 0), 8: (178, 178, 178), 9: (0, 0, 0),
    10: (115, 115, 0), 11: (205, 205, 102), 12: (255, 255, 115),
}
CHESAPEAKE_CVPR = {0: (0, 197, 255), 1: (38, 115, 0), 2: (163, 255, 115), 3: (255, 170, 0), 4: (156, 156, 156), 5: (0, 0, 0), 6: (178, 178, 178)}
OPEN_EARTH_MAP = {0: (128, 0, 0), 1: (0, 255, 36), 2: (148, 148, 148), 3: (255, 255, 255), 4: (34, 97, 38), 5: (0, 69, 255), 6: (75, 181, 73), 7: (222, 31, 7)}
COMMON = {0: (65, 155, 223), 1: (57, 125, 73), 2: (136, 176, 83), 3: (223, 195, 90), 4: (122, 135, 198), 5: (196, 40, 27), 6: (255, 255, 255), 7: (179, 159, 225)}
PALETTES = {"dynamic_world": DYNAMIC_WORLD, "chesapeake": CHESAPEAKE, "chesapeake_cvpr": CHESAPEAKE_CVPR, "open_earth_map": OPEN_EARTH_MAP, "common": COMMON}


def colour(label: Column, palette: dict[int, tuple[int, int, int]]) -> Column:
    """Struct (r, g, b) of a label; black for labels that the palette doesn't have, and for null."""
    rgb = lambda c: F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "rgb")])
    return functools.reduce(lambda out, k: F.when(label == k, rgb(palette[k])).otherwise(out), palette, rgb((0, 0, 0)))
