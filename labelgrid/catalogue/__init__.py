"""Queries that apply the library to the driver's tables. Importing this registers them."""

from . import bands, blocks, files, label_metrics, more, places, rasters, reports, views  # noqa: F401
