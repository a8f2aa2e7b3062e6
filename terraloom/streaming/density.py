"""Density maps of streams: additive blends commute, so late and unordered rows need no watermark; windows take one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import box_cells, cell_of


def point_density(stream: DataFrame, x: str, y: str, sx: float, sy: float) -> DataFrame:
    """(gx, gy, n), to be written in update or complete mode."""
    return stream.groupBy(cell_of(F.col(x), sx).alias("gx"), cell_of(F.col(y), sy).alias("gy")).agg(F.count(F.lit(1)).alias("n"))


def box_density(stream: DataFrame, box: str, sx: float, sy: float) -> DataFrame:
    return box_cells(stream, F.col(box), sx, sy).groupBy("gx", "gy").agg(F.sum("ratio").alias("value"))


def windowed_density(stream: DataFrame, ts: str, x: str, sx: float, window: str, late: str) -> DataFrame:
    """(start, gx, n) by windows of time; rows later than `late` are dropped, as a watermark does."""
    w = F.window(ts, window)
    out = stream.withWatermark(ts, late).groupBy(w, cell_of(F.col(x), sx).alias("gx")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "gx", "n")
