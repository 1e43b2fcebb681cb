"""Heights over square blocks of ground, and canopy shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.scalars import GROUND, height_bin


def _block(c: Column, anchor: float, width: float) -> Column:
    return F.floor((c - F.lit(float(anchor))) / F.lit(float(width))).cast("int")


def heights(returns: DataFrame, anchor: tuple[float, float], width: float = 10.0) -> DataFrame:
    """`returns` with `height` above the lowest ground return of their block; blocks without ground are dropped. Blocks are
    anchored to the area, never to a tile. The block minima are an aggregate that is joined back: no window gathers a block."""
    keyed = returns.withColumns({"__bx": _block(F.col("x"), anchor[0], width), "__by": _block(F.col("y"), anchor[1], width)})
    low = keyed.where(F.col("classification") == GROUND).groupBy("__bx", "__by").agg(F.min("z").alias("__low"))
    return keyed.join(low, ["__bx", "__by"]).withColumn("height", F.col("z") - F.col("__low")).drop("__bx", "__by", "__low")


def height_histogram(with_height: DataFrame) -> DataFrame:
    """(bin, n) over the seven height bins."""
    return with_height.groupBy(height_bin(F.col("height")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def canopy_shares(with_height: DataFrame, anchor: tuple[float, float], width: float = 100.0, above: float = 2.0) -> DataFrame:
    """(block_x, block_y, n, share) of returns higher than `above`, by block."""
    by = with_height.groupBy(_block(F.col("x"), anchor[0], width).alias("block_x"), _block(F.col("y"), anchor[1], width).alias("block_y"))
    return by.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("height") > above) / F.count(F.lit(1))).alias("share"))
