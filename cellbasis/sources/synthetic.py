"""Scenes whose answer is known, made from a lattice in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

ORIGIN = (48000.0, 169000.0)


def lattice(spark: SparkSession, side: float = 50.0, step: float = 0.2) -> DataFrame:
    """Points (x, y) from the origin, x fastest."""
    n = round(side / step)
    at = spark.range(n * n)
    return at.select((F.lit(ORIGIN[0]) + (F.col("id") % n) * step).alias("x"), (F.lit(ORIGIN[1]) + F.floor(F.col("id") / n) * step).alias("y"))


class Lattice:
    """A table function: the points (x, y) of a lattice from the origin, x fastest, for `SELECT * FROM lattice(side, step)`."""

    def eval(self, side: float, step: float):
        n = round(side / step)
        for k in range(n * n):
            yield ORIGIN[0] + k % n * step, ORIGIN[1] + k // n * step


def register_lattice(spark: SparkSession, name: str = "lattice") -> None:
    """Make `Lattice` known to the session's SQL. It runs on one worker: for small scenes; `lattice` is the one that is spread."""
    spark.udtf.register(name, udtf(Lattice, returnType="x double, y double"))


def _returns(points: DataFrame, z: Column, cls: Column) -> DataFrame:
    one = F.lit(1).cast("smallint")
    return points.select(F.lit("scene").alias("tile_id"), "x", "y", z.cast("double").alias("z"), cls.cast("smallint").alias("classification"), one.alias("return_number"), one.alias("number_of_returns"))


def ramp(spark: SparkSession, slope: float = 0.1, **size) -> DataFrame:
    return _returns(lattice(spark, **size), (F.col("x") - ORIGIN[0]) * slope, F.lit(2))


def terraced(spark: SparkSession, tread: float = 6.0, riser: float = 1.5, **size) -> DataFrame:
    return _returns(lattice(spark, **size), F.floor((F.col("x") - ORIGIN[0]) / tread) * riser, F.lit(2))


def hillside(spark: SparkSession, tread: float = 6.0, riser: float = 1.5, side: float = 50.0, step: float = 0.2) -> DataFrame:
    crest = ORIGIN[0] + side / 2
    return _returns(lattice(spark, side, step), -F.floor(F.abs(F.col("x") - crest) / tread) * riser, F.lit(2))


def canopy(spark: SparkSession, slope: float = 0.02, ground_share: float = 0.3, height: float = 8.0, seed: int = 0, **size) -> DataFrame:
    """A share of the points stays ground, the others are `height` above it, by a hash of the place."""
    base = (F.col("x") - ORIGIN[0]) * slope
    ground = F.pmod(F.xxhash64("x", "y", F.lit(seed)), F.lit(1000)) < int(1000 * ground_share)
    lift = F.lit(height) + F.pmod(F.xxhash64("y", "x", F.lit(seed)), F.lit(1000)) / F.lit(1000.0) - 0.5
    return _returns(lattice(spark, **size), base + F.when(ground, 0.0).otherwise(lift), F.when(ground, 2).otherwise(5))


def town(spark: SparkSession, grid, per_cell: int, seed: int = 0) -> DataFrame:
    """Terraces with ground returns, trees and roofs in the order of a scan, `per_cell` returns a cell of `grid` on average, with voids
    under the roofs and in every 53rd block of cells: a scene as large as wanted whose truth is known."""
    n = grid.n_cells * per_cell
    at = F.floor(F.col("id") / per_cell)
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    x = F.lit(grid.origin_x) + (at % grid.n_cols + u(1)) * grid.cell
    y = F.lit(grid.origin_y) - (F.floor(at / grid.n_cols) + u(2)) * grid.cell
    points = spark.range(n).select(x.alias("x"), y.alias("y"), u(3).alias("w"), F.pmod(F.xxhash64(F.floor(x / 8), F.floor(y / 8), F.lit(seed)), F.lit(53)).alias("block"))
    points = points.where("block != 0")
    kind = F.when(F.col("block") < 6, 6).when((F.col("block") < 20) & (F.col("w") < 0.7), 5).otherwise(2)
    base = F.floor(F.col("x") / 12) * 1.5
    over = F.when(kind == 6, 6.0).when(kind == 5, 2.0 + F.col("w") * 8.0).otherwise(F.col("w") * 0.1)
    return _returns(points, base + over, kind)


def with_void(returns: DataFrame, x0: float, y0: float, side: float) -> DataFrame:
    """Without the ground returns of a square that is closed like cells are: left-closed in x, top-closed in y."""
    hole = (F.col("x") >= x0) & (F.col("x") < x0 + side) & (F.col("y") > y0) & (F.col("y") <= y0 + side) & (F.col("classification") == 2)
    return returns.where(~hole)


def sparse(spark: SparkSession, density: float = 0.5, side: float = 50.0, seed: int = 0) -> DataFrame:
    """Uniform points on flat ground, placed by hashes of their number."""
    n = round(density * side * side)
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * side
    return _returns(spark.range(n).select((F.lit(ORIGIN[0]) + u(1)).alias("x"), (F.lit(ORIGIN[1]) + u(2)).alias("y")), F.lit(0.0), F.lit(2))
