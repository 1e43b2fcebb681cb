"""Returns: the point table that everything starts from, and the checks a reader makes before trusting it.

Columns: tile_id, x, y, z, classification, return_number, number_of_returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellbasis.functions.refusals import ReadRefusal
from cellbasis.functions.scalars import GROUND, NOISE

TOLERANCE = 0.01  # metres that a return may lie outside its tile's declared box


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Returns stored as Parquet; only the columns asked for are read."""
    return spark.read.parquet(path)


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point cloud that `view_of` makes of the driver's lineitem table."""
    return view_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def view_of(raw: DataFrame) -> DataFrame:
    """A point cloud over lineitem, batch or stream, in dyadic arithmetic so that every engine gets the same bits.

    Ten terraces along x carry ground noise, canopy, roofs and noise returns; tiles are 40 units wide.
    """
    cls = F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "A", 5).when(F.col("l_linestatus") == "F", 6).otherwise(7)
    over = (
        F.when(F.col("classification") == 2, (F.col("l_suppkey") % 8) / F.lit(64.0))
        .when(F.col("classification") == 5, F.lit(2.0) + (F.col("l_suppkey") % 64) / F.lit(16.0))
        .when(F.col("classification") == 6, F.lit(6.0))
        .otherwise(F.lit(500.0))
    )
    out = raw.withColumn("classification", cls.cast("smallint"))
    x = (F.col("l_partkey") % 120) + F.col("l_quantity") / F.lit(64.0)
    y = (F.col("l_orderkey") % 120) + F.col("l_linenumber") / F.lit(8.0)
    return out.select(
        F.format_string("%d_%d", F.floor(y / F.lit(40.0)), F.floor(x / F.lit(40.0))).alias("tile_id"),
        x.alias("x"), y.alias("y"), (F.floor((F.col("l_partkey") % 120) / F.lit(12.0)) * F.lit(1.5) + over).cast("double").alias("z"),
        "classification", F.col("l_linenumber").cast("smallint").alias("return_number"),
        F.greatest(F.col("l_linenumber").cast("long"), F.lit(1) + F.col("l_suppkey") % 7).cast("smallint").alias("number_of_returns"),
        F.col("l_shipdate").alias("stamp"), F.col("l_suppkey").alias("pulse"),
    )


def without_noise(returns: DataFrame) -> DataFrame:
    """Returns that are not of a noise class; the predicate reaches the scan where the class is stored."""
    return returns.where(~F.col("classification").isin(*NOISE))


def tile_facts(returns: DataFrame) -> DataFrame:
    """What a reader knows of each tile: returns in the file, noise dropped, official ground (over all returns), box."""
    noise = F.col("classification").isin(*NOISE)
    return returns.groupBy("tile_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_in_file"), F.count_if(noise).cast("int").alias("n_noise"), F.count_if(~noise).cast("int").alias("n_points"),
        F.bool_or(F.col("classification") == GROUND).alias("has_official_ground"),
        F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"),
    )


def _not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def stray_counts(returns: DataFrame, boxes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """By tile: returns outside the box that `boxes` (tile_id, fminx, fminy, fmaxx, fmaxy) declares, and the first of them.

    Returns of every class count: a coordinate that cannot be real is a fault of the read, whatever the class.
    """
    t = F.lit(tolerance)
    out = (F.col("x") < F.col("fminx") - t) | (F.col("x") > F.col("fmaxx") + t) | (F.col("y") < F.col("fminy") - t) | (F.col("y") > F.col("fmaxy") + t)
    return returns.join(boxes, "tile_id").groupBy("tile_id").agg(
        F.count_if(out).alias("n_stray"), F.min(F.when(out, F.struct("x", "y"))).alias("first_stray")
    )


def checked(returns: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """`returns` without noise, after the refusals of a read: coordinates that are not finite, returns outside their tile's box.

    Both are counted in aggregates of their own, before noise goes: one pass over the checked columns.
    """
    bad = returns.agg(*[F.count_if(_not_finite(F.col(c))).alias(c) for c in "xyz"]).first()
    for c in "xyz":
        if bad[c]:
            raise ReadRefusal(f"{bad[c]} return(s) have a {c} that is not finite")
    if boxes is not None:
        worst = stray_counts(returns, boxes).where("n_stray > 0").orderBy(F.desc("n_stray"), "tile_id").first()
        if worst:
            at = worst["first_stray"]
            raise ReadRefusal(f"{worst['n_stray']} return(s) of tile {worst['tile_id']} lie outside its declared box, the first at ({at['x']}, {at['y']})")
    return without_noise(returns)


def sample(returns: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """The returns of a half-open window."""
    return returns.where((F.col("x") >= minx) & (F.col("x") < maxx) & (F.col("y") >= miny) & (F.col("y") < maxy))
