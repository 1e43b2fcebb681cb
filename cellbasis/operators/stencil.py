"""Stencils as range windows over integer indices.

A range frame is clipped at the border by itself, which is the in-bounds-only rule. Two-pass forms need a dense frame:
the second pass only sees what the first attached to an existing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import FilterRefusal, Refusal


def _square(cells: DataFrame, r: int, aggs: dict[str, tuple], keep: list[str]) -> DataFrame:
    """Separable aggregates over (2r + 1) x (2r + 1) windows: along rows, then along columns."""
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-r, r)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-r, r)
    first = cells.withColumns({f"__{k}": fn(value).over(across) for k, (fn, value) in aggs.items()})
    return first.withColumns({k: fn(F.col(f"__{k}")).over(down) for k, (fn, _) in aggs.items()}).select("row", "col", *keep, *aggs)


def square_extreme(cells: DataFrame, r: int, value: str, out: str, dilate: bool) -> DataFrame:
    """Erosion, or dilation, of dense `cells` by a square; `value` stays, `out` is new."""
    keep = [c for c in cells.columns if c not in ("row", "col", out)]
    return _square(cells, r, {out: (F.max if dilate else F.min, F.col(value))}, keep)


def square_opening(cells: DataFrame, r: int, value: str, out: str) -> DataFrame:
    """Opening by a square of a filled surface. An element padded with the nearest edge value sees only values that a
    clipped one sees too, so clipping is enough."""
    eroded = square_extreme(cells, r, value, "__eroded", dilate=False)
    return square_extreme(eroded, r, "__eroded", out, dilate=True).drop("__eroded")


def diamond(cells: DataFrame, grid: Grid, r: int, value: str, dilate: bool, out: str) -> DataFrame:
    """Least (or greatest) value within the L1 ball of radius r.

    Rotated by 45 degrees the ball is a square: u = row + col, v = row - col. The lattice of all (u, v) is made dense with
    NULLs, so that both passes see every place; the cost does not depend on r. Meant for the small radii; growing
    windows over large grids take the chunked form in the ground filter.
    """
    spark = cells.sparkSession
    nu, nv = grid.n_rows + grid.n_cols - 1, grid.n_rows + grid.n_cols - 1
    lattice = spark.range(nu * nv).select(F.expr(f"cast(id div {nv} as int)").alias("u"), F.expr(f"cast(id % {nv} - {grid.n_cols - 1} as int)").alias("v"))
    placed = cells.select((F.col("row") + F.col("col")).alias("u"), (F.col("row") - F.col("col")).alias("v"), F.lit(True).alias("__cell"), F.col(value).alias("__z"))
    fn = F.max if dilate else F.min
    one = Window.partitionBy("v").orderBy("u").rangeBetween(-r, r)
    two = Window.partitionBy("u").orderBy("v").rangeBetween(-r, r)
    full = lattice.join(placed, ["u", "v"], "left").withColumn("__1", fn("__z").over(one)).withColumn(out, fn("__1").over(two))
    return full.where("__cell").select(((F.col("u") + F.col("v")) / 2).cast("int").alias("row"), ((F.col("u") - F.col("v")) / 2).cast("int").alias("col"), out)


def require_filled(cells: DataFrame, value: str) -> None:
    if cells.where(F.col(value).isNull() | F.isnan(value)).take(1):
        raise FilterRefusal("the surface has holes; every opening works on a filled one")


def interior(cells: DataFrame, mask: str, margin: int) -> DataFrame:
    """Cells whose whole (2 margin + 1) square is in the dense mask; what lies off the grid is not."""
    if margin < 1:
        raise Refusal(f"the margin has one cell at least, got {margin}")
    inside = _square(cells.withColumn("__m", F.coalesce(F.col(mask), F.lit(False)).cast("int")), margin, {"__n": (F.sum, F.col("__m"))}, [c for c in cells.columns if c not in ("row", "col")])
    return inside.where(F.col("__n") == (2 * margin + 1) ** 2).drop("__n")


def step_magnitude(cells: DataFrame, grid: Grid, value: str, window: int = 7, least: int = 2) -> DataFrame:
    """Range of the known values in a square window, of a dense frame: rows where at least `least` are known and the window
    lies inside the grid."""
    if window < 3 or window % 2 == 0:
        raise Refusal(f"the window must be an odd number of cells from 3, got {window}")
    if least < 2:
        raise Refusal(f"a range needs two values, got {least}")
    r, v = window // 2, F.col(value).cast("double")
    known = F.col(value).isNotNull().cast("int")
    out = _square(cells, r, {"__hi": (F.max, v), "__lo": (F.min, v), "n": (F.sum, known)}, [])
    observed = (F.col("row") >= r) & (F.col("row") < grid.n_rows - r) & (F.col("col") >= r) & (F.col("col") < grid.n_cols - r)
    return out.where(observed & (F.col("n") >= least)).select("row", "col", (F.col("__hi") - F.col("__lo")).alias("step"), F.col("n").cast("int").alias("n"))


def gradient(cells: DataFrame, value: str) -> DataFrame:
    """Differences along columns (gx) and rows (gy): central inside, one-sided at the ends, 0 on an axis of one cell. Dense
    frame; NULL where a needed neighbour is."""

    def along(part: str, order: str) -> Column:
        w = Window.partitionBy(part).orderBy(order)
        whole = Window.partitionBy(part)
        me, before, after = F.col("__v"), F.lag("__v").over(w), F.lead("__v").over(w)
        first, last = F.col(order) == F.min(order).over(whole), F.col(order) == F.max(order).over(whole)
        return F.when(first & last, F.lit(0.0)).when(first, after - me).when(last, me - before).otherwise((after - before) / F.lit(2.0))

    out = cells.withColumn("__v", F.col(value).cast("double"))
    return out.withColumn("gx", along("row", "col")).withColumn("gy", along("col", "row")).drop("__v")
