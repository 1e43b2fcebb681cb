"""Returns to cells: one aggregate, whatever the number of tiles and in whatever order they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import ReadRefusal
from cellbasis.functions.scalars import GROUND


def binned(returns: DataFrame, grid: Grid) -> DataFrame:
    """Returns inside the grid, with row and col. The plain range test beside the exact one can reach the scan."""
    x, y = F.col("x"), F.col("y")
    return returns.where(grid.near(x, y) & grid.inside(x, y)).withColumns({"row": grid.row_of(y).cast("int"), "col": grid.col_of(x).cast("int")})


def outside_count(returns: DataFrame, grid: Grid) -> DataFrame:
    """How many returns the grid holds and how many it doesn't."""
    inside = F.coalesce(grid.inside(F.col("x"), F.col("y")), F.lit(False))
    return returns.agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))


def require_one_crs(epsgs: set[int], grid: Grid) -> None:
    """Refuse a fold of returns whose system isn't the grid's, before any return is touched."""
    for epsg in sorted(epsgs):
        if epsg != grid.epsg:
            raise ReadRefusal(f"returns in EPSG:{epsg} cannot be folded into a grid in EPSG:{grid.epsg}")


def cell_stats(returns: DataFrame, grid: Grid, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each cell that holds a return: extremes published as FLOAT, counts as INT.

    A partial and a final hash aggregate on (row, col) - not on tiles, so a dense tile is no hot key. `extra` adds
    aggregates, computed in the same pass.
    """
    ground = F.col("classification") == GROUND
    more = [c.alias(k) for k, c in (extra or {}).items()]
    return binned(returns, grid).groupBy("row", "col").agg(
        F.min("z").cast("float").alias("min_z"), F.max("z").cast("float").alias("max_z"),
        F.count(F.lit(1)).cast("int").alias("n_all"), F.count_if(ground).cast("int").alias("n_ground"),
        F.min(F.when(ground, F.col("z"))).cast("float").alias("min_z_ground"), *more,
    )


def dense(stats: DataFrame, grid: Grid, counts: tuple[str, ...] = ("n_all", "n_ground")) -> DataFrame:
    """Every cell of the grid: NULL where nothing was measured, 0 for counts."""
    out = grid.cells(stats.sparkSession).join(stats, ["row", "col"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in counts if c in stats.columns})


def block_min(cells: DataFrame, factor: int, value: str = "min_z") -> DataFrame:
    """The least value of each factor x factor block; blocks without any are absent or NULL."""
    return cells.groupBy(F.expr(f"cast(row div {factor} as int)").alias("row"), F.expr(f"cast(col div {factor} as int)").alias("col")).agg(F.min(value).alias(value))


def upsample(cells: DataFrame, coarse: DataFrame, factor: int, values: list[str]) -> DataFrame:
    """`values` of each cell's block."""
    blocks = coarse.select(F.col("row").alias("__row"), F.col("col").alias("__col"), *values)
    on = (F.expr(f"cast(row div {factor} as int)") == F.col("__row")) & (F.expr(f"cast(col div {factor} as int)") == F.col("__col"))
    return cells.join(blocks, on, "left").drop("__row", "__col")
