"""The one grid that every band shares: rows count down from the top edge, columns to the right."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellbasis.functions.refusals import GridRefusal, length

MAX_CELLS = 200_000_000


@dataclass(frozen=True)
class Grid:
    """Held on the driver and used as literals, so that Catalyst folds it; never a table."""

    origin_x: float
    origin_y: float
    cell: float
    n_cols: int
    n_rows: int
    epsg: int

    def __post_init__(self) -> None:
        length("cell", self.cell, GridRefusal)

    @property
    def n_cells(self) -> int:
        return self.n_cols * self.n_rows

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.origin_x, self.origin_y - self.n_rows * self.cell, self.origin_x + self.n_cols * self.cell, self.origin_y

    @property
    def transform(self) -> tuple[float, float, float, float, float, float]:
        return self.cell, 0.0, self.origin_x, 0.0, -self.cell, self.origin_y

    @property
    def area(self) -> float:
        return self.n_cells * self.cell * self.cell

    def col_of(self, x: Column) -> Column:
        """Left-closed: a return on a column's left edge is in it."""
        return F.floor((x - F.lit(float(self.origin_x))) / F.lit(float(self.cell)))

    def row_of(self, y: Column) -> Column:
        """Top-closed: a return on a row's top edge is in it, one on the grid's bottom edge is outside."""
        return F.floor((F.lit(float(self.origin_y)) - y) / F.lit(float(self.cell)))

    def inside(self, x: Column, y: Column) -> Column:
        """Whether a return falls into a cell; never clipped to one."""
        row, col = self.row_of(y), self.col_of(x)
        return (row >= 0) & (row < self.n_rows) & (col >= 0) & (col < self.n_cols)

    def near(self, x: Column, y: Column) -> Column:
        """A plain range test that holds for all of `inside` and can be pushed to a scan of x and y."""
        minx, miny, maxx, maxy = self.bounds
        return (x >= minx) & (x <= maxx) & (y >= miny) & (y <= maxy)

    def center_x(self, col: Column) -> Column:
        return F.lit(float(self.origin_x)) + (col + F.lit(0.5)) * F.lit(float(self.cell))

    def center_y(self, row: Column) -> Column:
        return F.lit(float(self.origin_y)) - (row + F.lit(0.5)) * F.lit(float(self.cell))

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell as (row, col)."""
        at = spark.range(self.n_cells)
        return at.select(F.expr(f"cast(id div {self.n_cols} as int)").alias("row"), F.expr(f"cast(id % {self.n_cols} as int)").alias("col"))

    def coarse(self, factor: int) -> Grid:
        """The grid of blocks of factor x factor cells; these must tile this one."""
        if factor < 1 or self.n_rows % factor or self.n_cols % factor:
            raise GridRefusal(f"{self.n_rows} x {self.n_cols} cells do not divide into blocks of {factor} x {factor}")
        return Grid(self.origin_x, self.origin_y, self.cell * factor, self.n_cols // factor, self.n_rows // factor, self.epsg)


def grid_for_bounds(minx: float, miny: float, maxx: float, maxy: float, cell: float, epsg: int, max_cells: int = MAX_CELLS, block: int = 1) -> Grid:
    """The grid of an area: origin snapped outward to whole cells, extent to whole blocks; refused above the ceiling, which
    is tested after snapping because snapping adds cells."""
    length("cell", cell, GridRefusal)
    if block < 1:
        raise GridRefusal(f"a block has one cell at least, got {block}")
    if not (maxx > minx and maxy > miny):
        raise GridRefusal(f"empty extent ({minx}, {miny}) to ({maxx}, {maxy})")
    left, top = math.floor(minx / cell) * cell, math.ceil(maxy / cell) * cell
    whole = lambda span: -(-math.ceil(span / cell) // block) * block
    n_cols, n_rows = whole(maxx - left), whole(top - miny)
    if n_cols * n_rows > max_cells:
        raise GridRefusal(f"{n_cols * n_rows} cells exceed the ceiling of {max_cells}; take larger cells or a smaller area")
    return Grid(left, top, cell, n_cols, n_rows, epsg)
