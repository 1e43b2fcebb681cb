"""Grid, scalars and refusals on the driver."""

import math

import pytest

from cellbasis.functions import projection
from cellbasis.functions.grid import Grid, grid_for_bounds
from cellbasis.functions.refusals import CrsRefusal, GridRefusal, Refusal
from cellbasis.functions.scalars import check_void, require_metric


def test_bounds_snap_outward_and_to_blocks():
    g = grid_for_bounds(0.3, 0.3, 10.2, 7.9, 0.5, 3763, block=4)
    assert (g.origin_x, g.origin_y) == (0.0, 8.0)
    assert g.n_cols == 24 and g.n_rows == 16
    assert g.bounds[0] <= 0.3 and g.bounds[2] >= 10.2 and g.bounds[1] <= 0.3 and g.bounds[3] >= 7.9


@pytest.mark.parametrize("cell", [0, -1, math.nan, math.inf])
def test_bad_cells_are_refused(cell):
    with pytest.raises(GridRefusal, match="cell"):
        grid_for_bounds(0, 0, 1, 1, cell, 3763)


def test_empty_extent_block_and_ceiling_are_refused():
    with pytest.raises(GridRefusal, match="empty"):
        grid_for_bounds(0, 0, 0, 1, 1, 3763)
    with pytest.raises(GridRefusal, match="block"):
        grid_for_bounds(0, 0, 1, 1, 1, 3763, block=0)
    # 9 x 11 cells are under the ceiling, 10 x 12 after snapping are not
    grid_for_bounds(0, 0, 11, 9, 1, 3763, max_cells=100)
    with pytest.raises(GridRefusal, match="ceiling"):
        grid_for_bounds(0, 0, 11, 9, 1, 3763, max_cells=100, block=2)


def test_cells_are_left_closed_and_top_closed(spark):
    g = Grid(0.0, 2.0, 1.0, 2, 2, 3763)
    pts = spark.createDataFrame([(0.0, 2.0), (1.0, 1.0), (0.5, 0.0), (2.0, 1.5), (1.999, 0.001)], "x double, y double")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in pts.select(g.row_of(F.col("y")), g.col_of(F.col("x")), g.inside(F.col("x"), F.col("y"))).collect()]
    assert got == [(0, 0, True), (1, 1, True), (2, 0, False), (0, 2, False), (1, 1, True)]


def test_systems():
    assert require_metric(3763) == 3763 and require_metric(32629) == 32629
    for bad in (4326, 9001, 123):
        with pytest.raises(CrsRefusal):
            require_metric(bad)


def test_projection_goes_there_and_back():
    for epsg, lon, lat in ((3763, -8.2, 41.3), (32629, -9.0, 38.7), (32755, 147.0, -42.0)):
        x, y = projection.to_metric(lon, lat, epsg)
        back = projection.to_degrees(x, y, epsg)
        assert back == pytest.approx((lon, lat), abs=1e-9)
    # the origin of the projection is its own image
    assert projection.to_metric(-8.133108333333334, 39.66825833333333, 3763) == pytest.approx((0, 0), abs=1e-6)


def test_void_share_and_its_domain():
    assert check_void(2.5, 1.0, 1.0) == pytest.approx(math.exp(-2.5))
    for bad in ((0, 1, 1), (math.nan, 1, 1), (1, math.inf, 1), (1, 1, 0), (1, 1, 1.1)):
        with pytest.raises(Refusal):
            check_void(*bad)
