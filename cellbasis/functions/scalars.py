"""Scalar expressions over columns, and their checked forms on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellbasis.functions.refusals import CrsRefusal, Refusal

# Point classes with a meaning, basis codes, sentinels of missing values.
GROUND, VEGETATION, BUILDING = 2, 5, 6
NOISE = (7, 18)
UNDETERMINED, MEASURED, INTERPOLATED = 0, 1, 2
NODATA_FLOAT, NODATA_CODE, NODATA_COUNT = -9999.0, 255, -1

#: Projected systems in metres that this engine knows, as ranges and single codes of their registry, and geographic ones
#: that it refuses by that name. There is no projection library in the environment.
METRIC = (
    range(32601, 32661), range(32701, 32761),  # UTM on WGS 84, north and south
    range(25828, 25839), range(26901, 26924), range(3034, 3036), range(3763, 3764), range(2154, 2155), range(27700, 27701), range(3857, 3858),
    range(2056, 2057), range(28992, 28993), range(5514, 5515), range(2180, 2181), range(3067, 3068), range(3006, 3007),
)
GEOGRAPHIC = (4326, 4258, 4979, 4269, 9001)


def require_metric(epsg: int) -> int:
    """`epsg` if it is a projected system in metres."""
    if epsg in GEOGRAPHIC:
        raise CrsRefusal(f"EPSG:{epsg} is geographic; every threshold here is a length in metres. Reproject first")
    if not any(epsg in r for r in METRIC):
        raise CrsRefusal(f"EPSG:{epsg} is not a projected system in metres that is known here")
    return epsg


def void_fraction(density: Column, cell: float, ground_share: float) -> Column:
    """Share of cells that a Poisson process of this density leaves without a ground return; an unusable density raises."""
    check_void(1.0, cell, ground_share)
    usable = (density > 0) & ~F.isnan(density) & (density < float("inf"))
    return F.when(usable, F.exp(-density * F.lit(cell * cell * ground_share))).otherwise(F.raise_error(F.lit("density must be positive and finite")))


def check_void(density: float, cell: float, ground_share: float) -> float:
    """The same on the driver."""
    if not (math.isfinite(density) and density > 0 and math.isfinite(cell) and cell > 0):
        raise Refusal(f"density and cell must be positive and finite, got {density} and {cell}")
    if not 0 < ground_share <= 1:
        raise Refusal(f"the ground share must be above 0 and at most 1, got {ground_share}")
    return math.exp(-density * cell * cell * ground_share)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0 (plain division raises in ANSI mode)."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a.cast("double") / F.when(b == 0, F.lit(1)).otherwise(b))


def judged(cls: Column, number: Column, of: Column, ignored: int = 7) -> Column:
    """Whether a last-or-only filter looked at a return: the only or the last of its pulse, and not of the ignored class."""
    return ((of == 1) | (number == of)) & (cls != ignored)


def height_bin(h: Column) -> Column:
    """The bin of a height among the edges -inf, 0.5, 1, 2, 5, 10, 20, inf; a bin holds its lower edge."""
    out = F.lit(0)
    for i, edge in enumerate((0.5, 1.0, 2.0, 5.0, 10.0, 20.0), 1):
        out = F.when(h >= edge, F.lit(i)).otherwise(out)
    return out
