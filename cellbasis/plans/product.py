"""The whole run: returns to bands and record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import NotSelected
from cellbasis.operators.accumulate import cell_stats, dense, outside_count
from cellbasis.operators.basis import agreement, basis, honesty, surfaces
from cellbasis.operators.catalogue import sorties, stamps_from_text
from cellbasis.operators.ground import ProgressiveParams, with_ground
from cellbasis.sinks.record import Input, record
from cellbasis.sources.returns import checked, tile_facts


#: What the record says of every run: parameters that no calibration stands behind, and what a product cannot vouch for.
UNCALIBRATED = ("cell", "k_min_returns", "d_max_interp_m", "smrf_cell", "smrf_slope", "smrf_scalar", "smrf_threshold", "smrf_window_m")
LIMITATIONS = (
    "An interpolated cell repeats the value of the nearest measured one; nothing is smoothed.",
    "A cell is ground or it isn't: returns within it are not judged one by one, and n_ground counts the delivery's ground returns, not this filter's.",
    "Equal results on other machines or other versions of Spark have not been tested.",
    "The hash knows the code by the package's version only.",
    "The hash leaves the attribution out, so two records that differ in nothing else share it.",
    "The share of ground behind the expected voids is a model's assumption and not measured.",
    "Buildings that the filter leaves standing count as measured ground.",
    "No rule limits how far the filter may cut; that it spares terraces is an observation.",
    "The cell must divide the filter's cell, and the grid grows outward to whole filter cells, so it can hold cells beyond the area asked for.",
    "The ceiling on a grid is a number of cells and not of bytes.",
)


@dataclass(frozen=True)
class Product:
    bands: DataFrame
    record: dict
    outside: int  # returns that the grid does not hold
    unclassified: list[str]  # tiles without any official ground


def run(returns: DataFrame, grid: Grid, attribution: str, boxes: DataFrame | None = None, digests: dict[str, str] | None = None, params: ProgressiveParams | None = None, least_returns: int = 1, distance: float = 2.0, catalogue: dict[str, dict] | None = None) -> Product:
    """Check, fold, filter, label and gather. Agreement is absent as soon as one tile has no official ground at all.

    `returns` are gone through several times; where they come from files they should be decoded into a table before.

    `catalogue`: by tile what the provider declares (point_count, flight_date, bbox); a tile that it lacks is refused, and its boxes
    are those that returns must lie in. Without it the record leaves those figures out.
    """
    params = params or ProgressiveParams()
    facts = tile_facts(returns).collect()  # one row a tile of one area
    declared = catalogue or {}
    missing = sorted(f["tile_id"] for f in facts if catalogue is not None and f["tile_id"] not in declared)
    if missing:
        raise NotSelected(f"not in the selection: {', '.join(missing)}")
    if boxes is None and any(d.get("bbox") for d in declared.values()):
        rows = [(k, *map(float, d["bbox"])) for k, d in declared.items() if d.get("bbox")]
        boxes = returns.sparkSession.createDataFrame(rows, "tile_id string, fminx double, fminy double, fmaxx double, fmaxy double")
    unclassified = sorted(f["tile_id"] for f in facts if not f["has_official_ground"])
    official = not unclassified
    clean = checked(returns, boxes)
    outside = outside_count(clean, grid).first()["n_out"]
    cells = dense(cell_stats(clean, grid), grid).checkpoint()
    labelled = basis(with_ground(cells, grid, params).checkpoint(), grid, least_returns=least_returns, distance=distance).checkpoint()
    told = honesty(labelled, grid).first().asDict()
    agreed = agreement(labelled).first().asDict() if official else None
    area = lambda f: (f["maxx"] - f["minx"]) * (f["maxy"] - f["miny"])
    density = lambda f: f["n_points"] / area(f) if area(f) > 0 else 0.0
    say = lambda f, k: declared.get(f["tile_id"], {}).get(k)
    inputs = [
        Input(f["tile_id"], f"{f['tile_id']}.las", (digests or {}).get(f["tile_id"], ""), f["n_in_file"], density(f), f["n_noise"], say(f, "point_count"), say(f, "flight_date"))
        for f in facts
    ]
    dates = sorted({i.flight_date for i in inputs if i.flight_date})
    mixed = False
    if dates:
        stamped = stamps_from_text(returns.sparkSession.createDataFrame([(1, d) for d in dates], "k int, t string"), "t")
        mixed = sorties(stamped, ["k"]).agg(F.max("sortie")).first()[0] > 0
    said = {"cell": grid.cell, "k_min_returns": least_returns, "d_max_interp_m": distance}
    said |= {"smrf_cell": params.cell, "smrf_slope": params.slope, "smrf_scalar": params.scalar, "smrf_threshold": params.threshold, "smrf_window_m": params.window_length}
    bands = surfaces(labelled)
    if not official:
        bands = bands.withColumn("n_ground", F.lit(-1).cast("int"))
    return Product(bands, record(grid, said, inputs, told, agreed, attribution, dates, mixed, UNCALIBRATED, LIMITATIONS), outside, unclassified)
