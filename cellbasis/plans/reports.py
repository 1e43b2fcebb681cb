"""Reports: risers of a zone, canopy of an area, sharp steps, and what a catalogue offers for a box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import SelectionRefusal
from cellbasis.functions.scalars import ratio
from cellbasis.operators import blocks, catalogue, profiles, steps


def riser_report(cells: DataFrame, grid: Grid, value: str = "min_z_ground", radius: float = 5.0, top: int = 20) -> dict:
    """Candidates, clusters, height percentiles, relief by direction and lag, and the highest clusters."""
    counts = cells.agg(F.count(F.lit(1)).alias("cells"), F.count(value).alias("known")).first()
    found = profiles.risers(cells, grid, value).checkpoint()
    order = F.when(F.col("direction") == "row", 0).when(F.col("direction") == "col", 1).when(F.col("direction") == "diag", 2).otherwise(3)
    placed = found.withColumns({
        "x": F.bround(grid.center_x(F.col("col")), 2), "y": F.bround(grid.center_y(F.col("row")), 2),
        "seq": order.cast("long") * grid.n_cells + F.col("row").cast("long") * grid.n_cols + F.col("col"),
    })
    heights = found.agg(F.count(F.lit(1)).alias("n"), F.percentile("height", F.lit(0.5)).alias("p50"), F.percentile("height", F.lit(0.9)).alias("p90"), F.max("height").alias("max")).first()
    kept = profiles.clusters(placed, radius, [-F.col("height")]).persist()
    relief = {}
    for r in profiles.relief(cells, grid, value).collect():
        relief.setdefault(r["direction"], {})[r["lag"]] = round(r["dz"], 3)
    listed = kept.orderBy(F.desc("height"), "seq").limit(top).drop("seq").collect()
    out = {"cells": counts["cells"], "known": counts["known"], "n_candidates": heights["n"], "n_clusters": kept.count(), "relief": relief, "top": [r.asDict() for r in listed]}
    if heights["n"]:
        out |= {"height_p50": round(heights["p50"], 3), "height_p90": round(heights["p90"], 3), "height_max": heights["max"]}
    return out


def canopy_report(returns: DataFrame, anchor: tuple[float, float], fine: float = 10.0, coarse: float = 100.0) -> dict:
    """Heights over block ground: histogram, shares above 2 and 5, percentiles of block shares, bare and covered blocks."""
    high = blocks.heights(returns, anchor, fine)
    shares = blocks.canopy_shares(high, anchor, coarse)
    facts = shares.agg(
        F.count(F.lit(1)).alias("blocks"), F.min("share").alias("min"), F.percentile("share", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.max("share").alias("max"),
        F.count_if(F.col("share") < 0.05).alias("bare"), F.count_if(F.col("share") > 0.5).alias("covered"),
    ).first()
    above = high.agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col("height") >= 2), F.count(F.lit(1))).alias("over_2"), ratio(F.count_if(F.col("height") >= 5), F.count(F.lit(1))).alias("over_5")).first()
    return {"histogram": {r["bin"]: r["n"] for r in blocks.height_histogram(high).collect()}, "blocks": facts.asDict(), "heights": above.asDict()}


def sharp_step_report(cells: DataFrame, grid: Grid, masks: list[str], value: str = "min_z_ground", threshold: float = 2.5, residual: float = 0.3) -> dict:
    """Candidates and population, residual percentiles, and by mask the share of the population that it keeps."""
    found = steps.sharp_steps(cells, grid, value, threshold=threshold, residual=residual).join(cells.select("row", "col", *masks), ["row", "col"])
    p = F.percentile("residual", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    member = F.col("in_population")
    row = found.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(member).alias("population"), p.alias("residuals"), F.count_if(F.col("residual") < 0.1).alias("near_planar"),
        *[(F.lit(100.0) * ratio(F.count_if(member & F.coalesce(F.col(m), F.lit(False))), F.count_if(member))).alias(f"{m}_pct") for m in masks],
    ).first()
    return row.asDict()


def triage(tiles: DataFrame, box: tuple[float, float, float, float], cell: float = 0.5, ground_share: float = 0.4) -> dict:
    """What a catalogue offers for a box: tiles, days, densities, the worst expected void, and coverage or why it is refused."""
    voids = catalogue.void_estimates(tiles, cell, ground_share)
    facts = voids.agg(
        F.count(F.lit(1)).alias("tiles"), F.sort_array(F.collect_set(F.date_format("stamp", "yyyy-MM-dd"))).alias("days"), F.min("density").alias("least_density"), F.max("density").alias("most_density"), F.max("void_at_f").alias("worst_void")
    ).first()
    out = facts.asDict()
    if not out["tiles"]:
        return out | {"coverage": None, "refused": "no coverage"}
    try:
        return out | {"coverage": catalogue.select_tiles(tiles, box).covered_fraction, "refused": None}
    except SelectionRefusal as e:
        return out | {"coverage": None, "refused": str(e)}
