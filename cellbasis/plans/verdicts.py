"""Filter comparisons with bounds set beforehand: tables of shares and a verdict that cannot pass on nothing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import CompareRefusal
from cellbasis.functions.scalars import ratio
from cellbasis.operators import basis, compare, stencil

# The bounds of the comparisons.
PLAIN_GROUND_AT_LEAST = 97.0
ROOF_AT_MOST = 30.0
AGREEMENT_AT_LEAST = 90.0
KAPPA_AT_LEAST = 0.60
KEPT_AT_LEAST = 85.0
KEPT_ON_STEPS_AT_LEAST = 80.0
STEP_THRESHOLDS = (1.5, 2.0, 2.5)
GATE = 2.5


@dataclass(frozen=True)
class Verdict:
    """Named values against bounds; NaN, the share of nothing, passes no bound."""

    rows: list[dict]
    checks: list[tuple[str, float, str, float, bool]]

    @property
    def passed(self) -> bool:
        return all(c[4] for c in self.checks)

    @property
    def exit_code(self) -> int:
        return 0 if self.passed else 1


def _check(name: str, value: float | None, sign: str, bound: float) -> tuple[str, float, str, float, bool]:
    v = math.nan if value is None else float(value)
    return name, v, sign, bound, v >= bound if sign == ">=" else v <= bound


def require_columns(cells: DataFrame, needed: list[str]) -> None:
    """Refuse a cached frame that lacks columns, rather than put others in their place."""
    lacking = [c for c in needed if c not in cells.columns]
    if lacking:
        raise CompareRefusal(f"the cached cells lack {', '.join(lacking)}; build them again")


def crop(cells: DataFrame, grid: Grid, zone: tuple[float, float, float, float]) -> tuple[DataFrame, Grid]:
    """The cells of a zone with rows and columns counted from its corner. Indices are truncated towards zero."""
    c0, c1 = (int((v - grid.origin_x) / grid.cell) for v in (zone[0], zone[2]))
    r0, r1 = (int((grid.origin_y - v) / grid.cell) for v in (zone[3], zone[1]))
    inside = cells.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
    moved = inside.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})
    return moved, Grid(grid.origin_x + c0 * grid.cell, grid.origin_y - r0 * grid.cell, grid.cell, c1 - c0, r1 - r0, grid.epsg)


def filter_verdict(cells: DataFrame, grid: Grid, tiles: DataFrame, is_ground: str = "is_ground", margin: int = 2, seam: float = 1.0) -> tuple[Verdict, dict]:
    """Our ground mask against a reference filter's, over dense cells with both: shares by population, confusion with and without
    tile seams, and how often the reference's ground lies above the cell's minimum."""
    require_columns(cells, ["min_z", "n_all", "n_ground", "n_class5", "n_class6", "n_reference_ground", "min_z_reference_ground", is_ground])
    marked = compare.populations(cells, margin).withColumn("theirs", F.coalesce(F.col("n_reference_ground"), F.lit(0)) > 0)
    table = compare.population_shares(marked, {"ours": F.col(is_ground), "reference": F.col("theirs")})
    table = table.withColumns({c + "_pct": F.lit(100.0) * ratio(F.col(c), F.col("cells")) for c in ("ours", "reference")})
    rows = [r.asDict() for r in table.orderBy("name").collect()]
    seen = marked.where(F.col("n_all") > 0)
    overall = basis.kappa(basis.confusion(seen, is_ground, "theirs")).first()
    away = seen.join(compare.seam_cells(cells.sparkSession, tiles, grid, seam), ["row", "col"], "left_anti")
    apart = basis.kappa(basis.confusion(away, is_ground, "theirs")).first()
    lift = F.col("min_z_reference_ground").cast("double") - F.col("min_z").cast("double")
    known = seen.where(F.col("theirs") & lift.isNotNull())
    over = known.agg(*[(F.lit(100.0) * ratio(F.count_if(lift > b), F.count(F.lit(1)))).alias(f"over_{b:g}") for b in (0.05, 0.25, 1.0)]).first()
    share = {r["name"]: r["ours_pct"] for r in rows}
    checks = [
        _check("plain ground called ground", share["plain_ground"], ">=", PLAIN_GROUND_AT_LEAST), _check("roof called ground", share["building_no_ground"], "<=", ROOF_AT_MOST),
        _check("agreement", overall["agreement_pct"], ">=", AGREEMENT_AT_LEAST), _check("kappa", overall["kappa"], ">=", KAPPA_AT_LEAST),
    ]
    return Verdict(rows, checks), {"overall": overall.asDict(), "away_from_seams": apart.asDict(), "lift": over.asDict()}


def terrace_verdict(cells: DataFrame, grid: Grid, before: str, after: str, reference: str, window: int = 7, least: int = 2, dense_least: int = 10) -> tuple[Verdict, dict]:
    """Of the cells one filter measured, those that another keeps: overall, and on steps in the official ground's minima. An empty
    gate population is a broken instrument, not a passing filter, and is refused."""
    require_columns(cells, ["min_z_ground", before, after, reference])
    step = stencil.step_magnitude(cells.select("row", "col", "min_z_ground"), grid, "min_z_ground", window, least)
    both = cells.join(step, ["row", "col"], "left")
    on = lambda t, n=least: F.coalesce((F.col("step") > t) & (F.col("n") >= n), F.lit(False))
    masks: dict[str, Column] = {"all": F.lit(True)} | {f"step > {t:g}": on(t) for t in STEP_THRESHOLDS} | {f"step > {GATE:g}, dense": on(GATE, max(dense_least, least))}
    kept = F.coalesce(F.col(before), F.lit(False))
    aggs = []
    for i, m in enumerate(masks.values()):
        aggs += [F.count_if(kept & m).alias(f"n{i}"), F.count_if(kept & m & F.coalesce(F.col(after), F.lit(False))).alias(f"k{i}"), F.count_if(kept & m & F.coalesce(F.col(reference), F.lit(False))).alias(f"r{i}")]
    got = both.agg(*aggs).first()
    pct = lambda a, n: 100.0 * a / n if n else math.nan
    rows = [{"population": name, "cells": got[f"n{i}"], "kept_pct": pct(got[f"k{i}"], got[f"n{i}"]), "reference_pct": pct(got[f"r{i}"], got[f"n{i}"])} for i, name in enumerate(masks)]
    gate = next(r for r in rows if r["population"] == f"step > {GATE:g}")
    if not gate["cells"]:
        raise CompareRefusal(f"no measured cell stands on a step above {GATE:g}: nothing was tested")
    checks = [_check("measured ground kept", rows[0]["kept_pct"], ">=", KEPT_AT_LEAST), _check("kept on steps", gate["kept_pct"], ">=", KEPT_ON_STEPS_AT_LEAST)]
    extra: dict = {}
    if "min_z_reference_ground" in cells.columns:
        lift = F.col("min_z_reference_ground").cast("double") - F.col("min_z").cast("double")
        agreed = both.where(kept & F.coalesce(F.col(reference), F.lit(False)) & lift.isNotNull())
        extra = agreed.agg(F.count(F.lit(1)).alias("cells"), F.percentile(lift, F.lit(0.5)).alias("median_lift"), (F.lit(100.0) * ratio(F.count_if(F.abs(lift) > 0.5), F.count(F.lit(1)))).alias("far_pct")).first().asDict()
    return Verdict(rows, checks), extra
