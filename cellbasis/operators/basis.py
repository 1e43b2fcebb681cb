"""What each cell is entitled to say: measured, interpolated from a named cell, or undetermined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import BasisRefusal, CompareRefusal
from cellbasis.functions.scalars import INTERPOLATED, MEASURED, UNDETERMINED, ratio
from cellbasis.operators.neighbours import nearest_in_chunks, reach, within


def basis(cells: DataFrame, grid: Grid, is_ground: str = "is_ground", least_returns: int = 1, distance: float = 2.0, check: bool = True) -> DataFrame:
    """Dense `cells` (row, col, n_all, ground mask) with basis, src_row, src_col.

    Measured: ground and at least `least_returns` returns. Interpolated: a measured cell within `distance` metres; 0 borrows
    from nothing. As nothing beyond the distance is ever used, the search is bounded by it.
    """
    radius = reach(distance, grid.cell)
    measured = F.coalesce(F.col(is_ground), F.lit(False)) & (F.col("n_all") >= least_returns)
    if check and not cells.where(measured).take(1):
        raise BasisRefusal("no cell is measured: nothing to interpolate from")
    near = nearest_in_chunks(cells.withColumn("__source", measured), "__source", grid, radius)
    close = within(F.col("d2"), grid.cell, distance)
    code = F.when(measured, MEASURED).when(close, INTERPOLATED).otherwise(UNDETERMINED).cast("tinyint")
    src = {c: F.when(close, F.col(c)) for c in ("src_row", "src_col")}
    return near.withColumns({"basis": code, **src}).drop("d2", "__source")


def surfaces(cells: DataFrame) -> DataFrame:
    """The bands: mdt from the cell's own or its source's minimum, mds from the maximum, chm only where measured.

    Arithmetic is in FLOAT, as published. The gather is an equi-join of the frame with itself on the source.
    """
    source = cells.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), F.col("min_z").alias("__source_z"))
    out = cells.join(source, ["src_row", "src_col"], "left")
    mdt = F.when(F.col("basis") == MEASURED, F.col("min_z")).when(F.col("basis") == INTERPOLATED, F.col("__source_z")).cast("float")
    mds = F.when(F.col("n_all") > 0, F.col("max_z")).cast("float")
    out = out.withColumns({"mdt": mdt, "mds": mds})
    chm = F.when(F.col("basis") == MEASURED, F.col("mds") - F.col("mdt")).cast("float")
    return out.withColumn("chm", chm).select("row", "col", "mdt", "mds", "chm", "basis", "n_all", "n_ground")


def honesty(cells: DataFrame, grid: Grid) -> DataFrame:
    """One row: fractions by basis over all cells, density over the grid's own area, and the void share a Poisson process of
    this density would leave."""
    share = lambda code: (F.count_if(F.col("basis") == code) / F.count(F.lit(1))).cast("double")
    out = cells.agg(
        share(MEASURED).alias("fraction_measured"), share(INTERPOLATED).alias("fraction_interpolated"), share(UNDETERMINED).alias("fraction_undetermined"),
        (F.sum("n_all") / F.lit(grid.area)).cast("double").alias("measured_density"),
    )
    return out.withColumn("expected_void_fraction", F.exp(-F.col("measured_density") * F.lit(grid.cell * grid.cell)))


def confusion(cells: DataFrame, ours: str, theirs: str) -> DataFrame:
    """One row: n_cells, tp, fp, fn, tn of two masks."""
    a, b = F.coalesce(F.col(ours), F.lit(False)), F.coalesce(F.col(theirs), F.lit(False))
    return cells.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"), F.count_if(~a & ~b).alias("tn")
    )


def agreement(cells: DataFrame, is_ground: str = "is_ground", check: bool = True) -> DataFrame:
    """Ground mask against the official classification over cells with returns; recalls of nothing are NaN."""
    seen = cells.where(F.col("n_all") > 0).withColumn("__official", F.col("n_ground") > 0)
    if check and not seen.take(1):
        raise CompareRefusal("nothing was measured: nothing to compare")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = confusion(seen, is_ground, "__official").withColumns(
        {
            "recall_ground": ratio(tp, tp + fn), "recall_nonground": ratio(tn, tn + fp), "accuracy": ratio(tp + tn, F.col("n_cells")),
            "ground_prevalence": ratio(tp + fn, F.col("n_cells")),
        }
    )
    return out.withColumn("majority_class_null", F.greatest(F.col("ground_prevalence"), F.lit(1.0) - F.col("ground_prevalence")))


def kappa(counts: DataFrame) -> DataFrame:
    """Agreement in percent and Cohen's kappa of a confusion row; kappa is NaN where chance alone gives full agreement."""
    n, tp, fp, fn, tn = (F.col(c).cast("double") for c in ("n_cells", "tp", "fp", "fn", "tn"))
    seen = ratio(tp + tn, n)
    chance = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return counts.withColumns({"agreement_pct": F.lit(100.0) * seen, "kappa": F.when(chance == 1.0, F.lit(float("nan"))).otherwise((seen - chance) / F.when(chance == 1.0, F.lit(1.0)).otherwise(F.lit(1.0) - chance))})
