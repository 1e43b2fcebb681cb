"""Nearest neighbours on the cell grid as equi-joins over exploded index offsets.

Ties are broken by (squared distance, row, col), so results do not depend on partitioning. The order key is packed into one
BIGINT where only the nearest is wanted: its minimum is a hash aggregate with partial results on the map side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import BasisRefusal, length
from cellbasis.operators.chunks import in_chunks

_SHIFT = 1 << 31  # above every flat index: the ceiling on cells is far below


def offsets(radius: float) -> list[tuple[int, int, int]]:
    """(squared distance, row, col) offsets within `radius` cells, which need not be whole, nearest first."""
    whole = math.floor(radius)
    out = [(r * r + c * c, r, c) for r in range(-whole, whole + 1) for c in range(-whole, whole + 1)]
    return sorted(o for o in out if o[0] <= radius * radius)


def _exploded(cells: DataFrame, some: list[tuple[int, int, int]], grid: Grid) -> DataFrame:
    """Each row of `cells` (row, col, ...) once for each offset that stays on the grid, as (trow, tcol, d2, ...)."""
    spark = cells.sparkSession
    table = F.broadcast(spark.createDataFrame(some, "d2 int, dr int, dc int"))  # its size follows the radius, not the data
    out = cells.crossJoin(table).withColumns({"trow": F.col("row") + F.col("dr"), "tcol": F.col("col") + F.col("dc")})
    return out.where((F.col("trow") >= 0) & (F.col("trow") < grid.n_rows) & (F.col("tcol") >= 0) & (F.col("tcol") < grid.n_cols)).drop("dr", "dc")


def nearest_within(sources: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """For each cell within `radius` cells of a source: (row, col, d2, src_row, src_col) of the nearest one."""
    flat = F.col("row").cast("long") * grid.n_cols + F.col("col")
    spread = _exploded(sources.select("row", "col"), offsets(radius), grid)
    best = spread.groupBy("trow", "tcol").agg(F.min(F.col("d2").cast("long") * F.lit(_SHIFT) + flat).alias("best"))
    at = F.col("best") % F.lit(_SHIFT)
    return best.select(
        F.col("trow").alias("row"), F.col("tcol").alias("col"), F.expr(f"cast(best div {_SHIFT} as int)").alias("d2"),
        F.floor(at / grid.n_cols).cast("int").alias("src_row"), (at % grid.n_cols).cast("int").alias("src_col"),
    )


def nearest_in_chunks(cells: DataFrame, source: str, grid: Grid, radius: float) -> DataFrame:
    """A dense frame with d2, src_row, src_col, which are those of `nearest_within` where a source lies within `radius` cells, and NULL.

    Offsets are tried nearest first, over whole arrays of a chunk and its halo, so the cost is one pass of each offset over the
    grid, however many of the cells are sources.
    """
    some = offsets(radius)
    halo = math.floor(radius)

    def run(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        known = np.pad(arrays["__s"] == 1, halo)
        rows, cols = arrays["__s"].shape
        best = np.full((rows, cols), -1, dtype=np.int32)
        for k, (_, dr, dc) in enumerate(some):
            here = known[halo + dr : halo + dr + rows, halo + dc : halo + dc + cols]
            best[(best < 0) & here] = k
            if k % 8 == 7 and (best >= 0).all():
                break
        return {"k": best}

    carry = tuple(c for c in cells.columns if c not in ("row", "col"))
    marked = cells.withColumn("__s", F.coalesce(F.col(source), F.lit(False)).cast("int"))
    best = in_chunks(marked, grid, ["__s"], halo, run, "k int", carry=carry)
    # the offsets of a radius, in one literal
    table = F.array(*[F.struct(F.lit(d2).alias("d2"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for d2, dr, dc in some])
    found = best.withColumn("__o", F.when(F.col("k") >= 0, table[F.col("k")]))
    return found.withColumns({"d2": F.col("__o.d2"), "src_row": F.col("row") + F.col("__o.dr"), "src_col": F.col("col") + F.col("__o.dc")}).drop("k", "__o")


def _near_fill(z: np.ndarray, some: list[tuple[int, int, int]], halo: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """`z` with each NaN replaced by the mean of the `need` nearest values among offsets `some`, and where too few lie there."""
    room = np.pad(z, halo, constant_values=np.nan)
    r, c = np.nonzero(np.isnan(z))
    got, total = np.zeros(len(r), dtype=np.int64), np.zeros(len(r))
    live = np.arange(len(r))
    for k, (_, dr, dc) in enumerate(some):
        value = room[r[live] + halo + dr, c[live] + halo + dc]
        known = ~np.isnan(value)
        got[live[known]] += 1
        total[live[known]] += value[known]
        if k >= need - 1:  # before that none can have enough
            live = live[got[live] < need]
            if not len(live):
                break
    out, late = z.copy(), np.zeros(z.shape, dtype=bool)
    done = got == need
    out[r[done], c[done]] = total[done] / need
    late[r[~done], c[~done]] = True
    return out, late


def knn_fill(cells: DataFrame, grid: Grid, value: str, k: int = 8, last_radius: int = 16, chunk: int = 128) -> DataFrame:
    """Dense `cells` with each NULL of `value` replaced by the mean of its k nearest known values (all, where there are fewer).

    Most voids are small: they are settled by k known cells within `last_radius` cells, sought nearest first in chunks with a halo
    of that width. What is left lies inside wide gaps, and is searched among the known cells near a void only, by chunks whose halo
    grows until all are settled. Without any known cell the frame comes back as it is.
    """
    known = cells.where(F.col(value).isNotNull())
    n_known = known.count()
    if not n_known or not cells.where(F.col(value).isNull()).take(1):
        return cells
    need, some = min(k, n_known), offsets(last_radius)

    def run(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        filled, late = _near_fill(arrays[value], some, last_radius, need)
        return {value: filled, "__late": late}

    near = in_chunks(cells, grid, [value], last_radius, run, f"{value} double, __late boolean").checkpoint()
    done, voids, found = near.where("not __late").drop("__late"), near.where("__late").select("row", "col"), []
    if voids.take(1):
        span = max(grid.n_rows, grid.n_cols)
        rim, halo = _rim(cells, value, k), 2 * chunk
        while True:
            found.append(_in_chunks(rim, voids, need, min(halo, span), span, chunk).checkpoint())
            voids = voids.join(found[-1], ["row", "col"], "left_anti").checkpoint()
            if halo >= span or voids.isEmpty():
                break
            halo *= 4
        rim.unpersist()
    for more in found:
        done = done.unionByName(more.withColumnRenamed("__fill", value))
    others = [c for c in cells.columns if c not in ("row", "col", value)]
    return cells.drop(value).join(done, ["row", "col"]).select(*cells.columns) if others else done.select(*cells.columns)


def _rim(cells: DataFrame, value: str, k: int) -> DataFrame:
    """Known cells with a void within k rows and columns.

    No other cell is among the k nearest of any void: on the way from a void to a known cell that has only known cells around it
    for k steps, those steps are k known cells that are nearer.
    """
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-k, k)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-k, k)
    marked = cells.select("row", "col", F.col(value).cast("double").alias("z"), F.col(value).isNull().cast("int").alias("__v"))
    marked = marked.withColumn("__v", F.max("__v").over(across)).withColumn("__v", F.max("__v").over(down))
    return marked.where((F.col("__v") == 1) & F.col("z").isNotNull()).select("row", "col", "z").persist()


def _in_chunks(rim: DataFrame, voids: DataFrame, need: int, halo: int, span: int, chunk: int) -> DataFrame:
    """(row, col, __fill) of the voids whose `need` nearest lie within the halo, from the rim cells around each chunk.

    A chunk's voids meet the rim cells of its haloed box in slices, so memory is bounded by the rim's length and not by the gap's
    area. Beyond the halo nothing has been seen: a void whose last neighbour is farther waits for the next, wider one.
    """
    whole = halo >= span
    mine = voids.select("row", "col", F.floor(F.col("row") / chunk).cast("int").alias("chunk_row"), F.floor(F.col("col") / chunk).cast("int").alias("chunk_col"))
    active = mine.select("chunk_row", "chunk_col").distinct()

    def spans(at: str):
        return F.explode(F.sequence(F.floor((F.col(at) - halo) / chunk).cast("int"), F.floor((F.col(at) + halo) / chunk).cast("int")))

    # rim cells go to the chunks whose box holds them and that have voids left
    around = rim.withColumn("chunk_row", spans("row")).withColumn("chunk_col", spans("col")).join(active, ["chunk_row", "chunk_col"], "left_semi")
    # both sides come from one frame; fresh names keep their columns apart
    around = around.select(*[F.col(c).alias(f"rim_{c}") for c in ("chunk_row", "chunk_col", "row", "col", "z")])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        vr, vc = left["row"].to_numpy(np.int64), left["col"].to_numpy(np.int64)
        place = np.lexsort((right["rim_col"], right["rim_row"]))
        rr, rc, rz = (right[c].to_numpy()[place] for c in ("rim_row", "rim_col", "rim_z"))
        rr, rc = rr.astype(np.int64), rc.astype(np.int64)
        out = []
        step = max(1, (1 << 21) // max(1, len(rr)))
        for first in range(0, len(vr) if len(rr) >= need else 0, step):
            r, c = vr[first : first + step], vc[first : first + step]
            # squared distance, then the rim's own order, in one number
            key = ((r[:, None] - rr) ** 2 + (c[:, None] - rc) ** 2) * np.int64(len(rr)) + np.arange(len(rr))
            best = np.partition(key, need - 1, axis=1)[:, :need]
            far = best.max(axis=1) // len(rr)
            ok = np.ones(len(r), dtype=bool) if whole else far <= halo * halo
            out.append(pd.DataFrame({"row": r[ok], "col": c[ok], "__fill": rz[best[ok] % len(rr)].mean(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "col": [], "__fill": []})

    return mine.groupBy("chunk_row", "chunk_col").cogroup(around.groupBy("rim_chunk_row", "rim_chunk_col")).applyInPandas(run, "row int, col int, __fill double")


def nearest_fill(cells: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Each NULL replaced by the nearest known value."""
    return knn_fill(cells, grid, value, k=1)


def reach(distance: float, cell: float) -> float:
    """Cells that a distance in metres spans, with room for rounding: `within` has the last word."""
    length("distance", distance, BasisRefusal, zero=True)
    length("cell", cell, BasisRefusal)
    return distance / cell + 1e-6


def within(d2: Column, cell: float, distance: float) -> Column:
    return F.sqrt(d2.cast("double")) * F.lit(float(cell)) <= F.lit(float(distance))
