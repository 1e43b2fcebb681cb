"""Profiles through a surface: risers between treads, relief by lag, and clusters of candidates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid

# A riser's slopes, lengths and heights in metres; relief is taken up to LONGEST_LAG.
TREAD_SLOPE, STEEP_SLOPE = 0.27, 0.8
TREAD_LENGTH, RISER_WIDTH, RISER_HEIGHT = 2.0, 3.0, 0.5
LONGEST_LAG = 2.0

DIRECTIONS = ("row", "col", "diag", "adiag")


def spacing(direction: str, cell: float) -> float:
    return cell if direction in ("row", "col") else cell * math.sqrt(2.0)


def profiles(cells: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Dense `cells` four times, as members of the profiles through them: (direction, profile, pos, row, col, z).

    Diagonals of a single cell, in the corners, are left out. `pos` counts along the profile.
    """
    row, col = F.col("row"), F.col("col")
    last = F.lit(grid.n_rows - 1) - row
    members = F.array(
        F.struct(F.lit("row").alias("direction"), row.alias("profile"), col.alias("pos")),
        F.struct(F.lit("col").alias("direction"), col.alias("profile"), row.alias("pos")),
        F.struct(F.lit("diag").alias("direction"), (col - row).alias("profile"), F.least(row, col).alias("pos")),
        F.struct(F.lit("adiag").alias("direction"), (col - last).alias("profile"), F.least(last, col).alias("pos")),
    )
    out = cells.select(row, col, F.col(value).cast("double").alias("z"), F.explode(members).alias("m"))
    out = out.select("m.direction", "m.profile", "m.pos", "row", "col", "z")
    corner = (F.col("profile") == -(grid.n_rows - 1)) | (F.col("profile") == grid.n_cols - 1)
    return out.where(F.col("direction").isin("row", "col") | ~corner)


def _h(cell: float) -> Column:
    return F.when(F.col("direction").isin("row", "col"), F.lit(float(cell))).otherwise(F.lit(cell * math.sqrt(2.0)))


def risers(cells: DataFrame, grid: Grid, value: str, tread_slope: float = TREAD_SLOPE, steep_slope: float = STEEP_SLOPE, tread_length: float = TREAD_LENGTH, max_width: float = RISER_WIDTH, min_height: float = RISER_HEIGHT) -> DataFrame:
    """Riser candidates: steep runs of one sign between two treads, at their middle sample.

    Gaps and islands in windows: each gap between neighbouring samples is a tread, steep up, steep down, or neither (NULL
    breaks runs); runs of one kind are islands; a steep island is a riser if it is narrow and high enough and the islands
    right before and after it are long enough treads.
    """
    along = Window.partitionBy("direction", "profile").orderBy("pos")
    h = _h(grid.cell)
    gaps = profiles(cells, grid, value).withColumns({"next_z": F.lead("z").over(along), "next_pos": F.lead("pos").over(along)}).where(F.col("next_pos").isNotNull())
    slope = (F.col("next_z") - F.col("z")) / h
    kind = F.when(F.abs(slope) <= tread_slope, F.lit("tread")).when(slope >= steep_slope, F.lit("up")).when(slope <= -steep_slope, F.lit("down")).otherwise(F.lit("other"))
    gaps = gaps.withColumn("kind", kind)
    new = F.when(F.col("kind") == F.lag("kind").over(along), 0).otherwise(1)
    gaps = gaps.withColumn("new", new).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    islands = gaps.groupBy("direction", "profile", "island", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.min_by("z", "pos").alias("z0"), F.max_by("next_z", "pos").alias("z1")
    )
    order = Window.partitionBy("direction", "profile").orderBy("island")
    tread = lambda side: F.when(side("kind", 1).over(order) == "tread", side("n", 1).over(order)).otherwise(0)
    islands = islands.withColumns({"before": tread(F.lag), "after": tread(F.lead)})
    least, most = F.ceil(F.lit(tread_length) / h), F.floor(F.lit(max_width) / h)
    height = F.abs(F.col("z1") - F.col("z0"))
    found = islands.where(F.col("kind").isin("up", "down") & (F.col("n") <= most) & (height >= min_height) & (F.col("before") >= least) & (F.col("after") >= least))
    middle = (F.col("first") + F.floor(F.col("n") / 2)).cast("int")
    # (first + first + n) div 2 is first + n div 2
    found = found.withColumns({"mid": middle, "height": height})
    row = (
        F.when(F.col("direction") == "row", F.col("profile")).when(F.col("direction") == "col", F.col("mid"))
        .when(F.col("direction") == "diag", F.col("mid") + F.greatest(F.lit(0), -F.col("profile")))
        .otherwise(F.lit(grid.n_rows - 1) - (F.col("mid") + F.greatest(F.lit(0), -F.col("profile"))))
    )
    col = F.when(F.col("direction") == "row", F.col("mid")).when(F.col("direction") == "col", F.col("profile")).otherwise(F.col("mid") + F.greatest(F.lit(0), F.col("profile")))
    return found.select(
        "direction", row.cast("int").alias("row"), col.cast("int").alias("col"), F.bround("height", 3).alias("height"),
        F.bround(F.col("n") * h, 3).alias("width"), (F.col("n") + 1).cast("int").alias("n_run"),
        F.bround(F.col("before") * h, 2).alias("tread_before"), F.bround(F.col("after") * h, 2).alias("tread_after"),
    )


def relief(cells: DataFrame, grid: Grid, value: str, longest: float = LONGEST_LAG) -> DataFrame:
    """(direction, lag, dz): the greatest absolute difference between samples `lag` apart on one profile, for all lags up to
    `longest` metres; 0 where no pair is known."""
    along = Window.partitionBy("direction", "profile").orderBy("pos")
    some = profiles(cells, grid, value)
    most = {d: math.floor(longest / spacing(d, grid.cell)) for d in DIRECTIONS}
    lags = range(1, max(most.values()) + 1)
    some = some.withColumns({f"__{k}": F.abs(F.lead("z", k).over(along) - F.col("z")) for k in lags})
    wide = some.groupBy("direction").agg(*[F.max(f"__{k}").alias(f"__{k}") for k in lags])
    out = wide.select("direction", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.col(f"__{k}"), F.lit(0.0)).alias("dz")) for k in lags])).alias("e"))
    out = out.select("direction", "e.lag", "e.dz")
    keep = F.col("lag") <= F.when(F.col("direction").isin("row", "col"), most["row"]).otherwise(most["diag"])
    return out.where(keep)


def _settled(part: pd.DataFrame, reach: float) -> np.ndarray:
    """Of the candidates of a block and its halo, in order of `rank`: 1 for those that stay, -1 for those displaced, 0 for those that wait.

    `fresh` ones stay and displace first. Then, best first, a candidate that nothing has displaced waits if it is not `own`, as what lies
    around it is not all there, or if a better one near it waits; otherwise it stays. Members of a square are looked at together, and
    those that are displaced, or already wait, are not looked at again.
    """
    x, y, own = part["x"].to_numpy(), part["y"].to_numpy(), part["own"].to_numpy()
    said = np.zeros(len(part), dtype=np.int8)
    said[part["fresh"].to_numpy()] = 1
    waits = ~own
    squares = {at: np.sort(members) for at, members in part.groupby(["sx", "sy"]).indices.items()}
    open_ = dict(squares)
    at = list(zip(part["sx"].tolist(), part["sy"].tolist(), strict=True))

    def near(i: int, some: dict, left: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        sx, sy = at[i]
        out = []
        for key in [(sx + dx, sy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
            if key in some:
                some[key] = some[key][left(some[key])]
                out.append(some[key])
        found = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
        return found[(x[found] - x[i]) ** 2 + (y[found] - y[i]) ** 2 <= reach * reach]

    for i in np.flatnonzero(said == 1):
        found = near(i, squares, lambda m: said[m] >= 0)
        said[found[said[found] == 0]] = -1
    for i in range(len(part)):
        if said[i]:
            continue
        if waits[i]:
            found = near(i, open_, lambda m: (said[m] == 0) & ~waits[m])
            waits[found[found > i]] = True
        else:
            said[i] = 1
            found = near(i, squares, lambda m: said[m] >= 0)
            said[found[said[found] == 0]] = -1
    return said


def clusters(candidates: DataFrame, radius: float, order: list[Column], key: str = "seq", block: int = 24) -> DataFrame:
    """Candidates (seq, x, y, ...) that no better one within `radius` has displaced: greedy by `order`.

    The greedy result is the lexicographically first maximal independent set: those that come first among the undecided around them stay
    and displace their neighbours. Each round deals the undecided ones and those that the round before has kept into blocks of `block` x
    `block` squares as wide as the radius, with a halo of one square, and a block settles all that does not wait for something outside it.
    So the rounds follow how often a chain of ever better neighbours leaves its block, and not its length, which equal heights make long. The
    blocks move by a third each round, so of three rounds one at least has any candidate well inside its block. The first undecided one of
    all is settled in any case. A group is what lies in a block and its halo; on a grid that is bounded whatever the input.
    """
    side = radius * (1 + 1e-6)  # a little wider, so that rounding can't put squares of neighbours two apart
    ranked = candidates.orderBy(*order, key).withColumn("__rank", F.monotonically_increasing_id()).checkpoint()
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    placed = F.coalesce((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")), F.lit(False))
    kept = ranked.where(~placed).select(F.col("__rank").alias("rank"))  # near nothing
    live = ranked.where(placed).select(F.col("__rank").alias("rank"), x.alias("x"), y.alias("y"), F.lit(False).alias("fresh"))
    live = live.withColumns({"sx": F.floor(F.col("x") / side).cast("long"), "sy": F.floor(F.col("y") / side).cast("long")})
    shift = 0
    while not live.where("not fresh").isEmpty():
        live = _round(live, radius, block, shift).checkpoint()
        kept = kept.unionByName(live.where("fresh").select("rank"))
        shift = (shift + block // 3) % block
    return ranked.join(kept.withColumnRenamed("rank", "__rank"), "__rank", "left_semi").select(*candidates.columns)


def _round(live: DataFrame, radius: float, block: int, shift: int) -> DataFrame:
    """`live` without those that were fresh and those that are displaced; those that stay are fresh."""

    def spans(at: str):
        low, high = [F.floor((F.col(at) + (shift + step)) / block).cast("long") for step in (-1, 1)]
        return F.explode(F.sequence(low, high))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank", ignore_index=True)
        part["own"] = ((part["sx"] + shift) // block == key[0]) & ((part["sy"] + shift) // block == key[1])
        said = _settled(part, radius)
        mine = part["own"] & ~part["fresh"] & (said >= 0)
        part["fresh"] = said == 1
        return part.loc[mine, ["rank", "x", "y", "fresh", "sx", "sy"]]

    spread = live.select("*", spans("sx").alias("bx")).select("*", spans("sy").alias("by"))
    return spread.groupBy("bx", "by").applyInPandas(one, "rank long, x double, y double, fresh boolean, sx long, sy long")
