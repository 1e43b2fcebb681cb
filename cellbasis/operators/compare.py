"""Comparisons: populations of cells, tile seams, two point files, two runs, repeated reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import CompareRefusal
from cellbasis.functions.scalars import GROUND, judged, ratio
from cellbasis.operators.stencil import interior


def reference_aggregates(reference_class: str = "reference_class") -> dict[str, Column]:
    """What a comparison needs of each cell beyond the fold, in the same pass."""
    seen = judged(F.col("classification"), F.col("return_number"), F.col("number_of_returns"))
    theirs = seen & (F.col(reference_class) == GROUND)
    return {
        "n_class5": F.count_if(F.col("classification") == 5).cast("int"),
        "n_class6": F.count_if(F.col("classification") == 6).cast("int"),
        "n_reference_ground": F.count_if(theirs).cast("int"),
        "min_z_judged": F.min(F.when(seen, F.col("z"))).cast("float"),
        "min_z_reference_ground": F.min(F.when(theirs, F.col("z"))).cast("float"),
    }


def judged_controls(returns: DataFrame, reference_class: str = "reference_class") -> DataFrame:
    """One row: returns the reference filter judged, those it moved into or out of ground, and ground it passed through unjudged."""
    seen = judged(F.col("classification"), F.col("return_number"), F.col("number_of_returns"))
    ours, theirs = F.col("classification") == GROUND, F.col(reference_class) == GROUND
    return returns.agg(
        F.count_if(seen).alias("judged"), F.count_if(seen & ~ours & theirs).alias("into_ground"), F.count_if(seen & ours & ~theirs).alias("out_of_ground"), F.count_if(~seen & ours & theirs).alias("passed_through")
    )


def point_differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The points of two files that are in one only, or whose coordinates differ."""
    other = b.select(*key, *[F.col(c).alias(f"__{c}") for c in "xyz"])
    both = a.select(*key, "x", "y", "z").join(other, key, "full_outer")
    same = F.lit(True)
    for c in "xyz":
        same = same & (F.col(c).eqNullSafe(F.col(f"__{c}")) & F.col(c).isNotNull())
    return both.where(~same)


def require_same_points(a: DataFrame, b: DataFrame, key: list[str]) -> None:
    """Refuse to compare two files point by point unless every key has the same coordinates in both."""
    n = point_differences(a, b, key).count()
    if n:
        raise CompareRefusal(f"{n} point(s) differ between the two files or are in one only")


def populations(cells: DataFrame, margin: int = 2) -> DataFrame:
    """Dense `cells` with n_ground, n_class5, n_class6 and the five populations as booleans."""
    c2, c5, c6 = (F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("n_ground", "n_class5", "n_class6"))
    out = cells.withColumns({"building": c6, "building_no_ground": c6 & ~c2, "canopy_only": c5 & ~c2 & ~c6, "plain_ground": c2 & ~c5 & ~c6})
    roof = interior(out.select("row", "col", "building_no_ground"), "building_no_ground", margin).select("row", "col", F.lit(True).alias("roof_interior"))
    return out.join(roof, ["row", "col"], "left").withColumn("roof_interior", F.coalesce("roof_interior", F.lit(False)))


POPULATIONS = ("building", "building_no_ground", "roof_interior", "canopy_only", "plain_ground")


def population_shares(cells: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """(name, cells, hits by name): one scan, unpivoted."""
    long = cells.select(*[c.alias(k) for k, c in hits.items()], F.explode(F.array(*[F.struct(F.lit(p).alias("name"), F.col(p).alias("member")) for p in POPULATIONS])).alias("p"))
    named = long.select("p.name", "p.member", *hits)
    return named.groupBy("name").agg(F.count_if("member").alias("cells"), *[F.count_if(F.col("member") & F.coalesce(F.col(k), F.lit(False))).alias(k) for k in hits])


def retention(cells: DataFrame, population: Column, before: Column, after: Column) -> DataFrame:
    """One row: cells of the population that were kept before, how many of them after, and the share in percent (NaN of none)."""
    out = cells.agg(F.count_if(population & before).alias("before"), F.count_if(population & before & after).alias("kept"))
    return out.withColumn("retention_pct", F.lit(100.0) * ratio(F.col("kept"), F.col("before")))


def seam_cells(spark, tiles: DataFrame, grid: Grid, margin: float) -> DataFrame:
    """Cells whose centre lies within `margin` of some tile's edge: in the grown box, not in the shrunk one.

    Each tile is turned into the index ranges its grown box spans and exploded along its own rim only.
    """
    m, c = F.lit(float(margin)), float(grid.cell)
    t = tiles.select("minx", "miny", "maxx", "maxy").distinct()
    x0 = F.greatest(F.lit(0), F.ceil((F.col("minx") - m - grid.origin_x) / c - 0.5)).cast("int")
    x1 = F.least(F.lit(grid.n_cols - 1), F.floor((F.col("maxx") + m - grid.origin_x) / c - 0.5)).cast("int")
    y0 = F.greatest(F.lit(0), F.ceil((grid.origin_y - F.col("maxy") - m) / c - 0.5)).cast("int")
    y1 = F.least(F.lit(grid.n_rows - 1), F.floor((grid.origin_y - F.col("miny") + m) / c - 0.5)).cast("int")
    t = t.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 <= x1 and y0 <= y1")
    cells = t.withColumn("row", F.explode(F.sequence("y0", "y1"))).withColumn("cy", grid.center_y(F.col("row")))
    deep_row = (F.col("cy") > F.col("miny") + m) & (F.col("cy") < F.col("maxy") - m)
    # rows in the shrunk band need only the two ends; others all columns
    cols = F.when(
        deep_row,
        F.filter(F.sequence("x0", "x1"), lambda k: (grid.center_x(k) <= F.col("minx") + m) | (grid.center_x(k) >= F.col("maxx") - m)),
    ).otherwise(F.sequence("x0", "x1"))
    return cells.select("row", F.explode(cols).alias("col")).distinct()


def run_difference(old: DataFrame, new: DataFrame, bands: list[str]) -> DataFrame:
    """(band, cells, differing): two band frames cell by cell, a cell missing from one side counting as different."""
    a = old.select("row", "col", F.lit(True).alias("__in_a"), *[F.col(b).alias(f"a_{b}") for b in bands])
    b = new.select("row", "col", F.lit(True).alias("__in_b"), *[F.col(b).alias(f"b_{b}") for b in bands])
    both = a.join(b, ["row", "col"], "full_outer")
    alone = F.col("__in_a").isNull() | F.col("__in_b").isNull()
    long = both.select(F.explode(F.array(*[F.struct(F.lit(x).alias("band"), (alone | ~F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}"))).alias("differs")) for x in bands])).alias("d"))
    return long.select("d.*").groupBy("band").agg(F.count(F.lit(1)).alias("cells"), F.count_if("differs").alias("differing"))


def require_same_bands(old: list[str], new: list[str]) -> None:
    if not old:
        raise CompareRefusal("the old run has no bands: nothing would be compared")
    if sorted(old) != sorted(new):
        raise CompareRefusal(f"band sets differ: {sorted(old)} and {sorted(new)}")


def changed_list(old: list[str], replaced: list[tuple[str, str]], added: list[str]) -> list[str]:
    """A declared list after a release: lines rewritten in place, then lines appended. Rewriting an absent line is refused."""
    out = list(old)
    for before, after in replaced:
        if before not in out:
            raise CompareRefusal(f"the line to be replaced is absent: {before!r}")
        out[out.index(before)] = after
    return out + list(added)


def list_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(line, change) of two tables of lines: added or removed."""
    gone = old.select(key).exceptAll(new.select(key)).withColumn("change", F.lit("removed"))
    come = new.select(key).exceptAll(old.select(key)).withColumn("change", F.lit("added"))
    return gone.unionByName(come)


def read_events(reads: DataFrame) -> DataFrame:
    """By configuration: reads, and events among them - an error, a non-zero exit, or a hash other than its tile's modal one.

    `reads`: config, tile, hash, exit_code, error. Equal counts are settled by the smaller hash.
    """
    counts = reads.where(F.col("hash").isNotNull()).groupBy("tile", "hash").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("tile").agg(F.min_by("hash", F.struct(-F.col("n"), F.col("hash"))).alias("modal"))
    event = F.col("error").isNotNull() | (F.coalesce(F.col("exit_code"), F.lit(0)) != 0) | ~F.col("hash").eqNullSafe(F.col("modal"))
    return reads.join(modal, "tile", "left").groupBy("config").agg(F.count(F.lit(1)).alias("reads"), F.count_if(event).alias("events"))
