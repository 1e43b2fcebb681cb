"""Tiles of a catalogue: sorties, coverage, selection, and what to expect before downloading.

Columns of a catalogue: item_id, minx, miny, maxx, maxy, crs_epsg, point_count, stamp (a timestamp).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellbasis.functions.refusals import PrecheckRefusal, SelectionRefusal, StampRefusal
from cellbasis.functions.scalars import check_void, void_fraction

GAP_HOURS = 6.0
Box = tuple[float, float, float, float]


def stamps_from_text(frame: DataFrame, text: str, out: str = "stamp") -> DataFrame:
    """`out`: the instant that an ISO-8601 text names; refuses texts that name none or carry no offset."""
    zoned = F.col(text).rlike(r"(Z|z|[+-]\d{2}:?\d{2})$")
    parsed = F.try_to_timestamp(F.col(text))
    bad = frame.where(F.col(text).isNotNull() & (~zoned | parsed.isNull())).select(text).first()
    if bad:
        raise StampRefusal(f"{bad[0]!r} is not an ISO-8601 instant with an offset")
    return frame.withColumn(out, parsed)


def sorties(stamps: DataFrame, keys: list[str], stamp: str = "stamp", gap_hours: float = GAP_HOURS) -> DataFrame:
    """`stamps` with `sortie`, counted from 0 by `keys`: a new one begins where more than the gap lies between two stamps."""
    if not gap_hours > 0:
        raise StampRefusal(f"the gap must be positive, got {gap_hours}")
    order = Window.partitionBy(*keys).orderBy(stamp)
    micros = F.unix_micros(F.col(stamp).cast("timestamp"))
    apart = micros - F.lag(micros).over(order) > F.lit(round(gap_hours * 3_600_000_000))
    out = stamps.withColumn("__new", F.coalesce(apart, F.lit(False)).cast("int"))
    running = order.rangeBetween(Window.unboundedPreceding, 0)
    return out.withColumn("sortie", F.sum("__new").over(running).cast("int")).drop("__new")


def overlap(box: Box) -> Column:
    """Area that a tile shares with the box; 0 for touching edges."""
    w = F.least(F.col("maxx"), F.lit(box[2])) - F.greatest(F.col("minx"), F.lit(box[0]))
    h = F.least(F.col("maxy"), F.lit(box[3])) - F.greatest(F.col("miny"), F.lit(box[1]))
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def covered_area(tiles: DataFrame, box: Box) -> DataFrame:
    """One row (covered, fraction): the area of the box under the union of the tiles, exactly.

    The clamped edges cut the box into elementary rectangles; each counts once, however many tiles span it. The number of
    edges follows the catalogue of one area, not the returns.
    """
    clamp = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.lit(float(lo))), F.lit(float(hi)))
    t = tiles.select(clamp("minx", box[0], box[2]).alias("x0"), clamp("maxx", box[0], box[2]).alias("x1"), clamp("miny", box[1], box[3]).alias("y0"), clamp("maxy", box[1], box[3]).alias("y1"))

    def intervals(a: str, b: str, name: str) -> DataFrame:
        edges = t.select(F.explode(F.array(a, b)).alias("e")).distinct()
        return edges.select(F.col("e").alias(f"{name}0"), F.lead("e").over(Window.orderBy("e")).alias(f"{name}1")).where(F.col(f"{name}1").isNotNull())

    xs, ys = intervals("x0", "x1", "ex"), intervals("y0", "y1", "ey")
    # per strip of x only the tiles that span it meet the strips of y
    strips = t.join(F.broadcast(xs), (F.col("x0") <= F.col("ex0")) & (F.col("x1") >= F.col("ex1"))).select("ex0", "ex1", "y0", "y1").distinct()
    pieces = strips.join(F.broadcast(ys), (F.col("y0") <= F.col("ey0")) & (F.col("y1") >= F.col("ey1"))).select("ex0", "ex1", "ey0", "ey1").distinct()
    total = pieces.agg(F.coalesce(F.sum((F.col("ex1") - F.col("ex0")) * (F.col("ey1") - F.col("ey0"))), F.lit(0.0)).alias("covered"))
    return total.withColumn("fraction", F.col("covered") / F.lit((box[2] - box[0]) * (box[3] - box[1])))


def footprint() -> list[Column]:
    """The lower corner to the millimetre, ties to even: tiles with equal ones are acquisitions of one footprint."""
    return [F.bround("minx", 3), F.bround("miny", 3)]


def chosen(tiles: DataFrame, box: Box, gap_hours: float = GAP_HOURS) -> DataFrame:
    """Tiles that overlap the box, with sortie, whether theirs is the dominant one (the largest sum of overlaps; the earliest of
    equals), and `kept`: the first of each footprint, the dominant sortie's before others, then by item_id."""
    touching = sorties(tiles.withColumn("overlap", overlap(box)).where("overlap > 0").withColumn("__all", F.lit(1)), ["__all"], gap_hours=gap_hours).drop("__all")
    best = touching.groupBy("sortie").agg(F.sum("overlap").alias("area")).agg(F.min_by("sortie", F.struct(-F.col("area"), F.col("sortie"))).alias("dominant"))
    joined = touching.crossJoin(F.broadcast(best))
    order = Window.partitionBy(*footprint()).orderBy(F.col("sortie") != F.col("dominant"), "item_id")
    return joined.withColumn("kept", F.row_number().over(order) == 1)


@dataclass(frozen=True)
class Selection:
    """The tiles that cover an area, ordered by corner, and what was found on the way."""

    tiles: DataFrame
    covered_fraction: float
    sorties: int
    mixed_epochs: bool
    dropped: list[str]


def select_tiles(tiles: DataFrame, box: Box, allow_mixed: bool = False, min_coverage: float = 0.999, max_km2: float = 200.0, gap_hours: float = GAP_HOURS) -> Selection:
    """Tiles for a box, or a refusal: empty box, no tile, several systems, several sorties, too little or too much."""
    if (box[2] - box[0]) * (box[3] - box[1]) <= 0:
        raise SelectionRefusal(f"empty area {box}")
    out = chosen(tiles, box, gap_hours).persist()
    facts = out.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("crs_epsg")).alias("crs"), F.count_if(F.col("crs_epsg").isNull()).alias("unnamed")).first()
    if not facts["n"]:
        raise SelectionRefusal(f"no tile overlaps {box}")
    if facts["unnamed"]:
        raise SelectionRefusal(f"{facts['unnamed']} tile(s) name no system of coordinates")
    if len(facts["crs"]) > 1:
        raise SelectionRefusal(f"the tiles are in several systems: {facts['crs']}")
    kept = out.where("kept")
    again = sorties(kept.drop("sortie").withColumn("__all", F.lit(1)), ["__all"], gap_hours=gap_hours)
    last = again.agg(F.max("sortie").alias("s"), F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area")).first()
    if last["s"] > 0 and not allow_mixed:
        raise SelectionRefusal(f"the area spans {last['s'] + 1} sorties; say that mixed epochs are allowed to accept that")
    share = covered_area(kept, box).first()["fraction"]
    if share < min_coverage:
        raise SelectionRefusal(f"the tiles cover {share:.4f} of the area, {min_coverage:.4f} is needed")
    if last["area"] / 1e6 > max_km2:
        raise SelectionRefusal(f"the tiles have {last['area'] / 1e6:.1f} km2, the cap is {max_km2}")
    dropped = [r.item_id for r in out.where("not kept").select("item_id").orderBy("item_id").collect()]
    return Selection(kept.orderBy("minx", "miny"), float(share), last["s"] + 1, last["s"] > 0, dropped)


def density() -> Column:
    return F.col("point_count") / ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))


def void_estimates(tiles: DataFrame, cell: float, ground_share: float) -> DataFrame:
    """By tile: density and the share of cells expected to hold no ground return, on open ground and at the ground share."""
    check_void(1.0, cell, ground_share)
    out = tiles.withColumn("density", density())
    return out.select("item_id", "density", "stamp", void_fraction(F.col("density"), cell, 1.0).alias("void_open"), void_fraction(F.col("density"), cell, ground_share).alias("void_at_f"))


def precheck(tiles: DataFrame, cell: float, ground_share: float, ceiling: float = 0.35, allow_sparse: bool = False) -> DataFrame:
    """`void_estimates`, refused if the worst tile is above the ceiling; the first by item_id of equals is named."""
    if not (math.isfinite(ceiling) and 0 < ceiling < 1):
        raise PrecheckRefusal(f"the ceiling must be a share between 0 and 1, got {ceiling}")
    out = void_estimates(tiles, cell, ground_share)
    worst = out.orderBy(F.desc("void_at_f"), "item_id").first()
    if worst and worst["void_at_f"] > ceiling and not allow_sparse:
        raise PrecheckRefusal(f"tile {worst['item_id']} with {worst['density']:.1f} returns a square metre leaves {worst['void_at_f']:.1%} of cells without ground; the ceiling is {ceiling:.0%}")
    return out


def with_catalogue(tiles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Tiles read joined with their catalogue entry; refuses tiles that have none. The catalogue is joined by key; Spark
    broadcasts it where its size allows."""
    missing = tiles.join(catalogue, "item_id", "left_anti").select("item_id").orderBy("item_id").limit(5).collect()
    if missing:
        raise SelectionRefusal(f"not in the selection: {', '.join(str(r.item_id) for r in missing)}")
    return tiles.join(catalogue, "item_id", "left")
