"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.operators import accumulate, basis, blocks, catalogue, compare, ground, neighbours, profiles, steps, stencil
from cellbasis.plans.session import ready
from cellbasis.sinks import bands
from cellbasis.sources import documents, returns
from cellbasis.streaming import fold

GRID = Grid(0.0, 120.0, 0.5, 240, 240, 3763)
COARSE = GRID.coarse(2)
INNER = Grid(20.0, 100.0, 0.5, 160, 160, 3763)
AOI = (10.0, 10.0, 150.0, 130.0)
VALUE = "min_z"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
    return fn


# ---- shared inputs ---------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.from_lineitem(spark, sf_dir)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.without_noise(_raw(spark, sf_dir))


def _referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns with the class that another filter gave them: its own verdict where it judged, the delivery's elsewhere."""
    raw = _raw(spark, sf_dir)
    seen = compare.judged(F.col("classification"), F.col("return_number"), F.col("number_of_returns"))
    theirs = F.when(F.col("pulse") % 3 == 0, F.lit(2)).otherwise(F.lit(1))
    return raw.withColumn("reference_class", F.when(seen, theirs).otherwise(F.col("classification")).cast("smallint"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.cell_stats(_points(spark, sf_dir), GRID)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.dense(_stats(spark, sf_dir), GRID)


def _terrace(width: int):
    """The known terrace under a column; stands in for a fill where only a filled surface is wanted."""
    return F.floor(F.col("col") / width) * F.lit(1.5)


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("row", "col", F.coalesce(F.col(VALUE).cast("double"), _terrace(24)).alias("z"))


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block minima on the coarse grid, dense, with holes."""
    return COARSE.cells(spark).join(accumulate.block_min(_stats(spark, sf_dir), 2), ["row", "col"], "left")


def _coarse_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir).select("row", "col", F.coalesce(F.col(VALUE).cast("double"), _terrace(12)).alias("z"))


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cells with a plain ground mask: within half a unit of the known terrace."""
    near = F.coalesce(F.col(VALUE).cast("double") - _terrace(24) <= 0.5, F.lit(False))
    return _dense(spark, sf_dir).withColumn("is_ground", near)


def _based(spark: SparkSession, sf_dir: str, distance: float = 2.0) -> DataFrame:
    return basis.basis(_grounded(spark, sf_dir), GRID, distance=distance, check=False)


def _surfaces(spark: SparkSession, sf_dir: str, distance: float = 2.0) -> DataFrame:
    return basis.surfaces(_based(spark, sf_dir, distance))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile catalogue over supplier: overlapping boxes on a lattice, flown on five days."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    minx, miny = (F.col("s_suppkey") % 10) * F.lit(20.0), (F.floor(F.col("s_suppkey") / 10) % 10) * F.lit(20.0)
    stamp = F.expr("timestamp_ntz'2024-07-01 00:00:00' + make_dt_interval(cast(floor(s_nationkey / 5) as int), 0, cast(s_nationkey % 5 as int), 0)")
    return s.select(
        F.concat(F.lit("T"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("item_id"), minx.alias("minx"), miny.alias("miny"), (minx + 22.0).alias("maxx"), (miny + 20.5).alias("maxy"),
        F.lit(3763).alias("crs_epsg"), (F.lit(400) + F.col("s_suppkey") * 37).alias("point_count"), stamp.alias("stamp"),
    )


def _referenced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.cell_stats(returns.without_noise(_referenced(spark, sf_dir)), GRID, compare.reference_aggregates())


# ---- fold ------------------------------------------------------------------------------------------------


@query
def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query
def cell_stats_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@query
def noise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.tile_facts(_raw(spark, sf_dir))


@query
def outside_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.outside_count(_points(spark, sf_dir), INNER)


@query
def stray_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    part = lambda i: F.element_at(F.split("tile_id", "_"), i).cast("double") * 40.0
    boxes = raw.select("tile_id").distinct().select("tile_id", part(2).alias("fminx"), part(1).alias("fminy"), (part(2) + 39.5).alias("fmaxx"), (part(1) + 39.5).alias("fmaxy"))
    found = returns.stray_counts(raw, boxes)
    return found.select("tile_id", "n_stray", F.col("first_stray.x").alias("first_x"), F.col("first_stray.y").alias("first_y"))


@query
def sample_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = returns.sample(_raw(spark, sf_dir), 30.0, 30.0, 45.0, 45.0)
    return cut.select("x", "y", "z", F.col("classification").cast("int").alias("classification"), F.col("return_number").cast("int").alias("return_number"))


@query
def judged_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.judged_controls(_referenced(spark, sf_dir))


@query
def reference_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _referenced_cells(spark, sf_dir)


@query
def class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select("tile_id", F.col("classification").cast("int").alias("class"))
    return raw.rollup("tile_id", "class").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


@query
def block_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.block_min(_stats(spark, sf_dir), 2)


@query
def block_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir)
    coarse = accumulate.block_min(stats, 4).withColumnRenamed(VALUE, "block_min_z")
    return accumulate.upsample(stats.select("row", "col", VALUE), coarse, 4, ["block_min_z"])


# ---- populations and stencils ----------------------------------------------------------------------------


@query
def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = accumulate.dense(_referenced_cells(spark, sf_dir), GRID, ("n_all", "n_ground", "n_class5", "n_class6", "n_reference_ground"))
    out = compare.population_shares(compare.populations(cells, 1), {"repeated": F.col("n_all") >= 2, "reference_ground": F.col("n_reference_ground") > 0})
    return out.withColumn("repeated_pct", F.lit(100.0) * F.try_divide(F.col("repeated"), F.col("cells")))


@query
def interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _dense(spark, sf_dir).select("row", "col", (F.col("n_all") > 0).alias("m"))
    return stencil.interior(cells, "m", 1).select("row", "col")


@query
def step_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.step_magnitude(_dense(spark, sf_dir), GRID, "min_z_ground")


@query
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.gradient(_coarse(spark, sf_dir), VALUE).where(F.col(VALUE).isNotNull()).select("row", "col", "gx", "gy")


@query
def square_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = stencil.square_opening(_filled(spark, sf_dir), 1, "z", "z1")
    return stencil.square_opening(once.select("row", "col", "z1"), 2, "z1", "z2").select("row", "col", "z1", "z2")


@query
def pmf_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.opening_ground(_dense(spark, sf_dir), GRID)


@query
def diamond_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.diamond(_coarse_filled(spark, sf_dir), COARSE, 3, "z", False, "eroded")


@query
def diamond_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.diamond(_coarse_filled(spark, sf_dir), COARSE, 3, "z", True, "dilated")


@query
def low_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the surface of maxima, whose pits are the gaps between roofs and crowns."""
    top = accumulate.dense(_stats(spark, sf_dir), GRID).select("row", "col", F.coalesce(F.col("max_z").cast("double"), _terrace(24)).alias("z"))
    return ground.low_outliers(top, GRID, "z").where("flagged").select("row", "col")


@query
def progressive_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.progressive_flags(_coarse_filled(spark, sf_dir), COARSE, "z", 0.15, 3.0)


@query
def progressive_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.chunked_flags(_coarse_filled(spark, sf_dir), COARSE, "z", 0.15, 3.0, chunk=50)


@query
def knn_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _coarse(spark, sf_dir).select("row", "col", F.col(VALUE).cast("double").alias("z"))
    return neighbours.knn_fill(cells, COARSE, "z")


@query
def smrf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.progressive_ground(_dense(spark, sf_dir).checkpoint(), GRID)


# ---- basis and bands -------------------------------------------------------------------------------------


@query
def nearest_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _based(spark, sf_dir).select("row", "col", F.col("basis").cast("int").alias("basis"), "src_row", "src_col")


@query
def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surfaces(spark, sf_dir).withColumn("basis", F.col("basis").cast("int"))


@query
def honesty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis.honesty(_based(spark, sf_dir), GRID).withColumn("expected_void_fraction", F.round("expected_void_fraction", 12))


@query
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis.agreement(_grounded(spark, sf_dir), check=False)


@query
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _referenced_cells(spark, sf_dir)
    ours = F.col(VALUE).cast("double") - _terrace(24) <= 0.5
    both = cells.select(ours.alias("ours"), (F.col("n_reference_ground") > 0).alias("theirs"))
    out = basis.kappa(basis.confusion(both, "ours", "theirs"))
    return out.withColumns({"agreement_pct": F.round("agreement_pct", 9), "kappa": F.round("kappa", 9)})


@query
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the cells on a step, those a plain mask calls ground that a stricter one keeps."""
    cells = _grounded(spark, sf_dir)
    step = stencil.step_magnitude(_dense(spark, sf_dir), GRID, "min_z_ground").where("step > 1.5").select("row", "col", F.lit(True).alias("on_step"))
    marked = cells.join(step, ["row", "col"], "left")
    strict = F.coalesce(F.col(VALUE).cast("double") - _terrace(24) <= 0.0625, F.lit(False))
    return compare.retention(marked, F.coalesce("on_step", F.lit(False)), F.col("is_ground"), strict)


@query
def band_unpivot_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.long_form(bands.encoded(_surfaces(spark, sf_dir)))


@query
def rgba_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.levels(_dense(spark, sf_dir).select("row", "col", VALUE), VALUE)


@query
def basis_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = bands.basis_colour(F.col("basis"))
    out = _based(spark, sf_dir).select(rgb.alias("c"))
    return out.groupBy(F.col("c")[0].alias("r"), F.col("c")[1].alias("g"), F.col("c")[2].alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.run_difference(_surfaces(spark, sf_dir), _surfaces(spark, sf_dir, 1.0), ["mdt", "mds", "chm", "basis"])


# ---- steps and profiles ----------------------------------------------------------------------------------


@query
def plane_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _dense(spark, sf_dir)
    at = stencil.step_magnitude(cells, GRID, VALUE).where("step > 2.5")
    fits = steps.plane_residual(cells, at, GRID, VALUE)
    return fits.withColumn("residual", F.round("residual", 6))


@query
def sharp_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps.sharp_steps(_dense(spark, sf_dir), GRID, "min_z_ground", threshold=1.5, residual=0.3)
    return found.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("in_population").alias("population"))


@query
def verified_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps.sharp_steps(_dense(spark, sf_dir), GRID, "min_z_ground", threshold=1.5, residual=0.3).where("in_population")
    points = [("riser", 12.1, 60.2), ("tread", 6.3, 60.2), ("second riser", 24.2, 33.3), ("edge", 0.4, 0.4), ("outside", -5.0, 10.0)]
    return steps.nearest_hits(found, points, GRID).select("name", "prow", "pcol", "inside", "found")


def _ground_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("row", "col", F.coalesce(F.col("min_z_ground").cast("double"), _terrace(24)).alias("z"))


@query
def relief_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.relief(_dense(spark, sf_dir), GRID, "min_z_ground")


@query
def risers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.risers(_ground_line(spark, sf_dir), GRID, "z")


@query
def riser_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.risers(_ground_line(spark, sf_dir), GRID, "z")
    order = F.when(F.col("direction") == "row", 0).when(F.col("direction") == "col", 1).when(F.col("direction") == "diag", 2).otherwise(3)
    placed = found.withColumns({"x": F.bround(GRID.center_x(F.col("col")), 2), "y": F.bround(GRID.center_y(F.col("row")), 2), "seq": order.cast("long") * GRID.n_cells + F.col("row") * GRID.n_cols + F.col("col")})
    kept = profiles.clusters(placed.checkpoint(), 5.0, [-F.col("height")])
    return kept.select("direction", "row", "col", "height", "x", "y")


@query
def riser_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's list of the highest twenty."""
    return risers(spark, sf_dir).orderBy(F.desc("height"), "direction", "row", "col").limit(20)


@query
def canopy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.height_histogram(blocks.heights(_points(spark, sf_dir), (0.0, 0.0)))


@query
def block_canopy_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.canopy_shares(blocks.heights(_points(spark, sf_dir), (0.0, 0.0)), (0.0, 0.0), 20.0)


@query
def lift_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lift = (F.col("min_z_reference_ground").cast("double") - F.col(VALUE).cast("double")).alias("lift")
    cells = _referenced_cells(spark, sf_dir).where(F.col("min_z_reference_ground").isNotNull()).select(lift)
    above = lambda v: F.try_divide(F.count_if(F.col("lift") > v), F.count(F.lit(1)))
    return cells.agg(F.percentile("lift", F.lit(0.5)).alias("p50"), F.percentile("lift", F.lit(0.9)).alias("p90"), above(0.05).alias("over_005"), above(0.25).alias("over_025"), above(1.0).alias("over_1"))


# ---- catalogue -------------------------------------------------------------------------------------------


@query
def sorties(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").alias("stamp"))
    out = catalogue.sorties(events, ["user_id"])
    return out.groupBy("user_id", "sortie").agg(F.count(F.lit(1)).alias("n"), F.min("stamp").alias("first_ts"), F.max("stamp").alias("last_ts"))


@query
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.covered_area(_tiles(spark, sf_dir).where(catalogue.overlap(AOI) > 0), AOI)


@query
def tile_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy(*catalogue.footprint()).orderBy("item_id")
    return _tiles(spark, sf_dir).select("item_id", (F.row_number().over(order) == 1).alias("kept"))


@query
def select_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.chosen(_tiles(spark, sf_dir), AOI).select("item_id", "minx", "miny", "overlap", "sortie", "dominant", "kept")


@query
def precheck_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogue.void_estimates(_tiles(spark, sf_dir), 0.5, 0.4)
    return out.select("item_id", "density", F.round("void_open", 12).alias("void_open"), F.round("void_at_f", 12).alias("void_at_f"))


@query
def precheck_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogue.precheck(_tiles(spark, sf_dir), 0.5, 0.4, allow_sparse=True)
    return out.agg(F.min_by("item_id", F.struct(-F.col("void_at_f"), F.col("item_id"))).alias("item_id"), F.round(F.max("void_at_f"), 12).alias("void_at_f"))


@query
def lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("item")).distinct()
    known = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey % 3 != 0").select(F.col("s_suppkey").alias("item"))
    return read.join(known, "item", "left_anti")


@query
def seam_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = returns.tile_facts(_raw(spark, sf_dir))
    return compare.seam_cells(spark, facts, GRID, 1.0)


@query
def stac_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    wkt = 'PROJCS["ETRS89_Portugal_TM06",GEOGCS["ETRS89",AUTHORITY["EPSG","4258"]],UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["Easting",EAST]]'
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    uid, one = F.col("user_id").cast("double"), F.lit(1.0)
    box = F.when(F.col("event_id") % 2 == 0, F.array(uid, k, uid + one, k + one)).otherwise(F.array(uid, k, F.lit(0.0), uid + one, k + one, F.lit(9.0)))
    properties = F.struct(
        F.col("event_id").alias("pc:count"), F.lit("2024-07-01T22:00:00Z").alias("datetime"), (F.col("event_id") * 30).alias("file:size"), box.alias("proj:bbox"), F.lit(wkt).alias("proj:wkt2")
    )
    item = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("LAZ").alias("collection"), properties.alias("properties"), F.struct(F.struct(F.col("event_type").alias("href")).alias("data")).alias("assets"))
    bodies = events.select(F.to_json(F.struct(F.array(item).alias("features"))).alias("body"))
    return documents.parse_search(bodies, "body", 100)


@query
def read_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    reads = orders.select(
        F.col("o_orderpriority").alias("config"), (F.col("o_custkey") % 50).alias("tile"), F.when(F.col("o_orderkey") % 101 != 0, F.col("o_orderstatus")).alias("hash"),
        F.when(F.col("o_orderkey") % 97 == 0, 1).otherwise(0).alias("exit_code"), F.when(F.col("o_orderkey") % 101 == 0, F.lit("unreadable")).alias("error"),
    )
    return compare.read_events(reads)


@query
def list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return compare.list_difference(part.where("p_partkey % 3 != 0").select("p_type"), part.where("p_partkey % 3 != 1").select("p_type"), "p_type").groupBy("p_type", "change").agg(F.count(F.lit(1)).alias("n"))


# ---- streaming -------------------------------------------------------------------------------------------


@query
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    live = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/lineitem.parquet*")
    return fold.drain(fold.stream_fold(returns.view_of(live), GRID), f"fold_{uuid.uuid4().hex}")
