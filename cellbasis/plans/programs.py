"""Programs around the engine: two runs compared, a first look at real tiles, repeated reads, and how planar the steps are."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import CompareRefusal
from cellbasis.functions.scalars import GROUND, check_void, ratio
from cellbasis.operators import blocks, catalogue, compare, steps
from cellbasis.sinks.record import append_lines
from cellbasis.sources import las, raster, returns
from cellbasis.sources.files import opened

# Fields of the record that may differ between two runs of one release, and the bounds of planar windows in metres.
MAY_DIFFER = ("created_utc", "package_version", "reproducibility_hash")
RESIDUAL_BANDS = (0.10, 0.20, 0.30, 0.50)
GATE = 2.5


# ---- two runs ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Line:
    subject: str
    said: str


@dataclass
class Comparison:
    """What was compared and what was found. Exit code 0: nothing that must be equal differs; 1: something does; 2: not comparable so."""

    lines: list[Line] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)
    comparable: bool = True

    @property
    def exit_code(self) -> int:
        return 2 if not self.comparable else 1 if self.problems else 0


def _record(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/record.json", wholetext=True).first()[0])


def compare_bands(spark: SparkSession, old: str, new: str) -> tuple[list[Line], list[str]]:
    """Every band of two folders with the same band sets: cells, differing cells, and whether sentinel, shape and place are equal."""
    heads = {name: {r.band: r for r in raster.headers(spark, folder).collect()} for name, folder in (("old", old), ("new", new))}  # one row a band
    problems = []
    for band, a in sorted(heads["old"].items()):
        b = heads["new"][band]
        problems += [f"{band}: {what} {a[what]} became {b[what]}" for what in ("rows", "cols", "nodata", "cell", "origin_x", "origin_y") if a[what] != b[what]]
        problems += [f"{band}: {side[band].nans} values of the {name} run are not numbers" for name, side in heads.items() if side[band].nans]
    lines = []
    for r in raster.compare_folders(spark, old, new).orderBy("band").collect():
        lines.append(Line(r.band, f"{r.cells} cells, {r.differing} differ"))
        if r.differing:
            problems.append(f"{r.band}: {r.differing} of {r.cells} cells differ")
    return lines, problems


def compare_records(old: dict, new: dict, tell_only: bool = False, changes: dict[str, dict] | None = None) -> tuple[list[Line], list[str]]:
    """Two records field by field. Those that MAY_DIFFER are told; others are problems, or told too with `tell_only`. The list of
    limitations must be the old one, or with `changes` the old one after the new release's declared change."""
    lines, problems = [], []
    for k in sorted(set(old) | set(new)):
        if k == "known_limitations":
            continue
        if k in MAY_DIFFER:
            lines.append(Line(k, f"{old.get(k)} -> {new.get(k)}"))
        elif old.get(k) != new.get(k):
            if tell_only:
                lines.append(Line(k, "changed, which is told and not judged here"))
            else:
                problems.append(f"record: {k} changed")
    before, after = list(old.get("known_limitations") or ()), list(new.get("known_limitations") or ())
    lines.append(Line("known_limitations", f"{len(before)} -> {len(after)} entries"))
    expected: list[str] | None = before
    if changes is not None:
        release = str(new.get("package_version") or "")
        if release not in changes:
            return lines, [*problems, f"no change of the limitations is declared for release {release!r}; known: {', '.join(sorted(changes)) or 'none'}"]
        try:
            expected = compare.changed_list(before, [tuple(x) for x in changes[release].get("replaced", ())], changes[release].get("added", []))
        except CompareRefusal as e:
            problems.append(str(e))
            expected = None  # what it should be cannot be said
    if expected is not None and after != expected:
        problems.append(f"record: known_limitations has {sorted(set(after) - set(expected))} too many and lacks {sorted(set(expected) - set(after))}, or their order changed")
    return lines, problems


def compare_runs(spark: SparkSession, old: str, new: str, record_only: bool = False, changes: dict[str, dict] | None = None) -> Comparison:
    """Two folders of image files and records. With `record_only`, which only makes sense between two releases, the bands' contents are
    left out; that there are bands, and the same ones, is checked all the same."""
    out = Comparison()
    names = {k: raster.band_names(spark, folder) for k, folder in (("old", old), ("new", new))}
    if not names["old"]:
        out.problems.append(f"no rasters in {old}: nothing was compared")
    if names["old"] != names["new"]:
        out.problems.append(f"band sets differ: {names['old']} and {names['new']}")
    a, b = _record(spark, old), _record(spark, new)
    if record_only and a.get("package_version") == b.get("package_version"):
        out.problems.append(f"both runs are of release {a.get('package_version')}: their bands are what there is to compare")
        out.comparable = False
        return out
    if not out.problems and not record_only:
        lines, problems = compare_bands(spark, old, new)
        out.lines += lines
        out.problems += problems
    lines, problems = compare_records(a, b, record_only, changes)
    out.lines += lines
    out.problems += problems
    return out


# ---- a first look at tiles ---------------------------------------------------------------------------------


def tile_counts(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile_id, declared, measured, delta, same_box) of every tile read, against the catalogue; a tile that it lacks is refused."""
    facts = returns.tile_facts(points).withColumnRenamed("tile_id", "item_id").withColumnsRenamed({c: f"read_{c}" for c in ("minx", "miny", "maxx", "maxy")})
    both = catalogue.with_catalogue(facts, tiles)
    same = F.lit(True)
    for c in ("minx", "miny", "maxx", "maxy"):
        same = same & (F.bround(f"read_{c}", 3) == F.col(c))
    return both.select(F.col("item_id").alias("tile_id"), F.col("point_count").alias("declared"), F.col("n_in_file").cast("long").alias("measured"), (F.col("n_in_file") - F.col("point_count")).alias("delta"), same.alias("same_box"))


def smoke(points: DataFrame, tiles: DataFrame, box: tuple[float, float, float, float], fine: float = 10.0, coarse: float = 100.0, cell: float = 0.5) -> dict:
    """A first look at real tiles: counts against the catalogue, heights over block ground, canopy by block, classes, and the voids to
    expect, over the returns of a half-open box."""
    here = returns.sample(points, *box)
    inside = returns.without_noise(here)
    high = blocks.heights(inside, (box[0], box[1]), fine)
    heights = high.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("height") >= 2).alias("over_2"), F.count_if(F.col("height") >= 5).alias("over_5")).first()
    shares = blocks.canopy_shares(high, (box[0], box[1]), coarse).agg(
        F.count(F.lit(1)).alias("blocks"), F.min("share").alias("least"), F.percentile("share", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p10_p50_p90"), F.max("share").alias("most"),
        F.count_if(F.col("share") < 0.05).alias("bare"), F.count_if(F.col("share") > 0.5).alias("covered"),
    ).first()
    classes = {r["classification"]: r["n"] for r in inside.groupBy("classification").agg(F.count(F.lit(1)).alias("n")).collect()}
    ground, area = classes.get(GROUND, 0), (box[2] - box[0]) * (box[3] - box[1])
    return {
        "tiles": [r.asDict() for r in tile_counts(points, tiles).orderBy("tile_id").collect()],
        "returns": inside.count(), "with_ground_below": heights["n"], "histogram": {r["bin"]: r["n"] for r in blocks.height_histogram(high).collect()},
        "share_over_2": heights["over_2"] / heights["n"] if heights["n"] else None, "share_over_5": heights["over_5"] / heights["n"] if heights["n"] else None,
        "canopy": shares.asDict(), "classes": dict(sorted(classes.items())), "ground_share": ground / heights["n"] if heights["n"] else None,
        "ground_density": ground / area, "expected_void": check_void(ground / area, cell, 1.0) if ground else None,
    }


# ---- repeated reads ----------------------------------------------------------------------------------------


def read_once(spark: SparkSession, folder: str, config: str, number: int) -> DataFrame:
    """One pass over the folder's tiles: for each its digests, of the raw points and of what was decoded, and the seconds it took, or
    the error. An error is a row like any other."""
    files = las.contents(spark, folder).select(F.col("tile_id").alias("tile"), "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for part in batches:
            for tile, path, content in part.itertuples(index=False):
                began, row = time.monotonic(), {"tile": tile, "config": config, "rep": number, "hash": None, "raw_hash": None, "points": None, "exit_code": 0, "error": None}
                try:
                    raw, decoded = hashlib.sha256(), hashlib.sha256()
                    with opened(path, content) as file:
                        head = las.head_of(file, tile)
                        for c in ("x", "y", "z", "classification"):  # a digest of whole columns, one after the other, of which a slice is held
                            for _, n, data in las.slices(file, head):
                                decoded.update(np.ascontiguousarray(las.points(data, head | {"start": 0}, 0, n)[c]).tobytes())
                                if c == "x":
                                    raw.update(data)
                    row |= {"hash": decoded.hexdigest(), "raw_hash": raw.hexdigest(), "points": head["count"]}
                except Exception as e:  # whatever goes wrong with a read is what this looks for
                    row |= {"error": f"{type(e).__name__}: {e}", "exit_code": 1}
                yield pd.DataFrame([row | {"seconds": round(time.monotonic() - began, 3)}]).astype({"points": "Int64"})

    return files.mapInPandas(run, "tile string, config string, rep int, hash string, raw_hash string, points long, exit_code int, error string, seconds double")


def read_passes(spark: SparkSession, folder: str, passes: int, out: str, config: str = "default") -> None:
    """Add `passes` passes over the folder's tiles to a folder of JSON lines."""
    for number in range(passes):
        append_lines(read_once(spark, folder, config, number), out)


def stability(spark: SparkSession, out: str) -> DataFrame:
    """Reads and events by configuration, of what `read_passes` has written."""
    rows = spark.read.schema("tile string, config string, hash string, exit_code int, error string").json(out)
    return compare.read_events(rows)


# ---- how planar the steps are ------------------------------------------------------------------------------


def ramp_confound(cells: DataFrame, grid: Grid, measured: str, masks: list[str], value: str = "min_z_ground", gate: float = GATE, window: int = 7) -> DataFrame:
    """(subset, cells, kept by each mask in percent) of the measured cells on a step above the gate, all of them and by how far their
    window is from a plane: a planar one is a ramp and no step. NULL of no cells."""
    found = steps.sharp_steps(cells, grid, value, window=window, threshold=gate, residual=RESIDUAL_BANDS[-1]).join(cells.select("row", "col", measured, *masks), ["row", "col"])
    found = found.where(F.coalesce(F.col(measured), F.lit(False)))
    subsets = {"all": F.lit(True)} | {f"residual >= {b:.2f}": F.coalesce(F.col("residual") >= b, F.lit(False)) for b in RESIDUAL_BANDS}
    subsets[f"residual < {RESIDUAL_BANDS[0]:.2f}"] = F.coalesce(F.col("residual") < RESIDUAL_BANDS[0], F.lit(False))
    pct = lambda member, m: F.nanvl(F.lit(100.0) * ratio(F.count_if(member & F.coalesce(F.col(m), F.lit(False))), F.count_if(member)), F.lit(None))
    # one row whatever was found, so each subset has its own
    told = found.agg(*[F.struct(F.lit(k).alias("subset"), F.count_if(member).alias("cells"), *[pct(member, m).alias(f"{m}_pct") for m in masks]).alias(f"s{i}") for i, (k, member) in enumerate(subsets.items())])
    return told.select(F.explode(F.array(*told.columns)).alias("s")).select("s.*")
