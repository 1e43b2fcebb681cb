"""Verdicts, reports and the command line."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellbasis.__main__ import main
from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import CompareRefusal, RenderRefusal, SelectionRefusal
from cellbasis.plans import product, programs, queries, reports, verdicts
from cellbasis.sinks import bands
from cellbasis.sources import las, returns, synthetic

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cells(spark):
    from cellbasis.operators import accumulate, compare

    raw = returns.without_noise(queries._referenced(spark, SF))
    stats = accumulate.cell_stats(raw, queries.GRID, compare.reference_aggregates())
    out = accumulate.dense(stats, queries.GRID, ("n_all", "n_ground", "n_class5", "n_class6", "n_reference_ground"))
    near = F.coalesce(F.col("min_z").cast("double") - queries._terrace(24) <= 0.5, F.lit(False))
    return out.withColumns({"is_ground": near, "theirs": F.col("n_reference_ground") > 0}).cache()


def test_filter_verdict(spark, cells):
    tiles = returns.tile_facts(returns.from_lineitem(spark, SF))
    verdict, more = verdicts.filter_verdict(cells, queries.GRID, tiles)
    assert {r["name"] for r in verdict.rows} == {"building", "building_no_ground", "roof_interior", "canopy_only", "plain_ground"}
    assert [c[0] for c in verdict.checks] == ["plain ground called ground", "roof called ground", "agreement", "kappa"]
    assert verdict.exit_code == (0 if verdict.passed else 1)
    assert more["away_from_seams"]["n_cells"] < more["overall"]["n_cells"]
    same, _ = verdicts.filter_verdict(cells.withColumn("is_ground", F.col("theirs")), queries.GRID, tiles)
    assert [c[4] for c in same.checks][2:] == [True, True]
    with pytest.raises(CompareRefusal, match="n_class5"):
        verdicts.filter_verdict(cells.drop("n_class5"), queries.GRID, tiles)


def test_terrace_verdict(spark, cells):
    with pytest.raises(CompareRefusal, match="nothing was tested"):
        verdicts.terrace_verdict(cells, queries.GRID, "is_ground", "theirs", "theirs")
    high = cells.withColumn("min_z_ground", F.col("min_z_ground") * 3)  # risers of 4.5
    verdict, extra = verdicts.terrace_verdict(high, queries.GRID, "is_ground", "is_ground", "theirs")
    assert verdict.passed and verdict.rows[0]["kept_pct"] == 100.0 and extra["cells"] > 0
    none, _ = verdicts.terrace_verdict(high.withColumn("no", F.lit(False)), queries.GRID, "is_ground", "no", "theirs")
    assert none.exit_code == 1


def test_share_of_nothing_passes_no_bound():
    assert not verdicts._check("x", math.nan, ">=", 0.0)[4] and not verdicts._check("x", None, "<=", 1.0)[4]


def test_crop(spark, cells):
    part, grid = verdicts.crop(cells, queries.GRID, (10.0, 20.0, 30.0, 50.0))
    assert part.count() == grid.n_cells == 40 * 60 and grid.origin_x == 10.0 and grid.origin_y == 50.0
    assert part.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first() == (0, 59, 0, 39)


def test_reports(spark, cells):
    part, grid = verdicts.crop(cells, queries.GRID, (0.0, 0.0, 60.0, 30.0))
    line = part.withColumn("z", F.coalesce(F.col("min_z_ground").cast("double"), queries._terrace(24)))
    report = reports.riser_report(line, grid, "z")
    assert report["n_candidates"] > report["n_clusters"] > 0 and len(report["top"]) <= 20 and report["height_max"] >= report["height_p90"]
    heights = [t["height"] for t in report["top"]]
    assert heights == sorted(heights, reverse=True)
    canopy = reports.canopy_report(returns.without_noise(returns.from_lineitem(spark, SF)), (0.0, 0.0), coarse=20.0)
    assert canopy["blocks"]["blocks"] == 36 and 0 < canopy["heights"]["over_2"] < 1 and sum(canopy["histogram"].values()) == canopy["heights"]["n"]
    sharp = reports.sharp_step_report(part, grid, ["is_ground"], threshold=1.5)
    assert sharp["candidates"] >= sharp["population"] and 0 <= sharp["is_ground_pct"] <= 100


def test_triage(spark):
    tiles = queries._tiles(spark, SF)
    told = reports.triage(tiles, queries.AOI)
    assert told["tiles"] == 100 and len(told["days"]) == 5 and told["coverage"] is None and "sorties" in told["refused"]
    assert reports.triage(tiles.limit(0), queries.AOI)["refused"] == "no coverage"


def tile_bytes(spark):
    p = synthetic.canopy(spark, side=20.0).toPandas()
    return las.encode(p.x.to_numpy(), p.y.to_numpy(), p.z.to_numpy(), p.classification.to_numpy().astype(np.uint8), 3763), p


def test_command_line(spark, tmp_path, capsys):
    data, p = tile_bytes(spark)
    (tmp_path / "las").mkdir()
    (tmp_path / "las/t.las").write_bytes(data)
    box = [48000.0, 169000.0, 48020.0, 169020.0]
    aoi = tmp_path / "aoi.json"
    aoi.write_text(json.dumps({"type": "Feature", "properties": {"bounds": box, "bounds_epsg": 3763}}))
    wkt = 'PROJCS["ETRS89_Portugal_TM06",UNIT["metre",1]]'
    item = {"id": "t", "collection": "LAZ", "properties": {"pc:count": len(p), "datetime": "2024-07-01T22:00:00Z", "file:size": len(data), "proj:bbox": box, "proj:wkt2": wkt}, "assets": {"data": {"href": "h"}}}
    search = tmp_path / "search.json"
    search.write_text(json.dumps({"features": [item]}))
    selection = tmp_path / "selection.json"
    assert main(["select", "--aoi", str(aoi), "--search", str(search), "--out", str(selection)], spark) == 0
    doc = json.loads(selection.read_text())
    assert doc["tiles"][0]["bbox"] == box and doc["covered_fraction"] == 1.0 and doc["sorties"] == [["2024-07-01T22:00:00Z"]]
    assert main(["precheck", "--aoi", str(aoi), "--search", str(search)], spark) == 0
    assert main(["precheck", "--aoi", str(aoi), "--search", str(search), "--max-void-fraction", "0.000001", "--cell", "0.05"], spark) == 1
    run = ["run", "--aoi", str(aoi), "--las", str(tmp_path / "las"), "--out", str(tmp_path / "out"), "--attribution", "synthetic"]
    assert main([*run, "--selection", str(selection), "--images"], spark) == 0
    names = {f.name for f in (tmp_path / "out").iterdir()}
    assert names == {"mdt.tif", "mds.tif", "chm.tif", "basis.tif", "n_all.tif", "n_ground.tif", "record.json"}
    told = json.loads((tmp_path / "out/record.json").read_text())
    assert told["inputs"][0]["point_count_catalogue"] == len(p) and told["flight_dates"] == ["2024-07-01T22:00:00Z"] and not told["mixed_epochs"]
    assert told["uncalibrated_thresholds"] == sorted(product.UNCALIBRATED) and told["known_limitations"] == list(product.LIMITATIONS)
    assert set(told["parameters"]) == set(product.UNCALIBRATED)
    said = capsys.readouterr().out
    for label in ("returns outside the grid", "cells undetermined", "expected void", "flight dates", "mixed epochs", "reproducibility_hash"):
        assert label in said
    assert main(["smoke", "--aoi", str(aoi), "--search", str(search), "--las", str(tmp_path / "las")], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["tiles"][0]["delta"] == 0 and report["returns"] == len(p) and sum(report["histogram"].values()) == report["with_ground_below"]
    # the same run again differs in its time only; another one in bands and fields
    assert main([*run[:-3], str(tmp_path / "again"), "--attribution", "synthetic", "--selection", str(selection), "--images"], spark) == 0
    assert main(["compare", str(tmp_path / "out"), str(tmp_path / "again")], spark) == 0
    assert main(["compare", str(tmp_path / "out"), str(tmp_path / "again"), "--record-only"], spark) == 2
    assert main([*run[:-3], str(tmp_path / "other"), "--attribution", "else", "--d-max-interp-m", "0", "--images"], spark) == 0
    capsys.readouterr()
    assert main(["compare", str(tmp_path / "out"), str(tmp_path / "other")], spark) == 1
    err = capsys.readouterr().err
    assert "attribution changed" in err and "cells differ" in err
    other = {"tiles": [{"item_id": "u", "bbox": box}]}
    selection.write_text(json.dumps(other))
    assert main([*run, "--selection", str(selection)], spark) == 2
    assert "not in the selection" in capsys.readouterr().err
    (tmp_path / "none").mkdir()
    assert main([*run[:4], str(tmp_path / "none"), *run[5:]], spark) == 2
    aoi.write_text(json.dumps({"type": "Point"}))
    assert main(run, spark) == 2


def test_records_of_two_releases():
    old = {"package_version": "1", "grid": 5, "known_limitations": ["a", "b"], "created_utc": "x"}
    new = {"package_version": "2", "grid": 5, "known_limitations": ["a", "c", "d"], "created_utc": "y"}
    changes = {"2": {"replaced": [["b", "c"]], "added": ["d"]}}
    assert programs.compare_records(old, new, changes=changes)[1] == []
    assert "known_limitations" in programs.compare_records(old, new)[1][0]
    assert "no change" in programs.compare_records(old, new, changes={})[1][0]
    assert "absent" in programs.compare_records(old, new, changes={"2": {"replaced": [["z", "c"]]}})[1][0]
    assert programs.compare_records(old, new | {"grid": 6}, changes=changes)[1] == ["record: grid changed"]
    assert programs.compare_records(old, new | {"grid": 6}, tell_only=True, changes=changes)[1] == []


def test_runs_without_rasters_are_not_equal(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "record.json").write_text(json.dumps({"package_version": name}))
    for record_only in (False, True):
        found = programs.compare_runs(spark, str(tmp_path / "a"), str(tmp_path / "b"), record_only)
        assert found.exit_code == 1 and "no rasters" in found.problems[0]


def test_read_stability(spark, tmp_path):
    data, _ = tile_bytes(spark)
    (tmp_path / "las").mkdir()
    (tmp_path / "las/t.las").write_bytes(data)
    (tmp_path / "las/broken.las").write_bytes(data[:300])
    assert main(["stability", "--las", str(tmp_path / "las"), "--passes", "2", "--out", str(tmp_path / "reads")], spark) == 0
    rows = spark.read.json(str(tmp_path / "reads")).collect()
    assert len(rows) == 4 and len({r.hash for r in rows if r.tile == "t"}) == 1
    assert tuple(programs.stability(spark, str(tmp_path / "reads")).first()) == ("default", 4, 2)
    (tmp_path / "none").mkdir()
    assert main(["stability", "--las", str(tmp_path / "none"), "--out", str(tmp_path / "reads")], spark) == 2


def test_ramp_confound(spark, cells):
    part, grid = verdicts.crop(cells, queries.GRID, (0.0, 0.0, 60.0, 30.0))
    got = {r.subset: r for r in programs.ramp_confound(part, grid, "is_ground", ["theirs"], gate=1.5).collect()}
    assert set(got) == {"all", "residual >= 0.10", "residual >= 0.20", "residual >= 0.30", "residual >= 0.50", "residual < 0.10"}
    assert got["all"].cells >= got["residual >= 0.10"].cells >= got["residual >= 0.30"].cells and 0 <= got["all"].theirs_pct <= 100


def test_run_refuses_returns_outside_the_declared_box(spark):
    g = Grid(48000.0, 169020.0, 0.5, 40, 40, 3763)
    scene = synthetic.canopy(spark, side=20.0)
    with pytest.raises(Exception, match="outside its declared box"):
        product.run(scene, g, "x", catalogue={"scene": {"bbox": [48000, 169000, 48010, 169020], "flight_date": "2024-01-01T00:00:00Z"}})
    with pytest.raises(SelectionRefusal):
        product.run(scene, g, "x", catalogue={})


def test_drawings(spark):
    g = Grid(0.0, 2.0, 1.0, 3, 2, 3763)
    rows = [(0, 0, 1.0, 1), (0, 1, 2.0, 2), (0, 2, None, 0), (1, 0, 3.0, 1), (1, 1, 4.0, 1), (1, 2, 5.0, 1)]
    frame = spark.createDataFrame(rows, "row int, col int, mdt float, basis int")
    assert bands.draw(frame, g, "mdt", bands.EARTH).startswith(b"\x89PNG") and bands.draw_basis(frame, g).startswith(b"\x89PNG")
    with pytest.raises(RenderRefusal, match="no valid"):
        bands.draw(frame.withColumn("mdt", F.lit(None).cast("float")), g, "mdt", bands.GREYS)
    with pytest.raises(RenderRefusal, match="unknown basis"):
        bands.draw_basis(frame.withColumn("basis", F.lit(9)), g)
    assert bands.ramp(bands.GREYS, 3) == [(0, 0, 0), (127, 127, 127), (255, 255, 255)]
