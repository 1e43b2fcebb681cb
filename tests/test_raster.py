"""Image files out and in again, and the comparison of two folders of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import CompareRefusal, ReadRefusal
from cellbasis.sinks import bands, record
from cellbasis.sources import raster

GRID = Grid(10.0, 300.0, 0.5, 300, 270, 3763)


@pytest.mark.parametrize("kind", [np.float32, np.uint8, np.int32])
def test_round_trip(kind):
    z = (np.arange(270 * 300).reshape(270, 300) % 200).astype(kind)
    got = raster.decode(bands.tiff(z, GRID, 199.0, {"band": "x"}))
    assert np.array_equal(got.band, z) and got.band.dtype == kind
    assert got.nodata == 199.0 and got.cell == 0.5 and got.origin == (10.0, 300.0)


def test_other_files_are_refused():
    for bad in (b"MM\0*", b"", b"\x89PNG"):
        with pytest.raises(ReadRefusal):
            raster.decode(bad)


def test_folders(spark, tmp_path):
    z = np.full((270, 300), -9999.0, dtype=np.float32)
    z[5, 7], z[200, 299] = 1.5, 2.5
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/mdt.tif").write_bytes(bands.tiff(z, GRID, -9999.0, {}))
    got = raster.read_bands(spark, str(tmp_path / "a"))
    assert got.count() == 270 * 300
    assert sorted((r.row, r.col, r.value) for r in got.where("value is not null").collect()) == [(5, 7, 1.5), (200, 299, 2.5)]
    with pytest.raises(CompareRefusal, match="no rasters"):
        raster.compare_folders(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    z[5, 7] = 1.25
    (tmp_path / "b/mdt.tif").write_bytes(bands.tiff(z, GRID, -9999.0, {}))
    assert tuple(raster.compare_folders(spark, str(tmp_path / "a"), str(tmp_path / "b")).first()) == ("mdt", 81000, 1)
    (tmp_path / "b/chm.tif").write_bytes(bands.tiff(z, GRID, -9999.0, {}))
    with pytest.raises(CompareRefusal, match="band sets"):
        raster.compare_folders(spark, str(tmp_path / "a"), str(tmp_path / "b"))


def test_lines_are_appended(spark, tmp_path):
    rows = spark.range(3)
    for _ in range(2):
        record.append_lines(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).agg(F.count("id")).first()[0] == 6
