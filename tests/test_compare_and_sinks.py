"""Comparisons, profiles, files, images, record, and the whole run."""

import hashlib
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import CompareRefusal, ReadRefusal, RecordRefusal, RenderRefusal
from cellbasis.operators import blocks, compare, profiles
from cellbasis.plans import product, studies
from cellbasis.sinks import bands, record
from cellbasis.sources import las, synthetic


def line(spark, values, rows=1):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r in range(rows) for c, v in enumerate(values)], "row int, col int, z double")


def test_riser_between_treads(spark):
    z = [0.0] * 6 + [1.0, 2.0] + [2.0] * 6
    g = Grid(0.0, 0.5, 0.5, len(z), 1, 3763)
    got = profiles.risers(line(spark, z), g, "z").collect()
    assert [(r.direction, r.row, r.col, r.height, r.width, r.n_run, r.tread_before, r.tread_after) for r in got] == [("row", 0, 6, 2.0, 1.0, 3, 2.5, 3.0)]
    broken = list(z)
    broken[3] = None  # a hole shortens the tread
    assert profiles.risers(line(spark, broken), g, "z").count() == 0
    assert profiles.risers(line(spark, [0.0, 5.0]), Grid(0, 1, 1, 2, 1, 3763), "z").count() == 0


def test_relief_needs_both_ends(spark):
    z = [0.0, None, 3.0, 4.0]
    got = {(r.direction, r.lag): r.dz for r in profiles.relief(line(spark, z), Grid(0.0, 1.0, 1.0, 4, 1, 3763), "z").collect()}
    assert got[("row", 1)] == 1.0 and got[("row", 2)] == 3.0


def test_profiles_leave_out_corner_diagonals(spark):
    g = Grid(0.0, 3.0, 1.0, 4, 3, 3763)
    p = profiles.profiles(line(spark, [0.0] * 4, 3), g, "z")
    n = {r.direction: (r.p, r.n) for r in p.groupBy("direction").agg(F.countDistinct("profile").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"row": (3, 12), "col": (4, 12), "diag": (4, 10), "adiag": (4, 10)}


def greedy(points, radius):
    kept = []
    for p in sorted(points, key=lambda p: (-p[3], p[0])):
        if all((k[1] - p[1]) ** 2 + (k[2] - p[2]) ** 2 > radius**2 for k in kept):
            kept.append(p)
    return sorted(p[0] for p in kept)


def test_clusters_equal_greedy(spark):
    rng = np.random.default_rng(3)
    points = [(i, float(x), float(y), float(h)) for i, (x, y, h) in enumerate(zip(rng.random(150) * 40, rng.random(150) * 40, rng.integers(0, 9, 150)))]
    frame = spark.createDataFrame(points, "seq long, x double, y double, height double")
    got = sorted(r.seq for r in profiles.clusters(frame, 5.0, [-F.col("height")]).collect())
    assert got == greedy(points, 5.0)
    assert profiles.clusters(frame.limit(0), 5.0, [-F.col("height")]).count() == 0


@pytest.mark.parametrize("block", [3, 24])
def test_clusters_equal_greedy_across_blocks(spark, block):
    """A grid of candidates, several a place, of equal or few heights, so that chains run from block to block."""
    rng = np.random.default_rng(5)
    points = [(i, 0.5 * (i // 2 % 60) - 12.25, 0.5 * (i // 120) - 7.75, float(h)) for i, h in enumerate(rng.integers(0, 3, 7200))]
    points = [p[:3] + (1.5,) if p[2] > 10 else p for p in points if rng.random() < 0.4]
    frame = spark.createDataFrame(points, "seq long, x double, y double, height double")
    assert sorted(r.seq for r in profiles.clusters(frame, 2.0, [-F.col("height")], block=block).collect()) == greedy(points, 2.0)


def test_clusters_of_equal_heights_take_few_rounds(spark):
    """Along a wall of one height each candidate waits for the one before it."""
    points = [(i, 0.5 * i, 3.0, 1.5) for i in range(600)]
    frame = spark.createDataFrame(points, "seq long, x double, y double, height double")
    spark.sparkContext.setJobGroup("wall", "clusters of a wall")
    got = sorted(r.seq for r in profiles.clusters(frame, 5.0, [-F.col("height")]).collect())
    spark.sparkContext.setJobGroup("other", "other tests")
    assert got == list(range(0, 600, 11))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("wall")) < 60


def test_candidates_without_a_place_stay(spark):
    points = [(1, None, 1.0, 2.0), (2, float("nan"), 1.0, 2.0), (3, 1.0, 1.0, 2.0), (4, 1.5, 1.0, 3.0), (5, 1.0, None, 1.0)]
    frame = spark.createDataFrame(points, "seq long, x double, y double, height double")
    assert sorted(r.seq for r in profiles.clusters(frame, 5.0, [-F.col("height")]).collect()) == [1, 2, 4, 5]


def test_seams(spark):
    g = Grid(0.0, 20.0, 1.0, 20, 20, 3763)
    tiles = spark.createDataFrame([(0.0, 0.0, 10.0, 20.0), (10.0, 0.0, 20.0, 20.0)], "minx double, miny double, maxx double, maxy double")
    got = {(r.row, r.col) for r in compare.seam_cells(spark, tiles, g, 2.0).collect()}
    want = set()
    for r in range(20):
        for c in range(20):
            x, y = c + 0.5, 20 - r - 0.5
            for a, b, d, e in ((0, 0, 10, 20), (10, 0, 20, 20)):
                if a - 2 <= x <= d + 2 and b - 2 <= y <= e + 2 and not (a + 2 < x < d - 2 and b + 2 < y < e - 2):
                    want.add((r, c))
    assert got == want


def test_point_files_must_correspond(spark):
    a = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)], "i int, x double, y double, z double")
    compare.require_same_points(a, a, ["i"])
    with pytest.raises(CompareRefusal, match="1 point"):
        compare.require_same_points(a, a.withColumn("z", F.when(F.col("i") == 1, 0.0).otherwise(F.col("z"))), ["i"])
    with pytest.raises(CompareRefusal):
        compare.require_same_points(a, a.where("i = 0"), ["i"])


def test_runs_and_lists(spark):
    a = spark.createDataFrame([(0, 0, 1.0, 1), (0, 1, None, 0)], "row int, col int, mdt float, basis int")
    b = spark.createDataFrame([(0, 0, 1.0, 2), (0, 1, None, 0)], "row int, col int, mdt float, basis int")
    assert {r.band: r.differing for r in compare.run_difference(a, b, ["mdt", "basis"]).collect()} == {"mdt": 0, "basis": 1}
    assert compare.run_difference(a, a.where("col = 0"), ["mdt"]).first().differing == 1
    compare.require_same_bands(["a", "b"], ["b", "a"])
    for old, new in (([], []), (["a"], ["b"])):
        with pytest.raises(CompareRefusal):
            compare.require_same_bands(old, new)
    assert compare.changed_list(["a", "b"], [("a", "A")], ["c"]) == ["A", "b", "c"]
    with pytest.raises(CompareRefusal):
        compare.changed_list(["a"], [("x", "y")], [])


def test_read_events(spark):
    rows = [("A", 1, "h", 0, None), ("A", 1, "h", 0, None), ("A", 1, "g", 0, None), ("B", 1, "h", 1, None), ("B", 1, None, 0, "bad"), ("B", 2, "k", 0, None)]
    got = {r.config: (r.reads, r.events) for r in compare.read_events(spark.createDataFrame(rows, "config string, tile int, hash string, exit_code int, error string")).collect()}
    assert got == {"A": (3, 1), "B": (3, 2)}


def test_block_heights(spark):
    rows = [(1.0, 1.0, 10.0, 2), (2.0, 2.0, 13.0, 5), (11.0, 1.0, 99.0, 5)]
    h = blocks.heights(spark.createDataFrame(rows, "x double, y double, z double, classification int"), (0.0, 0.0))
    assert sorted(r.height for r in h.collect()) == [0.0, 3.0]
    assert {r.bin: r.n for r in blocks.height_histogram(h).collect()} == {0: 1, 3: 1}
    assert blocks.canopy_shares(h, (0.0, 0.0)).first().share == 0.5


def test_las_round_trip_and_refusals(spark, tmp_path):
    n = 1000
    rng = np.random.default_rng(0)
    x, y, z = 48000 + rng.integers(0, 10000, n) / 100, 169000 + rng.integers(0, 10000, n) / 100, rng.integers(0, 500, n) / 100
    data = las.encode(x, y, z, np.full(n, 2, np.uint8), 3763)
    (tmp_path / "tile.las").write_bytes(data)
    got = las.read(spark, str(tmp_path), 3763)
    rows = got.orderBy("point_idx").toPandas()
    assert np.allclose(rows.x, x) and np.allclose(rows.y, y) and np.allclose(rows.z, z)
    assert set(rows.classification) == {2} and set(rows.return_number) == {1} and rows.tile_id[0] == "tile"
    assert tuple(las.files(spark, str(tmp_path)).first()) == ("tile", hashlib.sha256(data).hexdigest(), 3763, n)
    assert tuple(las.digests(spark, str(tmp_path), "*.las").first()) == ("tile.las", len(data), hashlib.sha256(data).hexdigest())
    with pytest.raises(Exception, match="EPSG:3763"):
        las.read(spark, str(tmp_path), 32629).count()
    packed = bytearray(data)
    packed[104] |= 0x80
    for bad, why in ((b"nonsense" * 50, "not a LAS"), (bytes(packed), "compressed"), (las.encode(x, y, z, np.full(n, 2), None), "declares no system")):
        with pytest.raises(ReadRefusal, match=why):
            las.header(bad)
    (tmp_path / "none").mkdir()
    with pytest.raises(ReadRefusal, match="no .las"):
        las.read(spark, str(tmp_path / "none"))


def test_sentinels(spark):
    s = spark.createDataFrame([(0, 0, 1.0, None, float("nan"), 0, 2, 1)], "row int, col int, mdt float, mds float, chm float, basis int, n_all int, n_ground int")
    r = bands.encoded(s).first()
    assert (r.mdt, r.mds, r.chm, r.basis, r.n_ground) == (1.0, -9999.0, -9999.0, 0, 1)
    assert bands.encoded(s, official_ground=False).first().n_ground == -1
    assert bands.long_form(bands.encoded(s)).count() == 6


def test_levels_of_constant_and_empty_bands(spark):
    assert [r.level for r in bands.levels(line(spark, [2.0, 2.0, None]), "z", 255).orderBy("col").collect()] == [127, 127, None]
    assert [r.level for r in bands.levels(line(spark, [0.0, 1.0]), "z", 4).orderBy("col").collect()] == [0, 3]


def test_basis_colours_refuse_unknown_codes(spark):
    with pytest.raises(Exception, match="unknown basis code 7"):
        spark.createDataFrame([(7,)], "b int").select(bands.basis_colour(F.col("b"))).collect()


def test_tiff_holds_the_band():
    g = Grid(0.0, 300.0, 1.0, 310, 300, 3763)
    z = np.arange(300 * 310, dtype=np.float32).reshape(300, 310)
    data = bands.tiff(z, g, -9999.0, {"band": "mdt"})
    assert data[:4] == b"II*\0"
    (n,) = struct.unpack_from("<H", data, 8)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from("<HHI", data, 10 + 12 * i)
        fields[tag] = (kind, count, 10 + 12 * i + 8)
    (place,) = struct.unpack_from("<I", data, fields[324][2])
    starts = struct.unpack_from(f"<{fields[324][1]}I", data, place)
    tile = np.frombuffer(zlib.decompressobj().decompress(data[starts[0] :]), dtype=np.float32).reshape(256, 256)
    assert np.array_equal(tile, z[:256, :256]) and fields[324][1] == 4 and 42113 in fields


def test_palette_images():
    index = np.array([[0, 1], [1, 2]], dtype=np.uint8)
    png = bands.palette_png(index, [(1, 2, 3), (4, 5, 6), (0, 0, 0)], 2)
    assert png.startswith(b"\x89PNG") and b"tRNS" in png and png.endswith(struct.pack(">I", zlib.crc32(b"IEND")))
    for colours in ([], [(0, 0, 0)] * 257):
        with pytest.raises(RenderRefusal):
            bands.palette_png(index, colours, None)
    text = bands.style([(0, (215, 48, 39), "undetermined")], True)
    assert 'color="#d73027"' in text and "INTERPOLATED" in bands.style([(0.0, (0, 0, 0), "0%"), (1.0, (9, 9, 9), "100%")], False)


def test_record_hash_covers_inputs_and_not_results():
    g = Grid(0.0, 1.0, 0.5, 2, 2, 3763)
    one = record.Input("a", "a.las", "00", 10, 1.0)
    make = lambda **k: record.record(g, {"cell": 0.5}, [one], k.get("honesty", {}), None, k.get("attribution", "source, licence"), created="now")
    assert make()["reproducibility_hash"] == make(honesty={"x": 1.0}, attribution="other")["reproducibility_hash"]
    other = record.record(g, {"cell": 0.5}, [record.Input("a", "a.las", "01", 10, 1.0)], {}, None, "x")
    assert other["reproducibility_hash"] != make()["reproducibility_hash"]
    assert make()["agreement"] is None and json.loads(record.canonical(make()))
    with pytest.raises(RecordRefusal):
        make(attribution=" ")
    for name in ("", "..", "a/b.las", "a\\b.las"):
        with pytest.raises(RecordRefusal):
            record.Input("a", name, "00", 1, 1.0)


def test_whole_run(spark, tmp_path):
    g = Grid(48000.0, 169050.0, 0.5, 100, 100, 3763)
    out = product.run(synthetic.canopy(spark), g, "synthetic, public domain")
    told = out.record["honesty"]
    assert told["fraction_measured"] > 0.5 and out.record["agreement"]["n_cells"] > 0
    chm = [r.chm for r in out.bands.where("chm is not null").select("chm").collect()]
    assert 6.5 < np.median(chm) < 9.5
    bands.write_parquet(out.bands, str(tmp_path / "out"), out.record)
    assert spark.read.parquet(str(tmp_path / "out/bands")).where("band = 'mdt'").count() == g.n_cells
    image = bands.to_array(out.bands, g, "mdt", np.float32, -9999.0)
    assert image.shape == (100, 100)
    bare = product.run(synthetic.ramp(spark).withColumn("classification", F.lit(1).cast("smallint")), g, "x")
    assert bare.record["agreement"] is None and bare.bands.where("n_ground != -1").count() == 0


def test_studies():
    assert all(r < 1e-9 for _, _, r in studies.ramp_control((10.0, 45.0), 7, 0.5))
    assert studies.ramp_entry(7, 0.5, 2.5)["axis"] == pytest.approx(39.8, abs=0.05)
    rows = studies.ramp_study((31.0, 35.0, 40.0, 45.0), 7, 0.5, 2.5, 0.3)
    assert all(may == reached and not entered for _, _, may, reached, entered in rows) and any(r[2] for r in rows)
    assert 0.3 < studies.step_floor(2.6, 7, 0.5) < 1.0
    low, high, n = studies.width_band(2.6, 7, 0.5, 3, 2.5, orientations=(0, 30), shifts=np.arange(-2, 2, 0.25))
    assert n > 0 and low <= high and not math.isnan(low)
    noise = studies.noise_curve(45.0, (0.05, 0.2), 7, 0.5, draws=20)
    assert noise[0][1] < noise[1][1]
