"""Returns to cells, in batch and as a stream."""

import pytest

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import ReadRefusal
from cellbasis.operators.accumulate import block_min, cell_stats, dense, outside_count, require_one_crs, upsample
from cellbasis.sources import returns, synthetic
from cellbasis.streaming import fold

SCHEMA = "tile_id string, x double, y double, z double, classification smallint, return_number smallint, number_of_returns smallint"
GRID = Grid(0.0, 4.0, 1.0, 4, 4, 3763)


def points(spark, rows):
    return spark.createDataFrame([(t, x, y, z, c, 1, 1) for t, x, y, z, c in rows], SCHEMA)


ROWS = [("a", 0.5, 3.5, 1.0, 2), ("a", 0.6, 3.6, 5.0, 5), ("a", 0.7, 3.7, -9.0, 7), ("b", 1.0, 3.0, 2.5, 6), ("b", 9.0, 9.0, 0.0, 2)]


def test_extremes_counts_and_noise(spark):
    clean = returns.checked(points(spark, ROWS))
    got = {(r.row, r.col): (r.min_z, r.max_z, r.n_all, r.n_ground, r.min_z_ground) for r in cell_stats(clean, GRID).collect()}
    assert got == {(0, 0): (1.0, 5.0, 2, 1, 1.0), (1, 1): (2.5, 2.5, 1, 0, None)}
    assert tuple(outside_count(clean, GRID).first()) == (3, 1)


def test_order_of_tiles_does_not_matter(spark):
    a = cell_stats(points(spark, ROWS), GRID).collect()
    b = cell_stats(points(spark, ROWS[::-1]), GRID).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_dense_is_null_where_empty(spark):
    cells = dense(cell_stats(points(spark, ROWS), GRID), GRID)
    assert cells.count() == 16
    assert cells.where("min_z is null and n_all = 0").count() == 14


def test_refusals_of_a_read(spark):
    with pytest.raises(ReadRefusal, match="finite"):
        returns.checked(points(spark, [("a", float("nan"), 1.0, 1.0, 2)]))
    box = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 4.0), ("b", 0.0, 0.0, 4.0, 4.0)], "tile_id string, fminx double, fminy double, fmaxx double, fmaxy double")
    with pytest.raises(ReadRefusal, match="tile b"):
        returns.checked(points(spark, ROWS), box)
    # a stray return of a noise class is refused too; one within the tolerance is not
    with pytest.raises(ReadRefusal, match="outside"):
        returns.checked(points(spark, [("a", 5.0, 1.0, 1.0, 7)]), box)
    assert returns.checked(points(spark, [("a", 1.009, 1.0, 1.0, 2)]), box).count() == 1
    with pytest.raises(ReadRefusal, match="EPSG:32629"):
        require_one_crs({3763, 32629}, GRID)


def test_official_ground_is_judged_before_noise_goes(spark):
    facts = {r.tile_id: r for r in returns.tile_facts(points(spark, ROWS)).collect()}
    assert facts["a"].n_noise == 1 and facts["a"].n_points == 2 and facts["a"].has_official_ground
    assert facts["b"].n_in_file == 2


def test_blocks(spark):
    cells = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (2, 2, 6.0), (2, 3, None)], "row int, col int, min_z double")
    low = block_min(cells, 2)
    assert sorted(map(tuple, low.collect())) == [(0, 0, 1.0), (1, 1, 6.0)]
    up = upsample(cells.select("row", "col"), low.withColumnRenamed("min_z", "low"), 2, ["low"])
    assert sorted(map(tuple, up.collect())) == [(0, 0, 1.0), (0, 1, 1.0), (2, 2, 6.0), (2, 3, 6.0)]


def test_empty_table(spark):
    none = points(spark, ROWS).limit(0)
    assert cell_stats(returns.checked(none), GRID).count() == 0
    assert dense(cell_stats(none, GRID), GRID).where("n_all = 0").count() == 16


def test_scenes(spark):
    g = Grid(48000.0, 169010.0, 0.5, 20, 20, 3763)
    ramp = cell_stats(synthetic.ramp(spark, side=10.0), g)
    assert ramp.where("n_all > 0").count() >= 380
    assert cell_stats(synthetic.with_void(synthetic.ramp(spark, side=10.0), 48002.0, 169002.0, 3.0), g).count() == ramp.count() - 36
    assert synthetic.sparse(spark, 0.5, 20.0).count() == 200
    high = synthetic.canopy(spark, side=10.0)
    assert 0.2 < high.where("classification = 2").count() / high.count() < 0.4


def test_stream_equals_batch(spark, tmp_path):
    all_points = points(spark, ROWS)
    all_points.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(all_points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = fold.drain(fold.stream_fold(live, GRID), "fold_test").collect()
    want = cell_stats(returns.without_noise(all_points), GRID).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_guarded_batches(spark):
    box = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 4.0)], "tile_id string, fminx double, fminy double, fmaxx double, fmaxy double")
    seen = []
    fold.guarded(box, lambda frame, n: seen.append((n, frame.count())))(points(spark, ROWS[:3]), 7)
    assert seen == [(7, 2)]
    with pytest.raises(ReadRefusal):
        fold.guarded(box, lambda frame, n: None)(points(spark, [("a", 8.0, 1.0, 1.0, 2)]), 8)


def test_stream_sorties(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 06:00:00"), ("u", "2024-01-01 12:00:01"), ("v", "2024-01-01 01:00:00"), ("w", "2024-02-01 00:00:00")]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("stamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "s"))
    live = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "s"))
    got = sorted((r.k, r.n) for r in fold.drain(fold.stream_sorties(live, ["k"]), "sorties_test", "complete").collect())
    assert got == [("u", 1), ("u", 2), ("v", 1), ("w", 1)]
