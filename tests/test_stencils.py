"""Stencils, neighbours and filters against brute force on small grids."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import BasisRefusal, FilterRefusal, GridRefusal, Refusal
from cellbasis.operators import basis, ground, neighbours, steps, stencil

ROWS, COLS = 11, 13
GRID = Grid(0.0, float(ROWS), 1.0, COLS, ROWS, 3763)
RNG = np.random.default_rng(5)
FULL = RNG.integers(0, 64, (ROWS, COLS)) / 8.0
HOLES = np.where(RNG.random((ROWS, COLS)) < 0.6, np.nan, FULL)


def frame(spark, z, name="z"):
    rows = [(int(r), int(c), None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, f"row int, col int, {name} double")


def array(df, name, shape=(ROWS, COLS)):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", name).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else float(r[2])
    return out


def around(z, r, c, inside):
    return [z[i, j] for i in range(z.shape[0]) for j in range(z.shape[1]) if inside(abs(i - r), abs(j - c))]


def brute(z, inside, fn):
    return np.array([[fn(around(z, r, c, inside)) for c in range(z.shape[1])] for r in range(z.shape[0])])


@pytest.mark.parametrize("r", [1, 2, 5])
def test_diamond_is_the_l1_ball(spark, r):
    for dilate, fn in ((False, min), (True, max)):
        got = array(stencil.diamond(frame(spark, FULL), GRID, r, "z", dilate, "o"), "o")
        assert np.array_equal(got, brute(FULL, lambda a, b: a + b <= r, fn))


def test_square_opening(spark):
    got = array(stencil.square_opening(frame(spark, FULL), 2, "z", "o"), "o")
    low = brute(FULL, lambda a, b: max(a, b) <= 2, min)
    assert np.array_equal(got, brute(low, lambda a, b: max(a, b) <= 2, max))


def test_interior_counts_the_border_as_outside(spark):
    mask = np.ones((ROWS, COLS))
    mask[5, 5] = np.nan
    cells = frame(spark, mask).withColumn("m", F.col("z").isNotNull())
    got = {(r.row, r.col) for r in stencil.interior(cells, "m", 1).collect()}
    want = {(r, c) for r in range(1, ROWS - 1) for c in range(1, COLS - 1) if max(abs(r - 5), abs(c - 5)) > 1}
    assert got == want
    with pytest.raises(Refusal):
        stencil.interior(cells, "m", 0)


def test_step_magnitude_needs_two_values_and_a_whole_window(spark):
    got = {(r.row, r.col): (r.step, r.n) for r in stencil.step_magnitude(frame(spark, HOLES), GRID, "z", 5).collect()}
    want = {}
    for r in range(2, ROWS - 2):
        for c in range(2, COLS - 2):
            v = [x for x in HOLES[r - 2 : r + 3, c - 2 : c + 3].ravel() if not np.isnan(x)]
            if len(v) >= 2:
                want[r, c] = (max(v) - min(v), len(v))
    assert got == want
    for window, least in ((4, 2), (1, 2), (5, 1)):
        with pytest.raises(Refusal):
            stencil.step_magnitude(frame(spark, HOLES), GRID, "z", window, least)


def test_gradient_is_central_inside_and_one_sided_at_ends(spark):
    out = stencil.gradient(frame(spark, FULL), "z")
    gy, gx = np.gradient(FULL)
    assert np.allclose(array(out, "gx"), gx) and np.allclose(array(out, "gy"), gy)
    line = stencil.gradient(frame(spark, FULL[:1]), "z")
    assert np.allclose(array(line, "gy", (1, COLS)), 0)


def knn(z, k):
    known = [(r, c) for r in range(z.shape[0]) for c in range(z.shape[1]) if not np.isnan(z[r, c])]
    out = z.copy()
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if np.isnan(z[r, c]) and known:
                near = sorted(known, key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p))[:k]
                out[r, c] = np.mean([z[p] for p in near])
    return out


@pytest.mark.parametrize("k", [1, 8])
def test_knn_fill_with_escalation(spark, k):
    z = HOLES.copy()
    z[:, 4:] = np.nan  # wide gaps need a larger radius
    got = array(neighbours.knn_fill(frame(spark, z), GRID, "z", k=k, last_radius=2), "z")
    assert np.allclose(got, knn(z, k), atol=1e-12)


@pytest.mark.parametrize("k", [1, 8])
def test_knn_fill_of_wide_gaps_by_chunks(spark, k):
    shape = (40, 50)
    z = RNG.integers(0, 64, shape) / 8.0
    z[5:33, 8:45] = np.nan  # a gap much wider than the radii searched by offsets, with an island
    z[18, 25] = 1.0
    z[RNG.random(shape) < 0.1] = np.nan
    g = Grid(0.0, 40.0, 1.0, 50, 40, 3763)
    for last, chunk in ((0, 4), (2, 8)):
        got = array(neighbours.knn_fill(frame(spark, z), g, "z", k=k, last_radius=last, chunk=chunk), "z", shape)
        assert np.allclose(got, knn(z, k), atol=1e-12)


def test_knn_fill_of_few_or_no_values(spark):
    z = np.full((ROWS, COLS), np.nan)
    assert np.isnan(array(neighbours.knn_fill(frame(spark, z), GRID, "z"), "z")).all()
    z[0, 0], z[10, 12] = 1.0, 3.0
    got = array(neighbours.knn_fill(frame(spark, z), GRID, "z"), "z")
    assert got[5, 5] == 2.0 and got[0, 0] == 1.0


def progressive(z, slope, cell, radius):
    ball = lambda k: lambda a, b: a + b <= k
    last, out = z, np.zeros(z.shape, bool)
    for k in range(1, radius + 1):
        opened = brute(brute(z, ball(k), min), ball(k), max)
        out |= np.abs(last - opened) > slope * cell * k
        last = opened
    return out


def test_progressive_filter_in_windows_and_in_chunks(spark):
    want = progressive(FULL, 0.5, 1.0, 3)
    cells = frame(spark, FULL)
    for got in (ground.progressive_flags(cells, GRID, "z", 0.5, 3.0), ground.chunked_flags(cells, GRID, "z", 0.5, 3.0, chunk=4)):
        assert np.array_equal(array(got.select("row", "col", F.col("flagged").cast("int").alias("f")), "f") == 1, want)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 40), min_size=21, max_size=21))
def test_flags_on_lines(values):
    z = np.array(values, dtype=float).reshape(3, 7) / 4
    assert np.array_equal(ground.flag_objects(z, 0.3, 4), progressive(z, 0.3, 1.0, 4))


def test_plateau_is_flagged_and_nested_steps_are_not():
    z = np.zeros((1, 21))
    z[0, 8:13] = 5.0
    assert np.array_equal(np.flatnonzero(ground.flag_objects(z, 0.15, 5)[0]), np.arange(8, 13))
    nested = np.zeros((1, 31))
    nested[0, 12:19], nested[0, 13:18] = 0.44, 0.88
    assert not ground.flag_objects(nested, 0.15, 8).any()


def test_low_outlier(spark):
    for depth, hit in ((-10.0, True), (-2.0, False)):
        z = np.zeros((5, 5))
        z[2, 2] = depth
        got = ground.low_outliers(frame(spark, z), Grid(0, 5, 1, 5, 5, 3763), "z").where("flagged").collect()
        assert [(r.row, r.col) for r in got] == ([(2, 2)] if hit else [])


def scene():
    """A slope with a riser and a building on it, half-metre cells."""
    rows, cols = np.mgrid[0:120, 0:120]
    z = 0.05 * 0.5 * cols + np.where(cols >= 60, 1.5, 0.0)
    z[30:50, 20:40] += 6.0
    return z


def test_progressive_ground_on_a_scene(spark):
    z = scene()
    g = Grid(0.0, 60.0, 0.5, 120, 120, 3763)
    got = ground.progressive_ground(frame(spark, z, "min_z"), g)
    mask = array(got.select("row", "col", F.col("is_ground").cast("int").alias("g")), "g", z.shape) == 1
    assert mask[32:48, 22:38].mean() < 0.05
    assert mask[60:, :50].mean() > 0.95
    assert mask[:, 60:64].mean() > 0.90


def test_filter_refusals(spark):
    empty = frame(spark, np.full((4, 4), np.nan), "min_z")
    g = Grid(0, 2, 0.5, 4, 4, 3763)
    with pytest.raises(FilterRefusal, match="nothing was measured"):
        ground.progressive_ground(empty, g)
    with pytest.raises(FilterRefusal, match="nothing was measured"):
        ground.opening_ground(empty, g)
    with pytest.raises(FilterRefusal, match="multiple"):
        ground.block_factor(0.3, ground.ProgressiveParams())
    for bad in (0.0, -1.0, math.nan, math.inf):
        with pytest.raises(FilterRefusal):
            ground.block_factor(bad, ground.ProgressiveParams())
        with pytest.raises(FilterRefusal):
            ground.largest_radius(bad, 1.0)
        with pytest.raises(FilterRefusal):
            ground.opening_radii(bad, 1.0)
        with pytest.raises(FilterRefusal):
            ground.opening_ground(empty, g, ground.OpeningParams(cap=bad))
    with pytest.raises(FilterRefusal, match="cutting"):
        ground.provisional_dem(empty, g, ground.ProgressiveParams(cut=1.0))
    with pytest.raises(GridRefusal):
        Grid(0, 3, 0.5, 5, 6, 3763).coarse(2)
    with pytest.raises(FilterRefusal, match="holes"):
        stencil.require_filled(frame(spark, HOLES), "z")
    assert ground.opening_radii(4.0, 0.5) == [1, 2, 4] and ground.opening_radii(0.1, 1.0) == [1]


def cells_with(spark, ground_mask, n_all=None):
    rows = [(r, c, bool(ground_mask[r, c]), int(1 if n_all is None else n_all[r, c]), float(r + c), float(r + c + 2)) for r in range(ground_mask.shape[0]) for c in range(ground_mask.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, is_ground boolean, n_all int, min_z float, max_z float").withColumn("n_ground", F.col("n_all"))


def test_basis_against_brute_force(spark):
    mask = RNG.random((ROWS, COLS)) < 0.05
    mask[3, 3] = True
    for distance in (0.0, 1.0, 2.5):
        got = {(r.row, r.col): (r.basis, r.src_row, r.src_col) for r in basis.basis(cells_with(spark, mask), GRID, distance=distance).collect()}
        for r in range(ROWS):
            for c in range(COLS):
                near = sorted(((i - r) ** 2 + (j - c) ** 2, i, j) for i, j in np.argwhere(mask))[0]
                reach = math.sqrt(near[0]) <= distance
                code = 1 if mask[r, c] else 2 if reach else 0
                assert got[r, c] == (code, *(near[1:] if reach else (None, None)))


def test_basis_refusals_and_least_returns(spark):
    mask = np.zeros((4, 4), bool)
    g = Grid(0, 4, 1, 4, 4, 3763)
    with pytest.raises(BasisRefusal, match="no cell"):
        basis.basis(cells_with(spark, mask), g)
    mask[0, 0] = True
    for bad in (-1.0, math.nan, math.inf):
        with pytest.raises(BasisRefusal):
            basis.basis(cells_with(spark, mask), g, distance=bad)
    n = np.full((4, 4), 1)
    with pytest.raises(BasisRefusal):
        basis.basis(cells_with(spark, mask, n), g, least_returns=2)


def test_bands_say_nothing_without_a_basis(spark):
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = True
    g = Grid(0, 6, 1, 6, 6, 3763)
    out = basis.surfaces(basis.basis(cells_with(spark, mask), g, distance=2.0)).collect()
    for r in out:
        assert (r.mdt is None) == (r.basis == 0)
        assert (r.chm is not None) == (r.basis == 1)
        if r.chm is not None:
            assert r.chm == r.mds - r.mdt
    told = basis.honesty(basis.basis(cells_with(spark, mask), g), g).first()
    assert told.fraction_measured + told.fraction_interpolated + told.fraction_undetermined == pytest.approx(1)
    assert told.measured_density == 1.0 and told.expected_void_fraction == pytest.approx(math.exp(-1))


def test_agreement_with_empty_denominators(spark):
    mask = np.ones((2, 2), bool)
    r = basis.agreement(cells_with(spark, mask)).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (4, 0, 0, 0) and r.recall_ground == 1.0 and math.isnan(r.recall_nonground)
    assert r.majority_class_null == 1.0
    k = basis.kappa(basis.confusion(cells_with(spark, mask), "is_ground", "is_ground")).first()
    assert math.isnan(k.kappa) and k.agreement_pct == 100.0


def test_plane_fit():
    y, x = np.mgrid[-3:4, -3:4] * 0.5
    assert steps.plane_rms(x.ravel(), y.ravel(), (2 * x - y + 1).ravel()) < 1e-12
    wall = np.where(x > 0, 2.6, 0.0)
    assert steps.plane_rms(x.ravel(), y.ravel(), wall.ravel()) > 0.3
    line = np.arange(5.0)
    assert steps.plane_rms(line, 2 * line, line**2) > 0.1  # points on a line still have a plane of least norm
    assert math.isnan(steps.plane_rms(line[:3], line[:3], line[:3]))


def test_sharp_steps_and_hits(spark):
    z = np.zeros((20, 20))
    z[:, 10:] = 2.6
    g = Grid(0.0, 10.0, 0.5, 20, 20, 3763)
    cells = frame(spark, z, "min_z_ground")
    found = steps.sharp_steps(cells, g)
    assert found.where("in_population").count() == found.count() > 0
    hits = {r.name: r for r in steps.nearest_hits(found.where("in_population"), [("at", 5.1, 5.0), ("far", 1.6, 5.0), ("rim", 0.1, 5.0)], g, 1.0).collect()}
    assert hits["at"].found and hits["at"].residual > 0.3
    assert hits["far"].inside and not hits["far"].found
    assert not hits["rim"].inside and not hits["rim"].found
    ramp = np.mgrid[0:20, 0:20][1] * 0.5 * math.tan(math.radians(45))
    sloped = steps.sharp_steps(frame(spark, ramp, "min_z_ground"), g)
    assert sloped.count() > 0 and sloped.where("in_population").count() == 0
    with pytest.raises(Refusal):
        steps.sharp_steps(cells, g, residual=0)
