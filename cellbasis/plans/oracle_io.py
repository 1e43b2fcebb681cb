"""DuckDB SQL with the rows of the queries over sources, sinks, documents, reports, verdicts, streams and refusals."""

from __future__ import annotations

from cellbasis import __version__
from cellbasis.plans import oracle
from cellbasis.plans.oracle import _BASED, _CELLS, _CLUSTERS, _DENSE, _NEAR_1, _POINTS, _SMRF, _SURFACES, _bands, _nearest, _steps, _window, _with

_D = "CAST({} AS DOUBLE)"

_COMPARED = (
    *_DENSE,
    "grounded",
)
_POPULATIONS = (
    "f AS (SELECT g.*, n_class6 > 0 AS a, n_class6 > 0 AND n_ground = 0 AS b, n_class5 > 0 AND n_ground = 0 AND n_class6 = 0 AS canopy, n_ground > 0 AND n_class5 = 0 AND n_class6 = 0 AS plain, n_reference_ground > 0 AS theirs FROM grounded g)",
    _window("f", "deep", 2, "count(*) FILTER (b.b) = 25 AS inside"),
    """u AS (SELECT 'building' AS name, is_ground, theirs FROM f WHERE a UNION ALL SELECT 'building_no_ground', is_ground, theirs FROM f WHERE b
    UNION ALL SELECT 'roof_interior', is_ground, theirs FROM f JOIN deep USING ("row", col) WHERE inside UNION ALL SELECT 'canopy_only', is_ground, theirs FROM f WHERE canopy
    UNION ALL SELECT 'plain_ground', is_ground, theirs FROM f WHERE plain)""",
    "names AS (SELECT unnest(['building', 'building_no_ground', 'roof_interior', 'canopy_only', 'plain_ground']) AS name)",
    """shares AS (SELECT names.name, count(u.name) AS cells, count(*) FILTER (u.is_ground) AS ours, count(*) FILTER (u.theirs) AS reference,
       CASE WHEN count(u.name) > 0 THEN round(100 * (CAST(count(*) FILTER (u.is_ground) AS DOUBLE) / count(u.name)), 9) END AS ours_pct,
       CASE WHEN count(u.name) > 0 THEN round(100 * (CAST(count(*) FILTER (u.theirs) AS DOUBLE) / count(u.name)), 9) END AS reference_pct FROM names LEFT JOIN u USING (name) GROUP BY names.name)""",
)

# windows whose cells lie on one line are fitted along it: the sums of whole offsets say so exactly
_FITS = """fits AS (
  SELECT "row", col, CASE WHEN n >= 4 THEN sqrt(greatest(0, zz - CASE
      WHEN a * d - b * b <> 0 THEN (xz * (xz * d - yz * b) + yz * (yz * a - xz * b)) * n * n / (a * d - b * b)
      WHEN a <> 0 THEN xz * xz * n * n / a WHEN d <> 0 THEN yz * yz * n * n / d ELSE 0 END)) END AS residual
  FROM (SELECT a."row", a.col, count(*) AS n, CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) AS a, CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) AS b,
               CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE) AS d, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, var_pop(z) AS zz
        FROM (SELECT t."row", t.col, t.x, t.y, s.z
              FROM (SELECT "row", col, dc AS x, dr AS y, ("row" + dr) * 1000 + col + dc AS f FROM picked, range(-3, 4) i(dr), range(-3, 4) j(dc)) t
              JOIN (SELECT "row" * 1000 + col AS f, z FROM src WHERE z IS NOT NULL) s ON s.f = t.f) a
        GROUP BY a."row", a.col))"""

_CHOSEN = (
    "t AS (SELECT *, (least(maxx, 150) - greatest(minx, 10)) * (least(maxy, 130) - greatest(miny, 10)) AS overlap FROM tiles WHERE least(maxx, 150) > greatest(minx, 10) AND least(maxy, 130) > greatest(miny, 10))",
    "s AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS sortie FROM t)",
    "d AS (SELECT sortie AS dominant FROM s GROUP BY sortie ORDER BY sum(overlap) DESC, sortie LIMIT 1)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY minx, miny ORDER BY sortie <> dominant, item_id) = 1 AS kept FROM s, d)",
)
_UNION_OF_KEPT = (
    "b AS (SELECT greatest(minx, 10) AS x0, least(maxx, 150) AS x1, greatest(miny, 10) AS y0, least(maxy, 130) AS y1 FROM k WHERE kept)",
    "xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT x0 AS x FROM b UNION SELECT x1 FROM b))",
    "ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS ny FROM (SELECT y0 AS y FROM b UNION SELECT y1 FROM b))",
    "c AS (SELECT (nx - x) * (ny - y) AS area FROM xs, ys WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE x0 <= x AND x1 >= nx AND y0 <= y AND y1 >= ny))",
)


def _stops(name: str, stops: list[tuple[float, tuple[int, int, int]]]) -> str:
    pieces = []
    for (p, c), (q, e) in zip(stops, stops[1:], strict=False):
        part = ", ".join(f"CAST(floor((({e[i]} - {c[i]}) / {_D.format(q - p)}) * (share - {_D.format(p)}) + {c[i]}) AS INT) AS {n}" for i, n in enumerate("rgb"))
        last = " OR share >= 1" if q == 1.0 else ""
        pieces.append(f"SELECT '{name}' AS ramp, CAST(i AS INT) AS i, {part} FROM places WHERE (share >= {_D.format(p)} AND share < {_D.format(q)}){last}")
    return " UNION ALL ".join(pieces)


# The stops of the ramps.
_RAMPS = {
    "greys": [(0.0, (0, 0, 0)), (1.0, (255, 255, 255))],
    "earth": [(0.0, (51, 51, 153)), (0.15, (0, 153, 255)), (0.25, (0, 204, 102)), (0.5, (255, 255, 153)), (0.75, (128, 92, 84)), (1.0, (255, 255, 255))],
    "greens": [(0.0, (247, 252, 245)), (0.5, (116, 196, 118)), (1.0, (0, 68, 27))],
}

#: Transverse Mercator by the classical power series in the distance from the meridian, where the engine uses Krueger's.
_SERIES = """m AS (SELECT CAST(6378137 AS DOUBLE) AS ra, 1 / CAST(298.257222101 AS DOUBLE) AS f),
k AS (SELECT *, f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS ep FROM m),
places AS (
  SELECT s.*, i, j, radians(CAST(-8.5 AS DOUBLE) + i * CAST(0.37 AS DOUBLE) - lon0) AS dl, radians(CAST(37 AS DOUBLE) + j * CAST(0.61 AS DOUBLE)) AS phi, radians(lat0) AS phi0
  FROM (VALUES (3763, CAST(-8.133108333333334 AS DOUBLE), CAST(39.66825833333333 AS DOUBLE), CAST(1 AS DOUBLE), 0.0), (32629, -9.0, 0.0, 0.9996, 500000.0)) s(epsg, lon0, lat0, k0, fe), range(-4, 5) a(i), range(0, 9) b(j)),
t AS (
  SELECT p.*, ra, e2, ep, ra / sqrt(1 - e2 * sin(phi) ** 2) AS n, tan(phi) ** 2 AS tt, ep * cos(phi) ** 2 AS c, dl * cos(phi) AS a,
         ra * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) AS arc,
         ra * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi0 - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi0) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi0) - 35 * e2 ** 3 / 3072 * sin(6 * phi0)) AS arc0
  FROM places p, k)"""

_REFUSED = {
    "GridRefusal": ["cell of 0", "empty extent", "too many cells", "block of 0 cells", "blocks that do not tile"],
    "CrsRefusal": ["geographic system", "unknown system", "no projection"],
    "Refusal": ["density of 0", "ground share above 1", "even step window", "margin of 0"],
    "ReadRefusal": ["coordinate that is not finite", "return outside its box", "returns of another system", "not a LAS file", "compressed file", "not a TIFF"],
    "EmptyFolder": ["folder without tiles"],
    "FilterRefusal": ["window of 0", "nothing measured, openings", "nothing measured, diamonds", "surface with holes", "net cutting", "cell that does not divide the block"],
    "BasisRefusal": ["nothing to interpolate from", "negative distance"],
    "CompareRefusal": ["nothing to compare", "no rasters", "band sets that differ", "no bands", "line to be replaced absent", "points that differ", "cache without a column"],
    "StampRefusal": ["stamp without an offset", "gap of 0"],
    "CatalogueRefusal": ["response without features", "item that lacks a part", "response that may be cut off", "system of a WKT unknown"],
    "SelectionRefusal": ["no tile in the area", "area without extent", "too little covered", "tile without a system", "tile without an entry"],
    "PrecheckRefusal": ["void ceiling of 1", "too sparse"],
    "RecordRefusal": ["empty attribution", "path for a file name"],
    "RenderRefusal": ["no valid cell to draw", "unknown basis code", "too many colours"],
    "AoiRefusal": ["area that is no polygon", "bounds without a system", "bounds of two numbers", "ring in degrees without a system"],
}

_NAMES = "names AS (SELECT n_name AS name, n_nationkey AS key, 'n' AS kind FROM nation UNION ALL SELECT r_name, r_regionkey, 'r' FROM region)"
_HIGH = (
    "high AS (SELECT g.* REPLACE (CAST(min_z_ground * 3 AS FLOAT) AS min_z_ground), coalesce(CAST(min_z AS DOUBLE) - base <= 0.0625, false) AS strict, n_reference_ground > 0 AS theirs FROM grounded g)",
    'src AS (SELECT "row", col, CAST(min_z_ground AS DOUBLE) AS z FROM high)',
    _window("src", "win", 3, "max(b.z) AS hi, min(b.z) AS lo, count(b.z) AS n"),
    """j AS (SELECT h.*, CASE WHEN w.n >= 2 AND w."row" BETWEEN 3 AND 236 AND w.col BETWEEN 3 AND 236 THEN w.hi - w.lo END AS step, w.n AS known FROM high h JOIN win w USING ("row", col) WHERE is_ground)""",
    """p AS (SELECT 'all' AS population, strict, theirs FROM j UNION ALL SELECT 'step > 1.5', strict, theirs FROM j WHERE step > 1.5 UNION ALL SELECT 'step > 2', strict, theirs FROM j WHERE step > 2
    UNION ALL SELECT 'step > 2.5', strict, theirs FROM j WHERE step > 2.5 UNION ALL SELECT 'step > 2.5, dense', strict, theirs FROM j WHERE step > 2.5 AND known >= 10)""",
)
_IMAGE_DIFF = """diff AS (
  SELECT u.band AS band, count(*) AS cells, count(*) FILTER (u.d) AS differing FROM (
  SELECT unnest([{'band': 'mdt', 'd': a.mdt IS DISTINCT FROM b.mdt}, {'band': 'mds', 'd': a.mds IS DISTINCT FROM b.mds}, {'band': 'chm', 'd': a.chm IS DISTINCT FROM b.chm}, {'band': 'basis', 'd': a.basis IS DISTINCT FROM b.basis},
                 {'band': 'n_all', 'd': a.n_all IS DISTINCT FROM b.n_all}, {'band': 'n_ground', 'd': a.n_ground IS DISTINCT FROM b.n_ground}]) AS u FROM bands a FULL JOIN bands1 b USING ("row", col)) GROUP BY 1)"""

SQL: dict[str, str] = {
    "las_read": _with(_POINTS) + "SELECT tile_id, x, y, z, CAST(class AS INT) AS classification, CAST(rn AS INT) AS return_number, CAST(nr AS INT) AS number_of_returns FROM all_pts",
    "las_files": _with(_POINTS) + "SELECT tile_id, 3763 AS crs_epsg, count(*) AS points FROM all_pts GROUP BY tile_id",
    "file_digests": f"WITH {_NAMES} SELECT name || '.txt' AS name, CAST(strlen(name) AS BIGINT) AS bytes, sha256(name) AS sha256 FROM names",
    "read_twice": _with(_POINTS) + "SELECT 'default' AS config, 2 * count(DISTINCT tile_id) AS reads, CAST(0 AS BIGINT) AS events FROM all_pts",
    "raster_bands": _with(_BASED, *_SURFACES)
    + """SELECT b.band, "row", col, CASE b.band WHEN 'mdt' THEN CAST(mdt AS DOUBLE) WHEN 'mds' THEN CAST(mds AS DOUBLE) WHEN 'chm' THEN CAST(chm AS DOUBLE) WHEN 'basis' THEN CAST(basis AS DOUBLE) WHEN 'n_all' THEN CAST(n_all AS DOUBLE)
       ELSE CAST(n_ground AS DOUBLE) END AS value FROM bands, (SELECT unnest(['mdt', 'mds', 'chm', 'basis', 'n_all', 'n_ground']) AS band) b""",
    "raster_headers": """SELECT band, CAST(240 AS INT) AS rows, CAST(240 AS INT) AS cols, CAST(nodata AS DOUBLE) AS nodata, CAST(0.5 AS DOUBLE) AS cell, CAST(0 AS DOUBLE) AS origin_x, CAST(120 AS DOUBLE) AS origin_y, CAST(0 AS BIGINT) AS nans
FROM (VALUES ('mdt', -9999), ('mds', -9999), ('chm', -9999), ('basis', 255), ('n_all', -1), ('n_ground', -1)) v(band, nodata)""",
    "run_comparison": _with(_BASED, *_SURFACES, *_NEAR_1, _bands("based1", "bands1"), _IMAGE_DIFF)
    + """SELECT band AS subject, cells || ' cells, ' || differing || ' differ' AS said FROM diff UNION ALL SELECT 'record', 'record: parameters changed' UNION ALL SELECT 'exit code', '1'""",
    "palette_basis": _with(_BASED, *_nearest("2.0"))
    + """SELECT CAST(CASE basis WHEN 0 THEN 215 WHEN 1 THEN 26 ELSE 254 END AS INT) AS r, CAST(CASE basis WHEN 0 THEN 48 WHEN 1 THEN 152 ELSE 224 END AS INT) AS g,
       CAST(CASE basis WHEN 0 THEN 39 WHEN 1 THEN 80 ELSE 139 END AS INT) AS b, 255 AS opacity, count(*) AS n FROM based GROUP BY basis""",
    "palette_layer": _with(_DENSE, "e AS (SELECT CAST(min(min_z) AS DOUBLE) AS lo, CAST(max(min_z) AS DOUBLE) AS hi FROM dense)",
        "l AS (SELECT CASE WHEN min_z IS NOT NULL THEN least(254, floor((CAST(min_z AS DOUBLE) - lo) / (hi - lo) * 255)) END AS level FROM dense, e)",
        "g AS (SELECT level, CAST(floor(CAST(255 AS DOUBLE) * (level * (1 / CAST(254 AS DOUBLE)))) AS INT) AS v, count(*) AS n FROM l GROUP BY level)")
    + "SELECT CAST(coalesce(CASE WHEN level = 254 THEN 255 ELSE v END, 0) AS INT) AS r, CAST(coalesce(CASE WHEN level = 254 THEN 255 ELSE v END, 0) AS INT) AS g, CAST(coalesce(CASE WHEN level = 254 THEN 255 ELSE v END, 0) AS INT) AS b, CASE WHEN level IS NULL THEN 0 ELSE 255 END AS opacity, n FROM g",
    "ramp_colours": "WITH places AS MATERIALIZED (SELECT i, CASE WHEN i = 254 THEN CAST(1 AS DOUBLE) ELSE i * (1 / CAST(254 AS DOUBLE)) END AS share FROM range(255) r(i)) " + " UNION ALL ".join(_stops(k, v) for k, v in _RAMPS.items()),
    "layer_styles": """SELECT kind, CAST(n_nationkey AS DOUBLE) AS value, '#' || lower(lpad(to_hex(n_nationkey * 10), 2, '0') || lpad(to_hex(255 - n_nationkey), 2, '0') || '07') AS colour, n_name AS label
FROM nation, (SELECT unnest(['paletted', 'ramp']) AS kind)""",
    "line_append": f"WITH {_NAMES} SELECT name, CAST(key AS BIGINT) AS key, CASE kind WHEN 'n' THEN CAST(2 AS BIGINT) ELSE 1 END AS n FROM names",
    "selection_read": _with(("tiles",), *_CHOSEN) + "SELECT item_id, point_count, point_count / ((maxx - minx) * (maxy - miny)) AS density, minx, miny, maxx, maxy FROM k WHERE kept",
    "selection_facts": _with(("tiles",), *_CHOSEN, *_UNION_OF_KEPT)
    + """SELECT (SELECT sum(area) / 16800 FROM c) AS covered_fraction, CAST(count(DISTINCT sortie) FILTER (kept) AS INT) AS sorties, count(DISTINCT sortie) FILTER (kept) > 1 AS mixed_epochs, CAST(count(*) FILTER (NOT kept) AS INT) AS dropped,
       arg_min(item_id, (minx, miny)) FILTER (kept) AS first_tile FROM k""",
    "aoi_boxes": """WITH n AS (SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) AS k, n_nationkey % 4 AS way FROM nation)
SELECT name, CASE WHEN way < 3 THEN k END AS minx, CASE way WHEN 0 THEN k + 1 WHEN 3 THEN NULL ELSE 2 * k END AS miny, CASE way WHEN 0 THEN k + 2 WHEN 3 THEN NULL ELSE k + 5 END AS maxx,
       CASE way WHEN 0 THEN k + 3 WHEN 3 THEN NULL ELSE 2 * k + 7 END AS maxy, CAST(CASE way WHEN 0 THEN 3763 WHEN 1 THEN 32629 WHEN 2 THEN 25829 END AS INT) AS epsg, way = 3 AS refused FROM n""",
    "zoned_stamps": """SELECT event_id, CAST(epoch(date_trunc('second', ts)) - CASE event_id % 3 WHEN 1 THEN 7200 WHEN 2 THEN -19800 ELSE 0 END AS BIGINT) AS second FROM events""",
    "record_hash": _with(_POINTS, "f AS (SELECT tile_id, count(*) AS n, sha256(tile_id) AS digest FROM all_pts GROUP BY tile_id)",
        f"""h AS (SELECT sha256('{{"grid":{{"cell":0.5,"crs_epsg":3763,"n_cols":240,"n_rows":240,"origin_x":0.0,"origin_y":120.0}},"inputs":['
    || string_agg('{{"item_id":"' || tile_id || '","sha256":"' || digest || '"}}', ',' ORDER BY tile_id) || '],"package_version":"{__version__}","parameters":{{"cell":0.5,"smrf_slope":0.15}}}}') AS hash FROM f)""")
    + "SELECT tile_id AS item_id, CAST(row_number() OVER (ORDER BY tile_id) - 1 AS INT) AS place, n AS points, hash FROM f, h",
    "list_rewrite": f"WITH {_NAMES}" + """, o AS (SELECT name, row_number() OVER (ORDER BY kind, key) - 1 AS place, kind FROM names)
SELECT CAST(place AS INT) AS place, CASE WHEN kind = 'n' AND place % 5 = 0 THEN lower(name) || '!' ELSE name END AS line FROM o""",
    "grids_for_boxes": """WITH b AS (SELECT s_suppkey, s_acctbal AS minx, -s_acctbal / 2 AS miny, s_acctbal + 30.25::DOUBLE AS maxx, -s_acctbal / 2 + 17.75::DOUBLE + s_suppkey % 7 AS maxy FROM supplier),
o AS (SELECT *, floor(minx / 0.5::DOUBLE) * 0.5::DOUBLE AS origin_x, ceil(maxy / 0.5::DOUBLE) * 0.5::DOUBLE AS origin_y FROM b)
SELECT s_suppkey, origin_x, origin_y, CAST(2 * ceil(ceil((maxx - origin_x) / 0.5::DOUBLE) / 2) AS INT) AS n_cols, CAST(2 * ceil(ceil((origin_y - miny) / 0.5::DOUBLE) / 2) AS INT) AS n_rows FROM o""",
    "metric_codes": """SELECT CAST(code AS INT) AS code FROM range(2000, 33000) r(code) WHERE code BETWEEN 32601 AND 32660 OR code BETWEEN 32701 AND 32760 OR code BETWEEN 25828 AND 25838 OR code BETWEEN 26901 AND 26923 OR code BETWEEN 3034 AND 3035
   OR code IN (3763, 2154, 27700, 3857, 2056, 28992, 5514, 2180, 3067, 3006)""",
    "block_factors": "SELECT CAST(n AS INT) AS fortieths, CASE WHEN 40 % n = 0 THEN CAST(40 // n AS INT) END AS factor FROM range(1, 41) r(n)",
    "ramp_reaches": "SELECT CAST(d AS INT) AS degrees, diagonal, 3.0 * CASE WHEN diagonal THEN sqrt(2) ELSE 1 END * tan(radians(d)) > 2.5 AS reaches FROM range(1, 90) r(d), (SELECT unnest([true, false]) AS diagonal)",
    "ramp_verdicts": """WITH b AS (SELECT unnest([true, false]) AS v) SELECT a.v AS reached1, b.v AS reached2, c.v AS entered1, d.v AS entered2, e.v AS may1, f.v AS may2,
       (e.v OR f.v) AND a.v = e.v AND b.v = f.v AND NOT c.v AND NOT d.v AS passes FROM b a, b b, b c, b d, b e, b f""",
    "projected": f"WITH {_SERIES}" + """ SELECT CAST(epsg AS INT) AS epsg, CAST(i AS INT) AS i, CAST(j AS INT) AS j,
       round(fe + k0 * n * (a + (1 - tt + c) * a ** 3 / 6 + (5 - 18 * tt + tt ** 2 + 72 * c - 58 * ep) * a ** 5 / 120), 1) AS x,
       round(k0 * (arc - arc0 + n * tan(phi) * (a ** 2 / 2 + (5 - tt + 9 * c + 4 * c ** 2) * a ** 4 / 24 + (61 - 58 * tt + tt ** 2 + 600 * c - 330 * ep) * a ** 6 / 720)), 1) AS y, true AS returns FROM t""",
    "scenes": """WITH l AS (SELECT CAST(48000 AS DOUBLE) + (i % 20) * CAST(0.5 AS DOUBLE) AS x, CAST(169000 AS DOUBLE) + (i // 20) * CAST(0.5 AS DOUBLE) AS y FROM range(400) r(i))
SELECT 'ramp' AS scene, x, y, (x - 48000) * CAST(0.1 AS DOUBLE) AS z, 2 AS classification FROM l
UNION ALL SELECT 'terraced', x, y, floor((x - 48000) / 6) * CAST(1.5 AS DOUBLE), 2 FROM l UNION ALL SELECT 'hillside', x, y, 0 - floor(abs(x - 48005) / 6) * CAST(1.5 AS DOUBLE), 2 FROM l
UNION ALL SELECT 'holed', x, y, (x - 48000) * CAST(0.1 AS DOUBLE), 2 FROM l WHERE NOT (x >= 48002 AND x < 48006 AND y > 169003 AND y <= 169007)""",
    "lattice_function": "SELECT CAST(48000 AS DOUBLE) + (i % 24) * CAST(0.25 AS DOUBLE) AS x, CAST(169000 AS DOUBLE) + (i // 24) * CAST(0.25 AS DOUBLE) AS y FROM range(576) r(i)",
    "block_keys": _with(_POINTS) + "SELECT CAST(floor((x - 61) / 7) AS INT) AS bx, CAST(floor((y - CAST(59.5 AS DOUBLE)) / 7) AS INT) AS by, count(*) AS n FROM kept GROUP BY 1, 2",
    "zone_crop": _with(_DENSE)
    + """SELECT CAST("row" - 60 AS INT) AS "row", CAST(col - 40 AS INT) AS col, min_z, n_all, CAST(20 AS DOUBLE) AS origin_x, CAST(90 AS DOUBLE) AS origin_y, CAST(100 AS INT) AS n_cols, CAST(120 AS INT) AS n_rows FROM dense WHERE "row" >= 60 AND "row" < 180 AND col >= 40 AND col < 140""",
    "point_differences": "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0",
    "run_honesty": _with((*_DENSE, "blocks", "cgrid", "coarse"), *_SMRF,
        """grounded AS (SELECT d.*, coalesce(abs(s.z - CAST(d.min_z AS DOUBLE)) <= 0.5 + 1.25 * sqrt(s.gx * s.gx + s.gy * s.gy), false) AS is_ground FROM dense d JOIN slopes s ON s."row" = d."row" // 2 AND s.col = d.col // 2)""",
        *_nearest("2.0"))
    + """SELECT CAST(count(*) FILTER (basis = 1) AS DOUBLE) / count(*) AS measured, CAST(count(*) FILTER (basis = 2) AS DOUBLE) / count(*) AS interpolated, CAST(count(*) FILTER (basis = 0) AS DOUBLE) / count(*) AS undetermined,
       (SELECT count(*) FROM kept WHERE NOT (x >= 0 AND x < 120 AND y > 0 AND y <= 120)) AS outside, count(*) FILTER (is_ground AND n_all > 0 AND n_ground > 0) AS tp, CAST((SELECT count(DISTINCT tile_id) FROM all_pts) AS INT) AS tiles FROM based""",
    "measured_basis": oracle.SQL["pmf_ground"].replace('SELECT "row", col, d.min_z IS NOT NULL AND NOT', 'SELECT "row", col FROM (SELECT "row", col, d.min_z IS NOT NULL AND NOT') + ") WHERE is_ground",
    "filter_table": _with(_COMPARED, *_POPULATIONS) + "SELECT * FROM shares",
    "filter_checks": _with(_COMPARED, *_POPULATIONS,
        "o AS (SELECT f.*, n_all > 0 AS seen FROM f WHERE n_all > 0)",
        "q AS (SELECT count(*) AS n, count(*) FILTER (is_ground AND theirs) AS tp, count(*) FILTER (is_ground AND NOT theirs) AS fp, count(*) FILTER (NOT is_ground AND theirs) AS fn, count(*) FILTER (NOT is_ground AND NOT theirs) AS tn FROM o)",
        "kap AS (SELECT CAST(tp + tn AS DOUBLE) / n AS po, (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(fn + tn AS DOUBLE) * (fp + tn)) / (CAST(n AS DOUBLE) * n) AS pe FROM q)",
        "bx AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM all_pts GROUP BY tile_id)",
        'ce AS (SELECT "row", col, (col + 0.5) * 0.5 AS x, 120 - ("row" + 0.5) * 0.5 AS y FROM o)',
        "far AS (SELECT count(*) AS n FROM ce WHERE NOT EXISTS (SELECT 1 FROM bx WHERE x >= minx - 1 AND x <= maxx + 1 AND y >= miny - 1 AND y <= maxy + 1 AND NOT (x > minx + 1 AND x < maxx - 1 AND y > miny + 1 AND y < maxy - 1)))",
        """v AS (SELECT 'plain ground called ground' AS name, (SELECT ours_pct FROM shares WHERE name = 'plain_ground') AS value, '>=' AS sign, CAST(97 AS DOUBLE) AS bound
    UNION ALL SELECT 'roof called ground', (SELECT ours_pct FROM shares WHERE name = 'building_no_ground'), '<=', 30 UNION ALL SELECT 'agreement', (SELECT round(100 * po, 9) FROM kap), '>=', 90 UNION ALL SELECT 'kappa', (SELECT round((po - pe) / (1 - pe), 9) FROM kap), '>=', 0.6)""",
        "w AS (SELECT *, CASE sign WHEN '>=' THEN value >= bound ELSE value <= bound END AS passed FROM v)")
    + "SELECT * FROM w UNION ALL SELECT 'away from seams', CAST((SELECT n FROM far) AS DOUBLE), '', 0, (SELECT bool_and(passed) FROM w)",
    "terrace_table": _with(_COMPARED, *_HIGH, "pops AS (SELECT unnest(['all', 'step > 1.5', 'step > 2', 'step > 2.5', 'step > 2.5, dense']) AS population)")
    + """SELECT population, count(p.strict) AS cells, round(100 * CAST(count(*) FILTER (p.strict) AS DOUBLE) / nullif(count(p.strict), 0), 9) AS kept_pct, round(100 * CAST(count(*) FILTER (p.theirs) AS DOUBLE) / nullif(count(p.strict), 0), 9) AS reference_pct
FROM pops LEFT JOIN p USING (population) GROUP BY population""",
    "plane_residual": _with(_DENSE, *_steps("min_z"), "picked AS (SELECT * FROM steps WHERE step > 2.5)", _FITS) + 'SELECT "row", col, round(residual, 6) AS residual FROM fits',
    "sharp_report": _with(_COMPARED, *_steps("min_z_ground"), "picked AS (SELECT * FROM steps WHERE step > 1.5)", _FITS, 'm AS (SELECT p."row", p.col, f.residual, g.is_ground, coalesce(f.residual >= 0.3, false) AS member FROM picked p JOIN fits f USING ("row", col) JOIN grounded g USING ("row", col))')
    + """SELECT count(*) AS candidates, count(*) FILTER (member) AS population, count(*) FILTER (residual < 0.1) AS near_planar, round(quantile_cont(residual, 0.1), 6) AS p10, round(quantile_cont(residual, 0.25), 6) AS p25, round(quantile_cont(residual, 0.5), 6) AS p50,
       round(quantile_cont(residual, 0.75), 6) AS p75, round(quantile_cont(residual, 0.9), 6) AS p90, round(100 * CAST(count(*) FILTER (member AND is_ground) AS DOUBLE) / count(*) FILTER (member), 9) AS is_ground_pct FROM m""",
    "confounded_steps": _with(_COMPARED, *_steps("min_z_ground"), "picked AS (SELECT * FROM steps WHERE step > 1.5)", _FITS, 'm AS (SELECT f.residual, g.n_reference_ground > 0 AS theirs FROM picked p JOIN fits f USING ("row", col) JOIN grounded g USING ("row", col) WHERE g.is_ground)',
        """s AS (SELECT 'all' AS subset, theirs FROM m UNION ALL SELECT 'residual >= 0.10', theirs FROM m WHERE residual >= 0.1 UNION ALL SELECT 'residual >= 0.20', theirs FROM m WHERE residual >= 0.2 UNION ALL SELECT 'residual >= 0.30', theirs FROM m WHERE residual >= 0.3
    UNION ALL SELECT 'residual >= 0.50', theirs FROM m WHERE residual >= 0.5 UNION ALL SELECT 'residual < 0.10', theirs FROM m WHERE residual < 0.1)""",
        "names AS (SELECT unnest(['all', 'residual >= 0.10', 'residual >= 0.20', 'residual >= 0.30', 'residual >= 0.50', 'residual < 0.10']) AS subset)")
    + "SELECT subset, count(s.theirs) AS cells, round(100 * CAST(count(*) FILTER (s.theirs) AS DOUBLE) / nullif(count(s.theirs), 0), 9) AS theirs_pct FROM names LEFT JOIN s USING (subset) GROUP BY subset",
    "riser_report": _with(_DENSE, *_CLUSTERS, recursive=True)
    + """SELECT CAST(57600 AS BIGINT) AS cells, count(*) AS candidates, (SELECT count(*) FROM rounds WHERE seq = best) AS clusters, round_even(quantile_cont(height, 0.5), 3) AS p50, round_even(quantile_cont(height, 0.9), 3) AS p90, max(height) AS highest,
       (SELECT max(height) FROM rounds WHERE seq = best) AS top FROM risers""",
    "catalogue_triage": _with(("tiles",), "v AS (SELECT day, point_count / ((maxx - minx) * (maxy - miny)) AS density FROM tiles)")
    + """SELECT count(*) AS tiles, CAST(count(DISTINCT day) AS INT) AS days, min(density) AS least_density, max(density) AS most_density, round(max(exp(-density * (CAST(0.25 AS DOUBLE) * CAST(0.4 AS DOUBLE)))), 12) AS worst_void, true AS refused FROM v""",
    "smoke_tiles": _with(_POINTS)
    + """SELECT tile_id, count(*) - CASE WHEN tile_id LIKE '%1' THEN 5 ELSE 0 END AS declared, count(*) AS measured, CAST(CASE WHEN tile_id LIKE '%1' THEN 5 ELSE 0 END AS BIGINT) AS delta,
       round_even(min(x), 3) = min(x) AND round_even(min(y), 3) = min(y) AND round_even(max(x), 3) = max(x) + CASE WHEN tile_id LIKE '%1' THEN 5 ELSE 0 END AND round_even(max(y), 3) = max(y) AS same_box FROM all_pts GROUP BY tile_id""",
    "smoke_canopy": _with(_POINTS, "inside AS (SELECT * FROM kept WHERE x >= 20 AND x < 70 AND y >= 30 AND y < 90)",
        "low AS (SELECT floor((x - 20) / 10) AS bx, floor((y - 30) / 10) AS by, min(z) AS low FROM inside WHERE class = 2 GROUP BY ALL)",
        "h AS (SELECT i.*, i.z - l.low AS height FROM inside i JOIN low l ON l.bx = floor((i.x - 20) / 10) AND l.by = floor((i.y - 30) / 10))",
        "b AS (SELECT CAST(count(*) FILTER (height > 2) AS DOUBLE) / count(*) AS share FROM h GROUP BY floor((x - 20) / 20), floor((y - 30) / 20))")
    + """SELECT (SELECT count(*) FROM inside) AS returns, count(*) AS with_ground, round(CAST(count(*) FILTER (height >= 2) AS DOUBLE) / count(*), 12) AS over_2, (SELECT count(*) FROM b) AS blocks, (SELECT count(*) FROM b WHERE share < 0.05) AS bare,
       (SELECT count(*) FROM b WHERE share > 0.5) AS covered, (SELECT count(*) FROM inside WHERE class = 2) AS ground, (SELECT CAST(count(*) AS DOUBLE) FROM inside WHERE class = 2) / 3000 AS ground_density FROM h""",
    "stream_outside": oracle.SQL["outside_counts"],
    "stream_sessions": """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN ts - before > INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS sortie FROM l)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, sortie""",
    "stream_guarded": _with(_CELLS) + 'SELECT "row", col, min_z, max_z, n_all FROM cells',
    "refusals": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{name}')" for name, conditions in _REFUSED.items() for c in conditions) + ") v(condition, refused_by)",
}
