"""DuckDB SQL with the rows of the queries, in another formulation where there is one: self-joins over offsets for windows,
counting joins for erosion, ranked joins for neighbours, recursion for fixpoints."""

from __future__ import annotations

_PARTS = {
    "raw": """raw AS (
  SELECT *, CAST(floor(CAST(l_partkey % 120 AS DOUBLE) / 12) AS DOUBLE) * 1.5 AS base,
         CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 5 ELSE CASE l_linestatus WHEN 'F' THEN 6 ELSE 7 END END AS class
  FROM lineitem)""",
    "pts": """pts AS (
  SELECT CAST(l_partkey % 120 AS DOUBLE) + l_quantity / CAST(64 AS DOUBLE) AS x, CAST(l_orderkey % 120 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 8 AS y, class,
         base + CASE class WHEN 2 THEN CAST(l_suppkey % 8 AS DOUBLE) / 64 WHEN 5 THEN 2 + CAST(l_suppkey % 64 AS DOUBLE) / 16 WHEN 6 THEN CAST(6 AS DOUBLE) ELSE CAST(500 AS DOUBLE) END AS z,
         l_linenumber AS rn, greatest(l_linenumber, 1 + l_suppkey % 7) AS nr, l_suppkey AS pulse
  FROM raw)""",
    "all_pts": """all_pts AS (
  SELECT *, ((nr = 1 OR rn = nr) AND class <> 7) AS judged,
         CASE WHEN (nr = 1 OR rn = nr) AND class <> 7 THEN CASE WHEN pulse % 3 = 0 THEN 2 ELSE 1 END ELSE class END AS ref,
         CAST(floor(y / 40) AS INT) || '_' || CAST(floor(x / 40) AS INT) AS tile_id,
         CAST(floor((120 - y) * 2) AS INT) AS "row", CAST(floor(x * 2) AS INT) AS col
  FROM pts)""",
    "kept": "kept AS (SELECT * FROM all_pts WHERE class NOT IN (7, 18))",
    "cells": """cells AS (
  SELECT "row", col, CAST(min(z) AS FLOAT) AS min_z, CAST(max(z) AS FLOAT) AS max_z, CAST(count(*) AS INT) AS n_all,
         CAST(count(*) FILTER (class = 2) AS INT) AS n_ground, CAST(min(z) FILTER (class = 2) AS FLOAT) AS min_z_ground,
         CAST(count(*) FILTER (class = 5) AS INT) AS n_class5, CAST(count(*) FILTER (class = 6) AS INT) AS n_class6,
         CAST(count(*) FILTER (judged AND ref = 2) AS INT) AS n_reference_ground, CAST(min(z) FILTER (judged) AS FLOAT) AS min_z_judged,
         CAST(min(z) FILTER (judged AND ref = 2) AS FLOAT) AS min_z_reference_ground
  FROM kept GROUP BY "row", col)""",
    "grid": """grid AS (SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col FROM range(240) a(r), range(240) b(c))""",
    "dense": """dense AS (
  SELECT "row", col, min_z, max_z, coalesce(n_all, 0) AS n_all, coalesce(n_ground, 0) AS n_ground, min_z_ground,
         coalesce(n_class5, 0) AS n_class5, coalesce(n_class6, 0) AS n_class6, coalesce(n_reference_ground, 0) AS n_reference_ground,
         CAST(col // 24 AS DOUBLE) * 1.5 AS base
  FROM grid LEFT JOIN cells USING ("row", col))""",
    "filled": 'filled AS (SELECT "row", col, coalesce(CAST(min_z AS DOUBLE), base) AS z FROM dense)',
    "blocks": 'blocks AS (SELECT CAST("row" // 2 AS INT) AS "row", CAST(col // 2 AS INT) AS col, min(min_z) AS min_z FROM cells GROUP BY ALL)',
    "cgrid": """cgrid AS (SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col FROM range(120) a(r), range(120) b(c))""",
    "coarse": 'coarse AS (SELECT "row", col, CAST(min_z AS DOUBLE) AS z FROM cgrid LEFT JOIN blocks USING ("row", col))',
    "cfilled": 'cfilled AS (SELECT "row", col, coalesce(z, CAST(col // 12 AS DOUBLE) * 1.5) AS z FROM coarse)',
    "grounded": "grounded AS (SELECT *, coalesce(CAST(min_z AS DOUBLE) - base <= 0.5, false) AS is_ground FROM dense)",
    "tiles": """tiles AS (
  SELECT 'T' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS item_id, CAST(s_suppkey % 10 AS DOUBLE) * 20 AS minx, CAST((s_suppkey // 10) % 10 AS DOUBLE) * 20 AS miny,
         CAST(s_suppkey % 10 AS DOUBLE) * 20 + 22 AS maxx, CAST((s_suppkey // 10) % 10 AS DOUBLE) * 20 + CAST(20.5 AS DOUBLE) AS maxy, 400 + s_suppkey * 37 AS point_count,
         s_nationkey // 5 AS day
  FROM supplier)""",
}

_POINTS = ("raw", "pts", "all_pts", "kept")
_CELLS = (*_POINTS, "cells")
_DENSE = (*_CELLS, "grid", "dense")
_COARSE = (*_CELLS, "blocks", "cgrid", "coarse")


def _with(parts: tuple[str, ...], *more: str, recursive: bool = False) -> str:
    """The parts as common table expressions, each computed once however often it is used; one that refers to itself stays as it is."""
    listed = [*(_PARTS[p] for p in parts), *more]
    once = []
    for part in listed:
        name, _, body = part.partition(" AS ")
        once.append(part if recursive and f"FROM {name}" in body else f"{name} AS MATERIALIZED {body}")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(once) + "\n"


def _around(source: str, r: int, where: str = "true") -> str:
    """Each cell of a source once for each offset, as a; the key f names the place it looks at."""
    return f"""(SELECT s."row", s.col, dr * dr + dc * dc AS d2, (s."row" + dr) * 1000 + s.col + dc AS f FROM {source} s, range(-{r}, {r + 1}) i(dr), range(-{r}, {r + 1}) j(dc) WHERE {where}) a"""


def _placed(source: str, where: str = "true") -> str:
    """The cells of a source under the key of their place, as b."""
    return f"""(SELECT *, "row" * 1000 + col AS f FROM {source} WHERE {where}) b"""


def _window(source: str, out: str, r: int, aggs: str, shape: str = "true") -> str:
    """A stencil by joining each cell with the cells around it."""
    return f"""{out} AS (
  SELECT a."row", a.col, {aggs} FROM {_around(source, r, shape)} JOIN {_placed(source)} ON a.f = b.f GROUP BY a."row", a.col)"""


def _open(source: str, out: str, r: int, shape: str = "true") -> tuple[str, str]:
    return _window(source, f"{out}_e", r, "min(b.z) AS z", shape), _window(f"{out}_e", out, r, "max(b.z) AS z", shape)


def _ball(r: int) -> str:
    return f"abs(dr) + abs(dc) <= {r}"


def _nearest(distance: str) -> tuple[str, str]:
    """Basis and nearest source within a distance in cells."""
    return (
        f"""near AS (
  SELECT g."row" + dr AS "row", g.col + dc AS col, min((dr * dr + dc * dc) * 100000000 + g."row" * 240 + g.col) AS best
  FROM grounded g, range(-4, 5) i(dr), range(-4, 5) j(dc) WHERE g.is_ground AND g.n_all >= 1 AND sqrt(dr * dr + dc * dc) * 0.5 <= {distance} GROUP BY ALL)""",
        """based AS (
  SELECT g.*, CASE WHEN g.is_ground AND g.n_all >= 1 THEN 1 WHEN n.best IS NOT NULL THEN 2 ELSE 0 END AS basis,
         CAST((n.best % 100000000) // 240 AS INT) AS src_row, CAST((n.best % 100000000) % 240 AS INT) AS src_col
  FROM grounded g LEFT JOIN near n ON n."row" = g."row" AND n.col = g.col)""",
    )


def _bands(source: str, out: str) -> str:
    return f"""{out} AS (
  SELECT "row", col, mdt, mds, CAST(CASE WHEN basis = 1 THEN mds - mdt END AS FLOAT) AS chm, basis, n_all, n_ground
  FROM (SELECT b."row", b.col, CAST(CASE b.basis WHEN 1 THEN b.min_z WHEN 2 THEN s.min_z END AS FLOAT) AS mdt,
               CAST(CASE WHEN b.n_all > 0 THEN b.max_z END AS FLOAT) AS mds, b.basis, b.n_all, b.n_ground
        FROM {source} b LEFT JOIN cells s ON s."row" = b.src_row AND s.col = b.src_col))"""


_BASED = (*_DENSE, "grounded")
_SURFACES = (*_nearest("2.0"), _bands("based", "bands"))
_NEAR_1 = tuple(x.replace("near AS", "near1 AS").replace("based AS", "based1 AS").replace("JOIN near n", "JOIN near1 n") for x in _nearest("1.0"))

_PROFILES = """profiles AS (
  SELECT 'row' AS direction, "row" AS profile, col AS pos, "row", col, z, CAST(0.5 AS DOUBLE) AS h FROM line
  UNION ALL SELECT 'col', col, "row", "row", col, z, 0.5 FROM line
  UNION ALL SELECT 'diag', col - "row", least("row", col), "row", col, z, 0.5 * sqrt(2) FROM line WHERE col - "row" NOT IN (-239, 239)
  UNION ALL SELECT 'adiag', col - (239 - "row"), least(239 - "row", col), "row", col, z, 0.5 * sqrt(2) FROM line WHERE col - (239 - "row") NOT IN (-239, 239))"""

_RISERS = (
    'line AS (SELECT "row", col, coalesce(CAST(min_z_ground AS DOUBLE), base) AS z FROM dense)',
    _PROFILES,
    """gaps AS (
  SELECT a.direction, a.profile, a.pos, a.h, a.z, b.z AS nz, (b.z - a.z) / a.h AS s
  FROM profiles a JOIN profiles b ON b.direction = a.direction AND b.profile = a.profile AND b.pos = a.pos + 1)""",
    """kinds AS (SELECT *, CASE WHEN abs(s) <= 0.27 THEN 'tread' WHEN s >= 0.8 THEN 'up' WHEN s <= -0.8 THEN 'down' ELSE 'other' END AS kind FROM gaps)""",
    """numbered AS (
  SELECT *, pos - row_number() OVER (PARTITION BY direction, profile, kind ORDER BY pos) AS isle FROM kinds)""",
    """isles AS (
  SELECT direction, profile, kind, min(pos) AS first, max(pos) AS last, count(*) AS n, any_value(h) AS h, arg_min(z, pos) AS z0, arg_max(nz, pos) AS z1
  FROM numbered GROUP BY direction, profile, kind, isle)""",
    """found AS (
  SELECT r.direction, r.profile, r.first + r.n // 2 AS mid, r.n, r.h, abs(r.z1 - r.z0) AS height, b.n AS before, a.n AS after
  FROM isles r JOIN isles b ON b.direction = r.direction AND b.profile = r.profile AND b.kind = 'tread' AND b.last = r.first - 1
               JOIN isles a ON a.direction = r.direction AND a.profile = r.profile AND a.kind = 'tread' AND a.first = r.last + 1
  WHERE r.kind IN ('up', 'down') AND r.n <= floor(3 / r.h) AND abs(r.z1 - r.z0) >= 0.5 AND b.n >= ceil(2 / r.h) AND a.n >= ceil(2 / r.h))""",
    """risers AS (
  SELECT f.direction, p."row", p.col, round_even(f.height, 3) AS height, round_even(f.n * f.h, 3) AS width, CAST(f.n + 1 AS INT) AS n_run,
         round_even(f.before * f.h, 2) AS tread_before, round_even(f.after * f.h, 2) AS tread_after
  FROM found f JOIN profiles p ON p.direction = f.direction AND p.profile = f.profile AND p.pos = f.mid)""",
)

_HEIGHTS = """heights AS (
  SELECT k.*, k.z - g.low AS height FROM kept k JOIN (
    SELECT floor(x / 10) AS bx, floor(y / 10) AS by, min(z) AS low FROM kept WHERE class = 2 GROUP BY ALL) g ON g.bx = floor(k.x / 10) AND g.by = floor(k.y / 10))"""

_STEPS = """steps AS (
  SELECT "row", col, hi - lo AS step, CAST(n AS INT) AS n FROM win WHERE n >= 2 AND "row" BETWEEN 3 AND 236 AND col BETWEEN 3 AND 236)"""


def _steps(value: str) -> tuple[str, str, str]:
    source = f'src AS (SELECT "row", col, CAST({value} AS DOUBLE) AS z FROM dense)'
    return source, _window("src", "win", 3, "max(b.z) AS hi, min(b.z) AS lo, count(b.z) AS n"), _STEPS


_PLANE = """fits AS (
  SELECT "row", col, n, sxx, sxy, syy, sxz, syz, szz, sxx * syy - sxy * sxy AS det FROM (
    SELECT a."row", a.col, count(*) AS n, covar_pop(x, x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, covar_pop(y, y) * count(*) AS syy,
           covar_pop(x, z) * count(*) AS sxz, covar_pop(y, z) * count(*) AS syz, covar_pop(z, z) * count(*) AS szz
    FROM (SELECT t."row", t.col, t.x, t.y, s.z
          FROM (SELECT "row", col, dc * CAST(0.5 AS DOUBLE) AS x, dr * CAST(0.5 AS DOUBLE) AS y, ("row" + dr) * 1000 + col + dc AS f FROM picked, range(-3, 4) i(dr), range(-3, 4) j(dc)) t
          JOIN (SELECT "row" * 1000 + col AS f, z FROM src WHERE z IS NOT NULL) s ON s.f = t.f) a
    GROUP BY a."row", a.col))"""
_RESIDUAL = "sqrt(greatest(0, szz - (sxz * (sxz * syy - syz * sxy) + syz * (syz * sxx - sxz * sxy)) / det) / n)"

_VERIFIED = "points AS (SELECT * FROM (VALUES ('riser', 12.1, 60.2), ('tread', 6.3, 60.2), ('second riser', 24.2, 33.3), ('edge', 0.4, 0.4), ('outside', -5.0, 10.0)) v(name, x, y))"

_CLUSTERS = (
    *_RISERS,
    """placed AS (
  SELECT direction, "row", col, height, round_even(CAST((col + 0.5) * 0.5 AS DOUBLE), 2) AS x, round_even(CAST(120 - ("row" + 0.5) * 0.5 AS DOUBLE), 2) AS y,
         CASE direction WHEN 'row' THEN 0 WHEN 'col' THEN 1 WHEN 'diag' THEN 2 ELSE 3 END * 57600 + "row" * 240 + col AS seq FROM risers)""",
    # each round the best of what is left stays and takes its neighbours with it
    """rounds AS (
  SELECT 0 AS round, *, first_value(seq) OVER (ORDER BY height DESC, seq) AS best, first_value(x) OVER (ORDER BY height DESC, seq) AS cx, first_value(y) OVER (ORDER BY height DESC, seq) AS cy FROM placed
  UNION ALL
  SELECT round + 1, direction, "row", col, height, x, y, seq, first_value(seq) OVER (ORDER BY height DESC, seq), first_value(x) OVER (ORDER BY height DESC, seq), first_value(y) OVER (ORDER BY height DESC, seq)
  FROM rounds WHERE (x - cx) ** 2 + (y - cy) ** 2 > 25)""",
)


def _fill(source: str, out: str, r: int) -> tuple[str, str]:
    """Each void gets the mean of its eight nearest values."""
    return (
        f"""{out}_near AS (SELECT a."row", a.col, b.z, row_number() OVER (PARTITION BY a."row", a.col ORDER BY a.d2, b."row", b.col) AS k
  FROM {_around(source, r, "s.z IS NULL")} JOIN {_placed(source, "z IS NOT NULL")} ON a.f = b.f)""",
        f"""{out} AS (SELECT s."row", s.col, coalesce(s.z, m.z) AS z FROM {source} s LEFT JOIN (SELECT "row", col, avg(z) AS z FROM {out}_near WHERE k <= 8 GROUP BY ALL) m USING ("row", col))""",
    )


_RADII = range(1, 19)
_SMRF = (
    *_fill("coarse", "f1", 24),
    *(part for k in _RADII for part in _open("f1", f"o{k}", k, _ball(k))),
    'neg AS (SELECT "row", col, -z AS z FROM f1)',
    *_open("neg", "n1", 1, _ball(1)),
    'cut AS (SELECT "row", col, CASE WHEN NOT (abs(neg.z - n1.z) > 5'
    + "".join(f" OR abs({'f1' if k == 1 else f'o{k - 1}'}.z - o{k}.z) > CAST(0.15 AS DOUBLE) * {k}" for k in _RADII)
    + ') THEN f1.z END AS z FROM f1 JOIN neg USING ("row", col) JOIN n1 USING ("row", col) '
    + " ".join(f'JOIN o{k} USING ("row", col)' for k in _RADII)
    + ")",
    *_fill("cut", "dem", 40),
    """slopes AS (
  SELECT m."row", m.col, m.z, CASE WHEN m.col = 0 THEN e.z - m.z WHEN m.col = 119 THEN m.z - w.z ELSE (e.z - w.z) / 2 END AS gx,
         CASE WHEN m."row" = 0 THEN s.z - m.z WHEN m."row" = 119 THEN m.z - n.z ELSE (s.z - n.z) / 2 END AS gy
  FROM dem m LEFT JOIN dem e ON e."row" = m."row" AND e.col = m.col + 1 LEFT JOIN dem w ON w."row" = m."row" AND w.col = m.col - 1
  LEFT JOIN dem s ON s."row" = m."row" + 1 AND s.col = m.col LEFT JOIN dem n ON n."row" = m."row" - 1 AND n.col = m.col)""",
)

_EVENT_JSON = "CAST(json_extract(props, '$.k') AS DOUBLE)"

SQL: dict[str, str] = {
    "cell_stats": _with(_CELLS) + 'SELECT "row", col, min_z, max_z, n_all, n_ground, min_z_ground FROM cells',
    "cell_stats_dense": _with(_DENSE) + 'SELECT "row", col, min_z, max_z, n_all, n_ground, min_z_ground FROM dense',
    "stream_fold": _with(_CELLS) + 'SELECT "row", col, min_z, max_z, n_all, n_ground, min_z_ground FROM cells',
    "reference_cells": _with(_CELLS) + "SELECT * FROM cells",
    "noise_counts": _with(_POINTS)
    + """SELECT tile_id, CAST(count(*) AS INT) AS n_in_file, CAST(count(*) FILTER (class IN (7, 18)) AS INT) AS n_noise, CAST(count(*) FILTER (class NOT IN (7, 18)) AS INT) AS n_points,
       bool_or(class = 2) AS has_official_ground, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM all_pts GROUP BY tile_id""",
    "outside_counts": _with(_POINTS)
    + """SELECT CAST(count(*) FILTER (x >= 20 AND x < 100 AND y > 20 AND y <= 100) AS BIGINT) AS n_in, CAST(count(*) FILTER (NOT (x >= 20 AND x < 100 AND y > 20 AND y <= 100)) AS BIGINT) AS n_out FROM kept""",
    "stray_counts": _with(
        _POINTS,
        "b AS (SELECT *, CAST(split_part(tile_id, '_', 2) AS DOUBLE) * 40 AS fx, CAST(split_part(tile_id, '_', 1) AS DOUBLE) * 40 AS fy FROM all_pts)",
        "s AS (SELECT tile_id, x, y, (x < fx - 0.01 OR x > fx + 39.5 + 0.01 OR y < fy - 0.01 OR y > fy + 39.5 + 0.01) AS stray FROM b)",
    )
    + """SELECT tile_id, CAST(count(*) FILTER (stray) AS BIGINT) AS n_stray, min(x) FILTER (stray) AS first_x, arg_min(y, (x, y)) FILTER (stray) AS first_y FROM s GROUP BY tile_id""",
    "sample_cut": _with(_POINTS) + "SELECT x, y, z, CAST(class AS INT) AS classification, CAST(rn AS INT) AS return_number FROM all_pts WHERE x >= 30 AND x < 45 AND y >= 30 AND y < 45",
    "judged_controls": _with(_POINTS)
    + """SELECT CAST(count(*) FILTER (judged) AS BIGINT) AS judged, CAST(count(*) FILTER (judged AND class <> 2 AND ref = 2) AS BIGINT) AS into_ground,
       CAST(count(*) FILTER (judged AND class = 2 AND ref <> 2) AS BIGINT) AS out_of_ground, CAST(count(*) FILTER (NOT judged AND class = 2 AND ref = 2) AS BIGINT) AS passed_through FROM all_pts""",
    "class_rollup": _with(_POINTS) + "SELECT tile_id, CAST(class AS INT) AS class, count(*) AS n, CAST(grouping(tile_id, class) AS INT) AS level FROM all_pts GROUP BY ROLLUP (tile_id, class)",
    "block_min": _with((*_CELLS, "blocks")) + "SELECT * FROM blocks",
    "block_upsample": _with(_CELLS)
    + """SELECT "row", col, min_z, min(min_z) OVER (PARTITION BY "row" // 4, col // 4) AS block_min_z FROM cells""",
    "populations": _with(
        _DENSE,
        "f AS (SELECT *, n_class6 > 0 AS a, n_class6 > 0 AND n_ground = 0 AS b, n_class5 > 0 AND n_ground = 0 AND n_class6 = 0 AS canopy, n_ground > 0 AND n_class5 = 0 AND n_class6 = 0 AS plain FROM dense)",
        _window("f", "inner_b", 1, "count(*) FILTER (b.b) = 9 AS inside"),
        """m AS (SELECT f.*, i.inside FROM f JOIN inner_b i USING ("row", col))""",
        """u AS (SELECT 'building' AS name, n_all, n_reference_ground FROM m WHERE a UNION ALL SELECT 'building_no_ground', n_all, n_reference_ground FROM m WHERE b
    UNION ALL SELECT 'roof_interior', n_all, n_reference_ground FROM m WHERE inside UNION ALL SELECT 'canopy_only', n_all, n_reference_ground FROM m WHERE canopy
    UNION ALL SELECT 'plain_ground', n_all, n_reference_ground FROM m WHERE plain)""",
        "names AS (SELECT unnest(['building', 'building_no_ground', 'roof_interior', 'canopy_only', 'plain_ground']) AS name)",
    )
    + """SELECT names.name, count(u.n_all) AS cells, count(*) FILTER (u.n_all >= 2) AS repeated, count(*) FILTER (u.n_reference_ground > 0) AS reference_ground,
       CASE WHEN count(u.n_all) > 0 THEN 100 * (CAST(count(*) FILTER (u.n_all >= 2) AS DOUBLE) / count(u.n_all)) END AS repeated_pct FROM names LEFT JOIN u USING (name) GROUP BY names.name""",
    "interior": _with(_CELLS, _window("cells", "w", 1, "count(*) AS n")) + 'SELECT "row", col FROM w WHERE n = 9',
    "step_magnitude": _with(_DENSE, *_steps("min_z_ground")) + 'SELECT "row", col, step, n FROM steps',
    "gradient": _with(_COARSE)
    + """SELECT m."row", m.col,
       CASE WHEN m.col = 0 THEN e.z - m.z WHEN m.col = 119 THEN m.z - w.z ELSE (e.z - w.z) / 2 END AS gx,
       CASE WHEN m."row" = 0 THEN s.z - m.z WHEN m."row" = 119 THEN m.z - n.z ELSE (s.z - n.z) / 2 END AS gy
FROM coarse m LEFT JOIN coarse e ON e."row" = m."row" AND e.col = m.col + 1 LEFT JOIN coarse w ON w."row" = m."row" AND w.col = m.col - 1
LEFT JOIN coarse s ON s."row" = m."row" + 1 AND s.col = m.col LEFT JOIN coarse n ON n."row" = m."row" - 1 AND n.col = m.col WHERE m.z IS NOT NULL""",
    "square_opening": _with((*_DENSE, "filled"), *_open("filled", "o1", 1), *_open("o1", "o2", 2)) + 'SELECT "row", col, o1.z AS z1, o2.z AS z2 FROM o1 JOIN o2 USING ("row", col)',
    "pmf_ground": _with(
        _DENSE,
        "void AS (SELECT \"row\", col FROM dense WHERE min_z IS NULL)",
        f"""hit AS (SELECT a."row", a.col, min(a.d2 * 100000000 + b."row" * 240 + b.col) AS best FROM {_around("void", 24)} JOIN {_placed("cells")} ON a.f = b.f GROUP BY ALL)""",
        """fill AS (SELECT d."row", d.col, CAST(coalesce(d.min_z, s.min_z) AS DOUBLE) AS z FROM dense d LEFT JOIN hit ON hit."row" = d."row" AND hit.col = d.col
  LEFT JOIN cells s ON s."row" = (hit.best % 100000000) // 240 AND s.col = (hit.best % 100000000) % 240)""",
        *_open("fill", "o1", 1), *_open("o1", "o2", 2), *_open("o2", "o4", 4),
    )
    + """SELECT "row", col, d.min_z IS NOT NULL AND NOT (fill.z - o1.z > least(0.3 * 1.5 + 0.3, 3.5) OR o1.z - o2.z > least(0.3 * 2.5 + 0.3, 3.5) OR o2.z - o4.z > least(0.3 * 4.5 + 0.3, 3.5)) AS is_ground
FROM dense d JOIN fill USING ("row", col) JOIN o1 USING ("row", col) JOIN o2 USING ("row", col) JOIN o4 USING ("row", col)""",
    "diamond_erode": _with((*_COARSE, "cfilled"), _window("cfilled", "w", 3, "min(b.z) AS eroded", _ball(3))) + "SELECT * FROM w",
    "diamond_dilate": _with((*_COARSE, "cfilled"), _window("cfilled", "w", 3, "max(b.z) AS dilated", _ball(3))) + "SELECT * FROM w",
    "low_mask": _with(_DENSE, 'top AS (SELECT "row", col, -coalesce(CAST(max_z AS DOUBLE), base) AS z FROM dense)', *_open("top", "o1", 1, _ball(1)))
    + 'SELECT "row", col FROM top JOIN o1 USING ("row", col) WHERE abs(top.z - o1.z) > 5 * 0.5',
    "progressive_small": (
        _progressive := _with((*_COARSE, "cfilled"), *_open("cfilled", "o1", 1, _ball(1)), *_open("cfilled", "o2", 2, _ball(2)), *_open("cfilled", "o3", 3, _ball(3)))
        + """SELECT "row", col, abs(c.z - o1.z) > CAST(0.15 AS DOUBLE) OR abs(o1.z - o2.z) > CAST(0.15 AS DOUBLE) * 2 OR abs(o2.z - o3.z) > CAST(0.15 AS DOUBLE) * 3 AS flagged
FROM cfilled c JOIN o1 USING ("row", col) JOIN o2 USING ("row", col) JOIN o3 USING ("row", col)"""
    ),
    "progressive_chunked": _progressive,
    "knn_fill": _with(_COARSE, *_fill("coarse", "filled_in", 20)) + "SELECT * FROM filled_in",
    "nearest_basis": _with(_BASED, *_nearest("2.0")) + 'SELECT "row", col, CAST(basis AS INT) AS basis, src_row, src_col FROM based',
    "surfaces": _with(_BASED, *_SURFACES) + "SELECT * REPLACE (CAST(basis AS INT) AS basis) FROM bands",
    "honesty": _with(_BASED, *_nearest("2.0"))
    + """SELECT CAST(count(*) FILTER (basis = 1) AS DOUBLE) / count(*) AS fraction_measured, CAST(count(*) FILTER (basis = 2) AS DOUBLE) / count(*) AS fraction_interpolated,
       CAST(count(*) FILTER (basis = 0) AS DOUBLE) / count(*) AS fraction_undetermined, CAST(sum(n_all) AS DOUBLE) / 14400 AS measured_density,
       round(exp(-(CAST(sum(n_all) AS DOUBLE) / 14400) * CAST(0.25 AS DOUBLE)), 12) AS expected_void_fraction FROM based""",
    "agreement": _with(
        _BASED,
        """k AS (SELECT count(*) AS n, count(*) FILTER (is_ground AND n_ground > 0) AS tp, count(*) FILTER (is_ground AND n_ground = 0) AS fp, count(*) FILTER (NOT is_ground AND n_ground > 0) AS fn,
    count(*) FILTER (NOT is_ground AND n_ground = 0) AS tn FROM grounded WHERE n_all > 0)""",
    )
    + """SELECT n AS n_cells, tp, fp, fn, tn, CAST(tp AS DOUBLE) / (tp + fn) AS recall_ground, CAST(tn AS DOUBLE) / (tn + fp) AS recall_nonground, CAST(tp + tn AS DOUBLE) / n AS accuracy,
       CAST(tp + fn AS DOUBLE) / n AS ground_prevalence, greatest(CAST(tp + fn AS DOUBLE) / n, 1 - CAST(tp + fn AS DOUBLE) / n) AS majority_class_null FROM k""",
    "kappa": _with(
        _DENSE,
        """o AS (SELECT CAST(min_z AS DOUBLE) - base <= 0.5 AS a, n_reference_ground > 0 AS b FROM dense WHERE n_all > 0)""",
        "k AS (SELECT count(*) AS n, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (NOT a AND b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn FROM o)",
        "p AS (SELECT *, CAST(tp + tn AS DOUBLE) / n AS po, (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(fn + tn AS DOUBLE) * (fp + tn)) / (CAST(n AS DOUBLE) * n) AS pe FROM k)",
    )
    + "SELECT n AS n_cells, tp, fp, fn, tn, round(100 * po, 9) AS agreement_pct, round((po - pe) / (1 - pe), 9) AS kappa FROM p",
    "retention": _with(
        _BASED, *_steps("min_z_ground"),
        'j AS (SELECT g.*, CAST(g.min_z AS DOUBLE) - g.base <= 0.0625 AS strict FROM grounded g JOIN steps s USING ("row", col) WHERE s.step > 1.5)',
    )
    + """SELECT count(*) FILTER (is_ground) AS before, count(*) FILTER (is_ground AND strict) AS kept, 100 * (CAST(count(*) FILTER (is_ground AND strict) AS DOUBLE) / count(*) FILTER (is_ground)) AS retention_pct FROM j""",
    "band_unpivot_nodata": _with(_BASED, *_SURFACES)
    + """SELECT band, "row", col, value FROM (
  SELECT "row", col, CAST(coalesce(mdt, -9999) AS DOUBLE) AS mdt, CAST(coalesce(mds, -9999) AS DOUBLE) AS mds, CAST(coalesce(chm, -9999) AS DOUBLE) AS chm,
         CAST(basis AS DOUBLE) AS basis, CAST(n_all AS DOUBLE) AS n_all, CAST(n_ground AS DOUBLE) AS n_ground FROM bands)
UNPIVOT (value FOR band IN (mdt, mds, chm, basis, n_all, n_ground))""",
    "rgba_scale": _with(_DENSE, "e AS (SELECT CAST(min(min_z) AS DOUBLE) AS lo, CAST(max(min_z) AS DOUBLE) AS hi FROM dense)")
    + """SELECT "row", col, CASE WHEN min_z IS NOT NULL THEN CAST(least(254, floor(CASE WHEN hi > lo THEN (CAST(min_z AS DOUBLE) - lo) / (hi - lo) ELSE 0.5 END * 255)) AS INT) END AS level FROM dense, e""",
    "basis_colours": _with(_BASED, *_nearest("2.0"))
    + """SELECT CAST(CASE basis WHEN 0 THEN 215 WHEN 1 THEN 26 ELSE 254 END AS INT) AS r, CAST(CASE basis WHEN 0 THEN 48 WHEN 1 THEN 152 ELSE 224 END AS INT) AS g,
       CAST(CASE basis WHEN 0 THEN 39 WHEN 1 THEN 80 ELSE 139 END AS INT) AS b, count(*) AS n FROM based GROUP BY basis""",
    "run_diff": _with(_BASED, *_SURFACES, *_NEAR_1, _bands("based1", "bands1"))
    + """SELECT u.band AS band, count(*) AS cells, count(*) FILTER (u.d) AS differing FROM (
  SELECT unnest([{'band': 'mdt', 'd': a.mdt IS DISTINCT FROM b.mdt}, {'band': 'mds', 'd': a.mds IS DISTINCT FROM b.mds}, {'band': 'chm', 'd': a.chm IS DISTINCT FROM b.chm},
                 {'band': 'basis', 'd': a.basis IS DISTINCT FROM b.basis}]) AS u FROM bands a FULL JOIN bands1 b USING ("row", col)) GROUP BY 1""",
    "sharp_steps": _with(_DENSE, *_steps("min_z_ground"), "picked AS (SELECT * FROM steps WHERE step > 1.5)", _PLANE)
    + f"SELECT (SELECT count(*) FROM picked) AS candidates, count(*) FILTER (n >= 4 AND det > 1e-9 AND {_RESIDUAL.replace('/ det', '/ CASE WHEN det > 1e-9 THEN det END')} >= 0.3) AS population FROM fits",
    "verified_hits": _with(_DENSE, *_steps("min_z_ground"), "picked AS (SELECT * FROM steps WHERE step > 1.5)", _PLANE, _VERIFIED,
        f"""population AS (SELECT "row", col FROM fits WHERE n >= 4 AND det > 1e-9 AND {_RESIDUAL.replace('/ det', '/ CASE WHEN det > 1e-9 THEN det END')} >= 0.3)""",
        "named AS (SELECT name, CAST(floor((120 - y) / 0.5) AS INT) AS prow, CAST(floor(x / 0.5) AS INT) AS pcol FROM points)",
        "i AS (SELECT *, prow >= 4 AND pcol >= 4 AND prow < 236 AND pcol < 236 AS inside FROM named)")
    + """SELECT name, prow, pcol, inside, inside AND EXISTS (SELECT 1 FROM population p WHERE (p."row" - prow) ** 2 + (p.col - pcol) ** 2 <= 16) AS found FROM i""",
    "riser_clusters": _with(_DENSE, *_CLUSTERS, recursive=True) + 'SELECT direction, "row", col, height, x, y FROM rounds WHERE seq = best',
    "smrf_full": _with((*_DENSE, "blocks", "cgrid", "coarse"), *_SMRF)
    + """SELECT d."row", d.col, coalesce(abs(s.z - CAST(d.min_z AS DOUBLE)) <= 0.5 + 1.25 * sqrt(s.gx * s.gx + s.gy * s.gy), false) AS is_ground
FROM dense d JOIN slopes s ON s."row" = d."row" // 2 AND s.col = d.col // 2""",
    "relief_lags": _with(_DENSE, 'line AS (SELECT "row", col, CAST(min_z_ground AS DOUBLE) AS z FROM dense)', _PROFILES, "lags AS (SELECT CAST(unnest(range(1, 5)) AS INT) AS lag)")
    + """SELECT a.direction, lag, coalesce(max(abs(b.z - a.z)), 0) AS dz FROM profiles a CROSS JOIN lags LEFT JOIN profiles b ON b.direction = a.direction AND b.profile = a.profile AND b.pos = a.pos + lag
WHERE lag <= floor(2 / a.h) GROUP BY a.direction, lag""",
    "risers": _with(_DENSE, *_RISERS) + "SELECT * FROM risers",
    "riser_top": _with(_DENSE, *_RISERS) + 'SELECT * FROM risers ORDER BY height DESC, direction, "row", col LIMIT 20',
    "canopy_hist": _with(_POINTS, _HEIGHTS)
    + """SELECT CAST(CASE WHEN height >= 20 THEN 6 WHEN height >= 10 THEN 5 WHEN height >= 5 THEN 4 WHEN height >= 2 THEN 3 WHEN height >= 1 THEN 2 WHEN height >= 0.5 THEN 1 ELSE 0 END AS INT) AS bin,
       count(*) AS n FROM heights GROUP BY 1""",
    "block_canopy_share": _with(_POINTS, _HEIGHTS)
    + """SELECT CAST(floor(x / 20) AS INT) AS block_x, CAST(floor(y / 20) AS INT) AS block_y, count(*) AS n, CAST(count(*) FILTER (height > 2) AS DOUBLE) / count(*) AS share FROM heights GROUP BY 1, 2""",
    "lift_percentiles": _with(_CELLS, "l AS (SELECT CAST(min_z_reference_ground AS DOUBLE) - CAST(min_z AS DOUBLE) AS lift FROM cells WHERE min_z_reference_ground IS NOT NULL)")
    + """SELECT quantile_cont(lift, 0.5) AS p50, quantile_cont(lift, 0.9) AS p90, CAST(count(*) FILTER (lift > 0.05) AS DOUBLE) / count(*) AS over_005,
       CAST(count(*) FILTER (lift > 0.25) AS DOUBLE) / count(*) AS over_025, CAST(count(*) FILTER (lift > 1) AS DOUBLE) / count(*) AS over_1 FROM l""",
    "sorties": """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, CAST(sum(CASE WHEN ts - before > INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS sortie FROM l)
SELECT user_id, sortie, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, sortie""",
    "coverage": _with(
        ("tiles",),
        "t AS (SELECT greatest(minx, 10) AS x0, least(maxx, 150) AS x1, greatest(miny, 10) AS y0, least(maxy, 130) AS y1 FROM tiles WHERE least(maxx, 150) > greatest(minx, 10) AND least(maxy, 130) > greatest(miny, 10))",
        "xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT x0 AS x FROM t UNION SELECT x1 FROM t))",
        "ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS ny FROM (SELECT y0 AS y FROM t UNION SELECT y1 FROM t))",
        "c AS (SELECT (nx - x) * (ny - y) AS area FROM xs, ys WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM t WHERE x0 <= x AND x1 >= nx AND y0 <= y AND y1 >= ny))",
    )
    + "SELECT coalesce(sum(area), 0) AS covered, coalesce(sum(area), 0) / 16800 AS fraction FROM c",
    "tile_dedupe": _with(("tiles",)) + "SELECT item_id, item_id = min(item_id) OVER (PARTITION BY round_even(minx, 3), round_even(miny, 3)) AS kept FROM tiles",
    "select_tiles": _with(
        ("tiles",),
        "t AS (SELECT *, (least(maxx, 150) - greatest(minx, 10)) * (least(maxy, 130) - greatest(miny, 10)) AS overlap FROM tiles WHERE least(maxx, 150) > greatest(minx, 10) AND least(maxy, 130) > greatest(miny, 10))",
        "s AS (SELECT *, CAST(dense_rank() OVER (ORDER BY day) - 1 AS INT) AS sortie FROM t)",
        "d AS (SELECT sortie AS dominant FROM s GROUP BY sortie ORDER BY sum(overlap) DESC, sortie LIMIT 1)",
    )
    + """SELECT item_id, minx, miny, overlap, sortie, dominant, row_number() OVER (PARTITION BY minx, miny ORDER BY sortie <> dominant, item_id) = 1 AS kept FROM s, d""",
    "precheck_void": _with(("tiles",))
    + """SELECT item_id, point_count / ((maxx - minx) * (maxy - miny)) AS density, round(exp(-(point_count / ((maxx - minx) * (maxy - miny))) * CAST(0.25 AS DOUBLE)), 12) AS void_open,
       round(exp(-(point_count / ((maxx - minx) * (maxy - miny))) * (CAST(0.25 AS DOUBLE) * CAST(0.4 AS DOUBLE))), 12) AS void_at_f FROM tiles""",
    "precheck_worst": _with(("tiles",), "v AS (SELECT item_id, exp(-(point_count / ((maxx - minx) * (maxy - miny))) * (CAST(0.25 AS DOUBLE) * CAST(0.4 AS DOUBLE))) AS v FROM tiles)")
    + "SELECT item_id, round(v, 12) AS void_at_f FROM v ORDER BY v DESC, item_id LIMIT 1",
    "lookup_miss": "SELECT DISTINCT l_suppkey AS item FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 <> 0)",
    "seam_cells": _with(
        (*_POINTS, "grid"),
        "b AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM all_pts GROUP BY tile_id)",
        'c AS (SELECT "row", col, (col + 0.5) * 0.5 AS x, 120 - ("row" + 0.5) * 0.5 AS y FROM grid)',
    )
    + """SELECT "row", col FROM c WHERE EXISTS (SELECT 1 FROM b WHERE x >= minx - 1 AND x <= maxx + 1 AND y >= miny - 1 AND y <= maxy + 1
  AND NOT (x > minx + 1 AND x < maxx - 1 AND y > miny + 1 AND y < maxy - 1))""",
    "stac_parse": f"""SELECT CAST(event_id AS VARCHAR) AS item_id, 'LAZ' AS collection, CAST(user_id AS DOUBLE) AS minx, {_EVENT_JSON} AS miny, CAST(user_id AS DOUBLE) + 1 AS maxx, {_EVENT_JSON} + 1 AS maxy,
       3763 AS crs_epsg, event_id AS point_count, '2024-07-01T22:00:00Z' AS flight_date, event_id * 30 AS file_size, event_type AS href FROM events""",
    "read_stability": """WITH r AS (SELECT o_orderpriority AS config, o_custkey % 50 AS tile, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderstatus END AS hash, o_orderkey % 97 = 0 AS failed, o_orderkey % 101 = 0 AS bad FROM orders),
c AS (SELECT tile, hash, count(*) AS n FROM r WHERE hash IS NOT NULL GROUP BY ALL),
m AS (SELECT DISTINCT ON (tile) tile, hash AS modal FROM c ORDER BY tile, n DESC, hash)
SELECT config, count(*) AS reads, count(*) FILTER (bad OR failed OR hash IS DISTINCT FROM modal) AS events FROM r LEFT JOIN m USING (tile) GROUP BY config""",
    "list_diff": """WITH a AS (SELECT p_type, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_type), b AS (SELECT p_type, count(*) AS n FROM part WHERE p_partkey % 3 <> 1 GROUP BY p_type),
d AS (SELECT p_type, coalesce(b.n, 0) - coalesce(a.n, 0) AS d FROM a FULL JOIN b USING (p_type))
SELECT p_type, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS change, abs(d) AS n FROM d WHERE d <> 0""",
}
