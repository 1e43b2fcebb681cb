"""Bands out: explicit sentinels, long form, Parquet by band, a plain tiled image file, and colour levels."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import RenderRefusal
from cellbasis.functions.scalars import NODATA_CODE, NODATA_COUNT, NODATA_FLOAT

FLOATS, COUNTS = ("mdt", "mds", "chm"), ("n_all", "n_ground")
BANDS = (*FLOATS, "basis", *COUNTS)


def encoded(surfaces: DataFrame, official_ground: bool = True) -> DataFrame:
    """Missing values as sentinels; a count that was never made is missing in every cell. Types stay."""
    fill = {c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("float")), F.lit(NODATA_FLOAT).cast("float")) for c in FLOATS}
    fill["n_ground"] = F.col("n_ground") if official_ground else F.lit(NODATA_COUNT).cast("int")
    return surfaces.withColumns(fill)


def long_form(surfaces: DataFrame) -> DataFrame:
    """(band, row, col, value) of all bands, values as DOUBLE."""
    each = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in BANDS])
    return surfaces.select("row", "col", F.explode(each).alias("b")).select("b.band", "row", "col", "b.value")


def write_parquet(surfaces: DataFrame, path: str, record: dict, official_ground: bool = True) -> None:
    """Bands as Parquet partitioned by band, the record as JSON text beside them."""
    long_form(encoded(surfaces, official_ground)).write.mode("overwrite").partitionBy("band").parquet(f"{path}/bands")
    text = json.dumps(record, indent=2, sort_keys=True, ensure_ascii=False)
    surfaces.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/record")


def levels(cells: DataFrame, value: str, count: int = 255) -> DataFrame:
    """(row, col, level): `value` scaled to 0 .. count - 1 between its extremes, NULL for holes; a constant band is in the middle."""
    known = cells.where(F.col(value).isNotNull())
    ends = known.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    span = F.col("hi") - F.col("lo")
    share = F.when(span > 0, (F.col(value).cast("double") - F.col("lo")) / F.when(span > 0, span).otherwise(F.lit(1.0))).otherwise(F.lit(0.5))
    level = F.least(F.lit(count - 1), F.floor(share * count)).cast("int")
    return cells.crossJoin(F.broadcast(ends)).select("row", "col", F.when(F.col(value).isNotNull(), level).alias("level"))


# Colours of the basis codes.
BASIS_COLOURS = {0: (215, 48, 39), 1: (26, 152, 80), 2: (254, 224, 139)}


def basis_colour(code: Column) -> Column:
    """The colour of a basis code as an array; unknown codes raise."""
    out = F.raise_error(F.concat(F.lit("unknown basis code "), code.cast("string"))).cast("array<int>")
    for k, rgb in BASIS_COLOURS.items():
        out = F.when(code == k, F.array(*[F.lit(v) for v in rgb])).otherwise(out)
    return out


def to_array(cells: DataFrame, grid: Grid, value: str, kind, missing) -> np.ndarray:
    """One band on the driver, for image files of areas that fit there; refused above 64 million cells."""
    if grid.n_cells > 1 << 26:
        raise RenderRefusal(f"{grid.n_cells} cells are too many for one image file; write Parquet")
    out = np.full((grid.n_rows, grid.n_cols), missing, dtype=kind)
    got = cells.where(F.col(value).isNotNull()).select("row", "col", value).toArrow()
    out[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
    return out


def tiff(band: np.ndarray, grid: Grid, nodata: float, tags: dict[str, str]) -> bytes:
    """A single-band, tiled, deflated image file with geographic keys, sentinel and tags."""
    side = 256
    formats = {"f": 3, "u": 1, "i": 2}
    rows, cols = band.shape
    tiles = []
    for r in range(0, rows, side):
        for c in range(0, cols, side):
            part = np.full((side, side), nodata, dtype=band.dtype)
            piece = band[r : r + side, c : c + side]
            part[: piece.shape[0], : piece.shape[1]] = piece
            tiles.append(zlib.compress(np.ascontiguousarray(part).tobytes(), 6))
    text = "<GDALMetadata>" + "".join(f'<Item name="{k}">{v}</Item>' for k, v in sorted(tags.items())) + "</GDALMetadata>\0"
    geo = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, grid.epsg]
    fields: list[tuple[int, int, int, bytes]] = []
    put = lambda tag, kind, fmt, *v: fields.append((tag, kind, len(v), struct.pack(f"<{len(v)}{fmt}", *v)))
    put(256, 4, "I", cols)
    put(257, 4, "I", rows)
    put(258, 3, "H", band.dtype.itemsize * 8)
    put(259, 3, "H", 8)
    put(262, 3, "H", 1)
    put(277, 3, "H", 1)
    put(322, 3, "H", side)
    put(323, 3, "H", side)
    put(324, 4, "I", *[0] * len(tiles))
    put(325, 4, "I", *map(len, tiles))
    put(339, 3, "H", formats[band.dtype.kind])
    put(33550, 12, "d", grid.cell, grid.cell, 0.0)
    put(33922, 12, "d", 0.0, 0.0, 0.0, grid.origin_x, grid.origin_y, 0.0)
    put(34735, 3, "H", *geo)
    fields.append((42112, 2, len(text.encode()), text.encode()))
    said = f"{nodata:g}\0".encode()
    fields.append((42113, 2, len(said), said))
    at = 8 + 2 + 12 * len(fields) + 4
    places = []
    for _, _, _, data in fields:
        places.append(at)
        at += len(data) + len(data) % 2 if len(data) > 4 else 0
    starts = []
    for t in tiles:
        starts.append(at)
        at += len(t)
    fields[8] = (324, 4, len(tiles), struct.pack(f"<{len(tiles)}I", *starts))
    out = struct.pack("<2sHIH", b"II", 42, 8, len(fields))
    extra = b""
    for (tag, kind, n, data), place in zip(fields, places, strict=True):
        out += struct.pack("<HHI", tag, kind, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", place))
        if len(data) > 4:
            extra += data + b"\0" * (len(data) % 2)
    return out + struct.pack("<I", 0) + extra + b"".join(tiles)


def palette_png(index: np.ndarray, colours: list[tuple[int, int, int]], hole: int | None) -> bytes:
    """A palette image of colour numbers; `hole` is the transparent one. More than 256 colours are refused, never merged."""
    if len(colours) > 256:
        raise RenderRefusal(f"{len(colours)} colours do not fit a palette of 256")
    if not len(colours):
        raise RenderRefusal("no valid cells to draw")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows, cols = index.shape
    raw = np.zeros((rows, cols + 1), dtype=np.uint8)
    raw[:, 1:] = index
    clear = b"" if hole is None else chunk(b"tRNS", bytes(0 if i == hole else 255 for i in range(len(colours))))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 3, 0, 0, 0)) + chunk(b"PLTE", bytes(v for c in colours for v in c)) + clear + chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)) + chunk(b"IEND", b"")


def style(stops: list[tuple[float, tuple[int, int, int], str]], paletted: bool) -> str:
    """A layer style for desktop viewers: entries of a palette, or stops of an interpolated ramp."""
    hexed = lambda c: "#%02x%02x%02x" % c
    if paletted:
        items = "".join(f'<paletteEntry value="{v:g}" color="{hexed(c)}" alpha="255" label="{t}"/>' for v, c, t in stops)
        body = f'<rasterrenderer type="paletted" band="1" opacity="1"><colorPalette>{items}</colorPalette></rasterrenderer>'
    else:
        items = "".join(f'<item value="{v:g}" color="{hexed(c)}" alpha="255" label="{t}"/>' for v, c, t in stops)
        body = f'<rasterrenderer type="singlebandpseudocolor" band="1" opacity="1"><rastershader><colorrampshader colorRampType="INTERPOLATED">{items}</colorrampshader></rastershader></rasterrenderer>'
    return f'<qgis version="3.28" styleCategories="AllStyleCategories"><pipe>{body}</pipe></qgis>'


def ramp(stops: list[tuple[float, tuple[int, int, int]]], count: int = 255) -> list[tuple[int, int, int]]:
    """`count` colours between stops on 0 .. 1."""
    at = np.linspace(0.0, 1.0, count)
    where = [p for p, _ in stops]
    return [tuple(int(v) for v in c) for c in np.stack([np.interp(at, where, [c[i] for _, c in stops]) for i in range(3)], axis=1)]


# The stops of the ramps that bands are drawn with.
GREYS = [(0.0, (0, 0, 0)), (1.0, (255, 255, 255))]
EARTH = [(0.0, (51, 51, 153)), (0.15, (0, 153, 255)), (0.25, (0, 204, 102)), (0.5, (255, 255, 153)), (0.75, (128, 92, 84)), (1.0, (255, 255, 255))]
GREENS = [(0.0, (247, 252, 245)), (0.5, (116, 196, 118)), (1.0, (0, 68, 27))]


def draw(cells: DataFrame, grid: Grid, value: str, stops: list[tuple[float, tuple[int, int, int]]]) -> bytes:
    """A palette image of one band, holes transparent; refused where the band has no value."""
    if not cells.where(F.col(value).isNotNull()).take(1):
        raise RenderRefusal("no valid cells to draw")
    index = to_array(levels(cells.select("row", "col", value), value), grid, "level", np.uint8, 255)
    return palette_png(index, [*ramp(stops), (0, 0, 0)], 255)


def draw_basis(cells: DataFrame, grid: Grid) -> bytes:
    """The basis band in its colours; unknown codes are refused."""
    codes = {r[0] for r in cells.select("basis").distinct().limit(300).collect()}
    if not codes <= set(BASIS_COLOURS):
        raise RenderRefusal(f"unknown basis code(s) {sorted(codes - set(BASIS_COLOURS), key=str)}")
    index = to_array(cells, grid, "basis", np.uint8, len(BASIS_COLOURS))
    return palette_png(index, [*BASIS_COLOURS.values(), (0, 0, 0)], len(BASIS_COLOURS))


def images(surfaces: DataFrame, grid: Grid, record: dict) -> dict[str, bytes]:
    """The six bands as image files and the record, by file name, for areas that fit the driver."""
    tags = {k: str(record[k]) for k in ("attribution", "reproducibility_hash", "package_version", "mixed_epochs")} | {"flight_dates": ", ".join(record["flight_dates"])}
    out = {}
    for band in BANDS:
        kind, missing = (np.float32, NODATA_FLOAT) if band in FLOATS else (np.uint8, NODATA_CODE) if band == "basis" else (np.int32, NODATA_COUNT)
        out[f"{band}.tif"] = tiff(to_array(surfaces, grid, band, kind, missing), grid, missing, tags | {"band": band})
    out["record.json"] = json.dumps(record, indent=2, sort_keys=True, ensure_ascii=False).encode("utf-8")
    return out
