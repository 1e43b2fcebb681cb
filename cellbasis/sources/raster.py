"""Single-band image files as cell frames: classic TIFF, little-endian, tiled or in strips, deflated or plain."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellbasis.functions.refusals import CompareRefusal, ReadRefusal, RenderRefusal

_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("Q", 8), 12: ("d", 8)}


@dataclass(frozen=True)
class Raster:
    band: np.ndarray
    nodata: float | None
    cell: float | None
    origin: tuple[float, float] | None


def _fields(data: bytes) -> dict[int, tuple]:
    if data[:4] != b"II*\0":
        raise ReadRefusal("not a little-endian TIFF")
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from("<HHI", data, at + 2 + 12 * i)
        fmt, size = _SIZES[kind]
        place = at + 2 + 12 * i + 8
        if count * size > 4:
            (place,) = struct.unpack_from("<I", data, place)
        out[tag] = (data[place : place + count],) if kind == 2 else struct.unpack_from(f"<{count}{fmt}", data, place)
    return out


def decode(data: bytes) -> Raster:
    """The band of an image file, its sentinel and its place."""
    f = _fields(data)
    cols, rows = f[256][0], f[257][0]
    kind = np.dtype("<" + "uif"[f.get(339, (1,))[0] - 1] + str(f[258][0] // 8))
    compressed = f.get(259, (1,))[0]
    if compressed not in (1, 8, 32946) or f.get(317, (1,))[0] != 1:
        raise ReadRefusal(f"compression {compressed} or a predictor is not supported")
    wide, high = (f[322][0], f[323][0]) if 322 in f else (cols, f.get(278, (rows,))[0])
    starts, sizes = (f[324], f[325]) if 324 in f else (f[273], f[279])
    out = np.zeros((rows, cols), dtype=kind)
    across = -(-cols // wide)
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        raw = data[start : start + size]
        part = np.frombuffer(zlib.decompress(raw) if compressed != 1 else raw, dtype=kind).reshape(-1, wide)
        r, c = i // across * high, i % across * wide
        piece = part[: rows - r, : cols - c]
        out[r : r + len(piece), c : c + piece.shape[1]] = piece
    nodata = float(f[42113][0].rstrip(b"\0 ")) if 42113 in f else None
    return Raster(out, nodata, f[33550][0] if 33550 in f else None, (f[33922][3], f[33922][4]) if 33922 in f else None)


def _images(spark: SparkSession, folder: str) -> DataFrame:
    """(band, content) of the folder's *.tif files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("band"), "content")


def band_names(spark: SparkSession, folder: str) -> list[str]:
    return sorted(r.band for r in _images(spark, folder).select("band").collect())


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(band, rows, cols, nodata, cell, origin_x, origin_y, nans): what each image file says of itself, and how many of its values are not
    numbers. Such values have no place in a file with a sentinel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for name, data in part.itertuples(index=False):
                r = decode(data)
                nans = int(np.isnan(r.band).sum()) if r.band.dtype.kind == "f" else 0
                x, y = r.origin or (None, None)
                yield pd.DataFrame({"band": [name], "rows": [r.band.shape[0]], "cols": [r.band.shape[1]], "nodata": [r.nodata], "cell": [r.cell], "origin_x": [x], "origin_y": [y], "nans": [nans]}).astype({c: "float64" for c in ("nodata", "cell", "origin_x", "origin_y")})

    return _images(spark, folder).mapInPandas(run, "band string, rows int, cols int, nodata double, cell double, origin_x double, origin_y double, nans long")


def palette_counts(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(red, green, blue, opacity, pixels) of the colours that a palette image without row filters uses."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ReadRefusal("not a PNG")
    parts: dict[bytes, bytes] = {}
    at = 8
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ReadRefusal(f"the checksum of {kind.decode()} is wrong")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    cols, rows, depth, colour = struct.unpack_from(">IIBB", parts[b"IHDR"])
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), dtype=np.uint8).reshape(rows, cols + 1)
    if (depth, colour) != (8, 3) or raw[:, 0].any():
        raise ReadRefusal("only palette images of 8 bits without row filters are read")
    palette, clear = parts[b"PLTE"], parts.get(b"tRNS", b"")
    used = np.bincount(raw[:, 1:].ravel())
    return [(*palette[3 * i : 3 * i + 3], clear[i] if i < len(clear) else 255, int(used[i])) for i in np.flatnonzero(used).tolist()]


def read_bands(spark: SparkSession, folder: str) -> DataFrame:
    """(band, row, col, value) of the folder's *.tif files, one task a file; missing cells are NULL. A file that declares no
    sentinel is refused: its holes would have to be guessed."""
    files = _images(spark, folder)
    if not files.select("band").take(1):
        raise CompareRefusal(f"no rasters in {folder}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for name, data in part.itertuples(index=False):
                r = decode(data)
                if r.nodata is None:
                    raise RenderRefusal(f"{name} declares no sentinel; refusing to guess its holes")
                for first in range(0, len(r.band), 256):
                    rows = r.band[first : first + 256]
                    row, col = np.indices(rows.shape, dtype=np.int32)
                    values = rows.astype(float).ravel()
                    yield pd.DataFrame({"band": name, "row": row.ravel() + np.int32(first), "col": col.ravel(), "value": pd.Series(values).where(values != r.nodata)})

    return files.mapInPandas(run, "band string, row int, col int, value double")


def compare_folders(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(band, cells, differing) of two folders of image files; refused if either has none or their sets differ."""
    a, b = read_bands(spark, old), read_bands(spark, new)
    names = [sorted(r[0] for r in f.select("band").distinct().collect()) for f in (a, b)]
    if names[0] != names[1]:
        raise CompareRefusal(f"band sets differ: {names[0]} and {names[1]}")
    both = a.join(b.withColumnsRenamed({"value": "other"}).withColumn("there", F.lit(True)), ["band", "row", "col"], "full_outer")
    differs = F.col("there").isNull() | ~F.col("value").eqNullSafe(F.col("other"))
    return both.groupBy("band").agg(F.count(F.lit(1)).alias("cells"), F.count_if(differs).alias("differing"))
