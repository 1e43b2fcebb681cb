"""Cells dealt into square chunks with a halo: what a stencil of bounded reach needs, in a group of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid

#: (the values as arrays by name, NaN where a chunk has no cell) -> arrays by name of the same shape
Stencil = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def in_chunks(cells: DataFrame, grid: Grid, values: list[str], halo: int, run: Stencil, schema: str, chunk: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, columns to `carry` as they are, columns of `schema`) of a dense frame, by `run` over arrays of `values`. NaN comes out
    as NULL.

    Each cell is sent to its own chunk and to those whose halo it lies in, and a chunk keeps what it owns; cells off the grid are
    simply absent. A group is bounded by the chunk and the halo, whatever the grid's size.
    """

    def spans(at: str, n: int):
        low = F.greatest(F.lit(0), F.floor((F.col(at) - halo) / chunk)).cast("int")
        high = F.least(F.lit((n - 1) // chunk), F.floor((F.col(at) + halo) / chunk)).cast("int")
        return F.explode(F.sequence(low, high))

    kept = [F.col(v).cast("double").alias(v) for v in values]
    carried = [f.name for f in cells.schema if f.name in carry]
    spread = cells.select("row", "col", *kept, *[F.col(c).alias(f"__carry_{c}") for c in carried]).select("*", spans("row", grid.n_rows).alias("chunk_row"))
    spread = spread.select("*", spans("col", grid.n_cols).alias("chunk_col"))
    names = [c.split()[0] for c in schema.split(", ")]

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["row"].to_numpy(), part["col"].to_numpy()
        r0, c0 = int(r.min()), int(c.min())
        arrays = {}
        for v in values:
            arrays[v] = np.full((r.max() - r0 + 1, c.max() - c0 + 1), np.nan)
            arrays[v][r - r0, c - c0] = part[v].to_numpy()
        found = run(arrays)
        own = (r // chunk == key[0]) & (c // chunk == key[1])
        at = r[own] - r0, c[own] - c0
        mine = {name: part[f"__carry_{name}"][own].to_numpy() for name in carried}
        return pd.DataFrame({"row": r[own], "col": c[own], **mine, **{n: found[n][at] for n in names}})

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cells.schema if f.name in carried)
    return spread.groupBy("chunk_row", "chunk_col").applyInPandas(one, f"row int, col int, {kinds}{schema}")
