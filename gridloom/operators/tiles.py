"""Array kernels over tiles with halos: the form that neighbourhood operators take on long grids (r, c, value).

Each cell is sent to its tile, and to the tiles whose halo it lies in: one exchange, in which a cell near no border
travels once. A task then has a tile as a dense array and works on whole arrays. A grid has as many tasks as tiles,
whatever its shape, and no task holds more than a tile and its halo.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and columns of a tile.
TILE = 256


@dataclass(frozen=True)
class Box:
    """A tile with its halo: the row and column of its first cell, its width, and the grid's first and last rows and columns."""

    row: int
    col: int
    width: int
    edges: tuple[int, int, int, int]

    def mirrored(self, a: np.ndarray) -> np.ndarray:
        """a with cells beyond the grid's border repeating those within in reverse, edge cell first."""
        for axis, (start, low, high) in enumerate(((self.row, *self.edges[:2]), (self.col, *self.edges[2:]))):
            n = high - low + 1
            j = (np.arange(start, start + self.width) - low) % (2 * n)
            a = a.take(np.clip(np.minimum(j, 2 * n - 1 - j) + low - start, 0, self.width - 1), axis)
        return a


def beside(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """At each cell the value so many rows and columns on; NaN beyond the array."""
    out = np.full_like(a, np.nan)
    h, w = a.shape
    out[max(0, -rows) : h - max(0, rows), max(0, -cols) : w - max(0, cols)] = a[max(0, rows) : h + min(0, rows), max(0, cols) : w + min(0, cols)]
    return out


def over_tiles(df: DataFrame, values: list[str], halo: int, kernel: Callable[[Box, list[np.ndarray]], list[np.ndarray]], added: str, tile: int | None = None) -> DataFrame:
    """df with the columns `added` (doubles, as DDL), which the kernel makes of the values' arrays.

    kernel: takes the box and an array a value, tile and halo, NaN where there is no cell or no value; gives an array of
    the same shape for each new column, of which what lies in the halo is not read; NaN is null in the result. Columns of
    those names are replaced, others kept; cells are distinct in (r, c); an empty grid stays empty.
    """
    size = tile or TILE
    new = StructType.fromDDL(added)
    keep = [c for c in df.columns if c not in new.names]
    found = df.agg(*[f(c) for c in ("r", "c") for f in (F.min, F.max)]).first()
    edges = tuple(int(x) if x is not None else 0 for x in found)
    sent = df.select(*keep, *[F.col(v).cast("double").alias(f"__v{k}") for k, v in enumerate(values)])
    for axis in ("r", "c"):
        first, last = (F.floor((F.col(axis) + o) / size) for o in (-halo, halo))
        sent = sent.withColumn(f"__t{axis}", F.explode(F.sequence(first, last)))
    fields = df.select(*keep).schema.fields

    def run(cells: pa.Table) -> pa.Table:
        row, col = (cells.column(f"__t{a}")[0].as_py() * size - halo for a in ("r", "c"))
        box = Box(row, col, size + 2 * halo, edges)
        r, c = (cells.column(a).to_numpy().astype(np.int64) - o for a, o in (("r", row), ("c", col)))
        arrays = []
        for k in range(len(values)):
            a = np.full((box.width, box.width), np.nan)
            a[r, c] = cells.column(f"__v{k}").to_numpy(zero_copy_only=False)
            arrays.append(a)
        own = (r >= halo) & (r < halo + size) & (c >= halo) & (c < halo + size)
        made = [out[r[own], c[own]] for out in kernel(box, arrays)]
        kept = cells.select([f.name for f in fields]).filter(pa.array(own))
        return pa.table([*kept.columns, *[pa.array(m, pa.float64(), mask=np.isnan(m)) for m in made]], names=[*kept.column_names, *new.names])

    return sent.groupBy("__tr", "__tc").applyInArrow(run, StructType([*fields, *new.fields]))
