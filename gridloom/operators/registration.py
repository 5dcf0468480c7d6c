"""Sub-pixel shift between two images by phase correlation, tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """How far b lies from a, in rows and columns; the peak is refined by parabolas through its neighbours."""
    spectrum = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    peak = np.fft.ifft2(spectrum / np.maximum(np.abs(spectrum), 1e-12)).real
    at = np.unravel_index(int(peak.argmax()), peak.shape)
    out = []
    for axis, (i, n) in enumerate(zip(at, peak.shape)):
        line = [peak[tuple((at[k] + d * (k == axis)) % peak.shape[k] for k in (0, 1))] for d in (-1, 0, 1)]
        bend = line[0] - 2 * line[1] + line[2]
        part = 0.5 * (line[0] - line[2]) / bend if abs(bend) > 1e-12 else 0.0
        s = i + part
        out.append(-(s - n if s > n / 2 else s))
    return out[0], out[1]


def shift_between(a: DataFrame, b: DataFrame, tile: int = 256) -> DataFrame:
    """(tr, tc, n, d_row, d_col) of image b (r, c, z) against image a, for each tile; a tile is a task's array."""
    both = a.join(b.withColumnRenamed("z", "z2"), ["r", "c"])
    tiled = both.select(F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"), "r", "c", "z", "z2")

    def run(t: pa.Table) -> pa.Table:
        r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
        shape = (r.max() - r.min() + 1, c.max() - c.min() + 1)
        x, y = np.zeros(shape), np.zeros(shape)
        x[r - r.min(), c - c.min()], y[r - r.min(), c - c.min()] = t.column("z").to_numpy(), t.column("z2").to_numpy()
        dr, dc = _phase_shift(x - x.mean(), y - y.mean())
        return pa.table({"tr": t.column("tr")[:1], "tc": t.column("tc")[:1], "n": [len(r)], "d_row": [dr], "d_col": [dc]})

    return tiled.groupBy("tr", "tc").applyInArrow(run, "tr int, tc int, n long, d_row double, d_col double")
