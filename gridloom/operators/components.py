"""Connected patches of grid cells (8 neighbours), and what is asked of them.

Cells are labelled tile by tile in Python, then the tiles' patches are joined along their borders: only cells on
tile borders and pairs of patch ids are exchanged after that, however large the patches are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .grid import join_cells
from .lineage import cut

TILE = 512
OFFSETS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def neighbours(df: DataFrame, value: str = "z") -> DataFrame:
    """(r, c, value, k, r2, c2, value2) for each cell and each of its up to eight neighbours; k numbers the direction."""
    around = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in enumerate(OFFSETS)])
    out = df.select("r", "c", value, F.inline(around)).withColumns({"r2": F.col("r") + F.col("dr"), "c2": F.col("c") + F.col("dc")}).drop("dr", "dc")
    return join_cells(out, df.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col(value).alias(f"{value}2")), on=("r2", "c2"))


def _label_tile(table: pa.Table) -> pa.Table:
    """Labels of one tile's cells: the least (r, c) of the patch, packed into a number."""
    rows, cols = table.column("r").to_pylist(), table.column("c").to_pylist()
    members = set(zip(rows, cols))
    cells = sorted(members)
    label: dict[tuple[int, int], int] = {}
    for cell in cells:
        if cell in label:
            continue
        own = (cell[0] << 32) + cell[1]
        todo = [cell]
        label[cell] = own
        while todo:
            r, c = todo.pop()
            for a, b in OFFSETS:
                n = (r + a, c + b)
                if n in members and n not in label:
                    label[n] = own
                    todo.append(n)
    return pa.table({"r": pa.array([r for r, _ in cells], pa.int32()), "c": pa.array([c for _, c in cells], pa.int32()), "part": pa.array([label[x] for x in cells], pa.int64())})


def label_patches(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """(r, c, patch) for the cells of a mask (r, c): patch is the same for connected cells, and differs else."""
    tr, tc = F.floor(F.col("r") / tile).cast("int"), F.floor(F.col("c") / tile).cast("int")
    tiled = mask.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), tr.alias("tr"), tc.alias("tc"))
    parts = cut(tiled.groupBy("tr", "tc").applyInArrow(_label_tile, "r int, c int, part long"))
    rim = lambda a: F.pmod(F.col(a), F.lit(tile)).isin(0, tile - 1)
    border = parts.where(rim("r") | rim("c"))
    pairs = neighbours(border, "part").where("part != part2").select(F.col("part").alias("a"), F.col("part2").alias("b"))
    merged = connected_components(pairs)
    return parts.join(merged.withColumnRenamed("node", "part"), "part", "left").select("r", "c", F.coalesce("label", "part").alias("patch"))


def without_small(mask: DataFrame, least: int) -> DataFrame:
    """(r, c, patch) of the patches of at least so many cells."""
    patches = label_patches(mask)
    big = patches.groupBy("patch").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("patch")
    return patches.join(big, "patch", "left_semi")


def touching_border(mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """(r, c) of the patches that reach the grid's border."""
    patches = label_patches(mask)
    edge = patches.where((F.col("r").isin(0, rows - 1)) | F.col("c").isin(0, cols - 1)).select("patch").distinct()
    return patches.join(edge, "patch", "left_semi").select("r", "c")


def confirmed_patches(found: DataFrame, reference: DataFrame, least: int, tolerance: int) -> DataFrame:
    """(n_patches, n_confirmed): patches of at least `least` cells, and those of them that touch the widened reference."""
    from .focal import dilate

    wide = dilate(reference.select("r", "c"), tolerance).withColumn("__hit", F.lit(True))
    seen = label_patches(found).join(wide, ["r", "c"], "left").groupBy("patch").agg(F.count("*").alias("n"), F.max(F.coalesce("__hit", F.lit(False))).alias("hit"))
    return seen.where(F.col("n") >= least).agg(F.count("*").alias("n_patches"), F.count_if("hit").alias("n_confirmed"))
