"""Connected patches of cells: 8-connected components, by tile and then across seams.

Cells are rows of (row, col, value). Every tile of ``tile`` x ``tile`` cells is labelled in
one task; only cells beside a tile's edge are joined to their neighbours in other tiles, and
the labels that meet there are a graph whose components are found by Spark joins. The label
of a patch is the least cell number, row * 2^31 + col, so it doesn't depend on the tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.plans.graph import components
from terralapse.plans.storage import stored

FAR = 1 << 31


def cell_number(row, col):
    return row.cast("long") * F.lit(FAR) + col.cast("long")


def label_tile(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least cell number of each cell's component. Cells of a row that touch are one run; runs are joined by hooking and halving."""
    order = np.lexsort((col, row))
    r, c, v = row[order].astype(np.int64), col[order].astype(np.int64), value[order]
    number = r * FAR + c
    breaks = np.concatenate([[True], (number[1:] != number[:-1] + 1) | (v[1:] != v[:-1])])
    run = np.cumsum(breaks) - 1
    pairs = []
    for step in (-1, 0, 1):  # the three neighbours below
        below = np.searchsorted(number, number + FAR + step)
        below = np.minimum(below, len(number) - 1)
        met = (number[below] == number + FAR + step) & (v[below] == v)
        pairs.append(np.stack([run[met], run[below[met]]]))
    edges = np.unique(np.concatenate(pairs, 1), axis=1)
    label = np.arange(run[-1] + 1)
    a, b = edges
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    out = np.empty(len(number), np.int64)
    out[order] = number[breaks][label][run]
    return out


def labelled(cells: DataFrame, *, same_value: bool, tile: int = 256) -> tuple[DataFrame, DataFrame]:
    """Cells (row, col, value, label) with labels of their own tile, stored; and the patch of each label: (label, patch, n, value).

    ``same_value``: only cells of equal value are connected, else all cells are. A tile's label
    has at most tile x tile cells, so a join with labels has no hot key, however large a patch
    is. ``n`` and ``value`` are of the label's cells alone.
    """
    spark_tile = lambda x: F.floor(F.col(x) / tile).cast("int")

    def label(pdf):
        value = pdf["value"].to_numpy()
        pdf["label"] = label_tile(pdf["row"].to_numpy(), pdf["col"].to_numpy(), value if same_value else np.zeros(len(value), np.int8))
        return pdf[["row", "col", "value", "label"]]

    rows = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("long").alias("value"))
    tiles = rows.withColumn("tr", spark_tile("row")).withColumn("tc", spark_tile("col"))
    local = stored(tiles.groupBy("tr", "tc").applyInPandas(label, "row int, col int, value long, label long"), "patch-labels")
    at_edge = local.where((F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1)))
    sums = local.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    return local, seamed(at_edge, sums, same_value)


def seamed(at_edge: DataFrame, sums: DataFrame, same_value: bool) -> DataFrame:
    """(label, patch, n, value): the patch of each label of (label, n, value), by the cells (row, col, value, label) at the edges of tiles."""
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))))
    mine = at_edge.withColumn("s", F.explode(steps)).select(
        (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("label").alias("a"), F.col("value").alias("va")
    )
    met = mine.join(at_edge.select("row", "col", F.col("label").alias("b"), F.col("value").alias("vb")), ["row", "col"]).where(F.col("a") != F.col("b"))
    seams = (met.where("va = vb") if same_value else met).select("a", "b")
    merged = components(seams, "a", "b", "patch-seams").withColumnRenamed("node", "label")
    return sums.join(merged, "label", "left").select("label", F.coalesce("component", "label").alias("patch"), "n", "value")
