"""The class that most layers agree on, pixel by pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.grid import GridSpec
from terralapse.sources.warp import warped


def aligned(cells: DataFrame, grids: dict[str, GridSpec]) -> DataFrame:
    """Layers brought to the grid of the first one, by nearest cell; ``grids`` has the grid of each layer."""
    first = cells.orderBy("layer_ix").select("layer").first()[0]
    same = [name for name, grid in grids.items() if grid == grids[first]]
    out = cells.where(F.col("layer").isin(same)).select("layer", "layer_ix", "row", "col", "code")
    for name, grid in grids.items():
        if name not in same:
            moved = warped(cells.where(F.col("layer") == name), grid, grids[first], ["code"], by=("layer", "layer_ix"))
            out = out.unionByName(moved.select(*out.columns))
    return out


def consensus_levels(found: DataFrame, levels: DataFrame) -> DataFrame:
    """The first layer's levels (id, label, ...) of the classes that the consensus has."""
    return levels.join(found.select(F.col("code").alias("id")).where("id is not null").distinct(), "id", "left_semi")


def consensus(cells: DataFrame, confidence: bool = False, grids: dict[str, GridSpec] | None = None) -> DataFrame:
    """(row, col, code[, confidence]): the most frequent code; on ties the one whose first layer comes first.

    With ``grids``, layers on other grids than the first one's are aligned to it.

    Confidence is the share of the pixel's layers that aren't null. Pixels that are null in
    every layer have a null code. The two aggregates share their first keys and are combined
    before each shuffle.
    """
    if "layer_ix" not in cells.columns:
        raise ValueError("cells must be a named list of rasters, with a layer_ix column")
    if len(cells.select("layer_ix").distinct().limit(2).collect()) < 2:
        raise ValueError("consensus needs at least 2 rasters")
    cells = aligned(cells, grids) if grids else cells
    each = cells.groupBy("row", "col", "code").agg(F.count(F.lit(1)).alias("n"), F.min("layer_ix").alias("first"))
    known = F.col("code").isNotNull()
    out = each.groupBy("row", "col").agg(
        F.max_by(F.when(known, F.col("code")), F.when(known, F.struct("n", -F.col("first")))).alias("code"),
        (F.max(F.when(known, F.col("n"))) / F.sum(F.when(known, F.col("n")))).alias("confidence"),
    )
    return out if confidence else out.drop("confidence")
