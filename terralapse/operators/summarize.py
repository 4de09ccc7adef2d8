"""Area by class and layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralapse.grid import GridSpec, check_crs, check_unit


def percent(part: Column, whole: Column) -> Column:
    """In percent to two places; halves go up."""
    return F.floor(part * 10000.0 / whole + 0.5) / 100.0


def summarize(cells: DataFrame, grid: GridSpec, table: DataFrame, unit: str = "ha") -> DataFrame:
    """(layer, code, class_name, color, n_cells, area, pct): pct is of the layer's cells that aren't null."""
    check_unit(unit)
    check_crs(grid, "summarize")
    return areas(cells.where(F.col("code").isNotNull()).groupBy("layer", "code").agg(F.count(F.lit(1)).alias("n")), grid, table, unit)


def areas(counts: DataFrame, grid: GridSpec, table: DataFrame, unit: str) -> DataFrame:
    """The summary of (layer, code, n)."""
    factor = check_unit(unit)
    whole = F.sum("n").over(Window.partitionBy("layer"))
    return counts.withColumn("total", whole).join(table.select("code", "class_name", "color"), "code", "left").select(
        "layer",
        "code",
        F.coalesce("class_name", F.concat(F.lit("Unknown_"), F.col("code"))).alias("class_name"),
        F.coalesce("color", F.lit("#cccccc")).alias("color"),
        F.col("n").cast("int").alias("n_cells"),
        (F.col("n") * F.lit(grid.cell_area * factor)).alias("area", metadata={"unit": unit}),
        percent(F.col("n"), F.col("total")).alias("pct"),
    )


def net_change(summary: DataFrame, layers: list[str]) -> DataFrame:
    """(class_name, a column per layer, change, pct_change): from the first layer to the last; classes absent from a layer have 0."""
    wide = summary.groupBy("class_name").pivot("layer", layers).agg(F.sum("area")).na.fill(0.0)
    first, last = F.col(f"`{layers[0]}`"), F.col(f"`{layers[-1]}`")
    return wide.withColumn("change", last - first).withColumn("pct_change", F.try_divide((last - first) * 100.0, first))
