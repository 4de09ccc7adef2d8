"""Labels for class codes, and groups of classes.

Cells are rows of (layer, layer_ix, row, col, code). Codes stay; labels are a small table beside them.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Classified:
    cells: DataFrame
    #: id, label, color of the codes present, by layer.
    levels: DataFrame
    class_table: DataFrame


def remap_classes(cells: DataFrame, table: DataFrame, remap: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Groups classes by name. A group's code is the least of its members' and it takes that code's color."""
    rows = table.collect()  # a class table
    by_name = {r.class_name: r for r in rows}
    moved: dict[int, int] = {}
    added = []
    for name, members in remap.items():
        known = sorted((by_name[m] for m in members if m in by_name), key=lambda r: r.code)
        if not known:
            warnings.warn(f"remap group {name!r} has no matching class and is skipped", stacklevel=2)
            continue
        for r in known:
            moved[r.code] = known[0].code
        added.append((known[0].code, name, known[0].color, known[0].description))
    kept = [tuple(r) for r in rows if r.code not in moved]
    out = cells
    if moved:
        mapping = F.create_map(*(F.lit(x).cast("int") for pair in moved.items() for x in pair))
        out = cells.withColumn("code", F.coalesce(mapping[F.col("code")], F.col("code")))
    return out, cells.sparkSession.createDataFrame(sorted(kept + added), table.schema)


def classify(cells: DataFrame, table: DataFrame, remap: dict[str, list[str]] | None = None) -> Classified:
    if remap:
        cells, table = remap_classes(cells, table, remap)
    present = cells.where(F.col("code").isNotNull()).select("layer", "code").distinct()
    levels = present.join(table, "code").select("layer", F.col("code").alias("id"), F.col("class_name").alias("label"), "color")
    return Classified(cells, levels, table)
