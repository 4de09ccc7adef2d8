"""Class-to-class transitions between two layers, and the patches they form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralapse.grid import GridSpec, check_crs, check_patch_area, check_unit
from terralapse.operators.patches import FAR, labelled
from terralapse.operators.summarize import percent
from terralapse.plans.storage import stored

#: A pair of codes in one number is from * PAIR + to; more than twice any code, so that codes below 0 do no harm.
PAIR = 1 << 32
CELLS = "row int, col int, from_code int, to_code int"


@dataclass(frozen=True)
class Transition:
    #: row, col, from_code, to_code, code (from * 1000 + to)
    cells: DataFrame
    #: id, transition
    levels: DataFrame
    #: from_class, to_class, n_cells, area, pct
    summary: DataFrame
    #: Cells of patches below the threshold, like ``cells``; None without a threshold or if none is.
    removed: DataFrame | None
    grid: GridSpec


def check_layers(rows: DataFrame, *layers: str) -> None:
    known = {r.layer for r in rows.where(F.col("layer").isin(*layers)).select("layer").distinct().collect()}  # at most as many as asked for
    for layer in layers:
        if layer not in known:
            raise ValueError(f"Layer '{layer}' not found")


def pairs(cells: DataFrame, from_layer: str, to_layer: str) -> DataFrame:
    """(row, col, from_code, to_code) where both layers have a code: one aggregate in place of a join."""
    both = cells.where(F.col("layer").isin(from_layer, to_layer)).groupBy("row", "col").agg(
        F.max(F.when(F.col("layer") == from_layer, F.col("code"))).alias("from_code"),
        F.max(F.when(F.col("layer") == to_layer, F.col("code"))).alias("to_code"),
    )
    return both.where(F.col("from_code").isNotNull() & F.col("to_code").isNotNull())


def of_classes(rows: DataFrame, column: str, names: list[str] | None, table: DataFrame) -> DataFrame:
    """Rows whose code belongs to one of the named classes; None keeps all, names without a class keep none."""
    if names is None:
        return rows
    codes = [r.code for r in table.where(F.col("class_name").isin(list(names))).collect()]  # a class table
    return rows.where(F.col(column).isin(codes) if codes else F.lit(False))


def labels(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds from_class and to_class; codes without a class read NA."""
    names = table.select("code", "class_name")
    for side in ("from", "to"):
        own = names.select(F.col("code").alias(f"{side}_code"), F.col("class_name").alias(f"{side}_class"))
        rows = rows.join(own, f"{side}_code", "left")
    return rows.withColumns({f"{s}_class": F.coalesce(f"{s}_class", F.lit("NA")) for s in ("from", "to")})


def transition(
    cells: DataFrame,
    grid: GridSpec,
    from_layer: str,
    to_layer: str,
    table: DataFrame,
    *,
    from_class: list[str] | None = None,
    to_class: list[str] | None = None,
    unit: str = "ha",
    patch_area_min: float | None = None,
    tile: int = 256,
) -> Transition:
    """Transitions of every cell that both layers have.

    Class filters come first. Then, with ``patch_area_min`` (square metres), changed cells
    that touch form patches whatever their classes, and smaller patches go; unchanged cells stay.
    """
    check_unit(unit)
    check_patch_area(patch_area_min)
    check_crs(grid, "transition")
    if "layer" not in cells.columns:
        raise ValueError("cells must be a named list of rasters, with a layer column")
    found = of_classes(of_classes(pairs(cells, from_layer, to_layer), "from_code", from_class, table), "to_code", to_class, table)
    found = stored(found.withColumn("code", F.col("from_code") * 1000 + F.col("to_code")), "transition")
    if found.isEmpty():  # the only case in which a layer can be missing
        check_layers(cells, from_layer, to_layer)
    removed = None
    if patch_area_min:
        local, parts = labelled(pair_values(found.where("from_code <> to_code")), same_value=False, tile=tile)
        sizes = parts.groupBy("patch").agg(F.sum("n").alias("whole"))
        small = parts.join(sizes, "patch").where(F.col("whole") * grid.cell_area < patch_area_min).select("label", F.lit(True).alias("small"))
        # The cells of patches have all that is needed, so they aren't looked up among the others.
        marked = stored(of_values(local.join(small, "label", "left")).select(*found.columns, "small"), "changed")
        gone = marked.where("small").drop("small")
        kept = found.where("from_code = to_code").unionByName(marked.where("small is null").drop("small"))
        removed = None if gone.isEmpty() or kept.isEmpty() else gone
        found = kept
    counts = found.groupBy("from_code", "to_code").agg(F.count(F.lit(1)).alias("n"))
    return Transition(found, *matrix(counts, grid, table, unit), removed, grid)


def matrix(counts: DataFrame, grid: GridSpec, table: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Levels and summary of (from_code, to_code, n)."""
    factor = check_unit(unit)
    named = labels(counts, table).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    summary = named.orderBy(F.desc("n"), "from_code", "to_code").select(
        "from_class", "to_class", F.col("n").cast("int").alias("n_cells"), (F.col("n") * F.lit(grid.cell_area * factor)).alias("area", metadata={"unit": unit}), percent(F.col("n"), F.col("total")).alias("pct")
    )
    levels = named.orderBy("from_code", "to_code").select((F.col("from_code") * 1000 + F.col("to_code")).alias("id"), F.concat("from_class", F.lit(" -> "), "to_class").alias("transition"))
    return levels, summary


def pair_values(cells: DataFrame) -> DataFrame:
    """(row, col, value): both codes in one number, whatever they are."""
    return cells.select("row", "col", (F.col("from_code").cast("long") * F.lit(PAIR) + F.col("to_code")).alias("value"))


def of_values(rows: DataFrame) -> DataFrame:
    """Adds the codes of ``pair_values``, and ``code``."""
    last = F.pmod(F.col("value") + F.lit(PAIR // 2), F.lit(PAIR)) - F.lit(PAIR // 2)
    of = {"from_code": F.shiftright(F.col("value") - last, 32).cast("int"), "to_code": last.cast("int")}
    return rows.withColumns(of).withColumn("code", F.col("from_code") * 1000 + F.col("to_code"))


def patch_parts(found: Transition, *, changes_only: bool = False, patch_area_min: float | None = None, tile: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells with labels, the patch of each label, and the patches (patch, patch_id, n, value), numbered in scan order.

    Small patches go before that, so that numbers are dense.
    """
    check_patch_area(patch_area_min)
    check_crs(found.grid, "patch_cells")
    if not isinstance(changes_only, bool):
        raise ValueError("changes_only must be one logical value")
    rows = found.cells.where("from_code <> to_code") if changes_only else found.cells
    local, parts = labelled(pair_values(rows), same_value=True, tile=tile)
    whole = parts.groupBy("patch").agg(F.sum("n").alias("n"), F.min("value").alias("value"))
    whole = whole.where(F.col("n") * found.grid.cell_area >= patch_area_min) if patch_area_min else whole
    return local, parts, numbered(stored(whole, "patches"), "patch")


def cells_of(local: DataFrame, parts: DataFrame, whole: DataFrame) -> DataFrame:
    names = parts.select("label", "patch").join(whole.select("patch", "patch_id", "n"), "patch")
    return of_values(local.join(names, "label")).select("row", "col", "from_code", "to_code", F.col("patch").alias("label"), "patch_id", "n")


def patch_cells(found: Transition, **options) -> DataFrame:
    """(row, col, from_code, to_code, label, patch_id, n): each transition's own patches, numbered in scan order."""
    return cells_of(*patch_parts(found, **options))


def numbered(patches: DataFrame, by: str, rows: int = 64) -> DataFrame:
    """Dense numbers from 1 in the order of a column of cell numbers, without bringing all rows to one task.

    Patches are numbered within bands of ``rows`` rows of cells; the bands' counts, one row
    each, give where every band starts.
    """
    banded = patches.withColumn("band", F.floor(F.col(by) / F.lit(FAR * rows)))
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("k"))
    starts = counts.select("band", F.coalesce(F.sum("k").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = banded.withColumn("i", F.row_number().over(Window.partitionBy("band").orderBy(by)))
    return inside.join(F.broadcast(starts), "band").withColumn("patch_id", (F.col("before") + F.col("i")).cast("int")).drop("band", "before", "i")


def patches(found: Transition, table: DataFrame, **options) -> DataFrame:
    """(patch_id, transition, area_ha, n_cells): area is the number of cells times their area. Cells are counted by label and never joined."""
    return patch_table(found, patch_parts(found, **options)[2], table)


def patch_table(found: Transition, whole: DataFrame, table: DataFrame) -> DataFrame:
    return labels(of_values(whole), table).select(
        "patch_id", F.concat("from_class", F.lit(" -> "), "to_class").alias("transition"), (F.col("n") * F.lit(found.grid.cell_area * 1e-4)).alias("area_ha"), F.col("n").cast("int").alias("n_cells")
    )


def patches_and_runs(found: Transition, table: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The patches and their runs of cells, of one labelling."""
    local, parts, whole = patch_parts(found, **options)
    whole = stored(whole, "numbered")
    return patch_table(found, whole, table), runs(cells_of(local, parts, whole))


def runs(cells: DataFrame) -> DataFrame:
    """(patch_id, row, col_start, col_end): the patches as maximal runs of cells, both ends included."""
    island = F.col("col") - F.row_number().over(Window.partitionBy("patch_id", "row").orderBy("col"))
    return cells.select("patch_id", "row", "col", island.alias("k")).groupBy("patch_id", "row", "k").agg(F.min("col").alias("col_start"), F.max("col").alias("col_end")).drop("k")


def regrouped(summary: DataFrame, groups: dict[str, str]) -> DataFrame:
    """The summary with classes renamed to coarser groups: (from_class, to_class, n_cells, area)."""
    names = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair)) if groups else None
    renamed = lambda c: F.coalesce(names[F.col(c)], F.col(c)).alias(c) if groups else F.col(c)
    return summary.select(renamed("from_class"), renamed("to_class"), "n_cells", "area").groupBy("from_class", "to_class").agg(F.sum("n_cells").alias("n_cells"), F.sum("area").alias("area"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two summaries side by side: cells before, cells after (0 if gone) and the difference."""
    left = before.select("from_class", "to_class", F.col("n_cells").alias("n_before"))
    right = after.select("from_class", "to_class", F.col("n_cells").alias("n_after"))
    return left.join(right, ["from_class", "to_class"], "left").na.fill(0, ["n_after"]).withColumn("n_removed", F.col("n_before") - F.col("n_after"))
