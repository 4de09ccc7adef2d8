"""Patches and points or lines: how each relates to each, by the nine intersections (DE-9IM).

A patch is the union of its closed cells. Lines are cut where they pass a side of a cell, so every
piece lies in one cell or along a side between two, and every vertex in a cell, on a side (two
cells) or at a corner (four). An item that has all of its cells in a patch lies in the patch's
interior, one with some of them on its boundary, one with none outside. Items meet runs by an equality
of row and bucket of columns; the rest are two counts.

Coordinates within 1e-9 of a cell from a side lie on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralapse.functions.geometry import RINGS
from terralapse.functions.planar import spans
from terralapse.grid import GridSpec
from terralapse.operators.attribute import checked_overlay, in_crs, pieces
from terralapse.plans.storage import stored

KINDS = ("points", "lines")
#: What an item is: a piece of a line, a point inside a line, an end of a line, a point.
PIECE, VERTEX, END, POINT = range(4)
#: Patterns of the matrix, the patch first; one of them must fit. An area is never within, equal to or overlapped by points or lines.
PATTERNS: dict[str, tuple[str, ...]] = {
    "intersects": ("T********", "*T*******", "***T*****", "****T****"),
    "contains": ("T*****FF*",),
    "covers": ("T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"),
    "touches": ("FT*******", "F**T*****", "F***T****"),
    "crosses": ("T*****T**",),
    "within": ("T*F**F***",),
    "covered_by": ("T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"),
    "equals": ("T*F**FFF*",),
}
NEAR = 1e-9
#: Cuts of lines that are worked on together.
CUTS = 1 << 20


def fits(relation: Column, pattern: str) -> Column:
    """Whether a matrix of nine characters fits a pattern: F, a dimension, T for any dimension, * for whatever."""
    if len(pattern) != 9 or set(pattern) - set("TF*012"):
        raise ValueError("a pattern has nine characters, each one of T, F, *, 0, 1, 2")
    return relation.rlike("^" + pattern.replace("*", ".").replace("T", "[012]") + "$")


def point_items(overlay: DataFrame, grid: GridSpec) -> DataFrame:
    """(key, item, kind, need, len, head, row, col): a row for each cell that a point meets; ``head`` marks one of an item. Points without a coordinate are left out."""
    near = lambda v: F.when(F.abs(v - F.round(v)) <= NEAR, F.round(v)).otherwise(v)
    at = overlay.select("key", F.posexplode("geometry").alias("item", "p")).select("key", F.col("item").cast("long").alias("item"), near((F.col("p.x") - grid.xmin) / grid.resx).alias("u"), near((F.lit(grid.ymax) - F.col("p.y")) / grid.resy).alias("v"))
    cells = lambda v: F.when(v == F.floor(v), F.array(F.floor(v) - 1, F.floor(v))).otherwise(F.array(F.floor(v)))
    at = at.where("u is not null and v is not null and not isnan(u) and not isnan(v)").withColumns({"rows": cells(F.col("v")), "cols": cells(F.col("u"))})
    at = at.select("key", "item", F.lit(POINT).alias("kind"), (F.size("rows") * F.size("cols")).alias("need"), F.lit(0.0).alias("len"), F.posexplode("rows").alias("i", "row"), "cols")
    return at.select("key", "item", "kind", "need", "len", "row", "i", F.posexplode("cols").alias("j", "col")).select("key", "item", "kind", "need", "len", F.expr("i + j = 0").alias("head"), "row", "col")


def cut(u0, v0, u1, v1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, u, v): the ends of segments and where they pass sides of cells, in order along each."""
    segment, place = np.arange(len(u0)), [(np.zeros(len(u0)), u0, v0), (np.ones(len(u0)), u1, v1)]
    owners = [segment, segment]
    snapped = lambda v: np.where(np.abs(v - np.round(v)) <= NEAR, np.round(v), v)
    for a, b, c, d, across in ((u0, u1, v0, v1, False), (v0, v1, u0, u1, True)):
        of, k = spans(np.floor(np.minimum(a, b)).astype(np.int64) + 1, np.ceil(np.maximum(a, b)).astype(np.int64) - 1)
        t = (k - a[of]) / (b - a)[of]
        other = snapped(c[of] + t * (d - c)[of])
        owners.append(of)
        place.append((t, other, k.astype(float)) if across else (t, k.astype(float), other))
    of = np.concatenate(owners)
    t, u, v = (np.concatenate([p[i] for p in place]) for i in range(3))
    order = np.lexsort((t, of))
    of, t, u, v = of[order], t[order], u[order], v[order]
    long = (np.abs(u1 - u0) + np.abs(v1 - v0))[of]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | ((t[1:] - t[:-1]) * long[1:] > NEAR)
    return of[new], u[new], v[new]


def cells_of(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last column (or row) that a stretch between two sides, or a place, meets."""
    on = (low == high) & (low == np.floor(low))
    at = np.floor((low + high) / 2).astype(np.int64)
    return at - on, at


def line_items(overlay: DataFrame, grid: GridSpec) -> DataFrame:
    """The same columns of lines, each a list of parts. Items beyond the grid come without a cell, and so say that a line leaves it.

    Points without a coordinate are left out, and so are parts with fewer than two different points.
    """
    schema = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("kind", pa.int32()), ("need", pa.int32()), ("len", pa.float64()), ("head", pa.bool_()), ("row", pa.int64()), ("col", pa.int64())])

    def rows_of(keys, item, kind, u, v, length=None):
        """u, v: (low, high) of each item."""
        (c0, c1), (r0, r1) = cells_of(*u), cells_of(*v)
        wide = c1 - c0 + 1
        of, k = spans(np.zeros(len(c0), np.int64), wide * (r1 - r0 + 1) - 1)
        row, col = r0[of] + k // wide[of], c0[of] + k % wide[of]
        outside = (row < 0) | (row >= grid.nrow) | (col < 0) | (col >= grid.ncol)
        need = (wide * (r1 - r0 + 1)).astype(np.int32)
        columns = [keys[of], item[of], kind[of].astype(np.int32), need[of], np.zeros(len(of)) if length is None else length[of], k == 0]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(row, mask=outside), pa.array(col, mask=outside)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            lines = batch.column("geometry")
            sizes = lambda a: a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            parts = lines.flatten()
            points = parts.flatten()
            line = np.repeat(np.repeat(np.arange(len(keys)), sizes(lines)), sizes(parts))
            part = np.repeat(np.arange(len(parts)), sizes(parts))
            number = lambda name: points.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            snapped = lambda v: np.where(np.abs(v - np.round(v)) <= NEAR, np.round(v), v)
            u, v = snapped((number("x") - grid.xmin) / grid.resx), snapped((grid.ymax - number("y")) / grid.resy)
            known = np.isfinite(u) & np.isfinite(v)
            if len(points):
                known &= np.asarray(points.is_valid())
            line, part, u, v = line[known], part[known], u[known], v[known]
            moved = np.ones(len(u), bool)
            moved[1:] = (part[1:] != part[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            line, part, u, v = line[moved], part[moved], u[moved], v[moved]
            start = np.flatnonzero(part[1:] == part[:-1])
            if not len(start):
                continue
            stop = start + 1
            # Ends by the rule of two: a point where an even number of parts end lies inside the line.
            first, last = np.setdiff1d(start, stop), np.setdiff1d(stop, start)
            both = np.concatenate([first, last])
            ends, times = np.unique(np.stack([line[both], u[both], v[both]]), axis=1, return_counts=True)
            ends = ends[:, times % 2 == 1]
            tips = set(zip(*ends.tolist()))
            item = np.arange(ends.shape[1])
            yield rows_of(keys[ends[0].astype(np.int64)], item, np.full(len(item), END), (ends[1], ends[1]), (ends[2], ends[2]))
            number_of = len(item)
            passes = np.cumsum(np.abs(u[stop] - u[start]) + np.abs(v[stop] - v[start]) + 2)
            for chunk in np.split(np.arange(len(start)), np.searchsorted(passes, np.arange(CUTS, passes[-1], CUTS))):
                if not len(chunk):
                    continue
                a, b = start[chunk], stop[chunk]
                of, x, y = cut(u[a], v[a], u[b], v[b])
                own = line[a][of]
                piece = np.flatnonzero(of[1:] == of[:-1])
                length = np.hypot((x[piece + 1] - x[piece]) * grid.resx, (y[piece + 1] - y[piece]) * grid.resy)
                yield rows_of(keys[own[piece]], number_of + np.arange(len(piece)), np.full(len(piece), PIECE), *(tuple(np.sort(np.stack([c[piece], c[piece + 1]]), 0)) for c in (x, y)), length)
                number_of += len(piece)
                vertex = np.unique(np.stack([own, x, y]), axis=1)
                if tips:
                    vertex = vertex[:, [p not in tips for p in zip(*vertex.tolist())]]
                yield rows_of(keys[vertex[0].astype(np.int64)], number_of + np.arange(vertex.shape[1]), np.full(vertex.shape[1], VERTEX), (vertex[1], vertex[1]), (vertex[2], vertex[2]))
                number_of += vertex.shape[1]

    return overlay.select("key", F.col("geometry").cast(RINGS).alias("geometry")).mapInArrow(run, "key long, item long, kind int, need int, len double, head boolean, row long, col long")


def related(runs: DataFrame, overlay: DataFrame, grid: GridSpec, kind: str, bucket: int = 64) -> DataFrame:
    """(patch_id, key, relation, measure) of runs and the points or lines (key, geometry) that they touch.

    ``relation`` has nine characters, the patch's interior, boundary and exterior with those of the
    overlay; an area's exterior and boundary go beyond any line (that a line covers all of a boundary
    isn't told). ``measure``: the length of a line inside a patch, boundary included, or the number of points.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    items = stored((point_items if kind == "points" else line_items)(overlay.select("key", "geometry").dropDuplicates(["key"]), grid), "items")
    of_kind = lambda *kinds: F.col("kind").isin(*kinds)
    count = lambda c: F.count(F.when(c, 1))
    totals = items.where("head").groupBy("key").agg(count(of_kind(PIECE)).alias("pieces"), count(of_kind(POINT)).alias("points"), count(of_kind(END)).alias("ends"))
    own = pieces(runs.select("patch_id", "row", "col_start", "col_end"), bucket).select("patch_id", F.col("row").cast("long").alias("row"), "bx", "col_start", "col_end")
    met = items.where("row is not null").withColumn("bx", F.floor(F.col("col") / bucket)).join(own, ["row", "bx"]).where("col between col_start and col_end")
    each = met.groupBy("patch_id", "key", "item").agg(F.first("kind").alias("kind"), (F.count(F.lit(1)) == F.first("need")).alias("inner"), F.first("len").alias("len"))
    n = {f"{name}_{where}": count(of_kind(k) & (F.col("inner") == F.lit(where == "in"))) for name, k in (("piece", PIECE), ("vertex", VERTEX), ("end", END), ("point", POINT)) for where in ("in", "on")}
    counted = each.groupBy("patch_id", "key").agg(*(c.alias(name) for name, c in n.items()), F.sum("len").alias("length")).join(totals, "key")
    said = lambda *cases: F.coalesce(*(F.when(F.expr(when), F.lit(d)) for when, d in cases), F.lit("F"))
    matrix = F.concat(
        said(("piece_in > 0", "1"), ("point_in > 0", "0")), said(("end_in > 0", "0")), F.lit("2"),
        said(("piece_on > 0", "1"), ("vertex_on + point_on > 0", "0")), said(("end_on > 0", "0")), F.lit("1"),
        said(("piece_in + piece_on < pieces", "1"), ("point_in + point_on < points", "0")), said(("end_in + end_on < ends", "0")), F.lit("2"),
    )
    return counted.select("patch_id", "key", matrix.alias("relation"), (F.col("length") if kind == "lines" else (F.col("point_in") + F.col("point_on")).cast("double")).alias("measure"))


def attribute_features(
    patches: DataFrame,
    runs: DataFrame,
    overlay: DataFrame,
    grid: GridSpec,
    cols: list[str],
    *,
    kind: str,
    predicate: str = "intersects",
    overlay_crs: str | None = None,
    match_mode: str = "all",
    time_col: str | None = None,
    time_interval: tuple[float, float] | None = None,
    with_relation: bool = False,
    bucket: int = 64,
) -> DataFrame:
    """Patches with the columns ``cols`` of points (``geometry`` a list of points) or lines (a list of parts).

    ``predicate`` is one of PATTERNS or a pattern of nine characters, the patch first; it is asked of all
    that touch. ``largest`` takes the longest line inside, or the overlay with the most points; on equal ones (to a millionth)
    the first. Patches without a match keep nulls. ``with_relation`` adds ``relation`` and ``measure``.
    Null and empty geometries meet nothing; an overlay row that comes twice is matched twice.
    """
    overlay = checked_overlay(patches, overlay, cols, predicate, match_mode, time_col, time_interval)
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    if kind == "points":
        # As one part each, as the change of CRS knows parts.
        overlay = overlay.withColumn("geometry", F.array(F.coalesce("geometry", F.array())).cast(RINGS))
    overlay = in_crs(overlay, overlay_crs or grid.crs, grid.crs)
    if kind == "points":
        overlay = overlay.withColumn("geometry", F.col("geometry")[0])
    keyed = overlay.withColumn("key", F.col("overlay_ix").cast("long") if "overlay_ix" in overlay.columns else F.xxhash64(F.to_json(F.struct("geometry", *cols))))
    found = related(runs, keyed, grid, kind, bucket)
    asked = [fits(F.col("relation"), p) for p in PATTERNS.get(predicate, (predicate,))]
    found = found.where(reduce(Column.__or__, asked))
    if match_mode == "largest":
        best = Window.partitionBy("patch_id").orderBy(F.desc(F.round("measure", 6)), "key")
        found = found.withColumn("place", F.row_number().over(best)).where("place = 1")
    extra = ["relation", "measure"] if with_relation else []
    matched = found.join(keyed.select("key", *cols), "key").select("patch_id", *cols, *extra)
    return patches.join(matched, "patch_id", "left").select(*patches.columns, *cols, *extra)
