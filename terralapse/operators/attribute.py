"""Patches and polygons: attributes of overlays, zones, areas of interest, tiles.

Patches are given as runs of cells. Runs are cut at the edges of a coarse grid of buckets, and
polygons are dealt to the buckets that their bounding boxes meet, so patches and polygons meet
by an equality of buckets, and every piece of a run meets a polygon once. The exact geometry
runs on these candidates in Arrow batches: polygons are made valid once, by tasks, and sorted
by the rows of the grid, so that a run looks at the edges of its own row only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralapse.functions import geometry, planar
from terralapse.functions.strips import Strips
from terralapse.grid import GridSpec, reprojected
from terralapse.plans.storage import stored

X, Y = (lambda p: p["x"]), (lambda p: p["y"])
#: Conditions on a patch and an overlay that touch: their common area, and the area of each.
PREDICATES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "intersects": lambda area, patch, overlay: F.lit(True),
    "within": lambda area, patch, overlay: area >= patch * (1 - 1e-9),
    "contains": lambda area, patch, overlay: area >= overlay * (1 - 1e-9),
    "overlaps": lambda area, patch, overlay: (area > 0) & (area < patch * (1 - 1e-9)) & (area < overlay * (1 - 1e-9)),
    "touches": lambda area, patch, overlay: area <= 0,
    "equals": lambda area, patch, overlay: (area >= patch * (1 - 1e-9)) & (area >= overlay * (1 - 1e-9)),
    "covers": lambda area, patch, overlay: area >= overlay * (1 - 1e-9),
    "covered_by": lambda area, patch, overlay: area >= patch * (1 - 1e-9),
    # Two areas never cross.
    "crosses": lambda area, patch, overlay: F.lit(False),
}
#: Points of polygons that may be sent to every task: some 16 MB.
MOST_POINTS = 500_000


def in_crs(features: DataFrame, source: str, target: str) -> DataFrame:
    """Polygon features with the points of their ``geometry`` in another CRS."""
    if source.upper() == target.upper():
        return features

    @F.pandas_udf(geometry.RINGS)
    def moved(shapes: pd.Series) -> pd.Series:
        def ring(points) -> list[dict]:
            x, y = reprojected(np.array([p["x"] for p in points], float), np.array([p["y"] for p in points], float), source, target)
            return [{"x": float(a), "y": float(b)} for a, b in zip(x, y)]

        return shapes.map(lambda rings: None if rings is None else [ring(r) for r in rings])

    return features.withColumn("geometry", moved("geometry"))


def check_features(df: DataFrame, what: str) -> None:
    if "geometry" not in df.columns:
        raise ValueError(f"{what} must be polygon features with a geometry column")


def pieces(runs: DataFrame, bucket: int) -> DataFrame:
    """Runs of (…, row, col_start, col_end) cut at bucket edges, with the bucket of each piece."""
    parts = F.sequence(F.floor(F.col("col_start") / bucket), F.floor(F.col("col_end") / bucket))
    cut = runs.withColumn("bx", F.explode(parts)).withColumn("by", F.floor(F.col("row") / bucket))
    return cut.withColumn("col_start", F.greatest("col_start", F.col("bx") * bucket)).withColumn("col_end", F.least("col_end", (F.col("bx") + 1) * bucket - 1))


def shaped(polygons: DataFrame) -> DataFrame:
    """(key, edges): each polygon of (key, geometry) as valid edges with the inside to the left, worked out once and by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portioned(batches):
            e, of = geometry.edges_of(part.column("geometry"))
            pieces, of = planar.boundaries(e, np.zeros(len(e), np.int64), of, 1)
            ends = np.searchsorted(of, np.arange(part.num_rows + 1)) * 4
            edges = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pieces.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("key"), edges], names=["key", "edges"])

    return stored(polygons.select("key", "geometry").mapInArrow(run, "key long, edges array<double>"), "shapes")


def portioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many polygons (``geometry``, and ``edges`` if they have them) as are worked out together."""
    for batch in batches:
        points = np.concatenate([[0], np.cumsum(geometry.lengths(batch.column("geometry").flatten()))])
        sizes = np.diff(points[np.concatenate([[0], np.cumsum(geometry.lengths(batch.column("geometry")))])])
        if "edges" in batch.schema.names:
            sizes = sizes + geometry.lengths(batch.column("edges")) // 4
        for start, stop in planar.portions(sizes):
            yield batch.slice(start, stop - start)


def table_of(edges) -> np.ndarray:
    return np.asarray(edges, float).reshape(-1, 4)


def sent_to_all(shapes: DataFrame):
    """Keys and edges of all shapes, broadcast; None if they have more than MOST_POINTS edges."""
    if (shapes.agg(F.sum(F.size("edges"))).first()[0] or 0) > 4 * MOST_POINTS:
        return None
    rows = sorted(shapes.collect(), key=lambda r: r.key)
    return shapes.sparkSession.sparkContext.broadcast((np.array([r.key for r in rows], np.int64), [table_of(r.edges) for r in rows]))


class Shapes:
    """Strips of the polygons that were sent to every task, or of those that came with a batch's rows."""

    def __init__(self, sent, grid: GridSpec):
        self.sent, self.grid, self.keys = sent, grid, None
        if sent is not None:
            self.keys, edges = sent.value
            self.strips = Strips(grid, edges)

    def of(self, pdf: pd.DataFrame) -> tuple[Strips, np.ndarray]:
        """The strips, and the number of each row's polygon."""
        if self.sent is not None:
            return self.strips, np.searchsorted(self.keys, pdf["key"].to_numpy())
        # A polygon's edges come by rows of buckets: each such part is a shape of its own.
        parts = pd.MultiIndex.from_arrays([pdf["key"], pdf["by"]])
        number, own = pd.factorize(parts)
        if self.keys is None or not own.equals(self.keys):
            first = pd.Series(range(len(pdf))).groupby(number).first()
            self.keys, self.strips = own, Strips(self.grid, [table_of(pdf["edges"].iloc[i]) for i in first])
        return self.strips, number


def dealt(shapes: DataFrame, grid: GridSpec, bucket: int, sent) -> DataFrame:
    """(key, bx, by) of each polygon and every bucket that it meets, boundary included, and its box in cells (r0, r1, c0, c1); with its edges in the bucket's rows if they aren't sent to every task."""
    coarse = GridSpec(grid.xmin, grid.ymax, grid.resx * bucket, grid.resy * bucket, -(-grid.nrow // bucket), -(-grid.ncol // bucket), grid.crs)
    rides = sent is None

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            edges = [table_of(e) for e in pdf["edges"]]
            poly, by, bx = Strips(coarse, edges).met()
            out = pd.DataFrame({"key": pdf["key"].to_numpy()[poly], "bx": bx, "by": by})
            # Cells that a polygon's box can meet, sides included.
            boxes = np.array([(e[:, [1, 3]].max(), e[:, [1, 3]].min(), e[:, [0, 2]].min(), e[:, [0, 2]].max()) if len(e) else (0, 0, 0, 0) for e in edges]).reshape(-1, 4)[poly]
            out["r0"], out["r1"] = np.ceil((grid.ymax - boxes[:, 0]) / grid.resy) - 1, np.floor((grid.ymax - boxes[:, 1]) / grid.resy)
            out["c0"], out["c1"] = np.ceil((boxes[:, 2] - grid.xmin) / grid.resx) - 1, np.floor((boxes[:, 3] - grid.xmin) / grid.resx)
            if rides:
                parts = {}
                for p, row in set(zip(poly.tolist(), by.tolist())):
                    e = edges[p]
                    low, high = grid.ymax - (row + 1) * coarse.resy, grid.ymax - row * coarse.resy
                    parts[p, row] = e[(np.minimum(e[:, 1], e[:, 3]) <= high) & (np.maximum(e[:, 1], e[:, 3]) >= low)].ravel()
                out["edges"] = [parts[k] for k in zip(poly.tolist(), by.tolist())]
            yield out

    return shapes.mapInPandas(near, "key long, bx long, by long, r0 double, r1 double, c0 double, c1 double" + (", edges array<double>" if rides else ""))


def meetings(runs: DataFrame, shapes: DataFrame, grid: GridSpec, bucket: int, sent) -> DataFrame:
    """(patch_id, key, row, col_start, col_end) of pieces of runs and the polygons in their bucket."""
    found = pieces(runs, bucket).join(dealt(shapes, grid, bucket, sent), ["bx", "by"])
    found = found.where("row between r0 and r1 and col_end >= c0 and col_start <= c1")
    return found.select("patch_id", "key", *(() if sent is not None else ("by", "edges")), "row", "col_start", "col_end")


def of_runs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(pdf[c].to_numpy().astype(np.int64) for c in ("row", "col_start", "col_end"))


def overlaps(runs: DataFrame, shapes: DataFrame, grid: GridSpec, bucket: int = 64) -> DataFrame:
    """(patch_id, key, area, touches): of runs (patch_id, row, col_start, col_end) and ``shaped`` polygons.

    Polygons of at most MOST_POINTS edges go to every task once; larger ones ride with the rows.
    """
    sent = sent_to_all(shapes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Shapes(sent, grid)
        for pdf in batches:
            strips, poly = known.of(pdf)
            area, touch = strips.measured(poly, *of_runs(pdf))
            yield pdf[["patch_id", "key"]].assign(area=area, touches=touch)

    rows = meetings(runs, shapes, grid, bucket, sent).mapInPandas(measure, "patch_id int, key long, area double, touches boolean")
    return rows.groupBy("patch_id", "key").agg(F.sum("area").alias("area"), F.max("touches").alias("touches")).where("touches")


def sizes_of(shapes: DataFrame) -> DataFrame:
    """(key, overlay_area)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["key"]].assign(overlay_area=[planar.edges_area(table_of(e)) for e in pdf["edges"]])

    return shapes.mapInPandas(measure, "key long, overlay_area double")


def checked_overlay(patches: DataFrame, overlay: DataFrame, cols: list[str], predicate, match_mode: str, time_col: str | None, time_interval) -> DataFrame:
    """The overlay's rows in the interval of time; wrong arguments are refused."""
    check_features(overlay, "overlay")
    if match_mode not in ("all", "largest"):
        raise ValueError("match_mode must be one of all, largest")
    if match_mode == "largest" and predicate != "intersects":
        raise ValueError("a custom predicate can't be used with match_mode 'largest'")
    if not cols:
        raise ValueError("cols must name at least one column")
    if missing := [c for c in cols if c not in overlay.columns]:
        raise ValueError(f"cols not found in overlay: {', '.join(missing)}")
    if "geometry" in cols:
        raise ValueError("cols must not name the geometry column")
    if clash := [c for c in cols if c in patches.columns]:
        raise ValueError(f"cols clash with columns of patches: {', '.join(clash)}")
    if (time_col is None) != (time_interval is None):
        raise ValueError("time_col and time_interval must be given together")
    if time_col is not None:
        if not isinstance(time_col, str) or time_col not in overlay.columns:
            raise ValueError("time_col must be a single existing column of overlay")
        if dict(overlay.dtypes)[time_col] not in ("int", "bigint", "smallint", "tinyint", "float", "double"):
            raise ValueError("time_col must be numeric")
        if len(time_interval) != 2 or any(x is None or x != x for x in time_interval):
            raise ValueError("time_interval must be a length-2 numeric without NA")
        if time_interval[0] > time_interval[1]:
            raise ValueError("time_interval must not be decreasing")
        overlay = overlay.where(F.col(time_col).between(*time_interval))
    return overlay


def attribute(
    patches: DataFrame,
    runs: DataFrame,
    overlay: DataFrame,
    grid: GridSpec,
    cols: list[str],
    *,
    predicate: str | Callable[[Column, Column, Column], Column] = "intersects",
    overlay_crs: str | None = None,
    match_mode: str = "all",
    time_col: str | None = None,
    time_interval: tuple[float, float] | None = None,
    bucket: int = 64,
) -> DataFrame:
    """Patches with the columns ``cols`` of the overlay: every match, or the one that overlaps most.

    ``predicate`` is one of PREDICATES or a function of three columns: the area in common, the
    patch's and the overlay's; it is asked of all that touch. An overlay in another CRS is brought
    to the grid's. ``overlay_ix`` numbers the overlay; on equal overlaps the first wins. Patches without a
    match keep nulls. ``time_interval`` keeps overlays whose ``time_col`` lies in it, ends included.
    """
    if not callable(predicate) and predicate not in PREDICATES:
        raise ValueError(f"predicate must be one of {', '.join(PREDICATES)}")
    overlay = checked_overlay(patches, overlay, cols, predicate, match_mode, time_col, time_interval)
    overlay = in_crs(overlay, overlay_crs or grid.crs, grid.crs)
    keyed = overlay.withColumn("key", F.col("overlay_ix").cast("long") if "overlay_ix" in overlay.columns else F.xxhash64(F.to_json(F.struct("geometry", *cols))))
    # A row that comes twice is measured once and matched twice.
    shapes = shaped(keyed.dropDuplicates(["key"]))
    found = overlaps(runs, shapes, grid, bucket)
    if predicate != "intersects":
        size = runs.groupBy("patch_id").agg((F.sum(F.col("col_end") - F.col("col_start") + 1) * F.lit(grid.cell_area)).alias("whole"))
        both = found.join(size, "patch_id").join(sizes_of(shapes), "key")
        found = both.where((predicate if callable(predicate) else PREDICATES[predicate])(F.col("area"), F.col("whole"), F.col("overlay_area")))
    if match_mode == "largest":
        best = Window.partitionBy("patch_id").orderBy(F.desc("area"), "key")
        found = found.withColumn("place", F.row_number().over(best)).where("place = 1")
    matched = found.join(keyed.select("key", *cols), "key").select("patch_id", *cols)
    return patches.join(matched, "patch_id", "left").select(*patches.columns, *cols)


def zone_keys(zone: DataFrame, zone_col: str, crs: str | None, grid: GridSpec) -> DataFrame:
    check_features(zone, "zones")
    if zone_col not in zone.columns:
        raise ValueError(f"zone_col '{zone_col}' not found in zones")
    return in_crs(zone, crs or grid.crs, grid.crs).withColumn("key", F.xxhash64(F.col(zone_col), F.to_json("geometry"))).select("key", zone_col, "geometry")


def zones(patches: DataFrame, runs: DataFrame, zone: DataFrame, grid: GridSpec, zone_col: str, bucket: int = 64, *, zone_crs: str | None = None) -> DataFrame:
    """A row for each patch and zone that overlap: the patch's own area_ha stays whole, zone_area_ha is the part inside."""
    keyed = zone_keys(zone, zone_col, zone_crs, grid)
    found = overlaps(runs, shaped(keyed), grid, bucket).where("area > 0")
    return patches.join(found, "patch_id").join(keyed.select("key", zone_col), "key").select(*patches.columns, zone_col, (F.col("area") * 1e-4).alias("zone_area_ha"))


def zone_runs(runs: DataFrame, zone: DataFrame, grid: GridSpec, zone_col: str, bucket: int = 64, *, zone_crs: str | None = None) -> DataFrame:
    """(patch_id, zone, row, col_start, col_end): the patches cut by zones, as runs of the cells whose centres lie inside."""
    keyed = zone_keys(zone, zone_col, zone_crs, grid)
    shapes = shaped(keyed)
    sent = sent_to_all(shapes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Shapes(sent, grid)
        for pdf in batches:
            strips, poly = known.of(pdf)
            of, first, last = strips.centres(poly, *of_runs(pdf))
            yield pdf[["patch_id", "key", "row"]].iloc[of].assign(col_start=first, col_end=last)

    rows = meetings(runs, shapes, grid, bucket, sent).mapInPandas(cut, "patch_id int, key long, row int, col_start int, col_end int")
    # Runs that the buckets had cut are put together again.
    before = F.lag("col_end").over(Window.partitionBy("patch_id", "key", "row").orderBy("col_start"))
    new = F.when(F.col("col_start") == before + 1, 0).otherwise(1)
    island = F.sum("new").over(Window.partitionBy("patch_id", "key", "row").orderBy("col_start"))
    whole = rows.withColumn("new", new).withColumn("island", island).groupBy("patch_id", "key", "row", "island").agg(F.min("col_start").alias("col_start"), F.max("col_end").alias("col_end"))
    return whole.join(keyed.select("key", zone_col), "key").select("patch_id", zone_col, "row", "col_start", "col_end")


def clip(cells: DataFrame, area: DataFrame, grid: GridSpec, *, drop: bool = True, bucket: int = 64, area_crs: str | None = None) -> DataFrame:
    """Cells whose centre lies in the union of the area's polygons; with ``drop=False`` the others stay, with a null value.

    An area of at most MOST_POINTS edges is tested where the cells are; a larger one meets their pixels by buckets.
    """
    check_features(area, "aoi")
    keyed = in_crs(area, area_crs or grid.crs, grid.crs).withColumn("key", F.xxhash64(F.to_json("geometry"))).select("key", "geometry").dropDuplicates(["key"])
    values = [c for c in cells.columns if c not in ("layer", "layer_ix", "t", "row", "col")]
    shapes = shaped(keyed)
    sent = sent_to_all(shapes)
    if sent is not None:
        every = np.concatenate([*sent.value[1], np.zeros((0, 4))])
        if not len(every):
            return cells.where("false") if drop else cells.select(*(F.lit(None).cast(cells.schema[c].dataType).alias(c) if c in values else c for c in cells.columns))
        x0, x1, y0, y1 = every[:, [0, 2]].min(), every[:, [0, 2]].max(), every[:, [1, 3]].min(), every[:, [1, 3]].max()

        @F.pandas_udf("boolean")
        def within(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            strips = Strips(grid, sent.value[1], together=True)
            for row, col in parts:
                yield pd.Series(strips.inside(np.zeros(len(row), np.int64), row.to_numpy().astype(np.int64), col.to_numpy().astype(np.int64)))

        x, y = F.lit(grid.xmin) + (F.col("col") + 0.5) * grid.resx, F.lit(grid.ymax) - (F.col("row") + 0.5) * grid.resy
        boxed = x.between(float(x0), float(x1)) & y.between(float(y0), float(y1))
        if drop:
            return cells.where(boxed).where(within("row", "col"))
        marked = cells.withColumn("in_area", boxed & within("row", "col"))
        return marked.select(*(F.when(F.col("in_area"), F.col(c)).alias(c) if c in values else F.col(c) for c in cells.columns))

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Shapes(None, grid)
        for pdf in batches:
            strips, poly = known.of(pdf)
            yield pdf.loc[strips.inside(poly, pdf["row"].to_numpy().astype(np.int64), pdf["col"].to_numpy().astype(np.int64)), ["row", "col"]]

    pixels = cells.select("row", "col").distinct().withColumn("bx", F.floor(F.col("col") / bucket)).withColumn("by", F.floor(F.col("row") / bucket))
    kept = pixels.join(dealt(shapes, grid, bucket, None), ["bx", "by"]).select("row", "col", "key", "by", "edges").mapInPandas(inside, "row int, col int").distinct()
    if drop:
        return cells.join(kept, ["row", "col"], "left_semi").select(*cells.columns)
    marked = cells.join(kept.withColumn("in_area", F.lit(True)), ["row", "col"], "left")
    return marked.select(*(F.when(F.col("in_area"), F.col(c)).alias(c) if c in values else F.col(c) for c in cells.columns))


def rings_column(rings: list) -> list[list[dict]]:
    return [[{"x": x, "y": y} for x, y in ring] for ring in rings]


def make_valid(features: DataFrame) -> DataFrame:
    """The features with rings that don't cross or overlap, of the same inside: outer rings counter-clockwise, holes clockwise."""
    check_features(features, "features")

    @F.pandas_udf(geometry.RINGS)
    def valid(shapes: pd.Series) -> pd.Series:
        return shapes.map(lambda g: None if g is None else rings_column(planar.made_valid(geometry.edges(g))))

    return features.withColumn("geometry", valid("geometry"))


def zone_shapes(outlines: DataFrame, runs: DataFrame, zone: DataFrame, grid: GridSpec, zone_col: str, bucket: int = 64, *, zone_crs: str | None = None) -> DataFrame:
    """(patch_id, zone, geometry, zone_area_ha): the patches' ``outlines`` cut at the zones' sides. Patches wholly inside a zone aren't cut."""
    keyed = zone_keys(zone, zone_col, zone_crs, grid)
    shapes = shaped(keyed)
    whole = runs.groupBy("patch_id").agg((F.sum(F.col("col_end") - F.col("col_start") + 1) * F.lit(grid.cell_area)).alias("whole"))
    found = overlaps(runs, shapes, grid, bucket).where("area > 0").join(whole, "patch_id").withColumn("within", F.col("area") >= F.col("whole") * (1 - 1e-9))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portioned(batches):
            n = part.num_rows
            patch, of_patch = geometry.edges_of(part.column("geometry"))
            sides_, of_zone = table_of(part.column("edges").flatten()), np.repeat(np.arange(n), geometry.lengths(part.column("edges")) // 4)
            kind = np.repeat([0, 1], [len(patch), len(sides_)])
            xy, ends, of = planar.traced_groups(*planar.boundaries(np.concatenate([patch, sides_]), kind, np.concatenate([of_patch, of_zone]), 2, np.logical_and))
            area = np.bincount(of, planar.ring_areas(xy, ends), n)
            yield pa.RecordBatch.from_arrays([part.column("patch_id"), part.column("key"), geometry.shapes_of(xy, ends, of, n), pa.array(area, pa.float64())], names=["patch_id", "key", "geometry", "area"])

    # Both ways below read these, so that patches are outlined and measured once.
    pairs = stored(found.join(outlines.select("patch_id", "geometry"), "patch_id"), "zone-pairs")
    crossing = pairs.where("not within").join(shapes, "key").select("patch_id", "key", "geometry", "edges").mapInArrow(cut, f"patch_id int, key long, geometry {geometry.RINGS}, area double")
    every = pairs.where("within").select("patch_id", "key", "geometry", "area").unionByName(crossing)
    return every.join(keyed.select("key", zone_col), "key").select("patch_id", zone_col, "geometry", (F.col("area") * 1e-4).alias("zone_area_ha"))


def tile_grid(area: DataFrame, tile_size: float) -> DataFrame:
    """(tile, xmin, ymin, xmax, ymax): square tiles from the lower left of the area's bounding box, those that meet the area."""
    check_features(area, "aoi")
    points = F.flatten("geometry")
    ends = {name: each(F.transform(points, axis)) for name, each, axis in (("gx0", F.array_min, X), ("gy0", F.array_min, Y), ("gx1", F.array_max, X), ("gy1", F.array_max, Y))}
    own = area.where(F.size(points) > 0).select("geometry", *(v.alias(k) for k, v in ends.items()))
    box = own.agg(F.min("gx0"), F.min("gy0"), F.max("gx1"), F.max("gy1")).first()
    if box[0] is None:
        raise ValueError("no tile intersects the AOI")
    x0, y0, x1, y1 = box
    nx, ny = (max(1, math.ceil((b - a) / tile_size)) for a, b in ((x0, x1), (y0, y1)))
    # Each polygon goes to the tiles under its own bounding box, boundary included.
    place = lambda c, start, n, slack: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - start) / tile_size + slack).cast("int")))
    span = lambda a, b, start, n: F.explode(F.sequence(place(a, start, n, -1e-9), place(b, start, n, 1e-9)))
    each = own.withColumn("tx", span("gx0", "gx1", x0, nx)).withColumn("ty", span("gy0", "gy1", y0, ny))
    tiles = each.select(
        "geometry", (F.col("ty") * nx + F.col("tx")).cast("int").alias("tile"),
        (F.lit(x0) + F.col("tx") * tile_size).alias("xmin"), (F.lit(y0) + F.col("ty") * tile_size).alias("ymin"),
        (F.lit(x0) + (F.col("tx") + 1) * tile_size).alias("xmax"), (F.lit(y0) + (F.col("ty") + 1) * tile_size).alias("ymax"),
    )

    def meets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [geometry.touches(geometry.edges(g), *box) for g, *box in zip(pdf["geometry"], pdf["xmin"], pdf["ymin"], pdf["xmax"], pdf["ymax"])]
            yield pdf.loc[keep, ["tile", "xmin", "ymin", "xmax", "ymax"]]

    return tiles.mapInPandas(meets, "tile int, xmin double, ymin double, xmax double, ymax double").distinct()


def sides(cells: DataFrame) -> DataFrame:
    """(patch_id, r0, c0, r1, c1): the boundaries of patches of cells (patch_id, row, col) as straight pieces from corner to corner, the cells to the left.

    A side that two cells of a patch share cancels out. What is left on a line and goes one way
    without a gap is one piece: where two cells touch in a corner only, the way turns round.
    """
    down = lambda dr, dc, across, way: F.struct(F.lit(across).alias("across"), (F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c"), F.lit(way).alias("way"))
    each = cells.select("patch_id", F.inline(F.array(down(1, 0, True, 1), down(0, 0, True, -1), down(0, 1, False, -1), down(0, 0, False, 1))))
    open_ = each.groupBy("patch_id", "across", "r", "c").agg(F.sum("way").alias("way"), F.count(F.lit(1)).alias("n")).where("n = 1")
    line, at = F.when(F.col("across"), F.col("r")).otherwise(F.col("c")), F.when(F.col("across"), F.col("c")).otherwise(F.col("r"))
    placed = open_.select("patch_id", "across", "way", line.alias("line"), at.alias("at"))
    island = F.col("at") - F.row_number().over(Window.partitionBy("patch_id", "across", "line", "way").orderBy("at"))
    pieces_ = placed.withColumn("k", island).groupBy("patch_id", "across", "line", "way", "k").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    a, b = F.when(F.col("way") == 1, F.col("a")).otherwise(F.col("b")), F.when(F.col("way") == 1, F.col("b")).otherwise(F.col("a"))
    pick = lambda yes, no: F.when(F.col("across"), yes).otherwise(no).cast("int")
    return pieces_.select("patch_id", pick(F.col("line"), a).alias("r0"), pick(a, F.col("line")).alias("c0"), pick(F.col("line"), b).alias("r1"), pick(b, F.col("line")).alias("c1"))


def outlines(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """(patch_id, geometry): each patch's boundary as rings, of cells (patch_id, row, col).

    Spark finds the straight pieces and gathers them by patch; tasks trace the patches of a batch one after another.
    """

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = geometry.lengths(batch.column("pieces"))
            for start, stop in planar.portions(n):
                part = batch.slice(start, stop - start)
                pieces_ = np.stack([c.to_numpy(zero_copy_only=False) for c in part.column("pieces").flatten().flatten()], 1).tolist()
                ends = np.concatenate([[0], np.cumsum(n[start:stop])]).tolist()
                shapes = [geometry.rings_of_sides(pieces_[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                rings = [ring for shape in shapes for ring in shape]
                at = np.array([p for ring in rings for p in ring], float).reshape(-1, 2)
                xy = np.stack([grid.xmin + at[:, 0] * grid.resx, grid.ymax - at[:, 1] * grid.resy], 1)
                of = np.repeat(np.arange(len(shapes)), [len(shape) for shape in shapes])
                made = geometry.shapes_of(xy, np.cumsum([0, *map(len, rings)]), of, len(shapes))
                yield pa.RecordBatch.from_arrays([part.column("patch_id"), made], names=["patch_id", "geometry"])

    gathered = sides(cells).groupBy(F.col("patch_id").cast("int").alias("patch_id")).agg(F.collect_list(F.struct("r0", "c0", "r1", "c1")).alias("pieces"))
    return gathered.mapInArrow(trace, f"patch_id int, geometry {geometry.RINGS}")
