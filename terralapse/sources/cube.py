"""From scenes to layers: composites, masks, band offsets, indices, and resampling.

Scene pixels are rows of (scene_id, scene_date, row, col, bands...) in Parquet. Everything is
lazy until it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralapse.functions import geometry
from terralapse.functions.indices import index_column, index_roles
from terralapse.grid import LONLAT, GridSpec, snapped_tile_size
from terralapse.operators.attribute import check_features, clip
from terralapse.sources import cache, catalog, config, warp

PERIODS = {"P1M": "month", "P3M": "quarter", "P1Y": "year", "P1W": "week", "P1D": "day"}


def period_start(day: Column, dt: str) -> Column:
    if dt not in PERIODS:
        raise ValueError(f"dt must be one of {', '.join(PERIODS)}")
    return F.trunc(day, PERIODS[dt]) if dt != "P1D" else day


def aggregated(value: Column, order: Column, how: str) -> Column:
    """One value of a group; ``first`` and ``last`` go by ``order``, nulls aside."""
    known = F.when(value.isNotNull(), order)
    table: dict[str, Callable[[], Column]] = {
        "first": lambda: F.min_by(value, known),
        "last": lambda: F.max_by(value, known),
        "median": lambda: F.median(value),
        "mean": lambda: F.mean(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "count": lambda: F.count(value),
    }
    if how not in table:
        raise ValueError(f"aggregation must be one of {', '.join(table)}")
    return table[how]()


def composite(pixels: DataFrame, bands: list[str], dt: str, aggregation: str, by: list[str] | None = None) -> DataFrame:
    """(row, col, [by...], t, bands...): each band on its own, over each period."""
    order = F.struct("scene_date", "scene_id")
    keys = ["row", "col", *(by or []), "t"]
    return pixels.withColumn("t", period_start(F.col("scene_date"), dt)).groupBy(*keys).agg(*(aggregated(F.col(b), order, aggregation).alias(b) for b in bands))


@dataclass(frozen=True)
class Place:
    """Where a fetch reads: the target grid and its area, None for the pixels' own grid as it is."""

    grid: GridSpec
    aoi: DataFrame | None
    tiles: DataFrame | None
    warp: bool
    #: The area in longitude and latitude, as lists of rings.
    lonlat: list | None


def placed(grid: GridSpec, aoi: DataFrame | None, aoi_crs: str | None, res: float | None, crs: str | None, tile_size: float | None) -> Place:
    if aoi is not None:
        check_features(aoi, "aoi")
    aoi_crs = aoi_crs or grid.crs
    if tile_size is not None:
        tile_size = snapped_tile_size(tile_size, float(res or grid.resx))
        if aoi is None:
            raise ValueError("tile_size needs an aoi")
    to = warp.target_grid(grid, aoi=aoi, aoi_crs=aoi_crs, res=res, crs=crs, tile_size=tile_size) if res or crs or tile_size else grid
    own = None if aoi is None else warp.in_crs(aoi, aoi_crs, to.crs)
    tiles = None if tile_size is None else warp.tiled(own, tile_size)
    # An area of interest is a handful of polygons.
    lonlat = None if aoi is None else [r[0] for r in warp.in_crs(aoi, aoi_crs, LONLAT[0]).select("geometry").collect()]
    return Place(to, own, tiles, to != grid, lonlat)


def box_around(areas: list) -> tuple[float, float, float, float]:
    e = np.concatenate([geometry.edges(rings) for rings in areas])
    return e[:, 0].min(), e[:, 1].min(), e[:, 0].max(), e[:, 1].max()


def pixels_of(source, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The pixels of the scenes found: of a table by scene, or what a reader gives for the (signed) items."""
    if callable(source):
        return source(wanted)
    return source.join(wanted.select(F.col("id").alias("scene_id")), "scene_id", "left_semi")


def stac_fetch(
    spark,
    items: DataFrame | str,
    pixels: DataFrame | Callable[[DataFrame], DataFrame],
    grid: GridSpec,
    *,
    source: str = "io-lulc",
    collection: str | None = None,
    aoi: DataFrame | None = None,
    aoi_crs: str | None = None,
    bbox: tuple[float, float, float, float] | None = None,
    years: list[int] | None = None,
    res: float | None = None,
    crs: str | None = None,
    dt: str = "P1Y",
    aggregation: str = "first",
    resampling: str = "near",
    tile_size: float | None = None,
    band: str = "code",
    sign: Callable[[str], str] | None = None,
    cache_dir: str | None = None,
    force: bool = False,
) -> DataFrame:
    """(layer, layer_ix, row, col, code): a class raster per year, of the scenes that a search finds, inside the area.

    ``items`` is a table or the path of a catalog; ``pixels`` a table on ``grid`` or a reader of
    the items found, whose addresses are signed (see ``catalog.read_assets``). The search is
    bounded by ``bbox`` or else by the area's box in longitude and latitude. With ``res``,
    ``crs`` (``auto`` for the area's UTM zone) or ``tile_size`` scenes are warped to
    ``warp.target_grid`` first, tile by tile if they are tiled. The cache is asked before the catalog.
    """
    chosen = config.categorical(source)
    collection = collection or chosen.collection
    years = sorted(set(years or chosen.available_years))
    place = placed(grid, aoi, aoi_crs, res, crs, tile_size)
    key = cache.key(
        source=source, catalog=items if isinstance(items, str) else None, collection=collection, years=years, dt=dt, aggregation=aggregation, resampling=resampling, grid=grid, target=place.grid, bbox=bbox,
        geometry=cache.geometry_key(place.aoi), band=band, **({"tile_size": snapped_tile_size(tile_size, place.grid.resx)} if tile_size else {}),
    )
    if cache_dir and not force and (hit := cache.read(spark, cache_dir, source, key)) is not None:
        return hit
    table = catalog.read_items(spark, items) if isinstance(items, str) else items
    box = bbox or (box_around(place.lonlat) if place.lonlat else None)
    wanted = catalog.signed(catalog.found(catalog.search(table, bbox=box, collection=collection, start=f"{years[0]}-01-01", end=f"{years[-1]}-12-31")), sign)
    wanted = wanted.where(F.year("item_date").isin(years))
    seen = pixels_of(pixels, wanted, [band])
    if place.warp:
        cells = warp.targets(spark, place.grid, place.tiles)
        seen = warp.warped(seen, grid, place.grid, [band], resampling, ("scene_id", "scene_date"), cells)
    # Tiles don't overlap, so the composites of all tiles together are their mosaic.
    layers = composite(seen, [band], dt, aggregation)
    order = F.create_map(*(F.lit(x) for i, y in enumerate(years) for x in (y, i)))
    cells = layers.select(F.year("t").cast("string").alias("layer"), order[F.year("t")].cast("int").alias("layer_ix"), "row", "col", F.col(band).cast("int").alias("code"))
    out = clip(cells, place.aoi, place.grid) if aoi is not None else cells
    return cache.write(out, cache_dir, source, key, place.grid) if cache_dir else out


def month_spine(stack: DataFrame, dt: str = "P1M", by: tuple[str, ...] = ()) -> DataFrame:
    """The stack with a row for every pixel and period from the first to the last, null where there was none."""
    step = {"P1M": "interval 1 month", "P3M": "interval 3 month", "P1Y": "interval 1 year", "P1W": "interval 7 day", "P1D": "interval 1 day"}[dt]
    ends = stack.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()  # one row
    if ends.a is None:
        return stack.select(*by, "row", "col", "t", "y")
    every = F.explode(F.sequence(F.lit(ends.a), F.lit(ends.b), F.expr(step))).alias("t")
    # Each pixel lays its values over the periods itself, so there is no second shuffle.
    pixels = stack.groupBy(*by, "row", "col").agg(F.map_from_entries(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("t", "y")))).alias("m"))
    return pixels.select(*by, "row", "col", "m", every).select(*by, "row", "col", F.col("t").cast("date").alias("t"), F.col("m")[F.col("t").cast("date")].alias("y"))


def index_stack(
    pixels: DataFrame,
    index: str = "kndvi",
    *,
    source: str = "sentinel-2-l2a",
    roles: dict[str, str] | None = None,
    dt: str = "P1M",
    aggregation: str = "median",
    mask_values: list[int] | None = None,
    spine: bool = True,
    by: tuple[str, ...] = (),
    boundary: str | None = None,
) -> DataFrame:
    """(row, col, t, y): the index of each period's composites.

    Pixels whose mask band holds a masked class go first. Bands are composited on each side of
    the offset's boundary, the index is taken of these composites with the side's own offset, and
    where a period has both sides the earlier one counts (a null one doesn't). ``boundary`` stands in for the source's.
    """
    chosen = config.cube(source)
    boundary = boundary or chosen.offset_boundary
    roles = roles or chosen.roles
    masked = list(chosen.mask_values if mask_values is None else mask_values)
    bands = sorted({roles[r] for r in index_roles(index) if r in roles})
    seen = pixels
    if masked and "mask" in roles:
        seen = seen.where(F.col(roles["mask"]).isNull() | ~F.col(roles["mask"]).isin(masked))
    # Dealt by pixel once: composites, sides, the spine and a trend or break of the stack need no other shuffle.
    seen = seen.select(*by, "row", "col", "scene_date", "scene_id", *bands).repartition("row", "col")
    before = F.lit(False) if boundary is None else F.coalesce(F.col("scene_date") < F.lit(boundary).cast("date"), F.lit(False))
    sided = composite(seen.withColumn("pre", before), bands, dt, aggregation, ["pre", *by])
    offset = F.when(F.col("pre"), F.lit(float(chosen.offset if chosen.offset_before is None else chosen.offset_before))).otherwise(F.lit(chosen.offset))
    valued = sided.withColumn("y", index_column(index, roles, chosen.scale, offset))
    merged = valued.groupBy(*by, "row", "col", "t").agg(F.coalesce(F.max(F.when(F.col("pre"), F.col("y"))), F.max(F.when(~F.col("pre"), F.col("y")))).alias("y"))
    return month_spine(merged, dt, by) if spine else merged


def stac_cube(
    spark,
    items: DataFrame | str,
    pixels: DataFrame | Callable[[DataFrame], DataFrame],
    grid: GridSpec,
    datetime: str,
    *,
    source: str = "sentinel-2-l2a",
    collection: str | None = None,
    index: str = "kndvi",
    aoi: DataFrame | None = None,
    aoi_crs: str | None = None,
    area_lonlat: list | None = None,
    res: float | None = None,
    crs: str | None = None,
    dt: str = "P1M",
    aggregation: str = "median",
    resampling: str = "bilinear",
    clip_to_aoi: bool = True,
    cloud_cover_max: float = 60,
    months: list[int] | None = None,
    mask_values: list[int] | None = None,
    tile_size: float | None = None,
    sign: Callable[[str], str] | None = None,
    cache_dir: str | None = None,
    force: bool = False,
) -> DataFrame:
    """(row, col, t, y): an index stack of the scenes that a search finds. The cache is asked first.

    Scenes must meet the area itself (``area_lonlat``, rings in longitude and latitude, or else
    ``aoi``). Arguments are as in ``stac_fetch``; masked pixels go before scenes are warped.
    """
    chosen = config.cube(source)
    collection = collection or chosen.collection
    start, end = catalog.interval(datetime)
    masked = sorted(set(chosen.mask_values if mask_values is None else mask_values))
    place = placed(grid, aoi, aoi_crs, res, crs, tile_size)
    key = cache.key(
        source=source, catalog=items if isinstance(items, str) else None, collection=collection, index=index, start=start, end=end, dt=dt, aggregation=aggregation, resampling=resampling,
        clip=bool(clip_to_aoi), cloud_cover_max=float(cloud_cover_max), grid=grid, target=place.grid, months=sorted(set(months or [])), mask_values=masked, scale=chosen.scale,
        offsets=[chosen.offset, chosen.offset_before, chosen.offset_boundary], geometry=cache.geometry_key(place.aoi), area=area_lonlat,
        **({"tile_size": snapped_tile_size(tile_size, place.grid.resx)} if tile_size else {}),
    )
    if cache_dir and not force and (hit := cache.read(spark, cache_dir, source, key)) is not None:
        return hit
    table = catalog.read_items(spark, items) if isinstance(items, str) else items
    areas = [area_lonlat] if area_lonlat is not None else place.lonlat
    wanted = catalog.signed(catalog.found(catalog.search(table, areas=areas, collection=collection, start=start, end=end, cloud_cover_max=cloud_cover_max, months=months)), sign)
    roles = chosen.roles
    bands = sorted({roles[r] for r in index_roles(index) if r in roles})
    seen = pixels_of(pixels, wanted, bands)
    if place.warp:
        if masked and "mask" in roles:
            seen = seen.where(F.col(roles["mask"]).isNull() | ~F.col(roles["mask"]).isin(masked))
        cells = warp.targets(spark, place.grid, place.tiles)
        seen = warp.warped(seen, grid, place.grid, bands, resampling, ("scene_id", "scene_date"), cells)
        masked = []
    out = index_stack(seen, index, source=source, dt=dt, aggregation=aggregation, mask_values=masked, by=("tile",) if place.tiles is not None else ())
    if place.tiles is not None:
        out = warp.of_tiles(out)
    if aoi is not None and clip_to_aoi:
        out = clip(out, place.aoi, place.grid, drop=False)
    return cache.write(out, cache_dir, source, key, place.grid) if cache_dir else out
