"""Geometry, overlays, areas, tiles, classes, consensus, catalog, cache and map."""

import json
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralapse import mapspec
from terralapse.functions import geometry
from terralapse.functions.geometry import RINGS
from terralapse.grid import GridSpec, check_crs, lonlat_from_utm, reprojected, snapped_tile_size, utm_epsg, utm_from_lonlat
from terralapse.operators import attribute as at
from terralapse.operators.classify import classify
from terralapse.operators.consensus import consensus
from terralapse.operators.summarize import summarize
from terralapse.operators.transition import transition
from terralapse.sources import cache, catalog, cube, warp
from terralapse.sources.classes import ITEMS_SCHEMA, class_table, classes_of_items
from terralapse.sources.config import source_config

GRID = GridSpec(0.0, 100.0, 10.0, 10.0, 10, 40)
CELLS = "layer string, layer_ix int, row int, col int, code int"


def box(x0, y0, x1, y1):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]


def features(spark, rows, schema):
    return spark.createDataFrame(rows, f"geometry {RINGS}, {schema}")


def test_areas():
    e = geometry.edges(box(0, 0, 10, 10))
    assert geometry.overlap(e, 5, 5, 20, 20) == pytest.approx(25) and geometry.overlap(e, 10, 0, 20, 10) == 0 and geometry.touches(e, 10, 0, 20, 10) and not geometry.touches(e, 10.1, 0, 20, 10)
    bow = geometry.edges([[(-10, -10), (110, 110), (110, -10), (-10, 110)]])
    assert geometry.area(bow) == pytest.approx(7200)
    hole = geometry.edges([*box(0, 0, 10, 10), *box(2, 2, 4, 4)])
    assert geometry.area(hole) == pytest.approx(96) and not geometry.contains(hole, np.array([3.0]), np.array([3.0]))[0]
    triangle = geometry.edges([[(0, 0), (10, 0), (0, 10)]])
    assert geometry.overlap(triangle, 2, 2, 6, 9) == pytest.approx(sum((min(6, 10 - y) - 2) * 1e-3 for y in np.arange(2.0005, 8, 1e-3)), rel=1e-3)


@pytest.mark.parametrize("lon, lat, epsg", [(175, -42, 32760), (2, 48, 32631), (-126.15, 54.375, 32609)])
def test_utm(lon, lat, epsg):
    assert utm_epsg(lon, lat) == epsg
    x, y = utm_from_lonlat(lon, lat, epsg)
    assert lonlat_from_utm(x, y, epsg) == pytest.approx((lon, lat), abs=1e-9)
    assert 166_000 < x < 834_000 and 0 < y < 10_000_000
    with pytest.raises(ValueError, match="not a UTM zone"):
        utm_from_lonlat(0, 0, 3005)


def test_utm_known_point():
    assert utm_from_lonlat(3.0, 0.0, 32631) == pytest.approx((500_000, 0), abs=1e-6)
    assert utm_from_lonlat(-75.0, 40.0, 32618) == pytest.approx((500_000, 4_427_757.2187), abs=1e-3)


def test_tile_sizes():
    assert snapped_tile_size(None, 10) is None and snapped_tile_size(500, 10) == 500
    with pytest.warns(UserWarning):
        assert snapped_tile_size(504, 10) == 500
    with pytest.warns(UserWarning):
        assert snapped_tile_size(506, 10) == 510
    for bad in (4, -1, float("inf"), "x", True):
        with pytest.raises(ValueError):
            snapped_tile_size(bad, 10)
    with pytest.raises(ValueError, match="projected CRS"):
        check_crs(GridSpec(0, 0, 1, 1, 1, 1, "EPSG:4326"), "summarize")


def test_tiles(spark):
    square = spark.createDataFrame([(box(0, 0, 1000, 1000),)], f"geometry {RINGS}")
    assert {(r.xmin, r.ymin) for r in at.tile_grid(square, 500.0).collect()} == {(0, 0), (500, 0), (0, 500), (500, 500)}
    strip = spark.createDataFrame([([[{"x": x, "y": y} for x, y in ((0.0, 0.0), (20.0, 0.0), (1000.0, 980.0), (1000.0, 1000.0), (980.0, 1000.0), (0.0, 20.0))]],)], f"geometry {RINGS}")
    assert 0 < at.tile_grid(strip, 400.0).count() < 9
    assert at.tile_grid(spark.createDataFrame([(box(0, 0, 400, 400),)], f"geometry {RINGS}"), 500.0).count() == 1
    with pytest.raises(ValueError, match="no tile"):
        at.tile_grid(spark.createDataFrame([([],)], f"geometry {RINGS}"), 500.0)


@pytest.fixture(scope="module")
def squares(spark):
    """Two squares of 100 m, 300 m apart, as patches and runs."""
    patches = spark.createDataFrame([(1, "Trees -> Crops", 1.0), (2, "Trees -> Water", 1.0)], "patch_id int, transition string, area_ha double")
    runs = spark.createDataFrame([(p, r, c, c + 9) for p, c in ((1, 0), (2, 30)) for r in range(10)], "patch_id int, row int, col_start int, col_end int")
    overlay = features(spark, [(box(-10, -10, 30, 110), 2018.0, "fire", "x"), (box(30, -10, 150, 110), 2022.0, "harvest", "y")], "fire_year double, cause string, ignore_me string")
    return patches, runs, overlay


@pytest.mark.parametrize("bucket", [4, 64])
def test_attribution(spark, squares, bucket):
    run = lambda **k: sorted((r.patch_id, r.fire_year) for r in at.attribute(*squares, GRID, ["fire_year"], bucket=bucket, **k).collect())
    assert run(match_mode="largest") == [(1, 2022.0), (2, None)]
    assert run() == [(1, 2018.0), (1, 2022.0), (2, None)]
    assert run(time_col="fire_year", time_interval=(2022, 2023)) == [(1, 2022.0), (2, None)]
    assert run(time_col="fire_year", time_interval=(2019, 2021)) == [(1, None), (2, None)]
    inside = features(spark, [(box(-10, -10, 110, 110), "containing"), (box(90, -10, 150, 110), "clipping")], "cause string")
    got = at.attribute(squares[0], squares[1], inside, GRID, ["cause"], predicate="within", bucket=bucket).collect()
    assert sorted((r.patch_id, r.cause) for r in got if r.cause) == [(1, "containing")]
    bow = features(spark, [([[{"x": x, "y": y} for x, y in ((-10.0, -10.0), (110.0, 110.0), (110.0, -10.0), (-10.0, 110.0))]], "bow")], "cause string")
    assert [r.cause for r in at.attribute(squares[0], squares[1], bow, GRID, ["cause"], bucket=bucket).orderBy("patch_id").collect()] == ["bow", None]
    none = at.attribute(squares[0], squares[1], squares[2].where("false"), GRID, ["cause", "fire_year"], bucket=bucket)
    assert none.count() == 2 and dict(none.dtypes)["fire_year"] == "double"
    zones = at.zones(squares[0], squares[1], squares[2], GRID, "cause", bucket).orderBy("cause").collect()
    assert [(r.patch_id, r.cause, r.area_ha, round(r.zone_area_ha, 6)) for r in zones] == [(1, "fire", 1.0, 0.3), (1, "harvest", 1.0, 0.7)]


@pytest.mark.parametrize(
    "options, message",
    [
        ({"cols": []}, "at least one"),
        ({"cols": ["nope"]}, "not found"),
        ({"cols": ["geometry"]}, "geometry"),
        ({"cols": ["cause"], "predicate": "touching"}, "predicate"),
        ({"cols": ["cause"], "predicate": "within", "match_mode": "largest"}, "largest"),
        ({"cols": ["cause"], "time_col": "fire_year"}, "together"),
        ({"cols": ["cause"], "time_col": "cause", "time_interval": (1, 2)}, "numeric"),
        ({"cols": ["cause"], "time_col": "x", "time_interval": (1, 2)}, "existing"),
        ({"cols": ["cause"], "time_col": "fire_year", "time_interval": (2, 1)}, "decreasing"),
        ({"cols": ["cause"], "time_col": "fire_year", "time_interval": (1,)}, "length-2"),
    ],
)
def test_attribution_messages(squares, options, message):
    with pytest.raises(ValueError, match=message):
        at.attribute(*squares, GRID, options.pop("cols"), **options)


def test_clip(spark):
    cells = spark.createDataFrame([(str(k), k, r, c, 1) for k in range(2) for r in range(10) for c in range(10)], CELLS)
    left = spark.createDataFrame([(box(0, 0, 50, 100),), (box(0, 0, 20, 20),)], f"geometry {RINGS}")
    assert at.clip(cells, left, GRID).count() == 100 and at.clip(cells, left, GRID, bucket=3).selectExpr("max(col)").first()[0] == 4
    kept = at.clip(cells, left, GRID, drop=False)
    assert kept.count() == 200 and kept.where("code is null").count() == 100


def test_outlines(spark):
    cells = spark.createDataFrame([(1, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(2, 5, 5), (2, 6, 6)], "patch_id int, row int, col int")
    got = {r.patch_id: r.geometry for r in at.outlines(cells, GRID).collect()}
    assert geometry.area(geometry.edges([[p.asDict() for p in ring] for ring in got[1]])) == pytest.approx(800) and len(got[1]) == 2
    assert geometry.area(geometry.edges([[p.asDict() for p in ring] for ring in got[2]])) == pytest.approx(200) and len(got[2]) == 2


def test_classes(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0, 2), ("a", 0, 0, 1, 11), ("a", 0, 0, 2, 99), ("a", 0, 0, 3, None)], CELLS)
    table = class_table(spark)
    assert table.count() == 10 and class_table(spark, "esa-worldcover").count() == 11
    with pytest.raises(ValueError, match="source"):
        class_table(spark, "nope")
    with pytest.warns(UserWarning, match="no matching class"):
        found = classify(cells, table, {"Green": ["Trees", "Rangeland"], "Nothing": ["Nowhere"]})
    assert [(r.id, r.label, r.color) for r in found.levels.collect()] == [(2, "Green", "#397d49")]
    got = {r.code: r for r in summarize(cells, GRID, table, "m2").collect()}
    assert got[99].class_name == "Unknown_99" and got[99].color == "#cccccc" and got[2].area == 100.0 and got[2].pct == 33.33
    with pytest.raises(ValueError, match="unit"):
        summarize(cells, GRID, table, "acre")
    assert classes_of_items(spark, None).count() == 10


def test_consensus(spark):
    rows = [(str(i), i, 0, 0, v) for i, v in enumerate((3, 1, 1, 3))] + [(str(i), i, 0, 1, v) for i, v in enumerate((None, 5, None, 7))] + [(str(i), i, 0, 2, None) for i in range(4)]
    got = {r.col: r for r in consensus(spark.createDataFrame(rows, CELLS), confidence=True).collect()}
    assert (got[0].code, got[0].confidence) == (3, 0.5) and (got[1].code, got[1].confidence) == (5, 0.5) and got[2].code is None and got[2].confidence is None
    with pytest.raises(ValueError, match="at least 2 rasters"):
        consensus(spark.createDataFrame(rows[:1], CELLS))
    with pytest.raises(ValueError, match="named list"):
        consensus(spark.createDataFrame(rows, CELLS).drop("layer_ix"))


@pytest.fixture()
def items(spark, tmp_path):
    def item(name, day, cloud, x):
        return {"id": name, "bbox": [x, 0, x + 1, 1], "geometry": {"type": "Polygon"}, "properties": {"datetime": day, "eo:cloud_cover": cloud}, "assets": {"data": {"href": f"http://x/{name}"}}}

    rows = [item("a", "2018-06-01T10:00:00Z", 10, 0), item("b", "2019-07-01T10:00:00Z", 80, 0), item("c", "2019-12-01T10:00:00Z", None, 5), item("d", None, 5, 0)]
    (tmp_path / "collection.json").write_text(json.dumps({"features": rows}))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    assert catalog.read_items(spark, str(tmp_path / "collection.json")).count() == 4
    return catalog.read_items(spark, str(tmp_path / "lines.json"))


def test_catalog(spark, items):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(catalog.search(items, bbox=(0.5, 0.5, 2, 2))) == ["a", "b", "d"]
    assert ids(catalog.search(items, start="2019-01-01", end="2019-12-31")) == ["b", "c"]
    assert ids(catalog.search(items, cloud_cover_max=60)) == ["a", "d"] and ids(catalog.search(items, months=[6, 7])) == ["a", "b"]
    with pytest.raises(ValueError, match="No STAC items found"):
        catalog.found(catalog.search(items, bbox=(90, 0, 91, 1)))
    with pytest.raises(ValueError, match="start/end"):
        catalog.interval("2019-01-01")
    assert catalog.signed(items, lambda u: u + "?sig").where("id = 'a'").first().assets["data"].href == "http://x/a?sig"


def test_fetch_and_cache(spark, items, tmp_path):
    grid = GridSpec(0.0, 20.0, 10.0, 10.0, 2, 2)
    pixels = spark.createDataFrame([("a", 0, 0, 2), ("b", 0, 0, 5), ("b", 0, 1, 7), ("zz", 1, 1, 9)], "scene_id string, row int, col int, code int").join(items.selectExpr("id AS scene_id", "to_date(substring(properties.datetime, 1, 10)) AS scene_date"), "scene_id", "left")
    out = str(tmp_path / "cache")
    run = lambda **k: cube.stac_fetch(spark, items, pixels, grid, years=[2018, 2019], cache_dir=out, **k)
    got = sorted((r.layer, r.layer_ix, r.row, r.col, r.code) for r in run().collect())
    assert got == [("2018", 0, 0, 0, 2), ("2019", 1, 0, 0, 5), ("2019", 1, 0, 1, 7)]
    info = cache.cache_info(out)
    assert info["n_files"] > 0 and sorted(map(tuple, cube.stac_fetch(spark, items.where("false"), pixels, grid, years=[2019, 2018], cache_dir=out).collect())) == got
    with pytest.raises(ValueError, match="No STAC items"):
        cube.stac_fetch(spark, items.where("false"), pixels, grid, years=[2018, 2019], cache_dir=out, force=True)
    assert cache.cache_clear(out) == info["n_files"] and cache.cache_clear(out) == 0
    with pytest.raises(ValueError, match="cube source"):
        cube.stac_fetch(spark, items, pixels, grid, source="sentinel-2-l2a")
    with pytest.raises(ValueError, match="not a cube source"):
        cube.stac_cube(spark, items, pixels, grid, "2018/2019", source="io-lulc")
    with pytest.raises(ValueError, match="source must be one of"):
        source_config("nope")


def test_cache_keys(spark):
    area = features(spark, [(box(0, 0, 1, 1), "a")], "name string")
    other = features(spark, [(box(0, 0, 1, 1), "b")], "name string")
    assert cache.geometry_key(area) == cache.geometry_key(other)
    assert cache.key(res=10, a=1) == cache.key(a=1, res=10.0) != cache.key(a=2, res=10) and len(cache.key(a=1)) == 12


def test_map(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0, 2), ("b", 1, 0, 0, 5), ("a", 0, 0, 1, 1), ("b", 1, 0, 1, 1)], CELLS)
    table = class_table(spark)
    found = transition(cells, GRID, "a", "b", table)
    spec = mapspec.map_spec({"a": cells.where("layer = 'a'"), "b": cells.where("layer = 'b'")}, table, transition=found, bbox=(0, 0, 2, 4))
    assert spec["center"] == {"lng": 1.0, "lat": 2.0, "zoom": 14} and spec["hidden_groups"] == ["b"] and spec["overlay_groups"] == ["a", "b", "Trees -> Crops", "AOI"]
    assert spec["legends"][0]["labels"] == ["Water", "Trees", "Crops"] and spec["transitions"][0]["color"] == "#e49635"
    assert [list(b)[1] for b in spec["basemaps"]] == ["provider", "provider", "template", "provider"]
    assert "Trees" in mapspec.html(spec)
    url = mapspec.tile_url("https://t", "s3://b/x y.tif", table.where(F.col("code") == 1))
    assert url == "https://t/cog/tiles/WebMercatorQuad/{z}/{x}/{y}.png?url=s3%3A%2F%2Fb%2Fx%20y.tif&bidx=1&colormap=%7B%221%22%3A%5B65%2C155%2C223%2C255%5D%7D"
    assert mapspec.map_spec("http://x/1.tif", table, tiler="https://t")["layers"][0]["group"] == "Layer"
    with pytest.raises(ValueError, match="tiler URL"):
        mapspec.map_spec("http://x/1.tif", table)
    with pytest.raises(ValueError, match="transition"):
        mapspec.map_spec(cells, table, transition={"raster": 1})


def test_stream(spark, tmp_path):
    from terralapse.streaming.composites import daily_sums, month_of_days

    rows = [("2020-01-01 10:00:00", 0, 0, 10, 4), ("2020-01-01 12:00:00", 0, 0, 20, 4), ("2020-01-02 10:00:00", 0, 0, 40, 4), ("2020-01-02 11:00:00", 0, 0, 99, 9), ("2020-06-01 00:00:00", 1, 1, 7, 4)]
    df = spark.createDataFrame(rows, "ts string, row int, col int, B08 int, SCL int").selectExpr("timestamp(ts) AS scene_ts", "row", "col", "B08", "SCL")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = daily_sums(source, "B08", mask="SCL", mask_values=[9]).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = month_of_days(spark.table("days")).collect()
    assert [(r.row, r.col, str(r.t), r["mean"], r.n) for r in got] == [(0, 0, "2020-01-01", 70 / 3, 3)]


def test_resampling(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(10) for c in range(10)], "row int, col int, v double")
    of, to = GridSpec(0, 100, 10, 10, 10, 10), GridSpec(20, 80, 20, 20, 2, 2)
    near = {(r.row, r.col): r.v for r in warp.resampled(cells, of, to, "v").collect()}
    assert near[0, 0] == 33.0
    fine = {(r.row, r.col): r.v for r in warp.resampled(cells, of, to, "v", "bilinear").collect()}
    assert fine[0, 0] == pytest.approx(27.5)
    with warnings.catch_warnings(), pytest.raises(ValueError, match="method"):
        warp.resampled(cells, of, to, "v", "cubic")


# Grids, CRSs, tiles


def test_projections_of_arrays():
    x, y = np.array([300_000.0, 500_000.0, 690_000.0]), np.array([5_900_000.0, 6_100_000.0, 100.0])
    for source, target in (("EPSG:32609", "EPSG:32610"), ("EPSG:32609", "EPSG:4326"), ("EPSG:32733", "EPSG:4326")):
        there = reprojected(x, y, source, target)
        back = reprojected(*there, target, source)
        assert np.allclose(back[0], x, atol=1e-5) and np.allclose(back[1], y, atol=1e-5) and not np.allclose(there[0], x)
    with pytest.raises(ValueError, match="neither"):
        reprojected(x, y, "EPSG:27700", "EPSG:4326")


def test_a_grid_in_the_next_zone(spark):
    """Each target cell looks where its centre lies in the source's CRS."""
    of = GridSpec(690_000.0, 6_000_400.0, 10.0, 10.0, 40, 40, "EPSG:32609")
    cells = spark.createDataFrame([(r, c, 100 * r + c) for r in range(40) for c in range(40)], "row int, col int, v int")
    to = warp.target_grid(of, res=20.0, crs="EPSG:32610")
    assert to.crs == "EPSG:32610" and (to.resx, to.resy) == (20.0, 20.0) and to.nrow > 20
    got = {(r.row, r.col): r.v for r in warp.resampled(cells, of, to, "v").collect()}
    want = {}
    for r in range(to.nrow):
        for c in range(to.ncol):
            x, y = reprojected(to.xmin + (c + 0.5) * 20, to.ymax - (r + 0.5) * 20, to.crs, of.crs)
            i, j = int(np.floor((of.ymax - y) / 10)), int(np.floor((x - of.xmin) / 10))
            if 0 <= i < 40 and 0 <= j < 40:
                want[r, c] = 100 * i + j
    assert got == want and len(want) > 300
    smooth = {(r.row, r.col): r.v for r in warp.resampled(cells, of, to, "v", "bilinear").collect()}
    assert all(abs(smooth[k] - v) < 120 for k, v in want.items())
    assert warp.chosen_crs("auto", of, None, of.crs) == "EPSG:32609" and warp.chosen_crs("auto", of, features(spark, [(box(-120, 54, -119, 55), "a")], "name string"), "EPSG:4326") == "EPSG:32611"


def test_tiles_make_the_whole(spark):
    grid = GridSpec(0.0, 80.0, 10.0, 10.0, 8, 8)
    cells = spark.createDataFrame([(f"2020-0{t}-01", r, c, 100 * t + 8 * r + c) for t in (1, 2, 3) for r in range(8) for c in range(8)], "t string, row int, col int, y int")
    parts = [cells.where(f"row >= {r} and row < {r + 4} and col >= {c} and col < {c + 4}") for r in (0, 4) for c in (0, 4)]
    assert sorted(map(tuple, warp.mosaic(parts).collect())) == sorted(map(tuple, cells.collect()))
    with pytest.raises(ValueError, match="number of layers"):
        warp.mosaic([parts[0], parts[1].where("t <> '2020-01-01'")])
    with pytest.raises(ValueError, match="overlap"):
        warp.mosaic([parts[0], parts[0]])
    with pytest.raises(ValueError, match="at least one"):
        warp.mosaic([])
    marked = parts[0].withColumn("tile", F.lit(0)).union(parts[1].withColumn("tile", F.lit(1)))
    assert warp.of_tiles(marked).count() == 96
    with pytest.raises(ValueError, match="number of layers"):
        warp.of_tiles(marked.where("tile = 0 or t = '2020-01-01'"))
    area = features(spark, [(box(1, 1, 35, 38), "a"), (box(61, 61, 79, 79), "b")], "name string")
    to = warp.target_grid(grid, aoi=area, tile_size=20.0)
    assert (to.xmin, to.ymin, to.nrow, to.ncol) == (1.0, 1.0, 8, 8)
    got = warp.targets(spark, to, warp.tiled(area, 20.0))
    seen = {(r.row, r.col) for r in got.collect()}
    assert got.count() == len(seen) == got.select("tile").distinct().count() * 4 and (7, 0) in seen and (0, 0) not in seen and (0, 7) in seen


def test_searches_by_an_items_own_shape(spark):
    """A box that meets the area around a shape that doesn't; several areas; collections."""
    far = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[0,1],[0,0]]]]}'
    rows = [{"id": "shape", "bbox": [0, 0, 1, 1], "geometry": far, "collection": "a"}, {"id": "box", "bbox": [0, 0, 1, 1]}, {"id": "point", "bbox": [0, 0, 1, 1], "geometry": '{"type":"Point","coordinates":[0,0]}', "collection": "b"}]
    items = spark.createDataFrame([(json.dumps(r | {"properties": {"datetime": "2020-01-01"}}),) for r in rows], "j string").select(F.from_json("j", ITEMS_SCHEMA).alias("i")).select("i.*")
    ids = lambda **k: sorted(r.id for r in catalog.search(items, **k).collect())
    corner, both = [[(0.8, 0.8), (2, 0.8), (2, 2), (0.8, 2)]], [[(-1, -1), (0.1, -1), (0.1, 0.1), (-1, 0.1)]]
    assert ids(intersects=corner) == ["box", "point"] and ids(areas=[corner, both]) == ["box", "point", "shape"]
    assert ids(intersects=both, collection="a") == ["box", "shape"]
    inner = np.array(geometry.edges([[(0.4, 0.4), (0.6, 0.4), (0.6, 0.6)]]))
    outer = geometry.edges([[(0, 0), (1, 0), (1, 1), (0, 1)]])
    assert geometry.meet(inner, outer) and geometry.meet(outer, inner) and not geometry.meet(inner, outer + 5)


def test_fetch_reads_signed_addresses(spark, tmp_path):
    """The reader gets the signed address, the area bounds the search, and the catalog may be a path."""
    for name in ("a", "b"):
        spark.createDataFrame([(name, r, c, 2 if name == "a" else 5) for r in range(2) for c in range(2)], "scene_id string, row int, col int, code int").withColumn("scene_date", F.lit("2018-05-01").cast("date")).write.parquet(f"{tmp_path}/{name}.signed")
    lines = [{"id": n, "collection": "io-lulc-annual-v02", "bbox": b, "properties": {"datetime": "2018-05-01T00:00:00Z"}, "assets": {"data": {"href": f"{tmp_path}/{n}"}}} for n, b in (("a", [-130, 50, -128, 51]), ("b", [10, 10, 11, 11]))]
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, lines)))
    grid = GridSpec(500_000.0, 5_600_020.0, 10.0, 10.0, 2, 2)
    area = features(spark, [(box(500_001, 5_600_001, 500_012, 5_600_019), "x")], "name string")
    options = {"years": [2018], "aoi": area, "sign": lambda u: u + ".signed"}
    got = cube.stac_fetch(spark, str(tmp_path / "items.json"), lambda items: catalog.read_assets(items, "data"), grid, **options).collect()
    assert [(r.layer, r.row, r.col, r.code) for r in sorted(got)] == [("2018", 0, 0, 2), ("2018", 1, 0, 2)]
    with pytest.raises(ValueError, match="No STAC items"):
        cube.stac_fetch(spark, str(tmp_path / "items.json"), lambda items: items, grid, collection="other", **options)
    with pytest.raises(ValueError, match="tile_size needs"):
        cube.stac_fetch(spark, str(tmp_path / "items.json"), lambda items: items, grid, years=[2018], tile_size=50.0)


def test_cubes_that_differ_have_their_own_cache(spark, tmp_path):
    """No mask and the default mask, and two areas for the search, aren't one result."""
    grid = GridSpec(0.0, 20.0, 10.0, 10.0, 2, 2)
    rows = [{"id": n, "bbox": b, "properties": {"datetime": f"2020-0{m}-05", "eo:cloud_cover": 1.0}} for n, b, m in (("a", [0, 0, 1, 1], 1), ("b", [5, 5, 6, 6], 2))]
    items = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", ITEMS_SCHEMA).alias("i")).select("i.*")
    pixels = spark.createDataFrame([("a", 0, 0, 2000, 4000, 4), ("a", 0, 1, 2000, 3000, 8), ("b", 0, 0, 1000, 4000, 4)], "scene_id string, row int, col int, B04 int, B08 int, SCL int").join(items.selectExpr("id AS scene_id", "to_date(properties.datetime) AS scene_date"), "scene_id")
    made = lambda **k: {(r.col, str(r.t)): r.y for r in cube.stac_cube(spark, items, pixels, grid, "2020-01-01/2020-12-31", index="ndvi", cache_dir=str(tmp_path), **k).collect() if r.y is not None}
    one, two = [[(0, 0), (2, 0), (2, 2), (0, 2)]], [[(4, 4), (7, 4), (7, 7), (4, 7)]]
    assert len(made(mask_values=[])) == 3 and len(made()) == 2 and len(made(mask_values=[])) == 3
    assert list(made(area_lonlat=one)) == [(0, "2020-01-01")] and list(made(area_lonlat=two)) == [(0, "2020-02-01")]
    assert cache.cache_info(str(tmp_path))["n_files"] > 8 and cache.cache_clear(str(tmp_path), "sentinel-2-l2a") > 8


def test_an_own_condition(spark):
    grid = GridSpec(0.0, 100.0, 10.0, 10.0, 10, 40)
    runs = spark.createDataFrame([(1, 0, 0, 9), (2, 0, 20, 29)], "patch_id int, row int, col_start int, col_end int")
    patches = spark.createDataFrame([(1,), (2,)], "patch_id int")
    overlay = features(spark, [(box(0, 80, 35, 100), "small"), (box(-5, 80, 105, 105), "large"), (box(300, 90, 310, 100), "apart")], "name string")
    got = lambda predicate: sorted((r.patch_id, r.name) for r in at.attribute(patches, runs, overlay, grid, ["name"], predicate=predicate).collect())
    assert got("intersects") == [(1, "large"), (1, "small"), (2, "apart")] and got("within") == [(1, "large"), (2, None)]
    assert got(lambda area, patch, other: (area > 0) & (area < 0.5 * patch)) == [(1, "small"), (2, None)]
    assert got(lambda area, patch, other: other < 500) == [(1, None), (2, "apart")] and got("touches") == [(1, None), (2, "apart")]


def test_other_projections():
    """Published points (Snyder 1987, page 292, on Clarke's ellipsoid; EPSG guidance 7-2), round trips, equal areas."""
    from terralapse.grid import ALBERS, Albers, projection, reprojected

    clarke = (6378206.4, 1 - math.sqrt(1 - 0.00676866))
    x, y = Albers(23, -96, 29.5, 45.5, 0, 0, clarke).forward(-75.0, 35.0)
    assert x == pytest.approx(1885472.7, abs=0.06) and y == pytest.approx(1535925.0, abs=0.06)
    x, y = projection("EPSG:3857").forward(-(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600)
    assert x == pytest.approx(-11169055.58, abs=0.006) and y == pytest.approx(2800000.00, abs=0.02)
    rng = np.random.default_rng(2)
    for crs, (lat0, lon0, south, north, _, _) in ALBERS.items():
        lon, lat = lon0 + rng.uniform(-25, 25, 500), rng.uniform(min(south, north) - 8, max(south, north) + 8, 500)
        there = reprojected(lon, lat, "EPSG:4326", crs)
        back = reprojected(*there, crs, "EPSG:4326")
        assert np.abs(back[0] - lon).max() < 1e-10 and np.abs(back[1] - lat).max() < 1e-10
        # A small cell keeps its area: that of the ellipsoid between two parallels.
        own, d = projection(crs), 1e-3
        ring = np.array([own.forward(lon0 + 7 + a * d, north + b * d) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
        area = 0.5 * abs(np.sum(ring[:, 0] * np.roll(ring[:, 1], -1) - ring[:, 1] * np.roll(ring[:, 0], -1)))
        phi = np.radians(north + d / 2)
        e2 = own.e**2
        true = own.a**2 * (1 - e2) * math.cos(phi) / (1 - e2 * math.sin(phi) ** 2) ** 2 * math.radians(d) ** 2
        assert area == pytest.approx(true, rel=1e-6)
    there = reprojected(rng.uniform(3e5, 7e5, 50), rng.uniform(5e6, 6e6, 50), "EPSG:32609", "EPSG:3005")
    assert np.isfinite(there).all()
    assert np.allclose(reprojected(*reprojected(4e5, 5.6e6, "EPSG:32609", "EPSG:3857"), "EPSG:3857", "EPSG:32609"), (4e5, 5.6e6), atol=1e-4)
    for wrong in ("EPSG:27700", "EPSG:abc"):
        with pytest.raises(ValueError, match="neither"):
            projection(wrong)
