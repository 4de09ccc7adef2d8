"""The scan of scene pixels: the rows of a plain filter, and only the tiles that it needs."""

import datetime
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from terralapse.functions.geometry import RINGS
from terralapse.grid import GridSpec
from terralapse.operators.attribute import clip
from terralapse.sources import scenes

GRID = GridSpec(0.0, 1000.0, 10.0, 10.0, 100, 100)
SCHEMA = "scene_id string, scene_date date, cloud_cover double, row int, col int, B04 int, B08 double"


@pytest.fixture(scope="module")
def pixels(spark):
    rng = random.Random(3)
    rows = []
    for k in range(30):
        day = None if k == 7 else datetime.date(2020, 1, 1) + datetime.timedelta(days=11 * k)
        cloud = None if k % 9 == 4 else float(k % 40)
        rows += [(f"s/{k} ä", day, cloud, r, c, rng.randrange(100), rng.choice([None, 0.5])) for r in range(0, 100, 7) for c in range(k % 5, 100, 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def path(pixels, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("scenes") / "store")
    scenes.write_scenes(pixels, where, tile=32, page_entries=40)
    return where


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


FILTERS = [
    "true", "scene_date >= '2020-03-01'", "scene_date < '2020-03-01' and cloud_cover <= 5", "scene_date = '2020-01-12'", "row < 30 and col > 70", "row = 14", "row in (7, 91) and col >= 90",
    "scene_id in ('s/3 ä', 's/4 ä') and row > 50", "scene_date is null", "cloud_cover is null", "cloud_cover is not null and B04 > 50", "row < 10 or col < 5", "scene_date > '2030-01-01'", "B08 is null and row <= 7", "scene_date in ('2020-01-01', '2020-02-03')",
]


@pytest.mark.parametrize("plan_pages", [0, 1000])
def test_filters(spark, pixels, path, plan_pages):
    assert scenes.scan_scenes(spark, path, plan_pages=plan_pages).schema == pixels.schema
    for f in FILTERS:
        same(scenes.scan_scenes(spark, path, plan_pages=plan_pages).where(f), pixels.where(f))


def test_area(spark, pixels, path):
    triangle = spark.createDataFrame([([[{"x": 205.0, "y": 905.0}, {"x": 505.0, "y": 905.0}, {"x": 205.0, "y": 405.0}]],)], f"geometry {RINGS}")
    found = scenes.scan_scenes(spark, path, start="2020-02-01", end="2020-06-30", cloud_cover_max=20, aoi=triangle, grid=GRID)
    plain = clip(pixels.where("scene_date between '2020-02-01' and '2020-06-30' and cloud_cover <= 20"), triangle, GRID)
    assert plain.count() > 10
    same(found, plain)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    (pushed,) = [x for x in plan.splitlines() if x.startswith("PushedFilters")]
    assert all(f in pushed for f in ("row", "col", "scene_date", "cloud_cover"))
    assert scenes.scan_scenes(spark, path, aoi=triangle.where("false"), grid=GRID).count() == 0


@pytest.mark.parametrize("plan_pages", [0, 1000])
def test_other_tiles_are_never_opened(spark, pixels, path, tmp_path, plan_pages):
    """Everything outside the filters is broken beyond reading, and pages of other days are gone."""
    where = f"{tmp_path}/broken"
    shutil.copytree(path, where)
    for d, _, files in os.walk(where):
        for f in (x for x in files if x.endswith(".json")):
            text = open(f"{d}/{f}").read().replace(path, where)
            open(f"{d}/{f}", "w").write(text)
    reader = scenes.SceneReader(where, pixels.schema, plan_pages)
    kept = {f.removeprefix("file://") for p in scenes.lines(f"{where}/index") for e in reader.matching(json.loads(p)["page"]) if e["scene_date"] and e["scene_date"].month == 3 and e["row_min"] <= 20 for f in e["files"]}
    broken = 0
    for d, _, files in os.walk(f"{where}/pixels"):
        for f in (x for x in files if x.endswith(".parquet") and f"{d}/{x}" not in kept):
            open(f"{d}/{f}", "w").write("broken")
            broken += 1
    assert kept and broken > 10 * len(kept) / 2
    for line in map(json.loads, scenes.lines(f"{where}/index")):
        if line["last"] < "2020-03-01" or line["first"] > "2020-03-31":
            os.remove(line["page"].removeprefix("file://"))
    f = "scene_date >= '2020-03-01' and scene_date <= '2020-03-31' and row <= 20"
    same(scenes.scan_scenes(spark, where, plan_pages=plan_pages).where(f), pixels.where(f))
    with pytest.raises(Exception):
        scenes.scan_scenes(spark, where, plan_pages=plan_pages).where("row <= 20").agg(F.sum("B04")).collect()


def test_messages(spark, path, pixels, tmp_path):
    with pytest.raises(ValueError, match="grid"):
        scenes.scan_scenes(spark, path, aoi=spark.createDataFrame([([],)], f"geometry {RINGS}"))
    scenes.write_scenes(pixels.where("false"), f"{tmp_path}/none")
    assert scenes.scan_scenes(spark, f"{tmp_path}/none").count() == 0
