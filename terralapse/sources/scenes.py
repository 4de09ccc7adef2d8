"""Scene pixels as a data source of Spark's own kind: a scan that opens only the tiles it needs.

``write_scenes`` lays pixels out by scene and tile, with a catalog beside them: an entry for each
tile of a scene (its day, its clouds, the rows and columns it spans, its files), in pages that are
sorted by day, and an index with a row for each page. The source ``scene_pixels`` takes filters on
``scene_id``, ``scene_date``, ``cloud_cover``, ``row`` and ``col``: the driver reads the index and skips pages by day; the rest are
planned as partitions, either tiles (few pages) or whole pages, which tasks read themselves (many),
so the driver never goes through a large catalog. A tile is opened only if its entry meets all filters.

    spark.dataSource.register(ScenePixels)
    spark.read.format("scene_pixels").load(path).where("scene_date >= '2020-01-01' and row < 500")

Files are read by pyarrow, so their store must be one that pyarrow knows (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import datetime
import json
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terralapse.grid import GridSpec
from terralapse.operators.attribute import check_features, clip, in_crs

OF_ENTRY = ("scene_id", "scene_date", "cloud_cover")
OF_CELL = ("row", "col")
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Up to so many pages the driver reads entries and plans tiles; beyond, tasks read the pages.
PLAN_PAGES = 64
#: Pixels of a partition of planned tiles, about.
PARTITION_PIXELS = 1 << 20


def write_scenes(pixels: DataFrame, path: str, *, tile: int = 256, page_entries: int = 10_000) -> None:
    """Writes pixels (scene_id, scene_date, cloud_cover, row, col, bands...) and their catalog under ``path``."""
    spark = pixels.sparkSession
    bands = [c for c in pixels.columns if c not in OF_ENTRY + OF_CELL]
    given = pixels.where("scene_id is not null and row is not null and col is not null").select(*OF_ENTRY, *OF_CELL, *bands)
    place = lambda c: F.floor(F.col(c) / tile).cast("int")
    keys = ["scene", "tr", "tc"]
    tiled = given.withColumns({"scene": F.sha1(F.col("scene_id").cast("binary")), "tr": place("row"), "tc": place("col")})
    tiled.repartition(*keys).sortWithinPartitions(*keys, "row", "col").write.partitionBy(*keys).parquet(f"{path}/pixels")
    written = spark.read.schema(tiled.schema).parquet(f"{path}/pixels").withColumn("file", F.input_file_name())
    entries = written.groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in OF_ENTRY), *(f(c).alias(f"{c}_{n}") for c in OF_CELL for n, f in (("min", F.min), ("max", F.max))), F.count(F.lit(1)).alias("pixels"), F.collect_set("file").alias("files")
    )
    by_day = entries.repartitionByRange("scene_date", "scene_id", "tr", "tc").sortWithinPartitions("scene_date", "scene_id", "tr", "tc")
    by_day.drop("scene").write.option("maxRecordsPerFile", page_entries).json(f"{path}/catalog")
    pages = spark.read.schema("scene_date date").json(f"{path}/catalog").withColumn("page", F.input_file_name()).groupBy("page")
    pages.agg(F.min("scene_date").alias("first"), F.max("scene_date").alias("last"), F.count(F.lit(1)).alias("entries"), F.count("scene_date").alias("dated")).write.json(f"{path}/index")
    spark.createDataFrame([(given.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")


def lines(uri: str) -> list[str]:
    """The lines of a file, or of all files of a folder that Spark wrote."""
    store, path = fs.FileSystem.from_uri(uri)
    info = store.get_file_info(path)
    files = [info] if info.type == fs.FileType.File else sorted(store.get_file_info(fs.FileSelector(path)), key=lambda f: f.path)
    out = []
    for f in files:
        if f.base_name[:1] not in "._":
            with store.open_input_stream(f.path) as s:
                out += s.read().decode().splitlines()
    return out


def bounded(filters: list, column: str, low, high) -> bool:
    """Whether a value between ``low`` and ``high`` can meet the filters on a column; none can if there is no such value."""
    for name, op, value in filters:
        if name == column:
            if low is None:
                return False
            if op == "in" and not any(v is not None and low <= v <= high for v in value):
                return False
            if op in (operator.eq, operator.ge, operator.gt) and not (op if op is not operator.eq else operator.ge)(high, value):
                return False
            if op in (operator.eq, operator.le, operator.lt) and not (op if op is not operator.eq else operator.le)(low, value):
                return False
    return True


def day(text: str | None) -> datetime.date | None:
    return datetime.date.fromisoformat(text) if text else None


@dataclass
class Tiles(InputPartition):
    """Entries to open, or a page to look for them in."""

    entries: list[dict] | None
    page: str | None


class SceneReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, plan_pages: int):
        self.path, self.schema, self.plan_pages = path, schema, plan_pages
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column not in OF_ENTRY + OF_CELL:
                yield f
            elif type(f) in COMPARED and value is not None:
                self.filters.append((column, COMPARED[type(f)], value))
            elif isinstance(f, In):
                self.filters.append((column, "in", [v for v in value if v is not None]))
            elif isinstance(f, IsNotNull):
                self.filters.append((column, "known", None))
            else:
                yield f

    def matching(self, page: str) -> Iterator[dict]:
        for line in lines(page):
            entry = json.loads(line)
            entry["scene_date"] = day(entry.get("scene_date"))
            alone = all(bounded(self.filters, c, entry.get(c), entry.get(c)) for c in OF_ENTRY)
            if alone and all(bounded(self.filters, c, entry[f"{c}_min"], entry[f"{c}_max"]) for c in OF_CELL):
                yield entry

    def partitions(self) -> Sequence[InputPartition]:
        pages = [p for p in map(json.loads, lines(f"{self.path}/index")) if bounded(self.filters, "scene_date", day(p.get("first")), day(p.get("last")))]
        if len(pages) > self.plan_pages:
            return [Tiles(None, p["page"]) for p in pages]
        out, held, size = [], [], 0
        for entry in (e for p in pages for e in self.matching(p["page"])):
            if held and size + entry["pixels"] > PARTITION_PIXELS:
                out.append(Tiles(held, None))
                held, size = [], 0
            held.append(entry)
            size += entry["pixels"]
        return [*out, Tiles(held, None)]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        bands = [f.name for f in target if f.name not in OF_ENTRY]
        for entry in partition.entries if partition.page is None else self.matching(partition.page):
            for uri in entry["files"]:
                store, path = fs.FileSystem.from_uri(uri)
                table = pq.read_table(path, filesystem=store, columns=bands, partitioning=None)
                keep = np.ones(table.num_rows, bool)
                for column, op, value in self.filters:
                    if column in OF_CELL:
                        own = table.column(column).to_numpy()
                        keep &= np.isin(own, value) if op == "in" else np.ones(len(own), bool) if op == "known" else op(own, value)
                table = table.filter(pa.array(keep))
                columns = [pa.array([entry.get(f.name)] * table.num_rows, f.type) if f.name in OF_ENTRY else table.column(f.name).cast(f.type) for f in target]
                yield from pa.Table.from_arrays(columns, schema=target).to_batches()


class ScenePixels(DataSource):
    """Format ``scene_pixels``: what ``write_scenes`` wrote, read by tile. Option ``plan_pages``: see PLAN_PAGES."""

    @classmethod
    def name(cls) -> str:
        return "scene_pixels"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads("".join(lines(f"{self.options['path']}/schema"))))

    def reader(self, schema: StructType) -> SceneReader:
        return SceneReader(self.options["path"], schema, int(self.options.get("plan_pages", PLAN_PAGES)))


def scan_scenes(
    spark: SparkSession,
    path: str,
    *,
    start: str | None = None,
    end: str | None = None,
    cloud_cover_max: float | None = None,
    aoi: DataFrame | None = None,
    aoi_crs: str | None = None,
    grid: GridSpec | None = None,
    plan_pages: int = PLAN_PAGES,
) -> DataFrame:
    """Pixels of scenes between two days (included), of at most so many clouds, whose centres lie in an area of the grid."""
    spark.dataSource.register(ScenePixels)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("scene_pixels").option("plan_pages", plan_pages).load(path)
    for bound, test in ((start, F.col("scene_date") >= F.lit(start).cast("date")), (end, F.col("scene_date") <= F.lit(end).cast("date")), (cloud_cover_max, F.col("cloud_cover") <= F.lit(cloud_cover_max))):
        found = found if bound is None else found.where(test)
    if aoi is None:
        return found
    if grid is None:
        raise ValueError("an area needs the grid of the pixels")
    check_features(aoi, "aoi")
    own = in_crs(aoi, aoi_crs or grid.crs, grid.crs)
    points = own.select(F.explode(F.flatten("geometry")).alias("p"))
    x0, x1, y0, y1 = points.agg(F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
    if x0 is None:
        return found.where("false")
    # The area's box is what the scan can use; the area itself is cut out of what it gives.
    rows, cols = (int(np.floor((grid.ymax - y) / grid.resy)) for y in (y1, y0)), (int(np.floor((x - grid.xmin) / grid.resx)) for x in (x0, x1))
    for column, (low, high) in zip(OF_CELL, (rows, cols)):
        found = found.where((F.col(column) >= low) & (F.col(column) <= high))
    return clip(found, own, grid)
