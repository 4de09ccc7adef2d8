"""Class tables: built in, from a CSV file, or from a catalog item's metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "code int, class_name string, color string, description string"

#: The classes of the two land-cover products.
CLASSES = {
    "io-lulc": [
        (0, "No Data", "#000000", "No data"),
        (1, "Water", "#419bdf", "Water bodies"),
        (2, "Trees", "#397d49", "Tree cover"),
        (4, "Flooded Vegetation", "#7a87c6", "Flooded vegetation / wetlands"),
        (5, "Crops", "#e49635", "Cropland"),
        (7, "Built Area", "#c4281b", "Built-up / urban areas"),
        (8, "Bare Ground", "#a59b8f", "Bare ground / rock"),
        (9, "Snow/Ice", "#a8ebff", "Snow and ice"),
        (10, "Clouds", "#616161", "Cloud cover"),
        (11, "Rangeland", "#e3e2c3", "Grassland / shrubland"),
    ],
    "esa-worldcover": [
        (10, "Tree cover", "#006400", "Tree cover"),
        (20, "Shrubland", "#ffbb22", "Shrubland"),
        (30, "Grassland", "#ffff4c", "Grassland"),
        (40, "Cropland", "#f096ff", "Cropland"),
        (50, "Built-up", "#fa0000", "Built-up"),
        (60, "Bare / sparse vegetation", "#b4b4b4", "Bare / sparse vegetation"),
        (70, "Snow and ice", "#f0f0f0", "Snow and ice"),
        (80, "Permanent water bodies", "#0064c8", "Permanent water bodies"),
        (90, "Herbaceous wetland", "#0096a0", "Herbaceous wetland"),
        (95, "Mangroves", "#00cf75", "Mangroves"),
        (100, "Moss and lichen", "#fae6a0", "Moss and lichen"),
    ],
}


def class_table(spark: SparkSession, source: str = "io-lulc") -> DataFrame:
    if source not in CLASSES:
        raise ValueError(f"source must be one of {', '.join(CLASSES)}")
    return spark.createDataFrame(CLASSES[source], SCHEMA)


def class_table_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("header", True).csv(path)


def normal_color(color: Column) -> Column:
    """``#rrggbb`` stays, six bare hexadecimal digits get their #, anything else stays."""
    return F.when(color.rlike("^[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), color)).otherwise(color)


ITEM_CLASS = "array<struct<value:int,code:int,name:string,description:string,`color-hint`:string,color:string>>"
ITEMS_SCHEMA = f"id string, collection string, bbox array<double>, geometry string, properties struct<datetime:string,`eo:cloud_cover`:double,`classification:classes`:{ITEM_CLASS}>, assets map<string,struct<href:string>>"


def classes_of_items(spark: SparkSession, items: DataFrame | None, source: str = "io-lulc") -> DataFrame:
    """The classes that the first item (by id) declares; without items or classes, the built-in table."""
    if items is None:
        return class_table(spark, source)
    first = items.orderBy("id").select(F.col("properties.classification:classes").alias("classes")).limit(1)
    found = first.select(F.posexplode("classes").alias("pos", "c")).orderBy("pos").select(
        F.coalesce("c.value", "c.code").alias("code"),
        F.coalesce("c.description", "c.name").alias("class_name"),
        normal_color(F.coalesce("c.color-hint", "c.color")).alias("color"),
        F.col("c.description").alias("description"),
    )
    return class_table(spark, source) if found.isEmpty() else found
