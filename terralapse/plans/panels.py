"""Rasters made of the driver's tables: a panel of classes by year, and scenes of reflectances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralapse.grid import GridSpec

WIDTH = 50
GRID = GridSpec(0.0, 1_000_000.0, 10.0, 10.0, 100_000, WIDTH)
PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 5, "4-NOT SPECIFIED": 7, "5-LOW": 11}
SCENE_WIDTH = 100
SCENE_GRID = GridSpec(0.0, 1_000_000.0, 10.0, 10.0, 100_000, SCENE_WIDTH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_panel(spark: SparkSession, sf_dir: str, years: list[int] | None = None) -> DataFrame:
    """(layer, layer_ix, row, col, code): a pixel for each customer, a layer for each year, the class of the last order.

    A filter on years reaches the scan as a range of dates.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if years:
        day = F.col("o_orderdate")
        within = F.lit(False)
        for y in years:
            within = within | ((day >= F.lit(f"{y}-01-01").cast("timestamp")) & (day < F.lit(f"{y + 1}-01-01").cast("timestamp")))
        orders = orders.where(within)
    codes = F.create_map(*(F.lit(x) for pair in PRIORITY_CODES.items() for x in pair))
    year = F.year("o_orderdate")
    return orders.groupBy(F.floor(F.col("o_custkey") / WIDTH).cast("int").alias("row"), (F.col("o_custkey") % WIDTH).cast("int").alias("col"), year.alias("y")).agg(
        F.max_by(codes[F.col("o_orderpriority")], "o_orderkey").cast("int").alias("code")
    ).select(F.col("y").cast("string").alias("layer"), (F.col("y") - 1990).cast("int").alias("layer_ix"), "row", "col", "code")


PANEL_SQL = """panel AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS layer, CAST(o_custkey // 50 AS INTEGER) AS "row", CAST(o_custkey % 50 AS INTEGER) AS col,
    max_by(CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 5 WHEN '4-NOT SPECIFIED' THEN 7 WHEN '5-LOW' THEN 11 END AS INTEGER), o_orderkey) AS code
  FROM orders GROUP BY 1, 2, 3)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, scene_date, cloud_cover, row, col, B04, B08, B11, SCL): a pixel of a scene for each line item."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("scene_id"),
        F.to_date("l_shipdate").alias("scene_date"),
        F.col("l_quantity").alias("cloud_cover"),
        F.floor(F.col("l_partkey") / SCENE_WIDTH).cast("int").alias("row"),
        (F.col("l_partkey") % SCENE_WIDTH).cast("int").alias("col"),
        (F.floor(F.col("l_tax") * 100 + 0.5) * 100 + 1200).cast("int").alias("B04"),
        (F.floor(F.col("l_discount") * 100 + 0.5) * 200 + 2500).cast("int").alias("B08"),
        (F.col("l_quantity") * 40 + 1300).cast("int").alias("B11"),
        F.col("l_linenumber").cast("int").alias("SCL"),
    )


SCENES_SQL = """scenes AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS scene_id, CAST(l_shipdate AS DATE) AS scene_date, l_quantity AS cloud_cover,
    CAST(l_partkey // 100 AS INTEGER) AS "row", CAST(l_partkey % 100 AS INTEGER) AS col,
    CAST(floor(l_tax * 100 + 0.5) * 100 + 1200 AS INTEGER) AS B04, CAST(floor(l_discount * 100 + 0.5) * 200 + 2500 AS INTEGER) AS B08,
    CAST(l_quantity * 40 + 1300 AS INTEGER) AS B11, CAST(l_linenumber AS INTEGER) AS SCL
  FROM lineitem)"""
