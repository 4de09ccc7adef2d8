"""Named queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralapse.functions.geometry import RINGS
from terralapse.functions.indices import index_table
from terralapse.grid import GridSpec
from terralapse.mapspec import legend, rgb
from terralapse.operators import attribute as at
from terralapse.operators import blocks as bl
from terralapse.operators.breaks import break_monitor
from terralapse.operators.classify import classify, remap_classes
from terralapse.operators.consensus import consensus, consensus_levels
from terralapse.operators.relate import attribute_features
from terralapse.operators.rings import outline_points
from terralapse.operators.summarize import net_change, summarize
from terralapse.operators.transition import Transition, compared, patch_cells, patches, patches_and_runs, regrouped, runs, transition
from terralapse.operators.trend import trend
from terralapse.plans.panels import GRID, PANEL_SQL, SCENE_GRID, SCENES_SQL, class_panel, scenes
from terralapse.plans.storage import new_path, stored
from terralapse.sources.catalog import search
from terralapse.sources.classes import CLASSES, ITEMS_SCHEMA, class_table, classes_of_items
from terralapse.sources.config import SOURCES
from terralapse.sources.cube import composite, index_stack, month_spine, stac_cube, stac_fetch
from terralapse.sources.scenes import scan_scenes, write_scenes
from terralapse.sources.warp import met, mosaic, resampled
from terralapse.streaming.composites import month_of_days

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def r6(column: str):
    return F.floor(F.col(column) * 1e6 + 0.5) / 1e6


CT = f"ct(code, class_name, color, description) AS ({values(CLASSES['io-lulc'])})"
BASE = f"WITH RECURSIVE {PANEL_SQL}, {CT}"
PCT = "floor(CAST({n} AS DOUBLE) * 10000.0 / {total} + 0.5) / 100.0"

# Classes and areas


@query(f"{BASE} SELECT DISTINCT layer, panel.code AS id, class_name AS label, color FROM panel JOIN ct ON ct.code = panel.code")
def classify_levels(spark, sf):
    return classify(class_panel(spark, sf), class_table(spark)).levels


def summary_sql(panel: str, ct: str) -> str:
    return f"""SELECT layer, p.code AS code, coalesce(class_name, 'Unknown_' || p.code) AS class_name, coalesce(color, '#cccccc') AS color,
      CAST(n AS INTEGER) AS n_cells, n * CAST(0.01 AS DOUBLE) AS area, {PCT.format(n="n", total="sum(n) OVER (PARTITION BY layer)")} AS pct
    FROM (SELECT layer, code, count(*) AS n FROM {panel} WHERE code IS NOT NULL GROUP BY 1, 2) p LEFT JOIN {ct} c ON c.code = p.code"""


@query(f"{BASE} {summary_sql('panel', 'ct')}")
def area_by_class_year(spark, sf):
    return summarize(class_panel(spark, sf), GRID, class_table(spark))


REMAP = {"Vegetation": ["Trees", "Rangeland"], "Used": ["Crops", "Built Area"]}


@query(f"""{BASE},
  moved AS (SELECT layer, CASE code WHEN 11 THEN 2 WHEN 7 THEN 5 ELSE code END AS code FROM panel),
  rt AS (SELECT code, CASE code WHEN 2 THEN 'Vegetation' WHEN 5 THEN 'Used' ELSE class_name END AS class_name, color FROM ct WHERE code NOT IN (7, 11))
  {summary_sql("moved", "rt")}""")
def remap_summary(spark, sf):
    cells, table = remap_classes(class_panel(spark, sf), class_table(spark), REMAP)
    return summarize(cells, GRID, table)


@query(f"""{BASE}, s AS ({summary_sql("panel", "ct")}),
  w AS (SELECT class_name, coalesce(sum(area) FILTER (layer = '1995'), 0) AS "1995", coalesce(sum(area) FILTER (layer = '1997'), 0) AS "1997",
    coalesce(sum(area) FILTER (layer = '2000'), 0) AS "2000" FROM s WHERE layer IN ('1995', '1997', '2000') GROUP BY 1)
  SELECT *, "2000" - "1995" AS change, ("2000" - "1995") * 100.0 / "1995" AS pct_change FROM w""")
def net_change_pivot(spark, sf):
    return net_change(summarize(class_panel(spark, sf, [1995, 1997, 2000]), GRID, class_table(spark)), ["1995", "1997", "2000"])


@query(f"{BASE} SELECT code, class_name, color FROM ct WHERE code IN (SELECT code FROM panel)")
def map_legend(spark, sf):
    return legend(class_panel(spark, sf), class_table(spark))


@query(f"WITH {CT} SELECT code, " + ", ".join(f"CAST(('0x' || substr(color, {i}, 2)) AS INTEGER) AS {c}" for i, c in ((2, "r"), (4, "g"), (6, "b"))) + " FROM ct")
def colormap_rgb(spark, sf):
    return rgb(class_table(spark))


# Consensus

VOTES = f"""{BASE},
  votes AS (SELECT "row", col, code, count(*) AS n, min(layer) AS first FROM panel WHERE layer IN ('1995', '1997', '2000') AND code IS NOT NULL GROUP BY 1, 2, 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY "row", col) AS total FROM votes)
  SELECT "row", col, code"""


@query(f"{VOTES} FROM ranked WHERE k = 1")
def consensus_class(spark, sf):
    return consensus(class_panel(spark, sf, [1995, 1997, 2000]))


@query(f"{VOTES}, CAST(n AS DOUBLE) / total AS confidence FROM ranked WHERE k = 1")
def consensus_confidence(spark, sf):
    return consensus(class_panel(spark, sf, [1995, 1997, 2000]), confidence=True)


# Transitions

FOUND = """found AS (SELECT a."row", a.col, a.code AS f, b.code AS t FROM panel a JOIN panel b ON a."row" = b."row" AND a.col = b.col AND a.layer = '1995' AND b.layer = '2000')"""


def matrix_sql(found: str) -> str:
    return f"""SELECT coalesce(a.class_name, 'NA') AS from_class, coalesce(b.class_name, 'NA') AS to_class, CAST(n AS INTEGER) AS n_cells, n * CAST(0.01 AS DOUBLE) AS area,
      {PCT.format(n="n", total="sum(n) OVER ()")} AS pct
    FROM (SELECT f, t, count(*) AS n FROM {found} GROUP BY 1, 2) g LEFT JOIN ct a ON a.code = f LEFT JOIN ct b ON b.code = t"""


def found(spark, sf, **options) -> Transition:
    return transition(class_panel(spark, sf, [1995, 2000]), GRID, "1995", "2000", class_table(spark), **options)


@query(f"{BASE}, {FOUND} {matrix_sql('found')}")
def transition_matrix(spark, sf):
    return found(spark, sf).summary


@query(f"{BASE}, {FOUND} {matrix_sql('(SELECT * FROM found WHERE f = 2)')}")
def transition_from_trees(spark, sf):
    return found(spark, sf, from_class=["Trees"]).summary


@query(f"{BASE}, {FOUND} {matrix_sql('(SELECT * FROM found WHERE f = 2 AND t IN (5, 8, 11))')}")
def transition_from_to(spark, sf):
    return found(spark, sf, from_class=["Trees"], to_class=["Crops", "Rangeland", "Bare Ground"]).summary


@query(f"{BASE}, {FOUND} {matrix_sql('(SELECT * FROM found WHERE f = 99)')}")
def transition_no_match(spark, sf):
    return found(spark, sf, from_class=["No such class"]).summary


@query(f"""{BASE}, {FOUND} SELECT f * 1000 + t AS id, coalesce(a.class_name, 'NA') || ' -> ' || coalesce(b.class_name, 'NA') AS transition
  FROM (SELECT DISTINCT f, t FROM found) LEFT JOIN ct a ON a.code = f LEFT JOIN ct b ON b.code = t""")
def transition_levels(spark, sf):
    return found(spark, sf).levels


GROUPS = {"Crops": "Agriculture", "Rangeland": "Agriculture"}


@query(f"""{BASE}, {FOUND}, m AS ({matrix_sql("found")})
  SELECT CASE WHEN from_class IN ('Crops', 'Rangeland') THEN 'Agriculture' ELSE from_class END AS from_class,
    CASE WHEN to_class IN ('Crops', 'Rangeland') THEN 'Agriculture' ELSE to_class END AS to_class, CAST(sum(n_cells) AS BIGINT) AS n_cells, CAST(sum(n_cells) AS BIGINT) * CAST(0.01 AS DOUBLE) AS area
  FROM m GROUP BY 1, 2""")
def agri_regroup(spark, sf):
    out = regrouped(found(spark, sf).summary, GROUPS)
    return out.withColumn("area", F.col("n_cells") * F.lit(0.01))


def patch_sql(nodes: str, same: str) -> str:
    """lab(id, label): patches of nodes(id, row, col, v)."""
    return f"""nodes AS ({nodes}),
  e AS (SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND a.id <> b.id {same}),
  reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
  lab AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a)"""


ID = 'CAST("row" AS BIGINT) * 2147483648 + col'
TREES = f"""{BASE}, {FOUND}, own AS (SELECT *, {ID} AS id FROM found WHERE f = 2),
  {patch_sql('SELECT id, "row", col, 0 AS v FROM own WHERE f <> t', "")},
  small AS (SELECT id FROM lab WHERE label IN (SELECT label FROM lab GROUP BY 1 HAVING count(*) * 100.0 < 300))"""


@query(f"{TREES} {matrix_sql('(SELECT * FROM own WHERE id NOT IN (SELECT id FROM small))')}")
def transition_patch_min(spark, sf):
    return found(spark, sf, from_class=["Trees"], patch_area_min=300).summary


@query(f'{TREES} SELECT "row", col, f AS from_code, t AS to_code, f * 1000 + t AS code FROM own WHERE id IN (SELECT id FROM small)')
def transition_removed(spark, sf):
    return found(spark, sf, from_class=["Trees"], patch_area_min=300).removed


@query(f"""{TREES}, a AS ({matrix_sql("own")}), b AS ({matrix_sql("(SELECT * FROM own WHERE id NOT IN (SELECT id FROM small))")})
  SELECT a.from_class, a.to_class, a.n_cells AS n_before, coalesce(b.n_cells, 0) AS n_after, a.n_cells - coalesce(b.n_cells, 0) AS n_removed
  FROM a LEFT JOIN b ON a.from_class = b.from_class AND a.to_class = b.to_class""")
def patch_filter_comparison(spark, sf):
    return compared(found(spark, sf, from_class=["Trees"]).summary, found(spark, sf, from_class=["Trees"], patch_area_min=300).summary)


def patches_sql(where: str, least: int = 0) -> str:
    return f"""{BASE}, {FOUND}, {patch_sql(f'SELECT {ID} AS id, "row", col, f * 1000 + t AS v FROM found WHERE {where}', "AND a.v = b.v")},
  p AS (SELECT label, count(*) AS n, any_value(v) AS v FROM lab JOIN nodes USING (id) GROUP BY 1),
  num AS (SELECT *, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS patch_id FROM p WHERE n * 100.0 >= {least}),
  out AS (SELECT patch_id, coalesce(a.class_name, 'NA') || ' -> ' || coalesce(b.class_name, 'NA') AS transition, n * CAST(0.01 AS DOUBLE) AS area_ha, CAST(n AS INTEGER) AS n_cells
    FROM num LEFT JOIN ct a ON a.code = v // 1000 LEFT JOIN ct b ON b.code = v % 1000),
  cells AS (SELECT patch_id, "row", col FROM num JOIN lab USING (label) JOIN nodes USING (id))"""


@query(patches_sql("true") + " SELECT * FROM out")
def patches_all(spark, sf):
    return patches(found(spark, sf), class_table(spark))


@query(patches_sql("f <> t") + " SELECT * FROM out")
def patches_changes_only(spark, sf):
    return patches(found(spark, sf), class_table(spark), changes_only=True)


@query(patches_sql("true", 200) + " SELECT * FROM out")
def patches_min_area(spark, sf):
    return patches(found(spark, sf), class_table(spark), patch_area_min=200)


@query(patches_sql("true") + " SELECT * FROM out ORDER BY area_ha DESC, patch_id LIMIT 10")
def top10_patches(spark, sf):
    return patches(found(spark, sf), class_table(spark)).orderBy(F.desc("area_ha"), "patch_id").limit(10)


@query(patches_sql("f <> t", 200) + """ SELECT patch_id, "row", min(col) AS col_start, max(col) AS col_end
  FROM (SELECT *, col - row_number() OVER (PARTITION BY patch_id, "row" ORDER BY col) AS k FROM cells) GROUP BY patch_id, "row", k""")
def patch_runs(spark, sf):
    return runs(patch_cells(found(spark, sf), changes_only=True, patch_area_min=200))


# Of the four cells around a vertex, one or three of a patch make a corner, two across make two.
CORNERS = patches_sql("f <> t", 200) + """, v AS (SELECT patch_id, "row" + i AS r, col + j AS c, count(*) AS k, min(2 * i + j) AS a, max(2 * i + j) AS b FROM cells, unnest([0, 1]) x(i), unnest([0, 1]) y(j) GROUP BY 1, 2, 3)
  SELECT patch_id, CAST(sum(CASE WHEN k IN (1, 3) THEN 1 WHEN k = 2 AND (a, b) IN ((0, 3), (1, 2)) THEN 2 ELSE 0 END) AS BIGINT) AS n_corners, any_value(n) * 100.0 AS area
  FROM v JOIN (SELECT patch_id, n_cells AS n FROM out) USING (patch_id) GROUP BY 1"""


@query(CORNERS)
def patch_outlines(spark, sf):
    rings = at.outlines(patch_cells(found(spark, sf), changes_only=True, patch_area_min=200), GRID)
    twice = lambda ring: F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda s, i: s + F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])
    add = lambda values, start: F.aggregate(values, F.lit(start), lambda s, x: s + x)
    return rings.select("patch_id", add(F.transform("geometry", lambda r: F.size(r) - 1), 0).cast("long").alias("n_corners"), F.round(F.abs(add(F.transform("geometry", twice), 0.0)) / 2, 3).alias("area"))


@query(CORNERS)
def patch_outline_points(spark, sf):
    """The same corners and areas, from points in order: no task holds a patch."""
    points = outline_points(patch_cells(found(spark, sf), changes_only=True, patch_area_min=200), GRID, tile=16)
    ahead = points.select("patch_id", "ring", (F.col("ordinal") - 1).alias("ordinal"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    first = points.where("ordinal = 0").select("patch_id", "ring", F.col("x").alias("x0"), F.col("y").alias("y0"))
    twice = (F.col("x") - F.col("x0")) * (F.coalesce("y1", "y0") - F.col("y0")) - (F.coalesce("x1", "x0") - F.col("x0")) * (F.col("y") - F.col("y0"))
    both = points.join(ahead, ["patch_id", "ring", "ordinal"], "left").join(first, ["patch_id", "ring"])
    return both.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_corners"), F.round(F.abs(F.sum(twice)) / 2, 3).alias("area"))


# The same on blocks of 64 x 64 cells


def panel_blocks(spark, sf, years: list[int] | None = None) -> DataFrame:
    return stored(bl.blocks(class_panel(spark, sf, years), 64), "panel-blocks")


@query(f"{BASE} {summary_sql('panel', 'ct')}")
def area_by_class_year_blocks(spark, sf):
    return bl.summarize_blocks(panel_blocks(spark, sf), GRID, class_table(spark))


@query(f"{BASE} SELECT layer, layer_ix, \"row\", col, code FROM (SELECT *, CAST(CAST(layer AS INTEGER) - 1990 AS INTEGER) AS layer_ix FROM panel) WHERE code IS NOT NULL")
def block_cells(spark, sf):
    return bl.cells(panel_blocks(spark, sf))


@query(f"{BASE}, {FOUND} {matrix_sql('found')}")
def transition_matrix_blocks(spark, sf):
    return bl.transition_blocks(panel_blocks(spark, sf, [1995, 2000]), GRID, "1995", "2000", class_table(spark)).summary


@query(f"{BASE}, {FOUND} {matrix_sql('(SELECT * FROM found WHERE f = 2 AND t IN (5, 8, 11))')}")
def transition_from_to_blocks(spark, sf):
    rows = panel_blocks(spark, sf, [1995, 2000])
    return bl.transition_blocks(rows, GRID, "1995", "2000", class_table(spark), from_class=["Trees"], to_class=["Crops", "Rangeland", "Bare Ground"]).summary


@query(patches_sql("f <> t", 200) + " SELECT * FROM out")
def patches_blocks(spark, sf):
    found = bl.transition_blocks(panel_blocks(spark, sf, [1995, 2000]), GRID, "1995", "2000", class_table(spark))
    return bl.patches_of_blocks(found, class_table(spark), changes_only=True, patch_area_min=200)


@query(f'{VOTES}, CAST(n AS DOUBLE) / total AS confidence FROM ranked WHERE k = 1')
def consensus_blocks(spark, sf):
    return bl.consensus_of_blocks(panel_blocks(spark, sf, [1995, 1997, 2000]))


# Overlays: rectangles in cells (key, col0, row0, col1, row1, cause, year), so that SQL can measure them

RECTANGLES = [(1, 0.0, 0.0, 12.5, 9.0, "fire", 2018), (2, 12.5, 0.0, 50.0, 9.0, "harvest", 2022), (3, 5.0, 4.5, 30.25, 20.0, "flood", 2020), (4, 40.0, 25.0, 50.0, 27.0, "pest", 2021)]
RECT = f"rect(key, c0, r0, c1, r1, cause, year) AS ({values(RECTANGLES)})"


def ring(c0: float, r0: float, c1: float, r1: float, grid: GridSpec = GRID) -> list:
    x, y = (lambda c: grid.xmin + c * grid.resx), (lambda r: grid.ymax - r * grid.resy)
    return [[{"x": x(a), "y": y(b)} for a, b in ((c0, r0), (c1, r0), (c1, r1), (c0, r1), (c0, r0))]]


def rectangles(spark) -> DataFrame:
    return spark.createDataFrame([(k, ring(*box), cause, year) for k, *box, cause, year in RECTANGLES], f"overlay_ix long, geometry {RINGS}, cause string, year int")


MET = patches_sql("f <> t") + f""", {RECT},
  met AS (SELECT patch_id, key, cause, year,
      sum(greatest(0, least(col + 1, c1) - greatest(col, c0)) * greatest(0, least("row" + 1, r1) - greatest("row", r0))) * 100.0 AS area
    FROM cells JOIN rect ON col <= c1 AND col + 1 >= c0 AND "row" <= r1 AND "row" + 1 >= r0 GROUP BY ALL)"""


def overlay_inputs(spark, sf):
    return patches_and_runs(found(spark, sf), class_table(spark), changes_only=True)


@query(MET + " SELECT out.*, cause, year FROM out LEFT JOIN met USING (patch_id)")
def attribute_all(spark, sf):
    return at.attribute(*overlay_inputs(spark, sf), rectangles(spark), GRID, ["cause", "year"])


@query(MET + """ SELECT out.*, cause, year FROM out LEFT JOIN (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY area DESC, key) = 1) USING (patch_id)""")
def attribute_largest(spark, sf):
    return at.attribute(*overlay_inputs(spark, sf), rectangles(spark), GRID, ["cause", "year"], match_mode="largest")


@query(MET + " SELECT out.*, cause, year FROM out LEFT JOIN (SELECT * FROM met WHERE year BETWEEN 2018 AND 2020) USING (patch_id)")
def attribute_time(spark, sf):
    return at.attribute(*overlay_inputs(spark, sf), rectangles(spark), GRID, ["cause", "year"], time_col="year", time_interval=(2018, 2020))


@query(MET + " SELECT out.*, cause, year FROM out LEFT JOIN (SELECT met.* FROM met JOIN out USING (patch_id) WHERE area >= n_cells * 100.0 - 1e-6) USING (patch_id)")
def attribute_within(spark, sf):
    return at.attribute(*overlay_inputs(spark, sf), rectangles(spark), GRID, ["cause", "year"], predicate="within")


@query(MET + " SELECT out.*, cause, floor(area * 1e-4 * 1e6 + 0.5) / 1e6 AS zone_area_ha FROM out JOIN met USING (patch_id) WHERE area > 0")
def zone_patches(spark, sf):
    out = at.zones(*overlay_inputs(spark, sf), rectangles(spark), GRID, "cause")
    return out.withColumn("zone_area_ha", F.floor(F.col("zone_area_ha") * 1e6 + 0.5) / 1e6)


# Rectangles whose sides pass through cells, so that a last digit of the projection changes no result.
INNER = [(1, 0.31, 0.21, 12.61, 9.33, "fire", 2018), (2, 12.81, 0.27, 49.73, 9.41, "harvest", 2022), (3, 5.13, 4.57, 30.29, 20.19, "flood", 2020)]
MET_INNER = MET.replace(RECT, f"rect(key, c0, r0, c1, r1, cause, year) AS ({values(INNER)})")


def lonlat_rectangles(spark) -> DataFrame:
    own = spark.createDataFrame([(k, ring(*b), cause, year) for k, *b, cause, year in INNER], f"overlay_ix long, geometry {RINGS}, cause string, year int")
    return at.in_crs(own, GRID.crs, "EPSG:4326")


@query(MET_INNER + " SELECT out.*, cause, year FROM out LEFT JOIN met USING (patch_id)")
def attribute_other_crs(spark, sf):
    return at.attribute(*overlay_inputs(spark, sf), lonlat_rectangles(spark), GRID, ["cause", "year"], overlay_crs="EPSG:4326")


@query(MET_INNER + " SELECT out.*, cause FROM out LEFT JOIN (SELECT met.* FROM met JOIN out USING (patch_id) WHERE area >= 0.5 * n_cells * 100.0 AND area < 1000) USING (patch_id)")
def attribute_own_predicate(spark, sf):
    mostly = lambda area, patch, overlay: (area >= 0.5 * patch) & (area < 1000)
    return at.attribute(*overlay_inputs(spark, sf), lonlat_rectangles(spark), GRID, ["cause"], predicate=mostly, overlay_crs="EPSG:4326")


@query(MET + """, own AS (SELECT patch_id, cause, "row", col FROM cells JOIN rect ON col + 0.5 >= c0 AND col + 0.5 < c1 AND "row" + 0.5 > r0 AND "row" + 0.5 <= r1)
  SELECT patch_id, cause, "row", min(col) AS col_start, max(col) AS col_end
  FROM (SELECT *, col - row_number() OVER (PARTITION BY patch_id, cause, "row" ORDER BY col) AS k FROM own) GROUP BY patch_id, cause, "row", k""")
def zone_patch_runs(spark, sf):
    return at.zone_runs(overlay_inputs(spark, sf)[1], rectangles(spark), GRID, "cause")


@query(f"""{BASE}, {RECT} SELECT layer, "row", col, code FROM panel WHERE layer IN ('1995', '2000')
  AND EXISTS (SELECT 1 FROM rect WHERE key <> 2 AND col + 0.5 >= c0 AND col + 0.5 < c1 AND "row" + 0.5 > r0 AND "row" + 0.5 <= r1)""")
def clip_aoi(spark, sf):
    return at.clip(class_panel(spark, sf, [1995, 2000]), rectangles(spark).where("overlay_ix <> 2"), GRID).drop("layer_ix")


# Overlays made of a table, a rectangle (or a bow-tie in it) for each supplier, so that their number and reach grow with it

SUPPLIED = """rect AS (SELECT s_suppkey AS key, CAST(s_suppkey * 7 % 45 AS DOUBLE) + 0.31 AS c0, s_suppkey * CAST(0.3 AS DOUBLE) + 0.013 AS r0,
    CAST(s_suppkey * 7 % 45 AS DOUBLE) + 0.31 + (3 + s_suppkey % 4) AS c1, s_suppkey * CAST(0.3 AS DOUBLE) + (1 + s_suppkey % 3) + 0.613 AS r1,
    'cause ' || s_suppkey % 5 AS cause, CAST(2015 + s_suppkey % 8 AS INTEGER) AS year FROM supplier)"""
MET_SUPPLIED = MET.replace(RECT, SUPPLIED)


def supplier_shapes(spark, sf, corners=((0, 0), (1, 0), (1, 1), (0, 1))) -> DataFrame:
    """A ring for each supplier through corners (column side, row side) of its rectangle."""
    k = F.col("s_suppkey")
    columns = [(k * 7 % 45).cast("double") + 0.31, (k * 7 % 45).cast("double") + 0.31 + (3 + k % 4)]
    rows = [k * F.lit(0.3) + 0.013, k * F.lit(0.3) + (1 + k % 3) + 0.613]
    point = lambda c, r: F.struct((F.lit(GRID.xmin) + columns[c] * GRID.resx).alias("x"), (F.lit(GRID.ymax) - rows[r] * GRID.resy).alias("y"))
    ring_ = F.array(F.array(*(point(c, r) for c, r in (*corners, corners[0]))))
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet")
    return suppliers.select(k.alias("overlay_ix"), ring_.cast(RINGS).alias("geometry"), F.concat(F.lit("cause "), (k % 5).cast("string")).alias("cause"), (2015 + k % 8).cast("int").alias("year"))


@query(MET_SUPPLIED + " SELECT out.*, cause, year FROM out LEFT JOIN met USING (patch_id)")
def attribute_suppliers(spark, sf):
    return at.attribute(*overlay_inputs(spark, sf), supplier_shapes(spark, sf), GRID, ["cause", "year"])


@query(MET_SUPPLIED + " SELECT out.*, cause, year FROM out LEFT JOIN (SELECT met.* FROM met JOIN out USING (patch_id) WHERE area >= n_cells * 100.0 - 1e-6) USING (patch_id)")
def attribute_suppliers_within(spark, sf):
    return at.attribute(*overlay_inputs(spark, sf), supplier_shapes(spark, sf), GRID, ["cause", "year"], predicate="within")


ZONE_AREA = "floor(area * 1e-4 * 1e6 + 0.5) / 1e6 AS zone_area_ha"


@query(MET_SUPPLIED + f" SELECT out.*, cause, {ZONE_AREA} FROM out JOIN met USING (patch_id) WHERE area > 1e-6")
def zone_suppliers(spark, sf):
    return at.zones(*overlay_inputs(spark, sf), supplier_shapes(spark, sf), GRID, "cause").withColumn("zone_area_ha", r6("zone_area_ha"))


@query(MET_SUPPLIED + f" SELECT patch_id, cause, {ZONE_AREA} FROM met WHERE area > 1e-6")
def zone_geometry(spark, sf):
    """The area of what is left of each patch inside each zone, by its own corners."""
    cells = patch_cells(found(spark, sf), changes_only=True)
    out = at.zone_shapes(at.outlines(cells, GRID), runs(cells), supplier_shapes(spark, sf), GRID, "cause")
    return out.select("patch_id", "cause", F.floor(shape_area("geometry") * 1e-4 * 1e6 + 0.5).alias("zone_area_ha")).withColumn("zone_area_ha", F.col("zone_area_ha") / 1e6)


@query(MET_SUPPLIED + f" SELECT patch_id, cause, floor(area * 1e-4 * 1000.0 + 0.5) / 1000.0 AS zone_area_ha FROM met WHERE area > 100")
def zone_albers(spark, sf):
    """Zones whose corners come in an equal-area projection."""
    zones = at.in_crs(supplier_shapes(spark, sf), GRID.crs, "EPSG:3005")
    out = at.zones(*overlay_inputs(spark, sf), zones, GRID, "cause", zone_crs="EPSG:3005").where("zone_area_ha > 0.01")
    return out.select("patch_id", "cause", (F.floor(F.col("zone_area_ha") * 1e3 + 0.5) / 1e3).alias("zone_area_ha"))


def shape_area(column: str):
    """Of rings whose holes go the other way."""
    twice = lambda ring: F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda s, i: s + (F.get(ring, i)["x"] - F.get(ring, F.lit(0))["x"]) * (F.get(ring, i + 1)["y"] - F.get(ring, F.lit(0))["y"]) - (F.get(ring, i + 1)["x"] - F.get(ring, F.lit(0))["x"]) * (F.get(ring, i)["y"] - F.get(ring, F.lit(0))["y"]))
    return F.abs(F.aggregate(F.transform(column, twice), F.lit(0.0), lambda s, x: s + x)) / 2


@query(f"""{BASE}, {SUPPLIED} SELECT layer, "row", col, code FROM panel WHERE layer IN ('1995', '2000')
  AND EXISTS (SELECT 1 FROM rect WHERE col + 0.5 >= c0 AND col + 0.5 < c1 AND "row" + 0.5 > r0 AND "row" + 0.5 <= r1)""")
def clip_suppliers(spark, sf):
    return at.clip(class_panel(spark, sf, [1995, 2000]), supplier_shapes(spark, sf), GRID).drop("layer_ix")


# Overlays of points and lines, made of tables: quarters and halves of cells, so that many lie on sides and corners

ITEM_SQL = """,
  met AS (SELECT patch_id, key, item, any_value(kind) AS kind, any_value(len) AS len, count(*) = any_value((CASE WHEN c = floor(c) THEN 2 ELSE 1 END) * (CASE WHEN r = floor(r) THEN 2 ELSE 1 END)) AS inner_
    FROM items JOIN cells ON col <= c AND col + 1 >= c AND "row" <= r AND "row" + 1 >= r GROUP BY 1, 2, 3),
  totals AS (SELECT key, count(*) FILTER (kind = 0) AS pieces, count(*) FILTER (kind = 2) AS ends, count(*) FILTER (kind = 3) AS points FROM items GROUP BY 1),
  said AS (SELECT patch_id, key, sum(len) AS length, count(*) FILTER (kind = 3) AS n_points,
      CASE WHEN bool_or(kind = 0 AND inner_) THEN '1' WHEN bool_or(kind = 3 AND inner_) THEN '0' ELSE 'F' END || CASE WHEN bool_or(kind = 2 AND inner_) THEN '0' ELSE 'F' END || '2'
      || CASE WHEN bool_or(kind = 0 AND NOT inner_) THEN '1' WHEN bool_or(kind IN (1, 3) AND NOT inner_) THEN '0' ELSE 'F' END || CASE WHEN bool_or(kind = 2 AND NOT inner_) THEN '0' ELSE 'F' END || '1'
      || CASE WHEN count(*) FILTER (kind = 0) < any_value(pieces) THEN '1' WHEN count(*) FILTER (kind = 3) < any_value(points) THEN '0' ELSE 'F' END || CASE WHEN count(*) FILTER (kind = 2) < any_value(ends) THEN '0' ELSE 'F' END || '2' AS relation
    FROM met JOIN totals USING (key) GROUP BY 1, 2)"""
# A point for each order, beside its customer's cell.
POINT_SQL = """, items AS (SELECT o_orderkey AS key, 0 AS item, 3 AS kind, CAST(0 AS DOUBLE) AS len, CAST(o_custkey % 50 AS DOUBLE) + o_orderkey % 4 * CAST(0.25 AS DOUBLE) AS c, CAST(o_custkey // 50 AS DOUBLE) + o_orderkey % 3 * CAST(0.5 AS DOUBLE) AS r FROM orders)"""
# A line for each supplier: two legs of n cells, in directions of its own, from a multiple of half a cell.
LINE_SQL = """,
  legs AS (SELECT s_suppkey AS key, CAST(s_suppkey * 7 % 45 AS DOUBLE) + s_suppkey % 2 * CAST(0.5 AS DOUBLE) AS c, CAST(s_suppkey // 4 AS DOUBLE) + s_suppkey // 2 % 2 * CAST(0.5 AS DOUBLE) AS r, s_suppkey % 4 + 2 AS n, CASE s_suppkey % 3 WHEN 0 THEN 1 ELSE 0 END AS dr FROM supplier),
  halves AS (SELECT key, 2 * n AS m, unnest(range(4 * n + 1)) AS i, c, r, dr FROM legs),
  items AS (SELECT key, i * 2 AS item, CASE WHEN i IN (0, 2 * m) THEN 2 ELSE 1 END AS kind, CAST(0 AS DOUBLE) AS len, c + least(i, m) * CAST(0.5 AS DOUBLE) AS c, r + (dr * least(i, m) + greatest(i - m, 0)) * CAST(0.5 AS DOUBLE) AS r FROM halves
    UNION ALL SELECT key, i * 2 + 1, 0, CASE WHEN i < m AND dr = 1 THEN sqrt(CAST(50 AS DOUBLE)) ELSE 5 END, c + least(i + 0.5, m) * CAST(0.5 AS DOUBLE), r + (dr * least(i + 0.5, m) + greatest(i + 0.5 - m, 0)) * CAST(0.5 AS DOUBLE) FROM halves WHERE i < 2 * m)"""
MET_POINTS = patches_sql("f <> t") + POINT_SQL + ITEM_SQL
MET_LINES = patches_sql("f <> t") + LINE_SQL + ITEM_SQL
MEASURED = "floor(length * 1000000.0 + 0.5) / 1000000.0 AS measure"


def place(c, r):
    """A point at a column and a row of the panel, in cells."""
    return F.struct((F.lit(GRID.xmin) + c * GRID.resx).alias("x"), (F.lit(GRID.ymax) - r * GRID.resy).alias("y"))


def order_points(spark, sf) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(k.alias("overlay_ix"), k.alias("orderkey"), F.array(place((c % 50) + k % 4 * 0.25, F.floor(c / 50) + k % 3 * 0.5)).alias("geometry"))


def supplier_lines(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    c, r, n, down = (k * 7 % 45) + k % 2 * 0.5, F.floor(k / 4) + F.floor(k / 2) % 2 * 0.5, k % 4 + 2, F.when(k % 3 == 0, 1).otherwise(0)
    line = F.array(place(c, r), place(c + n, r + down * n), place(c + n, r + down * n + n))
    return spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("overlay_ix"), k.alias("suppkey"), F.array(line).alias("geometry"))


@query(MET_POINTS + " SELECT out.*, key AS orderkey, relation, CAST(n_points AS DOUBLE) AS measure FROM out LEFT JOIN said USING (patch_id)")
def attribute_points(spark, sf):
    return attribute_features(*overlay_inputs(spark, sf), order_points(spark, sf), GRID, ["orderkey"], kind="points", with_relation=True)


@query(MET_POINTS + " SELECT out.*, key AS orderkey FROM out LEFT JOIN (SELECT * FROM said WHERE relation LIKE '0%') USING (patch_id)")
def attribute_points_inside(spark, sf):
    """Points on a patch's boundary aren't contained."""
    return attribute_features(*overlay_inputs(spark, sf), order_points(spark, sf), GRID, ["orderkey"], kind="points", predicate="contains")


@query(MET_LINES + f" SELECT out.*, key AS suppkey, relation, {MEASURED} FROM out LEFT JOIN said USING (patch_id)")
def attribute_lines(spark, sf):
    return attribute_features(*overlay_inputs(spark, sf), supplier_lines(spark, sf), GRID, ["suppkey"], kind="lines", with_relation=True).withColumn("measure", r6("measure"))


@query(MET_LINES + " SELECT out.*, key AS suppkey FROM out LEFT JOIN (SELECT * FROM said WHERE relation[1] <> 'F' AND relation[7] <> 'F') USING (patch_id)")
def attribute_crosses(spark, sf):
    return attribute_features(*overlay_inputs(spark, sf), supplier_lines(spark, sf), GRID, ["suppkey"], kind="lines", predicate="crosses")


@query(MET_LINES + " SELECT out.*, key AS suppkey FROM out LEFT JOIN (SELECT * FROM said WHERE relation[1] = 'F' AND relation[2] = 'F') USING (patch_id)")
def attribute_touches(spark, sf):
    return attribute_features(*overlay_inputs(spark, sf), supplier_lines(spark, sf), GRID, ["suppkey"], kind="lines", predicate="touches")


@query(MET_LINES + f" SELECT out.*, key AS suppkey, {MEASURED} FROM out LEFT JOIN (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY floor(length * 1000.0 + 0.5) DESC, key) = 1) USING (patch_id)")
def attribute_lines_longest(spark, sf):
    found = attribute_features(*overlay_inputs(spark, sf), supplier_lines(spark, sf), GRID, ["suppkey"], kind="lines", match_mode="largest", with_relation=True)
    return found.drop("relation").withColumn("measure", r6("measure"))


@query(f"WITH {SUPPLIED} SELECT key, 2 AS n_rings, 6 AS n_corners, floor((c1 - c0) * (r1 - r0) * 100.0 / 2 + 0.5) AS area FROM rect")
def valid_bowties(spark, sf):
    """Rings that cross themselves in the middle come back as two that don't."""
    shapes = at.make_valid(supplier_shapes(spark, sf, ((0, 0), (1, 1), (1, 0), (0, 1))))
    corners = F.aggregate("geometry", F.lit(0), lambda s, ring: s + F.size(ring) - 1)
    return shapes.select(F.col("overlay_ix").alias("key"), F.size("geometry").alias("n_rings"), corners.alias("n_corners"), F.floor(shape_area("geometry") + 0.5).alias("area"))


@query(f"""WITH {RECT}, box AS (SELECT min(c0) * 10.0 AS x0, 1000000.0 - max(r1) * 10.0 AS y0, max(c1) * 10.0 AS x1, 1000000.0 - min(r0) * 10.0 AS y1 FROM rect WHERE key IN (1, 4)),
  t AS (SELECT x0 + tx * 70.0 AS xmin, y0 + ty * 70.0 AS ymin, x0 + (tx + 1) * 70.0 AS xmax, y0 + (ty + 1) * 70.0 AS ymax, tx, ty, CAST(ceil((x1 - x0) / 70.0) AS INTEGER) AS nx
    FROM box, unnest(range(CAST(ceil((x1 - x0) / 70.0) AS INTEGER))) a(tx), unnest(range(CAST(ceil((y1 - y0) / 70.0) AS INTEGER))) b(ty))
  SELECT CAST(ty * nx + tx AS INTEGER) AS tile, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM t
  WHERE EXISTS (SELECT 1 FROM rect WHERE key IN (1, 4) AND c0 * 10.0 <= xmax AND c1 * 10.0 >= xmin AND 1000000.0 - r1 * 10.0 <= ymax AND 1000000.0 - r0 * 10.0 >= ymin)""")
def tile_grid(spark, sf):
    return at.tile_grid(rectangles(spark).where("overlay_ix in (1, 4)"), 70.0)


# Index stacks

MASKED = "SCL NOT IN (3, 8, 9, 10, 11)"
SCENES = f"WITH {SCENES_SQL}"
R6 = "floor({x} * 1000000.0 + 0.5) / 1000000.0"


def stack_sql(index: str) -> str:
    o = "CASE WHEN pre THEN 0.0 ELSE -0.1 END"
    band = lambda b: f"(CAST({b} AS DOUBLE) * 1e-4 + {o})"
    other = "B11" if index == "ndmi" else "B04"
    ratio = f"({band('B08')} - {band(other)}) / nullif({band('B08')} + {band(other)}, 0)"
    y = f"tanh(pow({ratio}, 2.0))" if index == "kndvi" else ratio
    return f"""{SCENES},
    c AS (SELECT "row", col, CAST(date_trunc('month', scene_date) AS DATE) AS t, scene_date < DATE '2022-01-25' AS pre, median(B04) AS B04, median(B08) AS B08, median(B11) AS B11
      FROM scenes WHERE {MASKED} AND cloud_cover <= 40 GROUP BY 1, 2, 3, 4),
    stack AS (SELECT "row", col, t, coalesce(max(y) FILTER (pre), max(y) FILTER (NOT pre)) AS y FROM (SELECT *, {y} AS y FROM c) GROUP BY 1, 2, 3)"""


def clear(spark, sf) -> DataFrame:
    return scenes(spark, sf).where("cloud_cover <= 40")


def _index(name: str):
    def run(spark, sf):
        return index_stack(clear(spark, sf), name, spine=False).withColumn("y", r6("y"))

    run.__name__ = f"index_{name}_monthly"
    query(f'{stack_sql(name)} SELECT "row", col, t, {R6.format(x="y")} AS y FROM stack')(run)


for _name in ("ndvi", "kndvi", "ndmi"):
    _index(_name)


@query(f"""{SCENES} SELECT "row", col, CAST(date_trunc('quarter', scene_date) AS DATE) AS t, median(B04) AS B04, median(B08) AS B08 FROM scenes WHERE {MASKED} GROUP BY 1, 2, 3""")
def masked_composite(spark, sf):
    masked = list(SOURCES["sentinel-2-l2a"].mask_values)
    return composite(scenes(spark, sf).where(~F.col("SCL").isin(masked)), ["B04", "B08"], "P3M", "median")


@query(f"""{SCENES} SELECT "row", col, CAST(date_trunc('year', scene_date) AS DATE) AS t, arg_min(B11, (scene_date, scene_id)) AS B11 FROM scenes GROUP BY 1, 2, 3""")
def first_composite(spark, sf):
    return composite(scenes(spark, sf), ["B11"], "P1Y", "first")


# A boundary that pixels lie on both sides of, often in one month.
SPLIT = stack_sql("ndvi").replace("2022-01-25", "1998-06-25").replace("median(", "max(")


@query(f'{SPLIT} SELECT "row", col, t, {R6.format(x="y")} AS y FROM stack')
def offset_split_cover(spark, sf):
    return index_stack(clear(spark, sf), "ndvi", aggregation="max", boundary="1998-06-25", spine=False).withColumn("y", r6("y"))


@query(f"""{stack_sql("ndvi")},
  m AS (SELECT unnest(generate_series((SELECT min(t) FROM stack), (SELECT max(t) FROM stack), INTERVAL 1 MONTH))::DATE AS t)
  SELECT "row", col, count(*) AS n_months, count(y) AS n_known FROM (SELECT DISTINCT "row", col FROM stack) CROSS JOIN m LEFT JOIN stack USING ("row", col, t) GROUP BY 1, 2""")
def month_spine_counts(spark, sf):
    return month_spine(index_stack(clear(spark, sf), "ndvi", spine=False)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n_months"), F.count("y").alias("n_known"))


# The stack is rounded on both sides first, so that signs and ties can't differ by a last digit.
PAIRS = f"""{stack_sql("ndvi")},
  obs AS (SELECT "row", col, (t - DATE '1970-01-01') / CAST(365.25 AS DOUBLE) AS x, {R6.format(x="y")} AS y FROM stack WHERE y IS NOT NULL),
  pairs AS (SELECT a."row", a.col, (b.y - a.y) / (b.x - a.x) AS slope, sign(b.y - a.y) AS s FROM obs a JOIN obs b ON a."row" = b."row" AND a.col = b.col AND a.x < b.x),
  k AS (SELECT "row", col, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) >= 6),
  sen AS (SELECT "row", col, any_value(n) AS n, median(slope) AS slope, CAST(sum(s) AS INTEGER) AS s FROM pairs JOIN k USING ("row", col) GROUP BY 1, 2),
  z AS (SELECT *, CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END / sqrt(CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) / 18) AS z FROM sen)"""


def ndvi_trend(spark, sf) -> DataFrame:
    return trend(index_stack(clear(spark, sf), "ndvi", spine=False).withColumn("y", r6("y")))


@query(f'{PAIRS} SELECT "row", col, CAST(n AS INTEGER) AS n, {R6.format(x="slope")} AS trend, s, {R6.format(x="z")} AS z FROM z')
def trend_slope(spark, sf):
    return ndvi_trend(spark, sf).where("trend is not null").select("row", "col", "n", r6("trend").alias("trend"), F.col("s").cast("int").alias("s"), r6("z").alias("z"))


@query(f'{PAIRS} SELECT "row", col, slope > 0 AS rising FROM z WHERE abs(z) > 1.959963984540054')
def trend_significant(spark, sf):
    return ndvi_trend(spark, sf).where("trend_p < 0.05").select("row", "col", (F.col("trend") > 0).alias("rising"))


def least_squares_sql(name: str, source: str, columns: list[str], part: str) -> str:
    """``name``: the rows of ``source`` with residuals r of y, fitted to an intercept and columns on rows that are ``past``, by orthogonal columns one after another; and lev, what a row's forecast adds to its spread."""
    rest = [*columns, "y"]
    steps = [f"{name}0 AS (SELECT *, {', '.join(f'{c} - avg({c}) FILTER (past) OVER p AS {c}_0' for c in rest)}, 1 / CAST(count(*) FILTER (past) OVER p AS DOUBLE) AS lev_0 FROM {source} WINDOW p AS (PARTITION BY {part}))"]
    for i, q in enumerate(columns):
        rest, norm = rest[1:], f"nullif(sum({q}_{i} * {q}_{i}) FILTER (past) OVER p, 0)"
        new = [f"{c}_{i} - {q}_{i} * sum({c}_{i} * {q}_{i}) FILTER (past) OVER p / {norm} AS {c}_{i + 1}" for c in rest]
        steps.append(f"{name}{i + 1} AS (SELECT *, {', '.join(new)}, lev_{i} + {q}_{i} * {q}_{i} / {norm} AS lev_{i + 1}, {norm} AS norm_{i} FROM {name}{i} WINDOW p AS (PARTITION BY {part}))")
    n = len(columns)
    return ", ".join(steps) + f""",
  {name} AS (SELECT *, y_{n} AS r, lev_{n} AS lev, least({', '.join(f'norm_{i}' for i in range(n))}) AS norm FROM {name}{n})"""


# Observations in time order with a trend (c1) and harmonics, the history being ``past``.
HARMONICS = ", ".join(f"{f}(2 * pi() * {h} * (t0 + i / CAST(12 AS DOUBLE))) AS c{2 * h + d}" for h in (1, 2, 3) for d, f in enumerate(("cos", "sin")))
OBS_SQL = f"""{stack_sql("ndvi")},
  months AS (SELECT CAST(unnest(generate_series((SELECT min(t) FROM stack), (SELECT max(t) FROM stack), INTERVAL 1 MONTH)) AS DATE) AS t),
  axis AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, year((SELECT min(t) FROM stack)) + (month((SELECT min(t) FROM stack)) - 1) / CAST(12 AS DOUBLE) AS t0 FROM months),
  every AS (SELECT "row", col, t0 + i / CAST(12 AS DOUBLE) AS x, CAST(i + 1 AS DOUBLE) AS c1, {HARMONICS}, {R6.format(x="y")} AS y,
    row_number() OVER (PARTITION BY "row", col ORDER BY t) AS k, t0 + i / CAST(12 AS DOUBLE) < 1999 - 1e-9 AS past FROM stack JOIN axis USING (t) WHERE y IS NOT NULL)"""


R4 = "floor({x} * 10000.0 + 0.5) / 10000.0"


def break_sql(order: int, first: str = ", obs AS (SELECT * FROM every)", size: str = R6) -> str:
    """Least squares on the history, then moving sums over a quarter of it; ``first`` makes obs of what history is used."""
    terms = 2 * order + 2
    return f"""{OBS_SQL}{first},
  sizes AS (SELECT "row", col, count(*) AS m, count(*) FILTER (past) AS n, CAST(floor(0.25 * count(*) FILTER (past)) AS INTEGER) AS w FROM obs GROUP BY 1, 2),
  fit AS (SELECT * FROM obs JOIN sizes USING ("row", col) JOIN (SELECT "row", col FROM every GROUP BY ALL HAVING count(*) >= 6) USING ("row", col) WHERE n > {terms} AND w > 1 AND n < m),
  {least_squares_sql("g", "fit", [f"c{i}" for i in range(1, terms)], '"row", col')},
  sums AS (SELECT *, sqrt(sum(r * r) FILTER (past) OVER p / (n - {terms})) AS sigma, sum(r) OVER (PARTITION BY "row", col ORDER BY k) AS total FROM g WHERE norm > 1e-7 WINDOW p AS (PARTITION BY "row", col)),
  moved AS (SELECT a.*, a.total - b.total AS moving FROM sums a JOIN sums b ON a."row" = b."row" AND a.col = b.col AND b.k = a.k - a.w),
  hit AS (SELECT "row", col, min(x) AS break_date FROM moved WHERE NOT past AND abs(moving) / (sigma * sqrt(CAST(n AS DOUBLE))) > 1.51 * sqrt(2 * CASE WHEN k / CAST(n AS DOUBLE) > exp(1) THEN ln(k / CAST(n AS DOUBLE)) ELSE 1 END) GROUP BY 1, 2),
  size AS (SELECT "row", col, median(r) FILTER (NOT past) AS break_mag FROM sums GROUP BY 1, 2)
  SELECT "row", col, {R6.format(x="break_date")} AS break_date, {size.format(x="break_mag")} AS break_mag FROM (SELECT DISTINCT "row", col FROM stack) LEFT JOIN hit USING ("row", col) LEFT JOIN size USING ("row", col)"""


# Reverse CUSUM: each observation of the history against a fit to all later ones that determine it; obs begins after the first crossing.
STABLE_SQL = f""", turned AS (SELECT *, count(*) OVER (PARTITION BY "row", col) - k + 1 AS j FROM every WHERE past),
  prefixes AS (SELECT a."row", a.col, a.j AS i, a.k AS own, b.* EXCLUDE ("row", col, past), b.j < a.j AS past FROM turned a JOIN turned b ON a."row" = b."row" AND a.col = b.col AND b.j <= a.j WHERE a.j > 4),
  {least_squares_sql("s", "prefixes", ["c1", "c2", "c3"], '"row", col, i')},
  w AS (SELECT "row", col, i, own, r / sqrt(1 + lev) AS w FROM s WHERE j = i AND norm > 1e-7),
  path AS (SELECT *, abs(sum(w) OVER (PARTITION BY "row", col ORDER BY i)) AS total, row_number() OVER (PARTITION BY "row", col ORDER BY i) AS step, count(*) OVER p AS many, stddev_samp(w) OVER p AS scale FROM w WINDOW p AS (PARTITION BY "row", col)),
  since AS (SELECT "row", col, max(own) AS own FROM path WHERE scale > 1e-12 AND total / (scale * sqrt(CAST(many AS DOUBLE))) > 0.948 * (1 + 2 * CAST(step AS DOUBLE) / many) GROUP BY 1, 2),
  obs AS (SELECT every.* EXCLUDE (k), k - coalesce(own, 0) AS k FROM every LEFT JOIN since USING ("row", col) WHERE k > coalesce(own, 0))"""


@query(break_sql(1))
def break_dates(spark, sf):
    stack = index_stack(clear(spark, sf), "ndvi").withColumn("y", r6("y"))
    return break_monitor(stack, start=(1999, 1), order=1).withColumns({c: r6(c) for c in ("break_date", "break_mag")})


@query(break_sql(1, STABLE_SQL))
def break_dates_stable_history(spark, sf):
    stack = index_stack(clear(spark, sf), "ndvi").withColumn("y", r6("y"))
    return break_monitor(stack, start=(1999, 1), order=1, history="ROC").withColumns({c: r6(c) for c in ("break_date", "break_mag")})


@query(break_sql(3, size=R4))
def break_dates_order_3(spark, sf):
    stack = index_stack(clear(spark, sf), "ndvi").withColumn("y", r6("y"))
    return break_monitor(stack, start=(1999, 1), order=3).withColumns({"break_date": r6("break_date"), "break_mag": F.floor(F.col("break_mag") * 1e4 + 0.5) / 1e4})


@query(f"""{SCENES}, d AS (SELECT "row", col, scene_date, CAST(date_trunc('month', scene_date) AS DATE) AS t, CAST(sum(B08) AS BIGINT) AS total, count(*) AS n FROM scenes WHERE {MASKED} GROUP BY 1, 2, 3)
  SELECT "row", col, t, CAST(sum(total) AS BIGINT) / CAST(sum(n) AS DOUBLE) AS mean, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1, 2, 3""")
def monthly_means(spark, sf):
    masked = list(SOURCES["sentinel-2-l2a"].mask_values)
    days = scenes(spark, sf).where(~F.col("SCL").isin(masked)).groupBy("row", "col", "scene_date").agg(F.sum("B08").alias("total"), F.count(F.lit(1)).alias("n"))
    return month_of_days(days.withColumn("t", F.trunc("scene_date", "month")))


# Resampling of the class panel to other grids, as far down as the panel goes.

COARSE = GridSpec(0.0, 1_000_000.0, 25.0, 25.0, 40_000, 20)
SHIFTED = GridSpec(3.0, 999_996.0, 10.0, 10.0, 100_000, 49)


@query(f"""{BASE}, g AS (SELECT r, c, CAST(floor((r + 0.5) * 25.0 / 10.0) AS INTEGER) AS "row", CAST(floor((c + 0.5) * 25.0 / 10.0) AS INTEGER) AS col FROM (SELECT unnest(range(CAST(ceil((max("row") + 1) * 0.4 - 0.5) AS BIGINT))) AS r FROM panel WHERE layer = '2000') a, unnest(range(20)) b(c))
  SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, code FROM g JOIN panel USING ("row", col) WHERE layer = '2000'""")
def resample_near(spark, sf):
    panel = class_panel(spark, sf, [2000])
    return resampled(panel, GRID, met(panel, GRID, COARSE), "code")


@query(f"""{BASE}, g AS (SELECT r, c, 4.0 / 10 + r AS fy, 3.0 / 10 + c AS fx FROM (SELECT unnest(range(max("row") + 1)) AS r FROM panel WHERE layer = '2000') a, unnest(range(49)) b(c)),
  k AS (SELECT r, c, r + i AS "row", c + j AS col, CAST(CASE i WHEN 1 THEN 0.4 ELSE 0.6 END * CASE j WHEN 1 THEN 0.3 ELSE 0.7 END AS DOUBLE) AS w FROM g, unnest([0, 1]) a(i), unnest([0, 1]) b(j))
  SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, {R6.format(x="(sum(code * w) / sum(w))")} AS code FROM k JOIN panel USING ("row", col) WHERE layer = '2000' AND code IS NOT NULL GROUP BY 1, 2""")
def resample_bilinear(spark, sf):
    panel = class_panel(spark, sf, [2000])
    return resampled(panel, GRID, met(panel, GRID, SHIFTED), "code", "bilinear").withColumn("code", r6("code"))


# Catalog


def item_table(spark, sf) -> DataFrame:
    """An item for each order: its day, and a box and a cloud cover made of its numbers."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    x, y = (F.col("o_custkey") % 100).cast("double"), (F.col("o_orderkey") % 50).cast("double")
    json = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.array(x, y, x + 2, y + 2).alias("bbox"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'10:00:00'Z'").alias("datetime"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 101).cast("double")).alias("eo:cloud_cover")).alias("properties"),
    ))
    return orders.select(F.from_json(json, ITEMS_SCHEMA).alias("i")).select("i.*")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS item_date FROM orders
  WHERE o_custkey % 100 <= 30 AND o_custkey % 100 + 2 >= 20 AND o_orderkey % 50 <= 25 AND o_orderkey % 50 + 2 >= 10
    AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND month(o_orderdate) IN (6, 7, 8, 9) AND o_orderkey % 7 <> 0 AND o_orderkey % 101 <= 60""")
def catalog_search(spark, sf):
    items = item_table(spark, sf)
    return search(items, bbox=(20, 10, 30, 25), start="1996-01-01", end="1999-12-31", cloud_cover_max=60, months=[6, 7, 8, 9]).select("id", "item_date")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS item_date FROM orders
  WHERE o_custkey % 100 <= 30 AND o_custkey % 100 + 2 >= 20 AND o_orderkey % 50 <= 25 AND o_orderkey % 50 + 2 >= 10
    AND (o_custkey % 100) + (o_orderkey % 50) <= 45""")
def catalog_intersects(spark, sf):
    triangle = [[{"x": 20.0, "y": 10.0}, {"x": 30.0, "y": 10.0}, {"x": 30.0, "y": 15.0}, {"x": 20.0, "y": 25.0}]]
    return search(item_table(spark, sf), intersects=triangle).select("id", "item_date")


# Fetches: an item for each year of the panel, and one for each scene, all over the panel's area.


def year_items(spark) -> DataFrame:
    made = [(str(y), [-180.0, -90.0, 180.0, 90.0], f"{y}-07-01T00:00:00Z") for y in range(1992, 1999)]
    rows = spark.createDataFrame(made, "id string, bbox array<double>, day string")
    return rows.select(F.from_json(F.to_json(F.struct("id", "bbox", F.struct(F.col("day").alias("datetime")).alias("properties"))), ITEMS_SCHEMA).alias("i")).select("i.*")


def year_pixels(spark, sf) -> DataFrame:
    panel = class_panel(spark, sf, [1995, 1997])
    return panel.select(F.col("layer").alias("scene_id"), F.make_date(F.col("layer").cast("int"), F.lit(7), F.lit(1)).alias("scene_date"), "row", "col", "code")


AREA = [(1, 2.31, 0.27, 31.77, 9.41, "area", 0), (2, 40.13, 4.57, 49.29, 20.19, "area", 0)]
AREA_SQL = f"area(key, c0, r0, c1, r1, cause, year) AS ({values(AREA)})"


def area_of_interest(spark) -> DataFrame:
    """Two rectangles of the panel, in longitude and latitude."""
    own = spark.createDataFrame([(ring(*b),) for _, *b, _, _ in AREA], f"geometry {RINGS}")
    return at.in_crs(own, GRID.crs, "EPSG:4326")


IN_AREA = "EXISTS (SELECT 1 FROM area WHERE {x} >= c0 AND {x} < c1 AND {y} > r0 AND {y} <= r1)"


@query(f"""{BASE}, {AREA_SQL} SELECT layer, CAST(CASE layer WHEN '1995' THEN 0 ELSE 1 END AS INTEGER) AS layer_ix, "row", col, code FROM panel
  WHERE layer IN ('1995', '1997') AND {IN_AREA.format(x="col + 0.5", y='"row" + 0.5')}""")
def fetch_years(spark, sf):
    return stac_fetch(spark, year_items(spark), year_pixels(spark, sf), GRID, aoi=area_of_interest(spark), aoi_crs="EPSG:4326", years=[1995, 1997])


# A grid of 20 m from the area's lower left corner (2.31, 20.19 in cells), looked up at the cells' centres; 120 m tiles or none.
FETCHED = f"""{BASE}, {AREA_SQL},
  g AS (SELECT c, r, 2.31 + (c + 0.5) * 2.0 AS x, 20.19 - (n - r - 0.5) * 2.0 AS y FROM (SELECT {{rows}} AS n), unnest(range({{rows}})) a(r), unnest(range(24)) b(c))
  SELECT layer, CAST(CASE layer WHEN '1995' THEN 0 ELSE 1 END AS INTEGER) AS layer_ix, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, code
  FROM g JOIN panel ON "row" = CAST(floor(y) AS INTEGER) AND col = CAST(floor(x) AS INTEGER) WHERE layer IN ('1995', '1997') AND {IN_AREA.format(x="x", y="y")}"""


def fetched(spark, sf, **options) -> DataFrame:
    return stac_fetch(spark, year_items(spark), year_pixels(spark, sf), GRID, aoi=area_of_interest(spark), aoi_crs="EPSG:4326", years=[1995, 1997], res=20.0, **options)


@query(FETCHED.format(rows=10))
def fetch_resampled(spark, sf):
    return fetched(spark, sf)


@query(FETCHED.format(rows=12))
def fetch_tiled(spark, sf):
    return fetched(spark, sf, tile_size=120.0)


SCENE_AREA = [(1, 10.37, -0.29, 60.41, 7.83, "area", 0)]


def scene_area(spark) -> DataFrame:
    return spark.createDataFrame([(ring(*b, SCENE_GRID),) for _, *b, _, _ in SCENE_AREA], f"geometry {RINGS}")


def scene_items(spark, sf) -> DataFrame:
    """An item for each scene: its day, its clouds, and a square as its geometry."""
    lonlat = at.in_crs(scene_area(spark), SCENE_GRID.crs, "EPSG:4326").select(F.element_at(F.element_at("geometry", 1), 1).alias("p")).first().p
    x, y = lonlat.x, lonlat.y
    shape = f'{{"type":"Polygon","coordinates":[[[{x - 1},{y - 1}],[{x + 1},{y - 1}],[{x + 1},{y + 1}],[{x - 1},{y + 1}],[{x - 1},{y - 1}]]]}}'
    made = F.to_json(F.struct(
        F.col("scene_id").alias("id"), F.array(*map(F.lit, (x - 1, y - 1, x + 1, y + 1))).alias("bbox"), F.lit(shape).alias("geometry"),
        F.struct(F.date_format("scene_date", "yyyy-MM-dd'T'10:00:00'Z'").alias("datetime"), F.col("cloud_cover").cast("double").alias("eo:cloud_cover")).alias("properties"),
    ))
    return scenes(spark, sf).select(F.from_json(made, ITEMS_SCHEMA).alias("i")).select("i.*")


CUBE = f"""{stack_sql("ndvi").replace("cloud_cover <= 40", "scene_id IN (SELECT scene_id FROM scenes s WHERE cloud_cover <= 40 AND scene_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND month(scene_date) IN (6, 7, 8))")},
  m AS (SELECT CAST(unnest(generate_series((SELECT min(t) FROM stack), (SELECT max(t) FROM stack), INTERVAL 1 MONTH)) AS DATE) AS t)"""


def cube(spark, sf, **options) -> DataFrame:
    return stac_cube(spark, scene_items(spark, sf), scenes(spark, sf), SCENE_GRID, "1995-01-01/1996-12-31", index="ndvi", cloud_cover_max=40, months=[6, 7, 8], aoi=scene_area(spark), **options).withColumn("y", r6("y"))


@query(f"""{CUBE} SELECT "row", col, t, CASE WHEN col + 0.5 BETWEEN 10.37 AND 60.41 AND "row" + 0.5 <= 7.83 THEN {R6.format(x="y")} END AS y
  FROM (SELECT DISTINCT "row", col FROM stack) CROSS JOIN m LEFT JOIN stack USING ("row", col, t)""")
def cube_index(spark, sf):
    return cube(spark, sf)


# Scenes looked up one by one on a grid of 10 m from the area's lower left (10.37, 7.83), in tiles of 200 m.
WARPED = CUBE.replace("FROM scenes WHERE SCL", """FROM (SELECT g.r AS "row", g.c AS col, scene_id, scene_date, cloud_cover, B04, B08, B11, SCL FROM g JOIN scenes ON scenes."row" = CAST(floor(g.y) AS INTEGER) AND scenes.col = CAST(floor(g.x) AS INTEGER)) WHERE SCL""").replace(
    SCENES, f"""{SCENES}, g AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, 10.37 + c + 0.5 AS x, 7.83 - (20 - r - 0.5) AS y FROM unnest(range(20)) a(r), unnest(range(60)) b(c))""")


@query(f"""{WARPED} SELECT "row", col, t, CASE WHEN 10.37 + col + 0.5 < 60.41 AND "row" + 0.5 > 20 - 8.12 THEN {R6.format(x="y")} END AS y
  FROM (SELECT DISTINCT "row", col FROM stack) CROSS JOIN m LEFT JOIN stack USING ("row", col, t)""")
def cube_tiled(spark, sf):
    return cube(spark, sf, tile_size=200.0, resampling="near")


# A scene for each month, written out by tile and scanned.

MONTHS = f"""{SCENES}, months AS (SELECT strftime(scene_date, '%Y-%m') AS scene_id, CAST(date_trunc('month', scene_date) AS DATE) AS scene_date, "row", col,
    CAST((year(scene_date) * 12 + month(scene_date)) % 50 AS DOUBLE) AS cloud_cover, min(B04) AS B04, max(B08) AS B08 FROM scenes GROUP BY ALL)"""


def month_scenes(spark, sf) -> str:
    """The path of the store."""
    made = scenes(spark, sf).groupBy(F.date_format("scene_date", "yyyy-MM").alias("scene_id"), F.trunc("scene_date", "month").alias("scene_date"), "row", "col").agg(F.min("B04").alias("B04"), F.max("B08").alias("B08"))
    path = new_path(spark, "scene-store")
    write_scenes(made.withColumn("cloud_cover", ((F.year("scene_date") * 12 + F.month("scene_date")) % 50).cast("double")), path, tile=64)
    return path


@query(f"""{MONTHS} SELECT scene_id, scene_date, cloud_cover, "row", col, B04, B08 FROM months
  WHERE scene_date BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' AND cloud_cover <= 25 AND col + 0.5 >= 10.37 AND col + 0.5 < 60.41 AND "row" + 0.5 > -0.29 AND "row" + 0.5 <= 7.83""")
def scan_area(spark, sf):
    found = scan_scenes(spark, month_scenes(spark, sf), start="1994-01-01", end="1997-12-31", cloud_cover_max=25, aoi=scene_area(spark), grid=SCENE_GRID)
    return found.select("scene_id", "scene_date", "cloud_cover", "row", "col", "B04", "B08")


@query(f"""{MONTHS} SELECT "row", col, CAST(date_trunc('year', scene_date) AS DATE) AS t, median(B04) AS B04, median(B08) AS B08 FROM months WHERE scene_date < DATE '1996-01-01' AND cloud_cover > 10 GROUP BY 1, 2, 3""")
def scan_composite(spark, sf):
    found = scan_scenes(spark, month_scenes(spark, sf), end="1995-12-31").where("cloud_cover > 10")
    return composite(found, ["B04", "B08"], "P1Y", "median")


@query(f"""{BASE} SELECT layer, "row", col, code FROM panel WHERE layer IN ('1995', '2000')""")
def mosaic_layers(spark, sf):
    panel = class_panel(spark, sf, [1995, 2000])
    parts = [panel.where((F.col("col") >= a) & (F.col("col") < a + 25)) for a in (0, 25)]
    return mosaic(parts, "layer").drop("layer_ix")


@query(f"""{BASE},
  moved AS (SELECT "row", col, layer, code FROM panel WHERE layer = '1995' UNION ALL
    SELECT p."row", p.col, '2000', q.code FROM (SELECT DISTINCT "row", col FROM panel) p JOIN panel q ON q.layer = '2000' AND q."row" = CAST(floor(p."row" + 0.5 + 0.3) AS INTEGER) AND q.col = CAST(floor(p.col + 0.5 - 0.7) AS INTEGER)
    UNION ALL SELECT "row", col, layer, code FROM panel WHERE layer = '1997'),
  votes AS (SELECT "row", col, code, count(*) AS n, min(layer) AS first FROM moved WHERE code IS NOT NULL GROUP BY 1, 2, 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY n DESC, first) AS k FROM votes)
  SELECT "row", col, code FROM ranked WHERE k = 1 AND ("row", col) IN (SELECT ("row", col) FROM panel WHERE layer = '1995')""")
def consensus_aligned(spark, sf):
    """The layer of 2000 lies on a grid that is moved by 7 m and 3 m; pixels of the first layer."""
    panel = class_panel(spark, sf, [1995, 1997, 2000])
    last = panel.agg(F.max("row")).first()[0] or 0
    own = replace(GRID, nrow=last + 1)
    moved = replace(own, xmin=own.xmin + 7.0, ymax=own.ymax + 3.0)
    found = consensus(panel, grids={"1995": own, "1997": own, "2000": moved})
    return found.join(panel.where("layer = '1995'").select("row", "col"), ["row", "col"], "left_semi")


@query(f"""{VOTES.removesuffix('SELECT "row", col, code')} SELECT DISTINCT ct.code AS id, class_name AS label, color FROM ranked JOIN ct ON ct.code = ranked.code
  WHERE k = 1 AND ct.code IN (SELECT code FROM panel WHERE layer = '1995')""")
def consensus_labels(spark, sf):
    panel = class_panel(spark, sf, [1995, 1997, 2000])
    first = classify(panel.where("layer = '1995'"), class_table(spark)).levels.drop("layer")
    return consensus_levels(consensus(panel), first)


@query(f"WITH {CT} SELECT * FROM ct")
def class_table_rows(spark, sf):
    return class_table(spark)


@query("SELECT * FROM (VALUES (1, 'Water', '#419bdf', 'Water'), (2, 'Trees', '#397d49', 'Trees'), (3, 'Bare', 'red', NULL)) t(code, class_name, color, description)")
def class_table_from_items(spark, sf):
    classes = [{"value": 1, "description": "Water", "color-hint": "419bdf"}, {"value": 2, "description": "Trees", "color-hint": "#397d49"}, {"code": 3, "name": "Bare", "color": "red"}]
    import json

    items = spark.createDataFrame([(json.dumps({"id": "a", "properties": {"classification:classes": classes}}),)], "j string").select(F.from_json("j", ITEMS_SCHEMA).alias("i")).select("i.*")
    return classes_of_items(spark, items)


@query("""SELECT * FROM (VALUES ('ndvi', '(nir - red) / (nir + red)', 'nir,red', 'Normalized Difference Vegetation Index'),
  ('kndvi', 'tanh(pow((nir - red) / (nir + red), 2))', 'nir,red', 'Kernel NDVI (tanh of NDVI squared)'),
  ('ndmi', '(nir - swir16) / (nir + swir16)', 'nir,swir16', 'Normalized Difference Moisture Index')) t("index", formula, roles, description)""")
def index_registry(spark, sf):
    return index_table(spark)
