"""A map to look at: layers, groups, legends and tile addresses as plain data, and a page that shows them."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.operators.transition import Transition

#: The default base maps.
BASEMAPS = {
    "Light": "CartoDB.Positron",
    "Esri Satellite": "Esri.WorldImagery",
    "Google Satellite": "https://mt1.google.com/vt/lyrs=s&x={x}&y={y}&z={z}",
    "OpenTopoMap": "OpenTopoMap",
}
OTHER_COLOR = "#999999"


def colormap(table: DataFrame) -> str:
    """``{"code":[r,g,b,255],...}`` in the table's order."""
    rows = table.select("code", "color").collect()  # a class table
    return "{" + ",".join(f'"{r.code}":[{",".join(str(int(r.color[i : i + 2], 16)) for i in (1, 3, 5))},255]' for r in rows) + "}"


def tile_url(tiler: str, image: str, table: DataFrame) -> str:
    return f"{tiler}/cog/tiles/WebMercatorQuad/{{z}}/{{x}}/{{y}}.png?url={quote(image, safe='')}&bidx=1&colormap={quote(colormap(table), safe='')}"


def rgb(table: DataFrame) -> DataFrame:
    """(code, r, g, b) by Spark's own functions."""
    part = lambda i: F.conv(F.substring("color", i, 2), 16, 10).cast("int")
    return table.select("code", part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def legend(cells: DataFrame, table: DataFrame) -> DataFrame:
    """(code, class_name, color) of the classes present."""
    present = cells.where(F.col("code").isNotNull()).select("code").distinct()
    return table.join(present, "code", "left_semi").select("code", "class_name", "color")


def overlays(found: Transition, table: DataFrame) -> DataFrame:
    """(id, transition, color): a layer for each change in the summary, in the color of the class it leads to."""
    changes = found.summary.where("from_class <> to_class").select(F.concat("from_class", F.lit(" -> "), "to_class").alias("transition"), "to_class")
    colors = table.select(F.col("class_name").alias("to_class"), "color")
    return changes.join(found.levels, "transition").join(colors, "to_class", "left").select("id", "transition", F.coalesce("color", F.lit(OTHER_COLOR)).alias("color"))


def map_spec(
    layers: dict[str, DataFrame | str] | DataFrame | str,
    table: DataFrame,
    *,
    transition: Transition | None = None,
    bbox: tuple[float, float, float, float] | None = None,
    tiler: str | None = None,
    basemaps: dict[str, str] | None = None,
    legend_position: str | None = "bottomright",
    zoom: int = 14,
) -> dict:
    """Layers are class cells (rows with a code) or addresses of images, which need a tiler.

    The first layer is shown and the others are hidden. ``bbox`` is in degrees.
    """
    if not isinstance(layers, dict):
        layers = {"Layer": layers}
    remote = all(isinstance(x, str) for x in layers.values())
    if remote and not tiler:
        raise ValueError("COG mode requires a tiler URL")
    if transition is not None and not isinstance(transition, Transition):
        raise ValueError("transition must be a transition result with cells and summary")
    bases = [{"group": k, "template" if v.startswith(("http://", "https://")) else "provider": v} for k, v in (basemaps or BASEMAPS).items()]
    shown = [{"group": k, "url": tile_url(tiler, v, table)} if isinstance(v, str) else {"group": k} for k, v in layers.items()]
    changes = [r.asDict() for r in overlays(transition, table).collect()] if transition else []  # as many as pairs of classes
    legends = []
    if legend_position:
        if remote:
            classes = table.where(F.col("class_name") != "No Data").select("class_name", "color").collect()
        else:
            cells = None
            for x in layers.values():
                cells = x.select("code") if cells is None else cells.union(x.select("code"))
            classes = legend(cells, table).orderBy("code").collect()
        legends.append({"title": "Land Cover", "position": legend_position, "labels": [r.class_name for r in classes], "colors": [r.color for r in classes]})
        if changes:
            legends.append({"title": "Transitions", "position": legend_position, "labels": [c["transition"] for c in changes], "colors": [c["color"] for c in changes]})
    names = list(layers)
    return {
        "center": {"lng": (bbox[0] + bbox[2]) / 2, "lat": (bbox[1] + bbox[3]) / 2, "zoom": zoom} if bbox else None,
        "basemaps": bases,
        "layers": shown,
        "transitions": [{"group": c["transition"], "id": c["id"], "color": c["color"]} for c in changes],
        "legends": legends,
        "overlay_groups": [*names, *(c["transition"] for c in changes), *(["AOI"] if bbox else [])],
        "hidden_groups": names[1:],
    }


def html(spec: dict) -> str:
    """A page that holds the specification and lists its legends; a map library can be pointed at the data in it."""
    items = "".join(f'<h2>{g["title"]}</h2><ul>' + "".join(f'<li><span style="background:{c}">&emsp;</span> {n}</li>' for n, c in zip(g["labels"], g["colors"])) + "</ul>" for g in spec["legends"])
    data = json.dumps(spec).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>Map</title>{items}<script type="application/json" id="map">{data}</script>'
