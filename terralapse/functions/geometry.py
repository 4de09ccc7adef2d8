"""Small kernels on polygons. A polygon is a list of rings, a ring a list of (x, y); inside is even-odd."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RINGS = "array<array<struct<x:double,y:double>>>"


def edges(rings) -> np.ndarray:
    """x0, y0, x1, y1 of every edge; rings may or may not repeat their first point."""
    out = []
    for ring in rings:
        points = np.array([(p["x"], p["y"]) if isinstance(p, dict) else (p[0], p[1]) for p in ring], float).reshape(-1, 2)
        if len(points) > 1 and (points[0] == points[-1]).all():
            points = points[:-1]
        if len(points):
            out.append(np.hstack([points, np.roll(points, -1, 0)]))
    return np.concatenate(out) if out else np.zeros((0, 4))


def lengths(column: pa.Array) -> np.ndarray:
    """Of lists; nulls have none."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def edges_of(shapes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The edges of all polygons of a column, and the row of each."""
    rings = shapes.flatten()
    points, n = rings.flatten(), lengths(rings)
    x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    ends = np.cumsum(n)
    after = np.arange(1, len(x) + 1)
    after[ends[n > 0] - 1] = (ends - n)[n > 0]
    return np.stack([x, y, x[after], y[after]], 1), np.repeat(np.repeat(np.arange(len(shapes)), lengths(shapes)), n)


def shapes_of(xy: np.ndarray, ends: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """A column of ``n`` polygons: ``ends`` are the places among the points where each ring starts and the last ends, ``of`` is the row of each ring, ascending."""
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0], pa.float64()), pa.array(xy[:, 1], pa.float64())], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), rings)


def contains(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie inside. A point on a shared edge belongs to one side: left and lower edges are inside, right and upper ones aren't."""
    inside = np.zeros(np.shape(x), bool)
    for x0, y0, x1, y1 in e:
        if y0 != y1:
            crosses = (y0 > y) != (y1 > y)
            inside ^= crosses & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return inside


def crossings(e: np.ndarray) -> list[float]:
    """Heights at which edges cross one another."""
    out = []
    for i in range(len(e)):
        ax, ay, bx, by = e[i]
        cx, cy, dx, dy = e[i + 1 :].T
        det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
            t = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
        good = (det != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1)
        out += (ay + s[good] * (by - ay)).tolist()
    return out


def overlap(e: np.ndarray, x0: float, y0: float, x1: float, y1: float, crossed: list[float] | None = None) -> float:
    """Area of the polygon inside a rectangle, exact for self-crossing rings too; ``crossed`` are the polygon's ``crossings`` if known.

    The rectangle is cut at every height where an edge starts, ends, crosses another or leaves
    the rectangle's sides; between two such heights the width inside is linear.
    """
    if not len(e) or e[:, [0, 2]].max() <= x0 or e[:, [0, 2]].min() >= x1 or e[:, [1, 3]].max() <= y0 or e[:, [1, 3]].min() >= y1:
        return 0.0
    crossed = crossings(e) if crossed is None else crossed
    # Edges that the rectangle's rows don't meet change nothing in it.
    e = e[(np.minimum(e[:, 1], e[:, 3]) < y1) & (np.maximum(e[:, 1], e[:, 3]) > y0)]
    heights = [y0, y1, *e[:, 1], *e[:, 3], *crossed]
    slanted = e[(e[:, 0] != e[:, 2]) & (e[:, 1] != e[:, 3])]
    for side in (x0, x1):
        s = (side - slanted[:, 0]) / (slanted[:, 2] - slanted[:, 0])
        heights += (slanted[:, 1] + s * (slanted[:, 3] - slanted[:, 1]))[(s >= 0) & (s <= 1)].tolist()
    ys = np.unique(np.clip(heights, y0, y1))
    area = 0.0
    for low, high in zip(ys[:-1], ys[1:]):
        mid = (low + high) / 2
        of = e[(e[:, 1] > mid) != (e[:, 3] > mid)]
        xs = np.clip(np.sort(of[:, 0] + (mid - of[:, 1]) * (of[:, 2] - of[:, 0]) / (of[:, 3] - of[:, 1])), x0, x1)
        area += float((xs[1::2] - xs[::2]).sum()) * (high - low)
    return area


def touches(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether polygon and rectangle, both with their boundaries, have a point in common."""
    for ax, ay, bx, by in e:
        low, high = 0.0, 1.0
        for p, d, a, b in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
            if d == 0:
                if not a <= p <= b:
                    low = 2.0
            else:
                s, t = sorted(((a - p) / d, (b - p) / d))
                low, high = max(low, s), min(high, t)
        if low <= high:
            return True
    return bool(len(e)) and bool(contains(e, np.array([(x0 + x1) / 2]), np.array([(y0 + y1) / 2]))[0])


def meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two polygons, both with their boundaries, have a point in common."""
    if not len(a) or not len(b):
        return False
    for x0, y0, x1, y1 in a:
        cx, cy, dx, dy = b.T
        near = (np.minimum(cx, dx) <= max(x0, x1)) & (np.maximum(cx, dx) >= min(x0, x1)) & (np.minimum(cy, dy) <= max(y0, y1)) & (np.maximum(cy, dy) >= min(y0, y1))
        side = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
        if (near & (side(x0, y0, x1, y1, cx, cy) * side(x0, y0, x1, y1, dx, dy) <= 0) & (side(cx, cy, dx, dy, x0, y0) * side(cx, cy, dx, dy, x1, y1) <= 0)).any():
            return True
    return bool(contains(b, a[:1, 0], a[:1, 1])[0] or contains(a, b[:1, 0], b[:1, 1])[0])


def rings_of_geojson(text: str | None) -> list | None:
    """The rings of a Polygon or MultiPolygon in GeoJSON; None for anything else."""
    shape = json.loads(text) if text else None
    if not shape or shape.get("type") not in ("Polygon", "MultiPolygon"):
        return None
    parts = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
    return [[(p[0], p[1]) for p in ring] for part in parts for ring in part]


def area(e: np.ndarray) -> float:
    if not len(e):
        return 0.0
    return overlap(e, e[:, [0, 2]].min(), e[:, [1, 3]].min(), e[:, [0, 2]].max(), e[:, [1, 3]].max())


def rings_of_sides(sides) -> list[list[tuple[int, int]]]:
    """Closed rings of (col, row) corners made of straight pieces (r0, c0, r1, c1); holes are rings too.

    Pieces go with the cells to the left; where two diagonal cells meet in a corner the walk
    turns left, so that each of the two keeps its own ring there.
    """
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r0, c0, r1, c1 in sides:
        after.setdefault((c0, r0), []).append((c1, r1))
    rings = []
    # A ring starts at its least corner, where no other ring of the patch can be mixed up with it.
    for start in sorted(after):
        while after.get(start):
            ring, at, came = [start], start, None
            while True:
                ways = after[at]
                turn = lambda b: 0 if came is None else np.sign((b[0] - at[0]) * (at[1] - came[1]) - (at[0] - came[0]) * (b[1] - at[1]))  # noqa: B023, E731
                b = max(ways, key=turn)
                ways.remove(b)
                came, at = at, b
                if at == start:
                    break
                ring.append(at)
            rings.append([*ring, start])
    return rings
