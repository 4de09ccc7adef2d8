"""Relations of patches with points and lines, against exact fractions that look at every piece."""

import random
from fractions import Fraction as Q

import pytest

from terralapse.grid import GridSpec
from terralapse.operators import attribute as at
from terralapse.operators.relate import PATTERNS, attribute_features, fits, related

GRID = GridSpec(3.0, 400.0, 10.0, 5.0, 12, 10)
LINES = "key long, geometry array<array<struct<x:double,y:double>>>"
POINTS = "key long, geometry array<struct<x:double,y:double>>"


def placed(p):
    return {"x": float(GRID.xmin + p[0] * GRID.resx), "y": float(GRID.ymax - p[1] * GRID.resy)}


def touched(a, b):
    """The columns (or rows) that a stretch from a to b within one cell, or along a side, meets."""
    if a == b and a.denominator == 1:
        return [int(a) - 1, int(a)]
    return [int((a + b) / 2 // 1)]


def where(cells, u, v):
    """I, B or E: of a stretch ((u0, u1), (v0, v1)) against a patch."""
    met = [(r, c) in cells for r in touched(*v) for c in touched(*u)]
    return "I" if all(met) else "B" if any(met) else "E"


def brute(cells, parts):
    """(relation, length) or None."""
    ends, inner, pieces = {}, set(), []
    for part in parts:
        part = [p for i, p in enumerate(part) if i == 0 or p != part[i - 1]]
        if len(part) < 2:
            continue
        for p in (part[0], part[-1]):
            ends[p] = ends.get(p, 0) + 1
        for (u0, v0), (u1, v1) in zip(part, part[1:]):
            t = {Q(0), Q(1)}
            for a, b in ((u0, u1), (v0, v1)):
                t |= {(k - a) / (b - a) for k in range(int(min(a, b)) - 1, int(max(a, b)) + 2) if a != b and min(a, b) < k < max(a, b)}
            places = [(u0 + s * (u1 - u0), v0 + s * (v1 - v0)) for s in sorted(t)]
            inner |= set(places)
            pieces += list(zip(places, places[1:]))
    ends = {p for p, n in ends.items() if n % 2}
    of_pieces = [where(cells, (p[0], q[0]), (p[1], q[1])) for p, q in pieces]
    of_inner = {where(cells, (u, u), (v, v)) for u, v in inner - ends}
    of_ends = {where(cells, (u, u), (v, v)) for u, v in ends}
    if not ({"I", "B"} & (set(of_pieces) | of_inner | of_ends)):
        return None
    length = sum((float((q[0] - p[0]) * 10) ** 2 + float((q[1] - p[1]) * 5) ** 2) ** 0.5 for (p, q), w in zip(pieces, of_pieces) if w != "E")
    row = lambda w, rest: ("1" if w in of_pieces else "0" if w == "B" and w in of_inner else "F") + ("0" if w in of_ends else "F") + rest
    return row("I", "2") + row("B", "1") + row("E", "2"), length


def runs_of(spark, patches):
    return spark.createDataFrame([(i, r, c, c) for i, cells in patches.items() for r, c in cells], "patch_id int, row int, col_start int, col_end int")


def test_lines_against_fractions(spark):
    rng = random.Random(4)
    patches = {i: {(rng.randrange(12), rng.randrange(10)) for _ in range(30)} for i in range(3)}
    lines = {}
    for key in range(150):
        step = rng.choice([1, 2, 4, 7])
        point = lambda: (Q(rng.randrange(-step, 11 * step), step), Q(rng.randrange(-step, 13 * step), step))  # noqa: B023, E731
        lines[key] = [[point() for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 3))]
        if key % 5 == 0:
            lines[key][0].append(lines[key][0][0])
    overlay = spark.createDataFrame([(k, [[placed(p) for p in part] for part in parts]) for k, parts in lines.items()], LINES)
    got = {(r.patch_id, r.key): (r.relation, r.measure) for r in related(runs_of(spark, patches), overlay, GRID, "lines", bucket=3).collect()}
    want = {(i, k): found for i, cells in patches.items() for k, parts in lines.items() if (found := brute(cells, parts))}
    assert got.keys() == want.keys() and len(got) > 200
    for k in want:
        assert got[k][0] == want[k][0], (k, lines[k[1]])
        assert got[k][1] == pytest.approx(want[k][1], abs=1e-6)
    assert len({r for r, _ in got.values()}) > 8


def test_points(spark):
    """Inside, on a side, at corners, outside, several at once; cells of a patch on both sides make a side its inside."""
    patches = {1: {(2, 2), (2, 3), (3, 2), (3, 3)}, 2: {(4, 4)}}
    points = {1: [(2.5, 2.5)], 2: [(3, 3)], 3: [(3, 2.5)], 4: [(2, 2.5)], 5: [(4, 4)], 6: [(2.5, 2.5), (9, 9)], 7: [(9, 9)], 8: [], 9: None, 10: [(4.5, 4.5), (2, 2), (3, 3)]}
    rows = [(k, None if p is None else [placed(x) for x in p]) for k, p in points.items()] + [(11, [{"x": None, "y": 1.0}, None]), (12, [{"x": float("nan"), "y": 380.0}])]
    got = {(r.patch_id, r.key): (r.relation, r.measure) for r in related(runs_of(spark, patches), spark.createDataFrame(rows, POINTS), GRID, "points").collect()}
    inside, side = "0F2FF1FF2", "FF20F1FF2"
    assert got == {(1, 1): (inside, 1), (1, 2): (inside, 1), (1, 3): (inside, 1), (1, 4): (side, 1), (1, 5): (side, 1), (2, 5): (side, 1), (1, 6): ("0F2FF10F2", 1), (1, 10): ("0F20F10F2", 2), (2, 10): ("0F2FF10F2", 1)}


def test_attributes_of_lines(spark):
    """Named conditions, patterns, repeated rows, empty and null lines, clashing columns."""
    runs = runs_of(spark, {1: {(2, 2), (2, 3)}, 2: {(9, 9)}})
    patches = spark.createDataFrame([(1, "a"), (2, "b")], "patch_id int, row string")
    shapes = {"in": [[(2.2, 2.2), (3.8, 2.8)]], "over": [[(0, 2.5), (3, 2.5)]], "along": [[(2, 2), (4, 2)]], "near": [[(0, 0), (1, 1)]], "empty": [], "dot": [[(2.5, 2.5)]], "null": None}
    rows = [(name, None if s is None else [[placed(p) for p in part] for part in s]) for name, s in shapes.items()]
    overlay = spark.createDataFrame([*rows, rows[1]], "road string, geometry array<array<struct<x:double,y:double>>>")
    found = lambda **o: sorted((r.patch_id, r.road) for r in attribute_features(patches, runs, overlay, GRID, ["road"], kind="lines", **o).collect() if r.road)
    assert found() == [(1, "along"), (1, "in"), (1, "over"), (1, "over")]
    assert found(predicate="contains") == [(1, "in")] and found(predicate="covers") == [(1, "along"), (1, "in")]
    assert found(predicate="crosses") == [(1, "over"), (1, "over")] == found(predicate="T*****T**")
    assert found(predicate="touches") == [(1, "along")] and found(predicate="within") == found(predicate="equals") == []
    assert found(match_mode="largest") == [(1, "along")]
    assert attribute_features(patches, runs, overlay.where("false"), GRID, ["road"], kind="lines").count() == 2
    lonlat = at.in_crs(overlay, GRID.crs, "EPSG:4326")
    assert [r.road for r in attribute_features(patches, runs, lonlat, GRID, ["road"], kind="lines", overlay_crs="EPSG:4326", predicate="contains").collect()] == ["in", None]
    for wrong, said in (({"kind": "areas"}, "kind"), ({"kind": "lines", "predicate": "meets"}, "pattern"), ({"kind": "lines", "match_mode": "largest", "predicate": "crosses"}, "largest")):
        with pytest.raises(ValueError, match=said):
            attribute_features(patches, runs, overlay, GRID, ["road"], **wrong)


def test_relations_of_areas(spark):
    """The same names for polygons; a repeated overlay isn't measured twice."""
    runs = runs_of(spark, {1: {(2, 2), (2, 3)}})
    patches = spark.createDataFrame([(1,)], "patch_id int")
    box = lambda a, b, c, d: [[placed(p) for p in ((a, b), (c, b), (c, d), (a, d))]]
    rows = [("same", box(2, 2, 4, 3)), ("part", box(2, 2, 3, 3)), ("wide", box(0, 0, 9, 9)), ("half", box(3, 0, 5, 9)), ("half", box(3, 0, 5, 9)), ("side", box(4, 0, 6, 9))]
    overlay = spark.createDataFrame(rows, "zone string, geometry array<array<struct<x:double,y:double>>>")
    found = lambda p: sorted(r.zone for r in at.attribute(patches, runs, overlay, GRID, ["zone"], predicate=p).collect() if r.zone)
    assert found("equals") == ["same"] and found("covers") == ["part", "same"] and found("covered_by") == ["same", "wide"] == found("within")
    assert found("overlaps") == ["half", "half"] and found("touches") == ["side"] and found("crosses") == []


def test_patterns(spark):
    row = spark.createDataFrame([("0F2FF1FF2",)], "r string")
    said = {name: any(row.select(fits(row.r, p)).first()[0] for p in PATTERNS[name]) for name in PATTERNS}
    assert said == {"intersects": True, "contains": True, "covers": True, "touches": False, "crosses": False, "within": False, "covered_by": False, "equals": False}
