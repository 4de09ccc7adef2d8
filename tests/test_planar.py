"""Planar arrangements and the rows of polygons, against the kernels that look at every edge."""

import random
import time

import numpy as np
import pytest

from terralapse.functions import geometry, planar
from terralapse.functions.geometry import RINGS
from terralapse.functions.strips import Strips
from terralapse.grid import GridSpec
from terralapse.operators import attribute as at

GRID = GridSpec(3.0, 400.0, 10.0, 5.0, 80, 30)


def square(a, b, c, d):
    return [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]


def dicts(rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def some(rng, size, rings=2):
    return geometry.edges([[(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randrange(3, 12))] for _ in range(rng.randrange(1, rings + 1))])


def test_known_shapes():
    bow = planar.made_valid(geometry.edges([[(-10, -10), (110, 110), (110, -10), (-10, 110)]]))
    assert len(bow) == 2 and planar.ring_area(bow) == 7200 and all(len(r) == 4 for r in bow)
    hole = planar.made_valid(geometry.edges([square(0, 0, 10, 10), square(2, 2, 4, 4)]))
    assert sorted(planar.ring_area([r]) for r in hole) == [-4, 100]
    one = planar.union([geometry.edges([square(0, 0, 10, 10)]), geometry.edges([square(10, 0, 20, 10)])])
    assert len(one) == 1 and len(one[0]) == 5 and planar.ring_area(one) == 200
    assert planar.intersection(geometry.edges([square(0, 0, 10, 10)]), geometry.edges([square(10, 0, 20, 10)])) == []
    twice = geometry.edges([square(0, 0, 10, 10), square(0, 0, 10, 10)])
    assert planar.made_valid(twice) == [] and planar.made_valid(np.zeros((0, 4))) == [] and planar.made_valid(geometry.edges([[(1, 1), (1, 1)]])) == []


def test_groups_together_are_as_alone():
    rng = random.Random(3)
    pairs = [(some(rng, m) + shift, some(rng, m, 1) + shift) for m, shift in ((rng.choice([4, 6, 1000]), rng.choice([0.0, 1e6, -3.31])) for _ in range(200))] + [(np.zeros((0, 4)), np.zeros((0, 4)))]
    e, sizes = np.concatenate([x for p in pairs for x in p]), np.array([len(x) for p in pairs for x in p])
    xy, ends, of = planar.traced_groups(*planar.boundaries(e, np.repeat(np.arange(len(sizes)) % 2, sizes), np.repeat(np.arange(len(sizes)) // 2, sizes), 2, np.logical_and))
    found = [[] for _ in pairs]
    for k, a, b in zip(of, ends[:-1], ends[1:]):
        found[k].append([*map(tuple, xy[a:b].tolist())])
    alone = [planar.intersection(a, b) for a, b in pairs]
    assert found == alone and sum(map(len, found)) > 200
    assert np.bincount(of, planar.ring_areas(xy, ends), len(pairs)) == pytest.approx([planar.ring_area(r) for r in alone], abs=1e-9)
    assert [(int(a), int(b)) for a, b in planar.portions(np.array([3, 4, 9, 1, 0, 5]), 7)] == [(0, 2), (2, 3), (3, 6)]
    assert planar.traced(np.array([[0.0, 0, 1, 0], [1, 0, 2, 0], [2, 0, 0, 0]])) == []  # without an inside


@pytest.mark.parametrize("seed", range(8))
def test_random_shapes(seed):
    """Lattice points on small grids, so that edges meet in ends, overlap and cross many at a time."""
    rng = random.Random(seed)
    for _ in range(60):
        m = rng.choice([4, 6, 1000])
        a, b = some(rng, m), some(rng, m, 1)
        own, other, both, either = planar.made_valid(a), planar.made_valid(b), planar.intersection(a, b), planar.union([a, b])
        tolerance = 1e-6 * m * m
        assert planar.ring_area(own) == pytest.approx(geometry.area(a), abs=tolerance)
        assert planar.ring_area(both) + planar.ring_area(either) == pytest.approx(planar.ring_area(own) + planar.ring_area(other), abs=tolerance)
        x, y = np.array([rng.uniform(0, m) for _ in range(100)]), np.array([rng.uniform(0, m) for _ in range(100)])
        in_a, in_b = geometry.contains(a, x, y), geometry.contains(b, x, y)
        for rings, want in ((own, in_a), (both, in_a & in_b), (either, in_a | in_b)):
            assert (geometry.contains(geometry.edges(rings), x, y) == want).all()
            again = planar.noded(geometry.edges(rings))[0] if rings else []
            assert len(again) == sum(len(r) - 1 for r in rings) or m < 1000  # rings may touch in points, but nothing crosses


def test_strips():
    rng = random.Random(3)
    for _ in range(25):
        raw = []
        for _ in range(rng.randrange(1, 4)):
            m = rng.choice([5.0, 1.0, 0.37])
            point = lambda: (3 + round(rng.uniform(-60, 360) / m) * m, round(rng.uniform(-60, 460) / m) * m)  # noqa: B023, E731
            raw.append(geometry.edges([[point() for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 3))]))
        shapes = [planar.boundary([e]) for e in raw]
        strips, together = Strips(GRID, shapes), Strips(GRID, shapes, together=True)
        runs = [(rng.randrange(len(raw)), rng.randrange(80), a, rng.randrange(a, 30)) for a in (rng.randrange(30) for _ in range(80))]
        poly, row, a, b = map(np.array, zip(*runs))
        area, touch = strips.measured(poly, row, a, b)
        of, first, last = strips.centres(poly, row, a, b)
        for i, (p, r, c0, c1) in enumerate(runs):
            box = (3 + c0 * 10, 400 - (r + 1) * 5, 3 + (c1 + 1) * 10, 400 - r * 5)
            want = geometry.overlap(raw[p], *box)
            assert area[i] == pytest.approx(want, abs=1e-6)
            assert touch[i] == (want > 0 or geometry.touches(shapes[p], *box)) or want < 1e-6
            col = np.arange(c0, c1 + 1)
            x, y = 3 + (col + 0.5) * 10, np.full(len(col), 400 - (r + 0.5) * 5)
            inside = geometry.contains(shapes[p], x, y)
            assert {c for k in np.flatnonzero(of == i) for c in range(first[k], last[k] + 1)} == set(col[inside].tolist())
            assert (strips.inside(np.full(len(col), p), np.full(len(col), r), col) == inside).all()
            assert (together.inside(np.zeros(len(col), int), np.full(len(col), r), col) == np.logical_or.reduce([geometry.contains(s, x, y) for s in shapes])).all()


def test_met_cells():
    rng = random.Random(9)
    for _ in range(4):
        shapes = [planar.boundary([geometry.edges([[(rng.randrange(-20, 330, 5), rng.randrange(-20, 430, 5)) for _ in range(6)]])]) for _ in range(2)]
        met = set(zip(*(x.tolist() for x in Strips(GRID, shapes).met())))
        for p, s in enumerate(shapes):
            assert {(p, r, c) for r in range(80) for c in range(30) if geometry.touches(s, 3 + c * 10, 400 - (r + 1) * 5, 3 + (c + 1) * 10, 400 - r * 5)} == {k for k in met if k[0] == p}


def test_many_points_cost_little_more_than_few():
    """A polygon of 200,000 points clips two million cells in about the time that one of 50 takes."""
    grid, took = GridSpec(0, 30_000, 10, 10, 3000, 3000), {}
    for n in (50, 200_000):
        t = np.linspace(0, 2 * np.pi, n + 1)[:-1]
        ring = 1e4 * (1 + 0.2 * np.sin(6 * t))
        strips = Strips(grid, [planar.boundary([geometry.edges([list(zip(15_000 + ring * np.cos(t), 15_000 + ring * np.sin(t)))])])])
        rng = np.random.default_rng(1)
        row, col = rng.integers(0, 3000, (20, 100_000)), rng.integers(0, 3000, (20, 100_000))
        for k in range(47):
            strips.band(k)
        began = time.process_time()
        for r, c in zip(row, col):
            strips.inside(np.zeros(len(r), int), r, c)
        took[n] = time.process_time() - began
    assert took[200_000] < 3 * took[50]


def test_shapes_that_ride_with_the_rows(spark, monkeypatch):
    """Polygons too large to be sent to every task give what small ones give."""
    rng = random.Random(4)
    shapes = [[[(rng.uniform(0, 300), rng.uniform(0, 400)) for _ in range(7)]] for _ in range(6)]
    overlay = spark.createDataFrame([(k, dicts(g), f"z{k}") for k, g in enumerate(shapes)], f"overlay_ix long, geometry {RINGS}, name string")
    runs = spark.createDataFrame([(i, r, c, min(29, c + 1 + i % 9)) for i, (r, c) in enumerate((r, c) for r in range(0, 80, 2) for c in range(0, 30, 10))], "patch_id int, row int, col_start int, col_end int")
    patches = runs.select("patch_id").distinct()
    cells = spark.range(80 * 30).selectExpr("'a' AS layer", "cast(id div 30 as int) AS row", "cast(id % 30 as int) AS col", "1 AS code")

    def everything():
        found = [at.attribute(patches, runs, overlay, GRID, ["name"], predicate=p, bucket=8) for p in ("intersects", "within", "overlaps")]
        found += [at.zones(patches, runs, overlay, GRID, "name", 8).selectExpr("patch_id", "name", "round(zone_area_ha, 9) AS ha"), at.zone_runs(runs, overlay, GRID, "name", 8), at.clip(cells, overlay, GRID, bucket=8), at.clip(cells, overlay, GRID, drop=False, bucket=8)]
        return [sorted(map(tuple, f.collect()), key=repr) for f in found]

    small = everything()
    monkeypatch.setattr(at, "MOST_POINTS", 1)
    assert small == everything() and all(small)


def test_zone_shapes_of_many_patches(spark):
    """Patches and their cuts are worked out many at a time, so that they cost far less than some milliseconds each."""
    grid = GridSpec(0.0, 1e6, 10.0, 10.0, 1000, 50)
    cells = spark.range(15_000).selectExpr("cast(id div 3 + 1 as int) as patch_id", "cast(id div 30 * 2 as int) as row", "cast(id div 3 % 10 * 5 + id % 3 as int) as col")
    runs = cells.groupBy("patch_id", "row").agg({"col": "min"}).selectExpr("patch_id", "row", "`min(col)` as col_start", "`min(col)` + 2 as col_end")
    zone = spark.createDataFrame([(dicts([square(50 * k + 5, 0, 50 * k + 45, 1e6)]), k) for k in range(10)], f"geometry {RINGS}, name int")
    began = time.time()
    got = at.zone_shapes(at.outlines(cells, grid), runs, zone, grid, "name").collect()
    assert time.time() - began < 20
    assert len(got) == 5000 and all(r.name == (r.patch_id - 1) % 10 and len(r.geometry) == 1 and len(r.geometry[0]) == 5 for r in got)
    assert {round(r.zone_area_ha, 9) for r in got} == {0.025} and {p.x % 50 for r in got for p in r.geometry[0]} == {5, 30}


def test_zone_shapes(spark):
    """A patch's ring cut by a bow-tie: the area that runs give, and no piece outside either."""
    runs = spark.createDataFrame([(1, r, 5, 19) for r in range(20, 50)] + [(2, 60, 0, 3)], "patch_id int, row int, col_start int, col_end int")
    outlines = spark.createDataFrame([(1, dicts([[*square(53, 150, 203, 300), (53.0, 150.0)]])), (2, dicts([[*square(3, 95, 43, 100), (3.0, 95.0)]]))], f"patch_id int, geometry {RINGS}")
    zone = spark.createDataFrame([("bow", dicts([[(40, 140), (220, 310), (220, 140), (40, 310)]])), ("all", dicts([square(-100, -100, 900, 900)]))], f"name string, geometry {RINGS}").selectExpr("geometry", "name")
    got = {(r.patch_id, r.name): r for r in at.zone_shapes(outlines, runs, zone, GRID, "name").collect()}
    areas = {(r.patch_id, r.name): r.zone_area_ha for r in at.zones(runs.select("patch_id").distinct(), runs, zone, GRID, "name").collect()}
    assert set(got) == set(areas) == {(1, "bow"), (1, "all"), (2, "all")}
    for k, r in got.items():
        assert r.zone_area_ha == pytest.approx(areas[k])
        rings = [[(p.x, p.y) for p in ring] for ring in r.geometry]
        assert planar.ring_area(rings) * 1e-4 == pytest.approx(areas[k]) and all(53 - 1e-6 <= x <= 203 + 1e-6 or k[0] == 2 for ring in rings for x, _ in ring)
    valid = at.make_valid(zone).where("name = 'bow'").first()
    assert len(valid.geometry) == 2
