"""Outlines as points against outlines of whole patches, for any tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralapse.functions import geometry, planar
from terralapse.grid import GridSpec
from terralapse.operators import attribute as at
from terralapse.operators import rings

GRID = GridSpec(5.0, 900.0, 10.0, 5.0, 60, 60)


def by_ring(points):
    out = {}
    for r in points.orderBy("patch_id", "ring", "ordinal").collect():
        out.setdefault((r.patch_id, r.ring), []).append((r.ordinal, r.x, r.y))
    assert all([p[0] for p in v] == list(range(len(v))) for v in out.values())
    return {k: [(x, y) for _, x, y in v] for k, v in out.items()}


def turned(ring):
    """A ring from its least point, without its last one."""
    ring = ring[:-1] if ring[0] == ring[-1] else ring
    i = ring.index(min(ring))
    return tuple(ring[i:] + ring[:i])


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    noise = np.kron(rng.integers(0, 4, (30, 30)), np.ones((2, 2), int))
    snake = np.zeros((60, 60), int)
    for k in range(0, 60, 4):
        snake[k : k + 2] = 9
        snake[k : k + 4, (58 if k % 8 == 0 else 0) : (60 if k % 8 == 0 else 2)] = 9
    rows = [(int(noise[r, c]), r, c) for r in range(60) for c in range(60)] + [(9, r, c + 100) for r in range(60) for c in range(60) if snake[r, c]] + [(11, 3, 83), (11, 4, 84), (11, 4, 82), (11, 5, 83)]
    return spark.createDataFrame(rows, "patch_id int, row int, col int").cache()


@pytest.mark.parametrize("tile", [16, 256])
def test_points_are_the_outlines(cells, tile):
    got = by_ring(rings.outline_points(cells, GRID, tile=tile))
    want = {r.patch_id: [[(p.x, p.y) for p in ring] for ring in r.geometry] for r in at.outlines(cells, GRID).collect()}
    for patch, shape in want.items():
        mine = [v for (p, _), v in got.items() if p == patch]
        area = lambda rs: planar.ring_area([[*r, r[0]] for r in map(list, map(turned, rs))])
        assert area(mine) == pytest.approx(area(shape)) and area(mine) == pytest.approx(50 * cells.where(F.col("patch_id") == patch).count())
        edges = lambda rs: sorted(map(tuple, geometry.edges(rs).tolist()))
        assert edges(mine) == edges(shape)
    snake = [v for (p, _), v in got.items() if p == 9]
    assert len(snake) == 1 and len([k for k in got if k[0] == 11]) == 4  # four cells around a hole: each keeps its own ring


def test_tasks_hold_a_tile_at_most(cells):
    snake = cells.where("patch_id = 9")
    sides = at.sides(snake)
    tiles = sides.groupBy(F.floor(F.col("r0") / 8), F.floor(F.col("c0") / 8)).count()
    assert tiles.agg(F.max("count")).first()[0] < sides.count() / 3
    got = by_ring(rings.outline_points(snake, GRID, tile=8))
    assert [len(v) for v in got.values()] == [sides.count()]


def test_nothing(spark, cells):
    assert rings.outline_points(cells.where("false"), GRID).count() == 0
