"""Rasters in blocks against rows of cells."""

import numpy as np
import pytest

from terralapse.grid import GridSpec
from terralapse.operators import blocks as bl
from terralapse.operators.consensus import consensus
from terralapse.operators.summarize import summarize
from terralapse.operators.transition import patches, transition
from terralapse.sources.classes import class_table

GRID = GridSpec(0.0, 1000.0, 10.0, 10.0, 100, 90)
CELLS = "layer string, layer_ix int, row int, col int, code int"
CODES = [1, 2, 5, 11]


def field(seed, codes, missing=0.1):
    rng = np.random.default_rng(seed)
    coarse = rng.choice(codes, (25, 23))
    return np.where(rng.random((100, 90)) < missing, None, np.kron(coarse, np.ones((4, 4), int))[:100, :90])


@pytest.fixture(scope="module")
def panel(spark):
    layers = [("2017", 0, field(1, CODES)), ("2020", 1, field(2, CODES)), ("2023", 2, field(3, [*CODES, 300, -4]))]
    rows = [(n, k, r, c, None if a[r, c] is None else int(a[r, c])) for n, k, a in layers for r in range(100) for c in range(90)]
    return spark.createDataFrame(rows, CELLS).cache()


@pytest.fixture(scope="module", params=[16, 256])
def rows(panel, request):
    return bl.blocks(panel, request.param).cache()


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_cells_come_back(panel, rows):
    same(bl.cells(rows), panel.where("code is not null"))
    assert rows.where("wide").select("layer").distinct().collect() == [("2023",)]
    assert bl.cells(bl.blocks(panel.where("false"))).count() == 0
    twice = panel.sparkSession.createDataFrame([("a", 0, 5, 5, 2), ("a", 0, 5, 5, 7), ("a", 0, 5, 5, None)], CELLS)
    assert bl.cells(bl.blocks(twice)).select("code").collect() == [(7,)]


def test_areas(spark, panel, rows):
    same(bl.summarize_blocks(rows, GRID, class_table(spark)), summarize(panel, GRID, class_table(spark)))


@pytest.mark.parametrize("layers", [("2017", "2020"), ("2020", "2023"), ("2023", "2017")])
@pytest.mark.parametrize("classes", [{}, {"from_class": ["Trees"]}, {"from_class": ["Trees", "Crops"], "to_class": ["Rangeland"]}, {"to_class": ["nothing"]}])
def test_transitions(spark, panel, rows, layers, classes):
    table = class_table(spark)
    found, plain = bl.transition_blocks(rows, GRID, *layers, table, **classes), transition(panel, GRID, *layers, table, **classes)
    same(found.summary, plain.summary)
    same(found.levels, plain.levels)
    for options in ({}, {"changes_only": True}, {"changes_only": True, "patch_area_min": 1000}):
        same(bl.patches_of_blocks(found, table, **options), patches(plain, table, **options))


def test_consensus(panel, rows):
    same(bl.consensus_of_blocks(rows), consensus(panel, confidence=True).where("code is not null"))


def test_blocks_without_the_class_are_skipped(spark):
    cells = spark.createDataFrame([(n, k, r, r, 2 if r < 8 else 5) for n, k in (("a", 0), ("b", 1)) for r in range(64)], CELLS)
    rows = bl.blocks(cells, 8)
    assert rows.count() == 16 and bl.paired(rows, "a", "b").count() == 8 and bl.paired(rows, "a", "b", [2]).count() == 1 and bl.paired(rows, "a", "b", [2], [9]).count() == 0
    plan = bl.summarize_blocks(rows, GRID, class_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "counts" in plan


def test_messages(spark, rows):
    with pytest.raises(ValueError, match="Layer '1999' not found"):
        bl.transition_blocks(rows, GRID, "1999", "2020", class_table(spark))
    mixed = rows.where("layer = '2017'").union(bl.blocks(bl.cells(rows.where("layer = '2020'")), 32))
    with pytest.raises(Exception, match="blocks differ in size"):
        bl.transition_blocks(mixed, GRID, "2017", "2020", class_table(spark)).summary.collect()
    with pytest.raises(ValueError, match="projected"):
        bl.summarize_blocks(rows, GridSpec(0, 0, 1, 1, 1, 1, "EPSG:4326"), class_table(spark))


def test_layers_that_never_meet(spark, panel):
    rows = bl.blocks(panel, 16)
    apart = rows.where("layer = '2017' and tr = 0").union(rows.where("layer = '2020' and tr = 1"))
    assert bl.transition_blocks(apart, GRID, "2017", "2020", class_table(spark)).summary.count() == 0
