"""Connected patches against a flood fill; the conservation of cells; dense numbers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terralapse.grid import GridSpec
from terralapse.operators.patches import FAR, label_tile, labelled
from terralapse.operators.transition import patch_cells, patches, runs, transition
from terralapse.plans.graph import components
from terralapse.sources.classes import class_table

GRID = GridSpec(0.0, 1000.0, 10.0, 10.0, 100, 100)


def flood(cells: dict, same: bool) -> dict:
    label = {}
    for start in sorted(cells):
        if start in label:
            continue
        todo, label[start] = [start], start
        while todo:
            r, c = todo.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    near = (r + dr, c + dc)
                    if near in cells and near not in label and (not same or cells[near] == cells[r, c]):
                        label[near] = start
                        todo.append(near)
    return {k: v[0] * FAR + v[1] for k, v in label.items()}


def engineered() -> dict:
    """A 60 x 80 matrix with corner touches, a hole, class 0 and interlocked diagonals."""
    m = np.full((61, 81), -1)
    m[5:8, 5:8] = m[8:11, 8:11] = 10
    m[5:8, 8:11] = m[50, 70] = 20
    m[20, 20] = m[21, 21] = 30
    m[20, 21] = m[21, 20] = 40
    m[40:43, 40:46] = 0
    m[30:37, 60:67] = 50
    m[32:35, 62:65] = -1
    return {(r, c): int(v) for (r, c), v in np.ndenumerate(m) if v >= 0}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 12), st.integers(0, 12)), st.integers(0, 2), min_size=1), st.booleans())
def test_tile_against_flood(cells, same):
    keys = sorted(cells)
    row, col = np.array(keys).T
    value = np.array([cells[k] if same else 0 for k in keys])
    got = label_tile(row, col, value)
    assert {k: int(x) for k, x in zip(keys, got)} == flood(cells, same)


@pytest.mark.parametrize("tile", [3, 7, 256])
@pytest.mark.parametrize("same", [True, False])
def test_tiles_make_no_difference(spark, tile, same):
    cells = engineered()
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, value int")
    local, parts = labelled(df, same_value=same, tile=tile)
    got = {(r.row, r.col): r.patch for r in local.join(parts.select("label", "patch"), "label").collect()}
    assert parts.agg({"n": "sum"}).first()[0] == len(cells)
    assert got == flood(cells, same)
    if same:
        by_class = {}
        for k, label in got.items():
            by_class.setdefault(cells[k], set()).add(label)
        assert {v: len(x) for v, x in by_class.items()} == {10: 1, 20: 2, 30: 1, 40: 1, 0: 1, 50: 1}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long") if edges else spark.createDataFrame([], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    codes = np.array([2, 5, 7, 8, 11])
    before = np.kron(codes[rng.integers(0, 5, (10, 10))], np.ones((3, 3), int))
    after = np.where(rng.random((30, 30)) < 0.3, codes[rng.integers(0, 5, (30, 30))], before)
    gaps = rng.random((30, 30)) < 0.1
    rows = [(name, i, r, c, int(m[r, c])) for i, (name, m) in enumerate((("2017", before), ("2020", after))) for r in range(30) for c in range(30) if not gaps[r, c]]
    return spark.createDataFrame(rows, "layer string, layer_ix int, row int, col int, code int").cache()


def test_removed_and_kept_are_all_changed(spark, panel):
    table = class_table(spark)
    plain = transition(panel, GRID, "2017", "2020", table)
    changed = plain.cells.where("from_code <> to_code").count()
    assert abs(sum(r.pct for r in plain.summary.collect()) - 100) < 0.2
    last = None
    for least in (0, 200, 500, 1e9):
        found = transition(panel, GRID, "2017", "2020", table, patch_area_min=least, tile=8)
        gone = found.removed.count() if found.removed is not None else 0
        assert gone + found.cells.where("from_code <> to_code").count() == changed
        assert found.cells.where("from_code = to_code").count() == plain.cells.where("from_code = to_code").count()
        assert last is None or gone >= last
        last = gone
    assert last == changed
    assert transition(panel, GRID, "2017", "2020", table, patch_area_min=0).removed is None
    only = transition(panel, GRID, "2017", "2020", table, from_class=["Trees"], to_class=["Crops"], patch_area_min=1e9)
    assert only.removed is None and only.summary.count() == 0


def test_patch_table(spark, panel):
    table = class_table(spark)
    found = transition(panel, GRID, "2017", "2020", table)
    all_, changes = patches(found, table).collect(), patches(found, table, changes_only=True).collect()
    assert sorted(r.patch_id for r in all_) == list(range(1, len(all_) + 1))
    key = lambda rows: sorted((r.transition, r.area_ha) for r in rows if r.transition.split(" -> ")[0] != r.transition.split(" -> ")[1])
    assert key(all_) == key(changes)
    cells = patch_cells(found)
    lengths = {r.patch_id: r.n for r in runs(cells).selectExpr("patch_id", "col_end - col_start + 1 AS k").groupBy("patch_id").sum("k").toDF("patch_id", "n").collect()}
    assert lengths == {r.patch_id: r.n_cells for r in all_}
    first = {r.patch_id: r.first for r in cells.selectExpr("patch_id", "row * 1000 + col AS k").groupBy("patch_id").min("k").toDF("patch_id", "first").collect()}
    assert [first[i] for i in sorted(first)] == sorted(first.values())


def test_numbers_are_dense_after_small_patches_go(spark, panel):
    table = class_table(spark)
    found = transition(panel, GRID, "2017", "2020", table)
    every = {r.patch_id: r for r in patches(found, table).collect()}
    left = sorted(patches(found, table, patch_area_min=500).collect(), key=lambda r: r.patch_id)
    assert [r.patch_id for r in left] == list(range(1, len(left) + 1)) and 0 < len(left) < len(every)
    assert [(r.transition, r.n_cells) for r in left] == [(r.transition, r.n_cells) for _, r in sorted(every.items()) if r.n_cells * GRID.cell_area >= 500]


def test_empty_raster(spark):
    table = class_table(spark)
    cells = spark.createDataFrame([("a", 0, 0, 0, None), ("b", 1, 0, 0, None)], "layer string, layer_ix int, row int, col int, code int")
    found = transition(cells, GRID, "a", "b", table, patch_area_min=100)
    assert found.summary.count() == 0 and patches(found, table).columns == ["patch_id", "transition", "area_ha", "n_cells"] and patches(found, table).count() == 0


def test_messages(spark, panel):
    table = class_table(spark)
    with pytest.raises(ValueError, match="single non-negative number or NULL"):
        transition(panel, GRID, "2017", "2020", table, patch_area_min=-1)
    with pytest.raises(ValueError, match="Layer '1999' not found"):
        transition(panel, GRID, "1999", "2020", table)
    with pytest.raises(ValueError, match="named list"):
        transition(panel.drop("layer"), GRID, "2017", "2020", table)
    with pytest.raises(ValueError, match="projected CRS"):
        transition(panel, GridSpec(0, 1, 1, 1, 1, 1, "EPSG:4326"), "2017", "2020", table)
    with pytest.raises(ValueError, match="unit"):
        transition(panel, GRID, "2017", "2020", table, unit="acre")
