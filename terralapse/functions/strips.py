"""Polygons by the rows of a grid: every run or cell looks at the edges of its own row only.

Polygons are valid: edges that don't cross, with the inside to the left (``planar.boundary``), and a
number for each polygon. Edges are sorted by the first row that they meet; for a band of rows they
are cut at the rows' sides, all at once. Whatever is asked of a run of cells is then a search
among sorted whole numbers (polygon and row, then column):

- its area inside, by sums over the pieces to the right of its two ends, kept as running totals,
  and by those few pieces that pass over an end;
- whether it touches a piece, by the columns that pieces begin and end in;
- which centres are inside, by the columns where the boundary passes the height of the centres.

Bands are worked out when they are first asked for and kept while they are few.
"""

from __future__ import annotations

import numpy as np

from terralapse.functions.planar import spans
from terralapse.grid import GridSpec

#: Rows that are worked out together.
BAND = 64
#: Numbers that are kept of bands: some 200 MB.
KEPT = 24_000_000


class Band:
    """What the edges say of the rows ``first`` to ``last``, of all polygons."""

    def __init__(self, grid: GridSpec, poly: np.ndarray, e: np.ndarray, rows: np.ndarray, first: int, last: int):
        self.grid, self.first, self.n = grid, first, last - first + 1
        self.wide = grid.ncol + 4
        top, low = rows
        of, row = spans(np.maximum(top, first), np.minimum(low, last))
        p, x0, y0, x1, y1 = poly[of], *e[of].T
        self.key_row = lambda p, r: p * self.n + (r - first)
        line = self.key_row(p, row)
        upper = grid.ymax - row * grid.resy
        lower = grid.ymax - (row + 1) * grid.resy
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(y0 == y1, 0.0, (x1 - x0) / (y1 - y0))
        ya, yb = np.clip(y0, lower, upper), np.clip(y1, lower, upper)
        xa = np.where((ya == y0) | (y0 == y1), x0, x0 + (ya - y0) * slope) - grid.xmin
        xb = np.where((yb == y1) | (y0 == y1), x1, x0 + (yb - y0) * slope) - grid.xmin
        left, right, dy = np.minimum(xa, xb), np.maximum(xa, xb), yb - ya
        # Touching: the columns that each piece begins and ends in, both sides included.
        begin = self.clipped(np.ceil(left / grid.resx) - 1)
        end = self.clipped(np.floor(right / grid.resx))
        self.begins, self.ends = np.sort(self.keys(line, begin)), np.sort(self.keys(line, end))
        # Area: pieces at or to the right of a column's left side, and those that pass over it.
        whole = dy != 0
        line, left, right, dy = line[whole], left[whole], right[whole], dy[whole]
        at = np.floor(left / grid.resx)
        key = self.keys(line, self.clipped(at))
        order = np.argsort(key, kind="stable")
        self.right_of = key[order]
        self.totals = np.concatenate([np.zeros((2, 1)), np.cumsum(np.stack([dy, dy * (left + right) / 2])[:, order], 1)], 1)
        over, column = spans(np.maximum(at + 1, 0).astype(np.int64), np.minimum(np.ceil(right / grid.resx) - 1, grid.ncol).astype(np.int64))
        part = dy[over] * (right[over] - column * grid.resx) ** 2 / (2 * (right[over] - left[over]))
        self.passed, where = np.unique(self.keys(line[over], column), return_inverse=True)
        self.passing = np.bincount(where.ravel(), part, len(self.passed))
        # Centres: the first column whose centre isn't left of the crossing.
        y = grid.ymax - (row + 0.5) * grid.resy
        crosses = (y0 > y) != (y1 > y)
        x = (x0 + (y - y0) * slope)[crosses]
        c = np.ceil((x - grid.xmin) / grid.resx - 0.5)
        centre = lambda c: grid.xmin + (c + 0.5) * grid.resx
        c = np.where(centre(c - 1) >= x, c - 1, np.where(centre(c) < x, c + 1, c))
        key = self.keys(self.key_row(p, row)[crosses], self.clipped(c))
        order = np.argsort(key, kind="stable")
        self.crossings = key[order]
        # How many polygons begin less those that end there: pieces that go down have the inside to the east.
        self.depth = np.concatenate([[0], np.cumsum(np.where(y1 < y0, 1, -1)[crosses][order])])
        self.size = sum(len(x) for x in (self.begins, self.ends, self.right_of, self.right_of, self.right_of, self.passed, self.passed, self.crossings, self.crossings))

    def clipped(self, column: np.ndarray) -> np.ndarray:
        return np.clip(column, -1, self.grid.ncol + 1).astype(np.int64)

    def keys(self, line: np.ndarray, column: np.ndarray) -> np.ndarray:
        return line * self.wide + (column + 1)

    def area(self, poly: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The area inside of runs of cells from column a to b."""
        line = self.key_row(poly, row)
        stop = np.searchsorted(self.right_of, (line + 1) * self.wide, "left")

        def beyond(column):
            key = self.keys(line, column)
            one, first = (t[stop] - t[np.searchsorted(self.right_of, key, "left")] for t in self.totals)
            total = first - column * self.grid.resx * one
            if len(self.passed):
                at = np.minimum(np.searchsorted(self.passed, key), len(self.passed) - 1)
                total = total + np.where(self.passed[at] == key, self.passing[at], 0.0)
            return total

        found = beyond(a) - beyond(b + 1)
        # Running totals leave a last digit where nothing is.
        found = np.where(found > 1e-9 * self.grid.cell_area, found, 0.0)
        full = (b - a + 1) * self.grid.cell_area
        return np.where(np.abs(found - full) < 1e-9 * full, full, found)

    def touches(self, poly: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which runs, sides included, meet the boundary."""
        line = self.key_row(poly, row)
        start = line * self.wide
        begun = np.searchsorted(self.begins, self.keys(line, b), "right") - np.searchsorted(self.begins, start, "left")
        ended = np.searchsorted(self.ends, self.keys(line, a), "left") - np.searchsorted(self.ends, start, "left")
        return begun > ended

    def centres(self, poly: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, first column, last column) of the cells of runs whose centres are inside."""
        line = self.key_row(poly, row)
        start = np.searchsorted(self.crossings, line * self.wide, "left")
        low = (np.searchsorted(self.crossings, self.keys(line, a), "right") - start) // 2 * 2 + start
        high = (np.searchsorted(self.crossings, self.keys(line, b), "right") - start + 1) // 2 * 2 + start
        of, pair = spans(low, high - 1)
        first = (pair - start[of]) % 2 == 0
        of, pair = of[first], pair[first]
        enter, leave = (self.crossings[pair + k] - line[of] * self.wide - 1 for k in (0, 1))
        enter, leave = np.maximum(enter, a[of]), np.minimum(leave - 1, b[of])
        some = enter <= leave
        return of[some], enter[some], leave[some]

    def inside(self, poly: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        line = self.key_row(poly, row)
        upto, start = np.searchsorted(self.crossings, self.keys(line, np.clip(col, -1, self.grid.ncol + 1)), "right"), np.searchsorted(self.crossings, line * self.wide, "left")
        return self.depth[upto] > self.depth[start]


class Strips:
    """Polygons, each a table of valid edges, over a grid; ``together``: as one, and inside is what any has inside."""

    def __init__(self, grid: GridSpec, shapes: list[np.ndarray], together: bool = False):
        self.grid = grid
        poly = np.repeat(np.zeros(len(shapes), np.int64) if together else np.arange(len(shapes)), [len(s) for s in shapes])
        e = np.concatenate([*shapes, np.zeros((0, 4))])
        top = np.ceil((grid.ymax - np.maximum(e[:, 1], e[:, 3])) / grid.resy).astype(np.int64) - 1
        low = np.floor((grid.ymax - np.minimum(e[:, 1], e[:, 3])) / grid.resy).astype(np.int64)
        order = np.argsort(top, kind="stable")
        self.poly, self.e, self.rows = poly[order], e[order], (top[order], low[order])
        self.reach = np.maximum.accumulate(self.rows[1]) if len(e) else low
        self.bands: dict[int, Band] = {}
        self.size = 0

    def band(self, k: int) -> Band:
        if k not in self.bands:
            first, last = k * BAND, (k + 1) * BAND - 1
            # Sorted by first row: those that begin too late are cut off, and so are all before one that reaches the band.
            some = slice(int(np.searchsorted(self.reach, first, "left")), int(np.searchsorted(self.rows[0], last, "right")))
            here = np.flatnonzero(self.rows[1][some] >= first) + some.start
            made = Band(self.grid, self.poly[here], self.e[here], (self.rows[0][here], self.rows[1][here]), first, last)
            if self.size + made.size > KEPT:
                self.bands, self.size = {}, 0
            self.bands[k] = made
            self.size += made.size
        return self.bands[k]

    def by_band(self, row: np.ndarray):
        """(band, which runs are in it)."""
        k = row // BAND
        order = np.argsort(k, kind="stable")
        cuts = np.flatnonzero(np.diff(k[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            yield self.band(int(k[part[0]])), part

    def measured(self, poly, row, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Of each run the area inside a polygon, and whether they touch."""
        area, touch = np.zeros(len(row)), np.zeros(len(row), bool)
        for band, i in self.by_band(row):
            area[i] = band.area(poly[i], row[i], a[i], b[i])
            touch[i] = (area[i] > 0) | band.touches(poly[i], row[i], a[i], b[i])
        return area, touch

    def centres(self, poly, row, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for band, i in self.by_band(row):
            of, first, last = band.centres(poly[i], row[i], a[i], b[i])
            found.append((i[of], first, last))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def inside(self, poly, row, col) -> np.ndarray:
        out = np.zeros(len(row), bool)
        for band, i in self.by_band(row):
            out[i] = band.inside(poly[i], row[i], col[i])
        return out

    def met(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(polygon, row, column) of every cell of the grid that a polygon meets, sides included."""
        if not len(self.e):
            return (np.zeros(0, np.int64),) * 3
        first, last = max(int(self.rows[0].min()), 0), min(int(self.rows[1].max()), self.grid.nrow - 1)
        out = []
        for k in range(first // BAND, last // BAND + 1) if last >= first else []:
            band = self.band(k)
            touched = np.unique(np.concatenate([band.begins, band.crossings]) // band.wide)
            poly, row = touched // band.n, touched % band.n + band.first
            good = (row >= first) & (row <= last)
            poly, row = poly[good], row[good]
            zero, end = np.zeros(len(row), np.int64), np.full(len(row), self.grid.ncol - 1)
            of, a, b = band.centres(poly, row, zero, end)
            begin, stop = band.begins, band.ends
            # Pieces' own columns: begins and ends of a line are as many, and sorted alike they cover the same columns.
            line = begin // band.wide
            x0, x1 = begin % band.wide - 1, stop % band.wide - 1
            p, r = line // band.n, line % band.n + band.first
            poly, row = np.concatenate([poly[of], p]), np.concatenate([row[of], r])
            i, col = spans(np.maximum(np.concatenate([a, x0]), 0), np.minimum(np.concatenate([b, x1]), self.grid.ncol - 1))
            good = (row[i] >= first) & (row[i] <= last)
            out.append(np.unique(np.stack([poly[i][good], row[i][good], col[good]]), axis=1))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
