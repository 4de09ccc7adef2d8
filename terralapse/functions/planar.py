"""Planar arrangements of polygon edges: noding, sides, and the rings of what is inside.

Edges are rows of x0, y0, x1, y1. Inside is even-odd, so a ring may cross itself, and rings may
overlap. ``noded`` cuts edges where they meet; of each piece, the parity of the pieces west of it (or
below it, for level ones) tells which of its sides is inside; ``traced`` walks along the pieces
with the inside to the left, so outer rings run counter-clockwise and holes clockwise.

Many small arrangements are worked out together: edges have the number of their ``group``, in
ascending order, and only edges of one group meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that are looked at together.
CHUNK = 1 << 22
#: Edges of small groups that are worked out together.
TOGETHER = 1 << 15


def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, k) with first[i] <= k <= last[i]."""
    n = np.maximum(last - first + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def portions(sizes: np.ndarray, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """(start, stop) of items that come to at most ``most`` in all; a larger item comes alone."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, until
        at = until


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order, each once, and where each of the given ones is among them."""
    order = np.lexsort(rows.T[::-1])
    there = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (there[1:] != there[:-1]).any(1)
    where = np.empty(len(rows), np.int64)
    where[order] = np.cumsum(new) - 1
    return there[new], where


def runs_of(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group starts, and each row's group counted from 0."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def banded(low: np.ndarray, high: np.ndarray, group: np.ndarray, factor: int):
    """A function that gives the bands of heights of rows: of some times the group's mean extent of height each, a group's after those of the one before."""
    starts, own = runs_of(group)
    least, most = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    n = np.diff(np.append(starts, len(group)))
    height = np.maximum(np.maximum(np.add.reduceat(high - low, starts) / n * factor, (most - least) / n), 1e-300)
    count = np.floor((most - least) / height).astype(np.int64) + 1
    before_ = np.cumsum(count) - count
    return lambda y: before_[own] + np.floor((y - least[own]) / height[own]).astype(np.int64)


def near_pairs(e: np.ndarray, group: np.ndarray):
    """Pairs (i, j) of a group's edges whose boxes meet, in chunks: edges are dealt to bands of height, and met by x within a band."""
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    bands = banded(low, high, group, 2)
    b0, b1 = bands(low), bands(high)
    of, band = spans(b0, b1)
    order = np.lexsort((left[of], band))
    of, band = of[order], band[order]
    # An edge meets those after it in its band until one starts to the right of its end.
    starts = np.flatnonzero(np.diff(band, prepend=-1))
    ends = np.append(starts[1:], len(band))
    low_at, high_at = np.arange(len(of)) + 1, np.repeat(ends, ends - starts)
    x, ends_here = left[of], right[of]
    while (open_ := low_at < high_at).any():  # a binary search for all at once
        mid = (low_at + high_at) // 2
        go = open_ & (x[np.minimum(mid, len(x) - 1)] <= ends_here)
        low_at, high_at = np.where(go, mid + 1, low_at), np.where(open_ & ~go, mid, high_at)
    last = low_at - 1
    counts = np.cumsum(np.maximum(last - np.arange(len(of)), 0))
    at = 0
    while at < len(of):
        until = max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + CHUNK, "right")))
        i, j = spans(np.arange(at, until) + 1, last[at:until])
        i = i + at
        own = band[i] == np.maximum(b0[of[i]], b0[of[j]])  # the first band that both are in
        p, q = of[i[own]], of[j[own]]
        keep = (low[p] <= high[q]) & (low[q] <= high[p])
        if keep.any():
            yield p[keep], q[keep]
        at = until


def noded(e: np.ndarray, rounds: int = 30, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges cut at all points where they meet, and which edge each piece is of.

    Points lie on a lattice of 2^-36 of the group's extent. An edge that passes an end of another one closer than the
    lattice's grain goes through it, so that lines that should meet do; it is cut again until nothing changes.
    """
    e = np.asarray(e, float).reshape(-1, 4)
    of = np.arange(len(e))
    if not len(e):
        return e, of
    group = np.zeros(len(e), np.int64) if group is None else group
    starts, own = runs_of(group)
    extent = lambda c: np.maximum.reduceat(e[:, c].max(1), starts) - np.minimum.reduceat(e[:, c].min(1), starts)
    size = np.maximum.reduce([np.maximum.reduceat(np.abs(e).max(1), starts) * 2.0**-12, extent([0, 2]), extent([1, 3]), np.full(len(starts), 1e-280)])
    grains = (2.0 ** (np.floor(np.log2(size)) - 36))[own]
    e = np.round(e / grains[:, None]) * grains[:, None] + 0.0
    long = (e[:, :2] != e[:, 2:]).any(1)
    e, of = e[long], of[long]
    for _ in range(rounds if len(e) else 0):
        cut_edge, cut_at = [], []
        for p, q in near_pairs(e, group[of]):
            grain = grains[of[p]]
            a, r = e[p, :2], e[p, 2:] - e[p, :2]
            c, s = e[q, :2], e[q, 2:] - e[q, :2]
            touched = np.zeros(len(p), bool)
            for own, start, way, ends in ((p, a, r, (c, e[q, 2:])), (q, c, s, (a, e[p, 2:]))):
                length = np.hypot(way[:, 0], way[:, 1])
                for point in ends:
                    d = point - start
                    along = (d * way).sum(1) / length
                    off = np.abs(way[:, 0] * d[:, 1] - way[:, 1] * d[:, 0]) / length
                    on = (off < 0.71 * grain) & (along > -0.71 * grain) & (along < length + 0.71 * grain)
                    touched |= on
                    cut_edge.append(own[on])
                    cut_at.append(point[on])
            det = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
            d = c - a
            with np.errstate(divide="ignore", invalid="ignore"):
                t, u = (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / det, (d[:, 0] * r[:, 1] - d[:, 1] * r[:, 0]) / det
            met = ~touched & (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
            fine = grain[met, None]
            point = np.round((a[met] + t[met, None] * r[met]) / fine) * fine + 0.0
            cut_edge += [p[met], q[met]]
            cut_at += [point, point]
        edge = np.concatenate(cut_edge) if cut_edge else np.zeros(0, np.int64)
        at = np.concatenate(cut_at) if cut_at else np.zeros((0, 2))
        inner = (at != e[edge, :2]).any(1) & (at != e[edge, 2:]).any(1)
        edge, at = edge[inner], at[inner]
        if not len(edge):
            break
        d = e[edge, 2:] - e[edge, :2]
        every = np.concatenate([np.arange(len(e)), edge, np.arange(len(e))])
        place = np.concatenate([np.full(len(e), -np.inf), ((at - e[edge, :2]) * d).sum(1), np.full(len(e), np.inf)])
        points = np.concatenate([e[:, :2], at, e[:, 2:]])
        order = np.lexsort((place, every))
        every, points = every[order], points[order]
        same = (every[1:] == every[:-1]) & (points[1:] != points[:-1]).any(1)
        e, of = np.hstack([points[:-1], points[1:]])[same], of[every[:-1][same]]
    keep = (e[:, :2] != e[:, 2:]).any(1)
    return e[keep], of[keep]


def before(e: np.ndarray, weight: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For the middle of each piece, the sums of ``weight`` (a column for each kind) of its group's pieces west of it at its height, both noded; level ones have none."""
    out = np.zeros((len(e), weight.shape[1]), np.int64)
    up = np.flatnonzero(e[:, 1] != e[:, 3])
    if not len(up):
        return out
    v = e[up]
    low, high = np.minimum(v[:, 1], v[:, 3]), np.maximum(v[:, 1], v[:, 3])
    mid = (low + high) / 2
    at_x = (v[:, 0] + v[:, 2]) / 2
    # Pieces by bands of height: a piece looks at those of the band that its middle is in.
    bands = banded(low, high, group[up], 1)
    of, band = spans(bands(low), bands(high))
    order = np.argsort(band, kind="stable")
    of, band = of[order], band[order]
    own = bands(mid)
    first, last = np.searchsorted(band, own, "left"), np.searchsorted(band, own, "right") - 1
    counts = np.cumsum(last - first + 1)
    at = 0
    while at < len(v):
        until = max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + CHUNK, "right")))
        i, k = spans(first[at:until], last[at:until])
        i, j = i + at, of[k]
        y = mid[i]
        here = (low[j] <= y) & (y < high[j])
        i, j, y = i[here], j[here], y[here]
        x = v[j, 0] + (y - v[j, 1]) * (v[j, 2] - v[j, 0]) / (v[j, 3] - v[j, 1])
        west = (x < at_x[i]) & (i != j)
        np.add.at(out, up[i[west]], weight[up[j[west]]])
        at = until
    return out


def boundaries(e: np.ndarray, kind: np.ndarray, group: np.ndarray, kinds: int, inside=lambda *kinds: np.logical_or.reduce(kinds)) -> tuple[np.ndarray, np.ndarray]:
    """The pieces between what is inside and what isn't, with the inside to the left, and the group of each.

    Edges are of shapes ``kind``, of ``kinds`` in each group. ``inside`` gets for each shape whether a side is in it.
    """
    order = np.argsort(group, kind="stable")
    e, kind, group = e[order], kind[order], group[order]
    pieces, of = noded(e, group=group)
    if not len(pieces):
        return pieces, of
    # A piece that comes twice in one shape is none of it.
    swap = (pieces[:, 1] > pieces[:, 3]) | ((pieces[:, 1] == pieces[:, 3]) & (pieces[:, 0] > pieces[:, 2]))
    pieces[swap] = pieces[swap][:, [2, 3, 0, 1]]  # upwards, or eastwards
    rows, where = distinct(np.column_stack([group[of], pieces]))
    pieces, group = rows[:, 1:], rows[:, 0].astype(np.int64)
    weight = np.zeros((len(pieces), kinds), np.int64)
    np.add.at(weight, (where, kind[of]), 1)
    weight &= 1
    level = pieces[:, 1] == pieces[:, 3]
    side = before(pieces, weight, group)
    if level.any():
        side[level] = before(pieces[:, [1, 0, 3, 2]], weight, group)[level]  # what is below them
    one, other = inside(*(side.T & 1 == 1)), inside(*((side + weight).T & 1 == 1))  # west and east, or below and above
    keep = one != other
    pieces, group, other, level = pieces[keep], group[keep], other[keep], level[keep]
    # Upwards the left is west, eastwards it is above.
    turn = other != level
    pieces[turn] = pieces[turn][:, [2, 3, 0, 1]]
    return pieces, group


def boundary(shapes: list[np.ndarray], inside=lambda *kinds: np.logical_or.reduce(kinds)) -> np.ndarray:
    """The same of one group of shapes."""
    every = np.concatenate([np.asarray(s, float).reshape(-1, 4) for s in shapes]) if shapes else np.zeros((0, 4))
    kind = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    return boundaries(every, kind, np.zeros(len(every), np.int64), len(shapes), inside)[0]


def traced_groups(pieces: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed rings of directed pieces: points, where each ring starts and the last ends, and the group of each; where rings touch in a point, each keeps to itself. Points between two pieces of one line go."""
    if not len(pieces):
        return np.zeros((0, 2)), np.zeros(1, np.int64), np.zeros(0, np.int64)
    points, at = distinct(np.column_stack([np.tile(group, 2), np.concatenate([pieces[:, :2], pieces[:, 2:]])]))
    tail, head = at[: len(pieces)], at[len(pieces) :]
    angle = np.arctan2(pieces[:, 3] - pieces[:, 1], pieces[:, 2] - pieces[:, 0])
    order = np.lexsort((angle, tail))
    starts = np.searchsorted(tail[order], np.arange(len(points) + 1))
    # The way on after a piece is the sharpest turn to the left: the outgoing piece just before the way back, going round.
    back = np.where(angle > 0, angle - np.pi, angle + np.pi)
    following = np.empty(len(pieces), np.int64)
    single = starts[head + 1] - starts[head] == 1
    following[single] = order[starts[head[single]]]
    for i in np.flatnonzero(~single):
        ways = order[starts[head[i]] : starts[head[i] + 1]]
        following[i] = ways[np.argmin(np.mod(back[i] - angle[ways] - 1e-12, 2 * np.pi))]
    seen, after, walk, lengths = [False] * len(pieces), following.tolist(), [], []
    for i in np.lexsort((points[tail, 1], points[tail, 2], points[tail, 0])).tolist():
        begun = len(walk)
        while not seen[i]:
            seen[i] = True
            walk.append(i)
            i = after[i]
        if len(walk) > begun:
            lengths.append(len(walk) - begun)
    walk, lengths = np.array(walk), np.array(lengths)
    some = np.repeat(lengths > 2, lengths)
    walk, ring = walk[some], np.repeat(np.arange(len(lengths)), lengths)[some]
    xy = points[tail[walk], 1:]
    first, last = (np.searchsorted(ring, ring, side) for side in ("left", "right"))
    here = np.arange(len(ring))
    a, b = xy - xy[np.where(here == first, last - 1, here - 1)], xy[np.where(here == last - 1, first, here + 1)] - xy
    bend = a[:, 0] * b[:, 1] != a[:, 1] * b[:, 0]  # a ring without a bend has no inside, and goes
    xy, ring, of = xy[bend], ring[bend], group[walk[bend]]
    first = runs_of(ring)[0]
    n = np.diff(np.append(first, len(ring)))
    ends = np.concatenate([[0], np.cumsum(n + 1)])
    again, place = spans(np.zeros(len(n), np.int64), n)
    return xy[first[again] + np.where(place == n[again], 0, place)], ends, of[first]


def traced(pieces: np.ndarray) -> list[list[tuple[float, float]]]:
    """The same of one group, as lists of points."""
    xy, ends, _ = traced_groups(pieces, np.zeros(len(pieces), np.int64))
    return [[*map(tuple, xy[a:b].tolist())] for a, b in zip(ends[:-1], ends[1:])]


def made_valid(edges: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings that don't cross, of the same inside."""
    return traced(boundary([edges]))


def intersection(a: np.ndarray, b: np.ndarray) -> list[list[tuple[float, float]]]:
    return traced(boundary([a, b], np.logical_and))


def union(shapes: list[np.ndarray]) -> list[list[tuple[float, float]]]:
    return traced(boundary(shapes))


def ring_areas(xy: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of closed rings: holes have areas below zero."""
    ring = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    d = xy - xy[ends[ring]]
    cross = d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]  # of a ring's end and the next one's start it is 0
    return np.bincount(ring[:-1], cross, len(ends) - 1) / 2


def ring_area(rings: list[list[tuple[float, float]]]) -> float:
    """Of valid rings: holes count below zero."""
    total = 0.0
    for ring in rings:
        xy = np.array(ring) - ring[0]
        total += float((xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1]).sum()) / 2
    return total


def edges_area(e: np.ndarray) -> float:
    """Of directed edges with the inside to the left."""
    return float(((e[:, 0] + e[:, 2] - 2 * e[0, 0]) * (e[:, 3] - e[:, 1])).sum()) / 2 if len(e) else 0.0
