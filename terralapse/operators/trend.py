"""Robust trends: Theil-Sen slope and the Mann-Kendall test, pixel by pixel.

Signs of all pairs are counted bit by bit of the values' ranks, all pixels at once, without pairs. The
median slope of a short series comes from its pairs; that of a long one by selection: a bracket from a
sample of pairs, narrowed by counts of inversions until the slopes inside are few, which are then
told by merging. Either way it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.functions.planar import spans

#: Observations of a series whose pairs are all looked at, and pairs that are held at a time.
SHORT, PAIRS = 256, 2_000_000


def series(stack: DataFrame) -> DataFrame:
    """(row, col, n, ts): observations of each pixel in time order, t in years (days since 1970 / 365.25); nulls and NaN are left out."""
    y = F.when(F.isnan("y"), None).otherwise(F.col("y"))
    t = F.date_diff("t", F.lit("1970-01-01").cast("date")) / F.lit(365.25)
    pairs = F.array_sort(F.collect_list(F.when(y.isNotNull(), F.struct(t.alias("t"), y.alias("y")))))
    return stack.groupBy("row", "col").agg(pairs.alias("ts")).withColumn("n", F.size("ts"))


def concordance(owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each owner the pairs that rise less those that fall; ranks of one owner in order of time, equal ones tie.

    Two ranks compare by the first bit in which they differ: bit by bit, a group is what agrees so far.
    """
    size = int(owner.max(initial=-1)) + 1
    out, group = np.zeros(size, np.int64), owner.astype(np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(group)]])))
        ones = np.cumsum(one) - one
        ones -= ones[first][place]
        zeros = np.arange(len(group)) - first[place] - ones
        out += np.bincount(owner, np.where(one == 1, zeros, -ones), size).astype(np.int64)
        order = np.argsort(place * 2 + one, kind="stable")
        owner, rank = owner[order], rank[order]
        group = (place * 2 + one)[order]
    return out


def falling(z: np.ndarray) -> int:
    """How many pairs i < j have z[j] <= z[i]."""
    rank = np.unique(z, return_inverse=True)[1].ravel()
    ties = np.bincount(rank)
    tied = int((ties * (ties - 1) // 2).sum())
    pairs, n = len(z) * (len(z) - 1) // 2, len(z)
    s = int(concordance(np.zeros(n, np.int64), rank)[0]) if n else 0
    return (pairs - tied - s) // 2 + tied


def inverted(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j with place[i] > place[j] of a permutation, by merging blocks of twice the size at a time."""
    n, width, found = len(place), 1, []
    index = np.arange(n)
    while width < n:
        left = index // width % 2 == 0
        # Positions are sorted by place within their half; a right one falls below the rest of its left half.
        half = index // width
        order = np.lexsort((place, half))
        key = half[order] * n + place[order]
        right = order[~left[order]]
        start = np.searchsorted(key, (half[right] - 1) * n + place[right])
        stop = np.searchsorted(key, half[right] * n)
        of, at = spans(start, stop - 1)
        found.append(np.stack([order[at], right[of]]))
        width *= 2
    pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def selected(t: np.ndarray, y: np.ndarray, most: int = PAIRS) -> float:
    """The median of (y[j] - y[i]) / (t[j] - t[i]) over all i < j of a long series in order of time, holding at most some ``most`` slopes."""
    n = len(t)
    t, total = t - t[0], n * (n - 1) // 2
    ranks = ((total - 1) // 2, total // 2)
    rng = np.random.default_rng(n)
    i, j = rng.integers(0, n, (2, 4 * n))
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    sample = np.sort((y[j] - y[i]) / (t[j] - t[i]))
    order = lambda m: np.lexsort((-np.arange(n), y - m * t))
    below = lambda m: falling(y - m * t)
    if np.ptp(y) == 0:
        return 0.0
    # Slopes that agree to so much count as one, where too many of them tie to be told one by one.
    same = 1e-13 * max(np.ptp(y) / t[-1], float(np.abs(np.quantile(sample, (0.4, 0.6))).max()))
    one = lambda low, high: 0.0 if low <= 0 <= high else (low + high) / 2
    wide = 3 / sqrt(len(sample))
    step = np.diff(t).min()
    ends = (-2 * np.ptp(y) / step - 1, 2 * np.ptp(y) / step + 1)
    low, high = (float(np.quantile(sample, q)) for q in (0.5 - wide, 0.5 + wide))
    low, high = low - 1e-9 * (1 + abs(low)), high + 1e-9 * (1 + abs(high))
    under, upto = below(low), below(high)
    if not under <= ranks[0]:
        low, under = ends[0], 0
    if not upto > ranks[1]:
        high, upto = ends[1], total
    while upto - under > most and high - low > same:
        m = (low + high) / 2
        count = below(m)
        if count <= ranks[0]:
            low, under = m, count
        elif count > ranks[1]:
            high, upto = m, count
        else:
            # The two middle slopes lie on both sides.
            break
    if upto - under > most and not high - low > same:
        return one(low, high)
    if upto - under > most:
        near = lambda a, b, rank: _ranked(t, y, a, b, rank, below, order, most, same, one)
        return (near(low, m, ranks[0]) + near(m, high, ranks[1])) / 2
    return float(np.mean(_between(t, y, low, high, order)[[ranks[0] - under, ranks[1] - under]]))


def _between(t, y, low, high, order) -> np.ndarray:
    """The slopes above ``low`` up to ``high``, sorted: of pairs whose order by y - m t changes on the way."""
    before, after = order(low), order(high)
    place = np.empty(len(t), np.int64)
    place[after] = np.arange(len(t))
    a, b = inverted(place[before])
    a, b = before[a], before[b]
    return np.sort((y[b] - y[a]) / (t[b] - t[a]))


def _ranked(t, y, low, high, rank, below, order, most, same, one) -> float:
    under, upto = below(low), below(high)
    while upto - under > most and high - low > same:
        m = (low + high) / 2
        if (count := below(m)) <= rank:
            low, under = m, count
        else:
            high, upto = m, count
    return one(low, high) if upto - under > most else float(_between(t, y, low, high, order)[rank - under])


def short_medians(t: np.ndarray, y: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median slopes of series that begin at ``first`` and have ``n`` observations, by all their pairs."""
    out = np.empty(len(n))
    for size in np.unique(n):
        i, j = np.triu_indices(size, 1)
        same, many = np.flatnonzero(n == size), max(1, PAIRS // max(1, len(i)))
        for at in range(0, len(same), many):
            own = same[at : at + many]
            a, b = first[own, None] + i, first[own, None] + j
            out[own] = np.median((y[b] - y[a]) / (t[b] - t[a]), axis=1)
    return out


def trend(stack: DataFrame, min_obs: int = 6) -> DataFrame:
    """(row, col, n, trend, s, z, trend_p) of a stack (row, col, t DATE, y) with one value of a pixel at a time.

    Pixels with fewer than ``min_obs`` values (2 at least) stay, with nulls. The variance of s
    has no correction for ties.
    """
    missing = {"row", "col", "t", "y"} - set(stack.columns)
    if missing:
        raise ValueError("trend needs a time stack with row, col, t and y; a time value for every layer")
    least = max(2, int(min_obs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails: dict[float, float] = {}
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("ts").flatten()
            t, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            owner, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            # Ranks within a pixel: equal values share one.
            order = np.lexsort((y, owner))
            new = np.ones(len(y), bool)
            new[1:] = (owner[order][1:] != owner[order][:-1]) | (y[order][1:] != y[order][:-1])
            rank = np.empty(len(y), np.int64)
            rank[order] = np.cumsum(new)
            rank -= np.minimum.reduceat(rank, first[n > 0])[np.cumsum(n > 0)[owner] - 1] if len(y) else 0
            s = np.zeros(len(n), np.int64)
            counted = concordance(owner, rank)
            s[: len(counted)] = counted
            enough = n >= least
            slope = np.full(len(n), np.nan)
            short = enough & (n <= SHORT)
            slope[short] = short_medians(t, y, first[short], n[short])
            for i in np.flatnonzero(enough & ~short):
                own = slice(first[i], first[i] + n[i])
                slope[i] = selected(t[own], y[own])
            m = n.astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                z = (s - np.sign(s)) / np.sqrt(m * (m - 1) * (2 * m + 5) / 18)
            # The tail is a function of n and s alone, so few different values.
            for x in np.unique(z[enough]):
                tails.setdefault(x, erfc(abs(x) / sqrt(2)))
            p = [tails[x] if e else None for x, e in zip(z, enough)]
            columns = [batch.column("row"), batch.column("col"), batch.column("n"), pa.array(slope, mask=~enough), pa.array(s.astype(np.int64), mask=~enough), pa.array(z, mask=~enough), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "col", "n", "trend", "s", "z", "trend_p"])

    return series(stack).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "n", "ts").mapInArrow(run, "row int, col int, n int, trend double, s long, z double, trend_p double")
