"""Season-trend monitoring: when a pixel's index leaves the model of its own history.

A linear trend and ``order`` harmonics are fitted to the observations before ``start`` by least
squares; afterwards moving sums of the residuals are watched. The first crossing of the boundary
is the break; the magnitude is the median residual after ``start`` (negative: a drop). After
Verbesselt, Zeileis and Herold (2012), with the OLS-MOSUM process of Leisch, Hornik and Kuan (2000).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Critical values of the boundary for a window of a quarter of the history and monitoring up to
#: ten times its length, by level: quantiles of the limit process in our own Monte Carlo (see
#: ``simulated``); the last digit is uncertain.
CRITICAL = {0.001: 1.73, 0.0025: 1.65, 0.005: 1.58, 0.01: 1.51, 0.02: 1.43, 0.03: 1.39, 0.05: 1.33, 0.075: 1.28, 0.1: 1.24, 0.15: 1.18, 0.2: 1.14, 0.3: 1.08, 0.5: 0.98}
#: Of the reverse CUSUM test at 5 percent (Brown, Durbin and Evans, 1975).
CUSUM_CRITICAL = 0.948
WINDOW = 0.25


def critical(level: float) -> float:
    """The boundary's critical value at a level; between the known ones, along the logarithm of the level."""
    if isinstance(level, bool) or not isinstance(level, int | float) or not min(CRITICAL) <= level <= max(CRITICAL):
        raise ValueError(f"level must be from {min(CRITICAL)} to {max(CRITICAL)}")
    known = sorted(CRITICAL)
    return float(np.interp(np.log(level), np.log(known), [CRITICAL[k] for k in known]))


def simulated(levels: list[float], paths: int, steps: int = 400, period: int = 10, seed: int = 1) -> list[float]:
    """Critical values at some levels by paths of the limit process: moving increments of a Brownian motion less its rise over the history, against the boundary."""
    rng, width, most = np.random.default_rng(seed), int(WINDOW * steps), []
    time = np.arange(steps + 1, period * steps + 1) / steps
    shape = np.sqrt(2 * np.where(time > np.e, np.log(time), 1.0))
    for _ in range(0, paths, 500):
        path = np.concatenate([np.zeros((500, 1)), np.cumsum(rng.standard_normal((500, period * steps)) / np.sqrt(steps), 1)], 1)
        moving = path[:, steps + 1 :] - path[:, steps + 1 - width : -width] - WINDOW * path[:, [steps]]
        most.append((np.abs(moving) / shape).max(1))
    return [float(np.quantile(np.concatenate(most), 1 - x)) for x in levels]


def cadence_frequency(times: list[date]) -> int | None:
    """Layers per year, by the median gap in days: 12, 4, 1 or None."""
    if len(times) < 2:
        return None
    gap = float(np.median(np.diff([t.toordinal() for t in sorted(times)])))
    return next((f for low, high, f in ((26, 32, 12), (85, 95, 4), (360, 370, 1)) if low <= gap <= high), None)


def design(time: np.ndarray, frequency: int, order: int) -> np.ndarray:
    """Intercept, trend and harmonics; with a frequency of f, harmonics beyond f / 2 say nothing new."""
    columns = [np.ones(len(time)), (time - time[0]) * frequency + 1]
    for k in range(1, min(order, frequency // 2) + 1):
        columns.append(np.cos(2 * np.pi * k * time))
        if 2 * k != frequency:
            columns.append(np.sin(2 * np.pi * k * time))
    return np.stack(columns, 1)


#: A history determines a fit if the least eigenvalue of its products isn't below this share of the greatest.
DETERMINED = 1e-10


def advance(inverse: np.ndarray, beta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Takes one more observation into many fits (last axis) at once, in place: the errors of its forecast, and their spread."""
    gain = np.einsum("ijs,js->is", inverse, x)
    spread, error = 1 + (x * gain).sum(0), y - (x * beta).sum(0)
    share = gain / spread
    inverse -= gain[:, None] * share[None]
    beta += share * error
    return error, spread


def centred(x: np.ndarray) -> np.ndarray:
    """The same designs with a trend from -1 to 1, which changes no fit but keeps products near one another."""
    out = x.copy()
    low, high = x[..., 1].min(initial=np.inf), x[..., 1].max(initial=-np.inf)
    out[..., 1] = (2 * x[..., 1] - low - high) / max(high - low, 1.0)
    return out


def stable_since(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First observation of the stable end of each history (pixel, time): reverse recursive residuals, CUSUM test.

    ``n`` observations of each count. Residuals begin where the later observations determine a fit. All
    pixels go through the steps together.
    """
    x, k = centred(x), x.shape[2]
    pixels, steps = np.arange(len(x)), int(n.max(initial=0))
    back = np.maximum(n[:, None] - 1 - np.arange(steps), 0)
    x, y = np.take_along_axis(x, back[:, :, None], 1), np.take_along_axis(y, back, 1)
    inverse, beta = np.zeros((k, k, len(x))), np.zeros((k, len(x)))
    began, residual = np.full(len(x), steps), np.zeros((len(x), steps))
    products = np.einsum("pti,ptj->pij", x[:, : k - 1], x[:, : k - 1]) if steps >= k else None
    for i in range(k, steps):
        products = products + x[:, i - 1, :, None] * x[:, i - 1, None]
        waiting = pixels[(began == steps) & (n > i)]
        if len(waiting):
            values = np.linalg.eigvalsh(products[waiting])
            new = waiting[values[:, 0] > DETERMINED * values[:, -1]]
            if len(new):
                root = np.linalg.pinv(x[new, :i])
                inverse[:, :, new] = (root @ root.transpose(0, 2, 1)).transpose(1, 2, 0)
                beta[:, new] = np.einsum("pit,pt->ip", root, y[new, :i])
                began[new] = i
        if len(on := pixels[(began <= i) & (n > i)]):
            own, fit = inverse[:, :, on], beta[:, on]
            error, spread = advance(own, fit, x[on, i].T, y[on, i])
            inverse[:, :, on], beta[:, on] = own, fit
            residual[on, i] = error / np.sqrt(spread)
    count = np.maximum(n - began, 0)
    told = (np.arange(steps) >= began[:, None]) & (np.arange(steps) < n[:, None])
    mean = residual.sum(1) / np.maximum(count, 1)
    scale = np.sqrt((np.where(told, residual - mean[:, None], 0.0) ** 2).sum(1) / np.maximum(count - 1, 1))
    steady = (count < 2) | ~(scale > 1e-12)
    path = np.abs(np.cumsum(residual, 1)) / np.where(steady, 1.0, scale * np.sqrt(np.maximum(count, 1)))[:, None]
    bound = CUSUM_CRITICAL * (1 + 2 * (np.arange(steps) - began[:, None] + 1) / np.maximum(count, 1)[:, None])
    over = (path > bound) & told & ~steady[:, None]
    return np.where(over.any(1), n - over.argmax(1), 0) if steps else np.zeros(len(x), np.int64)


#: Segments of histories (numbers of a table) that are worked on together.
SEGMENTS = 2_000_000


def last_segment(x: np.ndarray, y: np.ndarray, n: np.ndarray, least: float = 0.15, most: int = 5) -> np.ndarray:
    """First observation of the last segment of each history: least squares over segments (Bai and Perron), their number by BIC.

    A segment's squares grow by those of the forecast of each further observation, so that all starts of
    all pixels grow together. ``n`` observations of each history (pixel, time) count.
    """
    x, steps = centred(x), int(n.max(initial=0))
    out, size = np.zeros(len(x), np.int64), max(1, SEGMENTS // max(1, steps * (steps + 1)))
    for at in range(0, len(x) if steps else 0, size):
        some = slice(at, at + size)
        out[some] = _last_segment(x[some, :steps], y[some, :steps], n[some], least, most)
    return out


def _last_segment(x: np.ndarray, y: np.ndarray, n: np.ndarray, least: float, most: int) -> np.ndarray:
    count, steps, k = x.shape
    h = np.maximum((least * n).astype(np.int64), k + 1)
    running = lambda v: np.concatenate([np.zeros((count, 1, *v.shape[2:])), np.cumsum(v, 1)], 1)
    xx, xy, yy = running(x[..., :, None] * x[..., None, :]), running(x * y[..., None]), running(y * y)
    pixel, start = np.nonzero(np.arange(steps) + h[:, None] <= n[:, None])
    stop = start + h[pixel]
    products, right = xx[pixel, stop] - xx[pixel, start], xy[pixel, stop] - xy[pixel, start]
    values = np.linalg.eigvalsh(products)
    clear = values[:, 0] > DETERMINED * values[:, -1]
    inverse = np.empty_like(products)
    inverse[clear] = np.linalg.inv(products[clear])
    inverse[~clear] = np.linalg.pinv(products[~clear], rcond=DETERMINED, hermitian=True)
    beta = np.einsum("sij,sj->si", inverse, right)
    squares = np.maximum(yy[pixel, stop] - yy[pixel, start] - np.einsum("si,si->s", beta, right), 0)
    rss = np.full((count, steps, steps + 1), np.inf)
    rss[pixel, start, stop] = squares
    # Starts that don't determine a fit by their first h observations are rare: each length of theirs is solved anew.
    for p, a in zip(pixel[~clear], start[~clear]):
        ends = np.arange(a + h[p] + 1, n[p] + 1)
        own, to = xx[p, ends] - xx[p, a], xy[p, ends] - xy[p, a]
        fit = np.einsum("sij,sj->si", np.linalg.pinv(own, rcond=DETERMINED, hermitian=True), to)
        rss[p, a, ends] = np.maximum(yy[p, ends] - yy[p, a] - np.einsum("si,si->s", fit, to), 0)
    pixel, start, stop, squares = (v[clear] for v in (pixel, start, stop, squares))
    inverse, beta = np.ascontiguousarray(inverse[clear].transpose(1, 2, 0)), np.ascontiguousarray(beta[clear].T)
    flat_x, flat_y = np.ascontiguousarray(x.reshape(-1, k).T), y.ravel()
    while len(pixel):
        on = stop < n[pixel]
        if not on.all():
            pixel, start, stop, squares, inverse, beta = pixel[on], start[on], stop[on], squares[on], inverse[:, :, on], beta[:, on]
        row = pixel * steps + stop
        error, spread = advance(inverse, beta, flat_x[:, row], flat_y[row])
        squares, stop = squares + error**2 / spread, stop + 1
        rss[pixel, start, stop] = squares
    own, end = np.arange(count), np.minimum(n, steps)
    best, back, told = rss[:, 0], [np.zeros(count, np.int64)], []
    floor = n * (1e-9 * (1 + np.abs(y).max(1, initial=0))) ** 2
    for m in range(most + 1):
        whole = best[own, end]
        told.append(np.where(np.isfinite(whole), n * np.log(np.maximum(whole, floor) / np.maximum(n, 1)) + (m + 1) * (k + 1) * np.log(np.maximum(n, 1)), np.inf))
        if m < most:
            cost = best[:, :steps, None] + rss
            back.append(cost[own, :, end].argmin(1))
            best = cost.min(1)
    return np.stack(back)[np.argmin(told, 0), own]


def monitor(values: np.ndarray, time: np.ndarray, frequency: int, start: float, order: int, level: float, history: str, min_obs: int) -> tuple[np.ndarray, np.ndarray]:
    """Break time and magnitude of each row; NaN where there is none, as where a history doesn't determine the fit.

    All rows at once: the observations of each are moved to its front, whatever its gaps, and
    the fits are solved as one stack of normal equations.
    """
    dates, sizes = np.full(len(values), np.nan), np.full(len(values), np.nan)
    known = ~np.isnan(values)
    past_all, count_all = (known & (time < start - 1e-9)).sum(1), known.sum(1)
    rows = np.flatnonzero(count_all >= min_obs)
    if not len(rows):
        return dates, sizes
    order_ = np.argsort(~known[rows], axis=1, kind="stable")
    x_all = design(time, frequency, order)
    first = np.zeros(len(rows), np.int64)
    if history != "all":
        some = np.flatnonzero(past_all[rows] > x_all.shape[1])
        most = int(past_all[rows[some]].max(initial=0))
        at = order_[some, :most]
        own = np.where(np.arange(most) < past_all[rows[some], None], np.take_along_axis(values[rows[some]], at, 1), 0.0)
        first[some] = (stable_since if history == "ROC" else last_segment)(x_all[at], own, past_all[rows[some]])
    steps = np.arange(values.shape[1])
    n, m = past_all[rows] - first, count_all[rows] - first
    width = np.floor(WINDOW * n).astype(np.int64)
    good = (n > x_all.shape[1]) & (width > 1) & (n < m)
    rows, order_, first, n, m, width = (v[good] for v in (rows, order_, first, n, m, width))
    if not len(rows):
        return dates, sizes
    at = np.take_along_axis(order_, np.minimum(steps + first[:, None], len(steps) - 1), 1)
    inside, told = steps < m[:, None], steps < n[:, None]
    y = np.where(inside, np.take_along_axis(values[rows], at, 1), 0.0)
    x = x_all[at]
    x = centred(x)
    weighed = x * told[:, :, None]
    spread = np.linalg.eigvalsh(weighed.transpose(0, 2, 1) @ weighed)
    clear = spread[:, 0] > DETERMINED * spread[:, -1]
    rows, n, m, width, at, inside, told, y, x = (v[clear] for v in (rows, n, m, width, at, inside, told, y, x))
    if not len(rows):
        return dates, sizes
    weighed = weighed[clear]
    beta = np.einsum("pij,pj->pi", np.linalg.pinv(weighed.transpose(0, 2, 1) @ x, hermitian=True), np.einsum("pti,pt->pi", weighed, y))
    residual = np.where(inside, y - np.einsum("pti,pi->pt", x, beta), 0.0)
    sigma = np.sqrt((np.where(told, residual, 0.0) ** 2).sum(1) / (n - x.shape[2]))
    total = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(residual, 1)], 1)
    k = steps + 1
    moving = total[:, 1:] - np.take_along_axis(total, np.maximum(k - width[:, None], 0), 1)
    floor = np.maximum(sigma, 1e-9 * (1 + np.abs(y).max(1)))
    ratio = np.maximum(k / n[:, None], 1.0)
    bound = critical(level) * np.sqrt(2 * np.where(ratio > np.e, np.log(ratio), 1.0))
    over = (np.abs(moving) / (floor * np.sqrt(n))[:, None] > bound) & inside & ~told
    crossed = over.any(1)
    dates[rows[crossed]] = time[np.take_along_axis(at, over.argmax(1)[:, None], 1)[:, 0][crossed]]
    sizes[rows] = np.nanmedian(np.where(inside & ~told, residual, np.nan), 1)
    return dates, sizes


def break_monitor(
    stack: DataFrame,
    *,
    history: str = "all",
    start: tuple[int, int] = (2022, 1),
    frequency: int | None = None,
    order: int = 3,
    level: float = 0.01,
    min_obs: int = 6,
) -> DataFrame:
    """(row, col, break_date, break_mag) of a stack (row, col, t DATE, y): every pixel of the stack, nulls where nothing is found.

    ``break_date`` is a decimal year. The series runs from the first layer without gaps, so months
    without a layer must be rows with a null y (see ``sources.cube.month_spine``).
    """
    if missing := {"row", "col", "t", "y"} - set(stack.columns):
        raise ValueError(f"break_monitor needs a time stack; it lacks {', '.join(sorted(missing))}")
    if history not in ("all", "ROC", "BP"):
        raise ValueError("history must be one of all, ROC, BP")
    critical(level)
    times = [r.t for r in stack.select(F.col("t").cast("date").alias("t")).distinct().orderBy("t").collect()]  # a row per layer
    if any(t is None for t in times):
        raise ValueError("the stack must carry a time value for every layer")
    cadence = cadence_frequency(times)
    if cadence is None:
        raise ValueError("Unsupported layer cadence; use a monthly or annual stack")
    if frequency is not None and frequency != cadence:
        raise ValueError(f"frequency ({frequency}) disagrees with the layer cadence (= {cadence})")
    first = times[0].year + ((times[0].month - 1) * cadence // 12) / cadence
    axis = first + np.arange(len(times)) / cadence
    began, days = start[0] + (start[1] - 1) / cadence, np.array([(t - date(1970, 1, 1)).days for t in times])
    usable = F.when(F.isnan("y"), None).otherwise(F.col("y"))
    day = F.unix_date(F.col("t").cast("date"))
    pixels = stack.groupBy("row", "col").agg(F.collect_list(F.when(usable.isNotNull(), F.struct(day.alias("d"), usable.cast("double").alias("y")))).alias("ts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                series = batch.column("ts")
                flat = series.flatten()
                values = np.full((batch.num_rows, len(axis)), np.nan)
                owner = np.repeat(np.arange(batch.num_rows), series.value_lengths().to_numpy(zero_copy_only=False))
                values[owner, np.searchsorted(days, flat.field(0).to_numpy(zero_copy_only=False))] = flat.field(1).to_numpy(zero_copy_only=False)
                found = monitor(values, axis, cadence, began, order, level, history, min_obs)
                columns = [pa.array(v, mask=np.isnan(v)) for v in found]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("col"), *columns], names=["row", "col", "break_date", "break_mag"])

    return pixels.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "ts").mapInArrow(run, "row int, col int, break_date double, break_mag double")
