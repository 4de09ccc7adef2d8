"""Trends, breaks, indices and composites on series with known answers."""

import datetime as dt
import math

import numpy as np
import pytest

from terralapse.functions.indices import index_expr, index_roles, resolve, scaled
from terralapse.operators.breaks import CRITICAL, break_monitor, cadence_frequency, critical, design, last_segment, monitor, simulated, stable_since
from terralapse.operators.trend import PAIRS, concordance, selected, trend
from terralapse.sources import cube


def months(n, year=2018):
    return [dt.date(year + i // 12, i % 12 + 1, 1) for i in range(n)]


def stack(spark, series, times):
    rows = [(0, c, t, None if v is None else float(v)) for c, values in enumerate(series) for t, v in zip(times, values)]
    return spark.createDataFrame(rows, "row int, col int, t date, y double")


def brute(y, times):
    known = [(t.toordinal() - dt.date(1970, 1, 1).toordinal(), float(v)) for t, v in zip(times, y) if v is not None and v == v]
    pairs = [((b - a) / ((s - t) / 365.25), (b > a) - (b < a)) for i, (t, a) in enumerate(known) for s, b in known[i + 1 :]]
    n, s = len(known), sum(x for _, x in pairs)
    z = (s - (s > 0) + (s < 0)) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return float(np.median([x for x, _ in pairs])), math.erfc(abs(z) / math.sqrt(2))


def test_trend(spark):
    i = np.arange(1, 25)
    rising, falling = 0.40 + 0.01 * i, 0.60 - 0.01 * i
    flat = 0.5 + 0.01 * np.where(i % 2, 1, -1)
    crash = np.where(i > 18, rising - 0.30, rising)
    gaps = [None if k % 5 == 0 else float("nan") if k % 7 == 0 else v for k, v in zip(i, rising)]
    series = [rising, falling, flat, crash, gaps, [None] * 24, [0.1, 0.2, 0.3] + [None] * 21]
    times = months(24)
    got = {r.col: r for r in trend(stack(spark, series, times)).collect()}
    assert len(got) == 7
    for c in range(5):
        slope, p = brute(series[c], times)
        assert got[c].trend == pytest.approx(slope, abs=1e-12) and got[c].trend_p == pytest.approx(p, abs=1e-12)
    assert got[0].trend > 0 and got[0].trend_p < 0.05 and got[1].trend < 0 and got[1].trend_p < 0.05
    assert abs(got[2].trend) < 0.02 and got[2].trend_p > 0.05 and got[3].trend > 0
    assert got[5].trend is None and got[6].trend is None and got[6].trend_p is None
    with pytest.raises(ValueError, match="time stack"):
        trend(stack(spark, series, times).drop("t"))


@pytest.mark.parametrize("most", [PAIRS, 2000, 20])
def test_trends_of_long_series(most):
    """The median slope by selection and the signs by bits equal those of all pairs, whatever the ties and gaps."""
    rng = np.random.default_rng(3)
    for n in (17, 60, 300, 701):
        t = np.sort(rng.choice(20_000, n, replace=False)) / 365.25
        for y in (rng.normal(0, 1, n), rng.integers(0, 3, n).astype(float), np.full(n, 0.5), 0.3 * t + rng.normal(0, 0.1, n)):
            i, j = np.triu_indices(n, 1)
            assert selected(t, y, most) == pytest.approx(np.median((y[j] - y[i]) / (t[j] - t[i])), abs=1e-12)
            assert concordance(np.zeros(n, int), np.unique(y, return_inverse=True)[1])[0] == np.sign(y[j] - y[i]).sum()


def test_a_long_series_beside_short_ones(spark):
    """5,000 observations of one pixel: its 12 million slopes are never held."""
    rng = np.random.default_rng(5)
    days = [dt.date(2000, 1, 1) + dt.timedelta(k) for k in range(5000)]
    long = 0.1 * np.arange(5000) / 365.25 + rng.normal(0, 0.1, 5000)
    got = {r.col: r for r in trend(stack(spark, [long, long[:40], [None] * 5000, long[:1]], days)).collect()}
    i, j = np.triu_indices(5000, 1)
    assert got[0].trend == pytest.approx(np.median((long[j] - long[i]) / ((j - i) / 365.25)), abs=1e-12) and got[0].s == np.sign(long[j] - long[i]).sum()
    assert got[1].trend == pytest.approx(brute(long[:40], days)[0], abs=1e-12) and got[2].n == 0 and got[2].s is None and got[3].trend is None
    assert trend(stack(spark, [], days)).count() == 0


def test_break(spark):
    t = np.arange(72)
    stable = 0.6 + 0.15 * np.sin(2 * np.pi * t / 12)
    drop = np.where(t >= 53, stable - 0.3, stable)
    got = {r.col: r for r in break_monitor(stack(spark, [drop, stable, [None] * 72, np.where(t % 11 == 0, np.nan, drop)], months(72)), order=1).collect()}
    assert len(got) == 4
    for c in (0, 3):
        assert 2022 < got[c].break_date < 2022.9 and got[c].break_mag == pytest.approx(-0.3, abs=0.02)
    assert got[1].break_date is None and got[2].break_date is None and got[2].break_mag is None


@pytest.mark.parametrize("history", ["ROC", "BP"])
def test_break_histories(history):
    """An older disturbance stays out of the history, but for the few values that a CUSUM needs to notice it."""
    rng = np.random.default_rng(1)
    t = np.arange(144)
    time = 2012 + t / 12
    y = 0.5 + 0.1 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.01, 144)
    y[:24] += 0.4
    first = {"ROC": stable_since, "BP": last_segment}[history](design(time, 12, 1)[None, :120], y[None, :120], np.array([120]))[0]
    assert 12 <= first <= 26
    if history == "BP":
        y[132:] -= 0.3
        dates, sizes = monitor(y[None], time, 12, 2022.0, 1, 0.05, history, 6)
        assert 2023 <= dates[0] < 2023.6 and sizes[0] < 0


def test_cadence():
    assert cadence_frequency(months(12)) == 12 and cadence_frequency(months(24)[::3]) == 4 and cadence_frequency(months(36)[::12]) == 1
    assert cadence_frequency(months(1)) is None and cadence_frequency([dt.date(2020, 1, d) for d in (1, 2, 3)]) is None


def test_break_messages(spark):
    with pytest.raises(ValueError, match="Unsupported layer cadence"):
        break_monitor(stack(spark, [[1, 2, 3]], [dt.date(2020, 1, d) for d in (1, 2, 3)]))
    with pytest.raises(ValueError, match="disagrees"):
        break_monitor(stack(spark, [[1, 2, 3]], months(3)), frequency=4)


def test_index_strings():
    assert index_expr("kndvi") == "tanh(pow(((B08 * 0.0001 - 0.1) - (B04 * 0.0001 - 0.1)) / ((B08 * 0.0001 - 0.1) + (B04 * 0.0001 - 0.1)), 2))"
    assert index_expr("ndvi", scale=1, offset=0) == "(B08 - B04) / (B08 + B04)"
    assert index_expr("ndmi", scale=1, offset=0) == "(B08 - B11) / (B08 + B11)"
    assert scaled("nir08", 0.0000275, -0.2) == "(nir08 * 0.0000275 - 0.2)"
    assert index_roles("ndmi") == ["nir", "swir16"]
    with pytest.raises(ValueError, match="Unknown index"):
        resolve("evi", {})
    with pytest.raises(ValueError, match="swir16"):
        resolve("ndmi", {"nir": "a"})


def test_no_step_at_the_offset_boundary(spark):
    """A constant reflectance gives a constant index, with the digital numbers 1000 higher after the boundary."""
    rows = []
    for i, t in enumerate(months(12, 2021) + months(12, 2022)):
        shift = 1000 if t >= dt.date(2022, 1, 25) else 0
        rows += [(f"s{i}", t, 0, 0, 1000 + shift, 3000 + shift, 4), (f"c{i}", t, 0, 0, 9000, 9000, 9), (f"d{i}", t + dt.timedelta(27), 0, 0, 1000 + (1000 if t + dt.timedelta(27) >= dt.date(2022, 1, 25) else 0), 3000 + (1000 if t + dt.timedelta(27) >= dt.date(2022, 1, 25) else 0), 4)]
    pixels = spark.createDataFrame(rows, "scene_id string, scene_date date, row int, col int, B04 int, B08 int, SCL int")
    got = cube.index_stack(pixels, "ndvi").orderBy("t").collect()
    assert len(got) == 24 and all(r.y == pytest.approx(0.5) for r in got)


def test_zero_denominator_and_spine(spark):
    pixels = spark.createDataFrame([("a", dt.date(2018, 1, 5), 0, 0, 0, 0, 4), ("b", dt.date(2018, 4, 5), 0, 0, 100, 300, 4)], "scene_id string, scene_date date, row int, col int, B04 int, B08 int, SCL int")
    got = cube.index_stack(pixels, "ndvi").orderBy("t").collect()
    assert [r.y for r in got] == [None, None, None, pytest.approx(0.5)] and got[1].t == dt.date(2018, 2, 1)


def test_critical_values():
    """Known levels, levels between, and the simulation that they come from."""
    assert critical(0.05) == CRITICAL[0.05] and CRITICAL[0.075] > critical(0.09) > CRITICAL[0.1]
    assert sorted(CRITICAL.values(), reverse=True) == [CRITICAL[k] for k in sorted(CRITICAL)]
    for wrong in (0.0001, 0.6, 0, True, "0.05"):
        with pytest.raises(ValueError, match="level"):
            critical(wrong)
    assert simulated([0.05], 4000)[0] == pytest.approx(CRITICAL[0.05], abs=0.04)


def test_last_segment_finds_the_jump():
    rng = np.random.default_rng(8)
    time = 2018 + np.arange(48) / 12
    y = 0.5 + 0.1 * np.sin(2 * np.pi * time) + rng.normal(0, 0.01, 48) + np.where(np.arange(48) >= 20, 0.4, 0.0)
    both = np.stack([y, y - np.where(np.arange(48) >= 20, 0.4, 0.0)])
    found = last_segment(np.stack([design(time, 12, 1)] * 2), both, np.array([48, 48]))
    assert abs(found[0] - 20) <= 1 and found[1] == 0


def plain_stable_since(x, y):
    (n, k), w, began = x.shape, [], None
    for i in range(k, n):
        later, values = x[n - i :], y[n - i :]
        fit, _, rank, _ = np.linalg.lstsq(later, values, rcond=1e-6)
        if rank == k:
            began = began if began is not None else i
            new = x[n - 1 - i]
            w.append((y[n - 1 - i] - new @ fit) / np.sqrt(1 + new @ np.linalg.pinv(later.T @ later) @ new))
    scale = np.std(w, ddof=1) if len(w) > 1 else 0.0
    for i in range(len(w) if scale > 1e-12 else 0):
        if abs(sum(w[: i + 1])) / (scale * np.sqrt(len(w))) > 0.948 * (1 + 2 * (i + 1) / len(w)):
            return n - (began + i)
    return 0


def plain_last_segment(x, y):
    (n, k), h = x.shape, max(int(0.15 * len(x)), x.shape[1] + 1)
    squares = {(a, b): float(((y[a:b] - x[a:b] @ np.linalg.lstsq(x[a:b], y[a:b], rcond=None)[0]) ** 2).sum()) for a in range(n) for b in range(a + h, n + 1)}
    best, scores = {b: (squares[0, b], 0) for b in range(h, n + 1)}, []
    for m in range(6):
        if n in best:
            scores.append((n * np.log(best[n][0] / n) + (m + 1) * (k + 1) * np.log(n), m, best[n][1]))
        best = {b: min((best[a][0] + squares[a, b], a) for a in best if (a, b) in squares) for b in range(n + 1) if any((a, b) in squares for a in best)}
    return min(scores)[2]


@pytest.mark.parametrize("order", [1, 3])
def test_histories_of_many_pixels(order):
    """Histories of different lengths with gaps and jumps, all at once, as each for itself."""
    rng = np.random.default_rng(order)
    design_ = design(2014 + np.arange(54) / 12, 12, order)
    n = rng.integers(40, 55, 40)
    x, y = np.zeros((40, 54, design_.shape[1])), np.zeros((40, 54))
    for p in range(40):
        at = np.sort(rng.choice(54, n[p], replace=False))
        x[p, : n[p]] = design_[at]
        y[p, : n[p]] = 0.5 + 0.1 * np.sin(at * np.pi / 6) + rng.normal(0, 0.02, n[p]) + np.where(at < rng.integers(0, 54), 0.3 * (p % 3 > 0), 0)
    since, last = stable_since(x, y, n), last_segment(x, y, n)
    assert since.tolist() == [plain_stable_since(x[p, : n[p]], y[p, : n[p]]) for p in range(40)] and len(set(since.tolist())) > 3
    assert last.tolist() == [plain_last_segment(x[p, : n[p]], y[p, : n[p]]) for p in range(40)] and len(set(last.tolist())) > 3
    assert stable_since(x[:0], y[:0], n[:0]).tolist() == last_segment(x[:0], y[:0], n[:0]).tolist() == []
    flat = np.full((1, 54), 0.25)
    assert stable_since(design_[None], flat, np.array([54]))[0] == last_segment(design_[None], flat, np.array([54]))[0] == 0
