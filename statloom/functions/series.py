"""Small numeric kernels that run on one bounded piece of a series inside a task."""

from __future__ import annotations

import numpy as np

JUMP = 5


def _cost_tables(x: np.ndarray, model: str):
    """Function giving the cost of segments [s, e) for many starts s and one end e."""
    n = len(x)
    if model == "l2":
        total, square = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
        return lambda s, e: (square[e] - square[s]) - (total[e] - total[s]) ** 2 / (e - s)
    if model == "l1":
        return lambda s, e: np.array([np.abs(x[i:e] - np.median(x[i:e])).sum() for i in s])
    # kernel cost: the scale is the median squared distance
    apart = (x[:, None] - x[None, :]) ** 2
    upper = apart[np.triu_indices(n, 1)]
    middle = np.median(upper) if len(upper) else 0.0
    gamma = 1.0 / middle if middle > 0 else 1.0
    gram = np.exp(-np.clip(apart * gamma, 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = gram.cumsum(0).cumsum(1)
    return lambda s, e: (e - s) - (area[e, e] - area[s, e] - area[e, s] + area[s, s]) / (e - s)


def pelt(x: np.ndarray, model: str, min_size: int, penalty: float, jump: int = JUMP) -> list[int]:
    """Segment ends (without the last) of the penalised optimal partition with pruning.

    Ends are multiples of ``jump``, segments start at least ``min_size`` before their end.
    """
    n = len(x)
    if n < 2 * min_size:
        return []
    cost = _cost_tables(x, model)
    best, previous = {0: 0.0}, {}
    alive: list[int] = []
    for end in [*range(jump * -(-min_size // jump), n, jump), n]:
        start = (end - min_size) // jump * jump
        if start in best and start not in alive:
            alive.append(start)
        if not alive:
            continue
        starts = np.array(alive)
        value = np.array([best[s] for s in alive]) + cost(starts, end) + penalty
        pick = int(np.argmin(value))
        best[end], previous[end] = float(value[pick]), int(starts[pick])
        alive = [s for s, v in zip(alive, value) if v <= best[end] + penalty]
    cuts, at = [], previous.get(n, 0)
    while at > 0:
        cuts.append(at)
        at = previous[at]
    return sorted(cuts)


def _loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray, whole: int) -> np.ndarray:
    """Local linear fits of an evenly spaced series at given positions, tricube weights.

    ``whole`` is the length of the series that ``y`` is a piece of: fits without slope are
    decided by it.
    """
    n = len(y)
    q = min(span, n)
    left = np.clip(np.floor(at).astype(int) - q // 2 + (0 if q % 2 else 1), 0, n - q)
    left = np.where(at <= 0, 0, np.where(at >= n - 1, n - q, left))
    idx = left[:, None] + np.arange(q)[None, :]
    gap = idx - at[:, None]
    reach = np.maximum(at - left, left + q - 1 - at).astype(float)
    reach = reach + (max(span - n, 0) // 2)
    r = np.abs(gap) / np.maximum(reach, 1e-12)[:, None]
    w = np.where(r <= 0.999, np.where(r <= 0.001, 1.0, (1 - r**3) ** 3), 0.0) * weights[idx]
    total = w.sum(1)
    safe = np.where(total > 0, total, 1.0)
    w = w / safe[:, None]
    mean = (w * gap).sum(1)
    spread = (w * (gap - mean[:, None]) ** 2).sum(1)
    slope = np.where(np.sqrt(spread) > 0.001 * (whole - 1), -mean / np.where(spread > 0, spread, 1.0), 0.0)
    w = w * (1 + slope[:, None] * (gap - mean[:, None]))
    return np.where(total > 0, (w * y[idx]).sum(1), np.nan)


def _average(x: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return (total[width:] - total[:-width]) / width


def _odd_above(v: float) -> int:
    k = int(np.ceil(v))
    return k if k % 2 else k + 1


SEASONAL_SPAN, INNER, OUTER = 7, 2, 15
# Residuals of this many medians and more have no weight in the next round.
OUTLIER_SCALE = 6


def trend_span(period: int) -> int:
    return _odd_above(1.5 * period / (1 - 1.5 / SEASONAL_SPAN))


def low_pass_span(period: int) -> int:
    return period + 1 if period % 2 == 0 else period + 2


def stl_reach(period: int) -> int:
    """Rows on each side that a value depends on within one round of ``stl_round``."""
    step = (SEASONAL_SPAN + 1) * period // 2 + low_pass_span(period) // 2 + trend_span(period) // 2 + period + 4
    return INNER * step


def stl_round(
    y: np.ndarray, trend: np.ndarray, rho: np.ndarray, period: int, phase: int, whole: int
) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part after one round of smoothing with given weights of the rows.

    ``phase`` is the position of the first value within the period and ``whole`` the length
    of the series, so that a piece of a series has the values of the whole one wherever it
    goes on for ``stl_reach`` rows to both sides.
    """
    n = len(y)
    positions, t_span, l_span = np.arange(n, dtype=float), trend_span(period), low_pass_span(period)
    for _ in range(INNER):
        free = y - trend
        cycle = np.zeros(n + 2 * period)
        for k in range(period):
            part = slice((k - phase) % period, n, period)
            sub = free[part]
            if not len(sub):
                continue
            at = np.arange(-1, len(sub) + 1, dtype=float)
            fitted = _loess(sub, SEASONAL_SPAN, at, rho[part], (whole - k + period - 1) // period)
            fitted = np.where(np.isnan(fitted), np.concatenate([[sub[0]], sub, [sub[-1]]]), fitted)
            cycle[part.start : part.start + period * len(fitted) : period] = fitted
        low = _average(_average(_average(cycle, period), period), 3)
        low = _loess(low, l_span, positions, np.ones(n), whole)
        seasonal = cycle[period : period + n] - low
        trend = _loess(y - seasonal, t_span, positions, rho, whole)
        trend = np.where(np.isnan(trend), y - seasonal, trend)
    return trend, seasonal


def stl(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust seasonal-trend decomposition by loess: trend, seasonal part and residual."""
    n = len(y)
    trend, rho = np.zeros(n), np.ones(n)
    for _ in range(OUTER + 1):
        trend, seasonal = stl_round(y, trend, rho, period, 0, n)
        residual = y - trend - seasonal
        scale = OUTLIER_SCALE * np.median(np.abs(residual))
        if scale <= 0:
            break
        u = np.abs(residual) / scale
        rho = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    return trend, seasonal, residual


def design(t: np.ndarray, days: np.ndarray, knots: int, yearly: np.ndarray, weekly: np.ndarray) -> np.ndarray:
    """Regressors of the forecast: line with hinges, yearly and weekly waves where switched on."""
    columns = [np.ones_like(t), t]
    columns += [np.maximum(t - 0.8 * (i + 1) / (knots + 1), 0.0) for i in range(knots)]
    for order, length, on in ((YEARLY_ORDER, 365.25, yearly), (WEEKLY_ORDER, 7.0, weekly)):
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * days / length
            columns += [np.sin(angle) * on, np.cos(angle) * on]
    return np.column_stack(columns)


YEARLY_ORDER, WEEKLY_ORDER = 10, 3
