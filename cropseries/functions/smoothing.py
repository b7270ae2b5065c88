"""Curve smoothing as Arrow functions: each batch of curves is one matrix.

The same smoothers written with nested array lambdas run a few hundred times slower, because Spark
interprets lambdas element by element; here Spark still partitions the curves and NumPy works per batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

CELLS = 4_000_000


def _once(fn):
    """Arrow function that the optimizer must not copy: a filter on its result would otherwise be pushed below the
    projection together with a second evaluation."""
    return F.arrow_udf(fn, "array<double>").asNondeterministic()


def savgol_coefficients(window: int, degree: int) -> np.ndarray:
    """Central least-squares weights of a polynomial fit over ``window`` equally spaced points."""
    half = window // 2
    x = np.arange(-half, half + 1, dtype=float) / max(half, 1)
    weights = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[0]
    weights[np.abs(weights) < 1e-12] = 0.0
    return (weights + weights[::-1]) / 2


def _wrap(curves: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Circular convolution of every row with symmetric weights."""
    half = len(weights) // 2
    return sum(w * np.roll(curves, half - k, axis=1) for k, w in enumerate(weights) if w)


def kernel_matrix(days: np.ndarray, values: np.ndarray, bandwidth: float) -> np.ndarray:
    """Gaussian local-constant fit per row at its own days, scaled to [0, 1] by the valid ones."""
    valid = ~np.isnan(values)
    low = np.where(valid, days, np.inf).min(axis=1, keepdims=True)
    high = np.where(valid, days, -np.inf).max(axis=1, keepdims=True)
    few = valid.sum(axis=1) < 3
    low[few], high[few] = 0.0, 1.0
    x = (days - low) / np.maximum(high - low, 1e-6)
    weights = np.exp(-0.5 * ((x[:, :, None] - x[:, None, :]) / bandwidth) ** 2) * valid[:, None, :]
    total = weights.sum(axis=2)
    fit = np.divide((weights * np.where(valid, values, 0.0)[:, None, :]).sum(axis=2), total,
                    out=np.full(values.shape, np.nan), where=total > 0)
    return np.where(few[:, None], values, fit)


def envelope_matrix(values: np.ndarray, first: np.ndarray, second: np.ndarray, iterations: int) -> np.ndarray:
    """Trend, then repeated max-and-smooth; a row stops with its previous curve once its weighted distance rises."""
    result = np.full(values.shape, np.nan)
    rows = np.flatnonzero(~np.isnan(values).any(axis=1))
    y = values[rows]
    curve = _wrap(y, first)
    gap = curve - y
    top = np.abs(gap).max(axis=1, keepdims=True)
    weight = np.minimum(1.0, 1.0 - np.divide(gap, top, out=np.zeros_like(gap), where=top > 0))
    cost = np.full(len(rows), np.inf)
    for _ in range(iterations):
        fit = _wrap(np.maximum(curve, y), second)
        now = (np.abs(fit - y) * weight).sum(axis=1)
        better = now <= cost
        result[rows[better]] = fit[better]
        rows, y, weight, curve, cost = rows[better], y[better], weight[better], fit[better], now[better]
        if not len(rows):
            break
    return result


def _by_length(smooth: Callable[..., np.ndarray], *lists: pa.Array) -> pa.Array:
    """Apply a matrix function to list arrays whose rows may have different lengths; NaN out means NULL.

    A NULL list gives NULL; lists of one row that differ in length are an error.
    """
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in lists]
    missing = np.zeros(len(lists[0]), dtype=bool)
    for c in lists:
        missing |= np.asarray(c.is_null())
    if missing.any():  # flattened values of all lists must stand at the same places
        lists = [pc.if_else(pa.array(missing), pa.scalar([], c.type), c) for c in lists]
    for c in lists[1:]:
        if not c.value_lengths().equals(lists[0].value_lengths()):
            raise ValueError("lists of one row differ in length")
    sizes = np.asarray(lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = [c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in lists]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(starts[-1]), np.nan)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        step = max(1, CELLS // int(n * n))
        for part in (rows[i:i + step] for i in range(0, len(rows), step)):
            at = starts[part][:, None] + np.arange(n)
            out[at] = smooth(*[f[at] for f in flat])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out, from_pandas=True),
                                    mask=pa.array(missing) if missing.any() else None)


def kernel_regression(days: str | Column, values: str | Column, bandwidth: float = 0.03) -> Column:
    """Gaussian local-constant smoother at the same days. Fewer than three valid points return the input;
    a vanishing weight sum gives NULL."""
    @_once
    def smooth(d: pa.Array, v: pa.Array) -> pa.Array:
        return _by_length(lambda x, y: kernel_matrix(x, y, bandwidth), d, v)
    return smooth(days, values)


def chen_sg(curve: str | Column, first: tuple[int, int] = (11, 7), second: tuple[int, int] = (3, 2),
            iterations: int = 10) -> Column:
    """Savitzky-Golay upper envelope; any missing point makes the whole curve missing."""
    w1, w2 = savgol_coefficients(*first), savgol_coefficients(*second)

    @_once
    def smooth(v: pa.Array) -> pa.Array:
        return _by_length(lambda y: envelope_matrix(y, w1, w2, iterations), v)
    return smooth(curve)


def smooth_curve(days: str | Column, values: str | Column, bandwidth: float = 0.03) -> Column:
    """Kernel regression followed by the envelope in one pass; curves that stay incomplete become all zero."""
    w1, w2 = savgol_coefficients(11, 7), savgol_coefficients(3, 2)

    def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.nan_to_num(envelope_matrix(kernel_matrix(x, y, bandwidth), w1, w2, 10))

    @_once
    def smooth(d: pa.Array, v: pa.Array) -> pa.Array:
        return _by_length(both, d, v)
    return smooth(days, values)
