"""Augmented Dickey-Fuller regression from accumulated cross products."""

from math import ceil, erf, pi, sqrt

import numpy as np

# Normal-quantile response surface for a regression with constant, one series
# (MacKinnon 1994, fixed values).
TAU_MAX, TAU_MIN, TAU_SPLIT = 2.74, -18.83, -1.61
SMALL_P = [2.1659, 1.4412, 0.038269]
LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]


def p_value(statistic: float) -> float:
    if statistic > TAU_MAX:
        return 1.0
    if statistic < TAU_MIN:
        return 0.0
    terms = SMALL_P if statistic <= TAU_SPLIT else LARGE_P
    z = sum(c * statistic**k for k, c in enumerate(terms))
    return 0.5 * (1.0 + erf(z / sqrt(2.0)))


def max_lag(rows: int) -> int:
    """Largest lag tried for a series of ``rows`` values."""
    return max(0, min(ceil(12.0 * (rows / 100.0) ** 0.25), rows // 2 - 2))


def design(values: np.ndarray, start: int, stop: int, lags: int) -> np.ndarray:
    """Columns: difference, level before it, constant, ``lags`` earlier differences.

    Rows are the differences number ``start`` to ``stop`` of ``values``.
    """
    steps = np.diff(values)
    at = np.arange(start, stop)
    columns = [steps[at], values[at], np.ones(len(at))]
    columns += [steps[at - k] for k in range(1, lags + 1)]
    return np.column_stack(columns)


def _scaled(gram: np.ndarray, lags: int):
    use = np.arange(1, 3 + lags)
    inner, cross = gram[np.ix_(use, use)], gram[use, 0]
    scale = np.sqrt(np.diag(inner))
    scale[scale == 0] = 1.0
    return inner / np.outer(scale, scale), cross / scale


def best_lag(gram: np.ndarray, tried: int) -> int:
    """Lag count up to ``tried`` with the lowest Akaike criterion, the smaller on ties.

    ``gram`` is the cross-product matrix of :func:`design` columns; its constant entry is the
    number of rows. The models are nested, so one factorisation gives every residual.
    """
    inner, cross = _scaled(gram, tried)
    try:
        explained = np.cumsum(np.linalg.solve(np.linalg.cholesky(inner), cross) ** 2)
    except np.linalg.LinAlgError:
        explained = np.array(
            [cross[:k] @ np.linalg.pinv(inner[:k, :k]) @ cross[:k] for k in range(1, 3 + tried)]
        )
    rows = gram[2, 2]
    residuals = np.maximum(gram[0, 0] - explained[1:], 0.0)
    with np.errstate(divide="ignore"):
        criteria = rows * (np.log(2 * pi * residuals / rows) + 1) + 2 * np.arange(2, 3 + tried)
    return int(np.argmin(criteria))


def t_statistic(gram: np.ndarray, lags: int) -> float:
    """t statistic of the level with the leading ``lags`` lags."""
    inner, cross = _scaled(gram, lags)
    inverse = np.linalg.pinv(inner, hermitian=True)
    beta = inverse @ cross
    residual = max(gram[0, 0] - beta @ cross, 0.0)
    variance = residual / (gram[2, 2] - len(beta)) * inverse[0, 0]
    return beta[0] / sqrt(variance) if variance > 0 else float("nan")
