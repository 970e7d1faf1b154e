"""ARIMA(1,1,1) per SKU by exact Gaussian likelihood, many SKUs at a time.

Spark gathers each SKU's months (a bounded list); a task fits all SKUs of an Arrow batch together, as
array arithmetic over SKUs. The one-step errors of the differenced series follow the innovations
recursion of Brockwell and Davis (1991).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Two differences: with one, the likelihood of any coefficients is unbounded.
_MIN_MONTHS = 3
_GRID = np.linspace(-0.9, 0.9, 10)
_REFINEMENTS = 14


def _innovations(phi: np.ndarray, theta: np.ndarray, x: np.ndarray, length: np.ndarray):
    """Negative concentrated log-likelihood, last error and last variance ratio for each row of ``x``.

    Rows are padded on the right; ``length`` gives their true lengths.
    """
    ratio = (1.0 + 2.0 * theta * phi + theta ** 2) / (1.0 - phi ** 2)
    expected = np.zeros(len(x))
    squares, logs = np.zeros(len(x)), np.zeros(len(x))
    last_error, last_ratio = np.zeros(len(x)), np.ones(len(x))
    for t in range(x.shape[1]):
        inside = t < length
        error = np.where(inside, x[:, t] - expected, 0.0)
        squares += error ** 2 / ratio
        logs += np.where(inside, np.log(ratio), 0.0)
        last_error = np.where(inside, error, last_error)
        last_ratio = np.where(inside, ratio, last_ratio)
        expected = phi * x[:, t] + theta / ratio * error
        ratio = np.where(inside, 1.0 + theta ** 2 - theta ** 2 / ratio, ratio)
    variance = np.maximum(squares / length, 1e-300)
    return 0.5 * (length * (np.log(2 * np.pi * variance) + 1.0) + logs), last_error, last_ratio


def fit_arima(series: list[np.ndarray], steps: int) -> pd.DataFrame:
    """phi, theta, log-likelihood and ``steps`` forecasts of each series; null where a fit is impossible."""
    count = len(series)
    usable = np.array([len(s) >= _MIN_MONTHS and np.isfinite(s).all() and np.ptp(np.diff(s)) > 0 for s in series])
    result = {"phi": np.full(count, np.nan), "theta": np.full(count, np.nan), "log_likelihood": np.full(count, np.nan)}
    forecasts = np.full((count, steps), np.nan)
    rows = np.flatnonzero(usable)
    if len(rows):
        differences = [np.diff(series[i]) for i in rows]
        length = np.array([len(d) for d in differences])
        x = np.zeros((len(rows), length.max()))
        for at, values in enumerate(differences):
            x[at, :len(values)] = values
        phi, theta = _maximise(x, length)
        cost, error, ratio = _innovations(phi, theta, x, length)
        result["phi"][rows], result["theta"][rows], result["log_likelihood"][rows] = phi, theta, -cost
        level = np.array([series[i][-1] for i in rows], dtype=float)
        change = phi * x[np.arange(len(rows)), length - 1] + theta / ratio * error
        for step in range(steps):
            level = level + change
            forecasts[rows, step] = level
            change = phi * change
    frame = pd.DataFrame(result)
    frame["forecasts"] = [row.tolist() if ok else None for row, ok in zip(forecasts, usable)]
    return frame.astype(object).where(frame.notna(), None)


def _maximise(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best coefficients: a coarse grid, then a pattern search around the best point of each series."""
    best_cost = np.full(len(x), np.inf)
    phi, theta = np.zeros(len(x)), np.zeros(len(x))

    def keep(new_phi, new_theta):
        nonlocal phi, theta, best_cost
        cost = _innovations(new_phi, new_theta, x, length)[0]
        better = cost < best_cost
        phi, theta = np.where(better, new_phi, phi), np.where(better, new_theta, theta)
        best_cost = np.where(better, cost, best_cost)

    for p in _GRID:
        for q in _GRID:
            keep(np.full(len(x), p), np.full(len(x), q))
    step = (_GRID[1] - _GRID[0]) / 2.0
    for _ in range(_REFINEMENTS):
        centre_phi, centre_theta = phi, theta
        for dp in (-step, 0.0, step):
            for dq in (-step, 0.0, step):
                keep(np.clip(centre_phi + dp, -0.999, 0.999), np.clip(centre_theta + dq, -0.999, 0.999))
        step /= 1.8
    return phi, theta


def arima_by_sku(demand: DataFrame, steps: int = 3) -> DataFrame:
    """One row per SKU: coefficients, log-likelihood and a list of ``steps`` forecasts, null on failure."""
    series = demand.groupBy("sku_id").agg(
        F.sort_array(F.collect_list(F.struct("period", "net_units")))["net_units"].alias("values")
    )
    schema = "phi double, theta double, log_likelihood double, forecasts array<double>"

    @F.pandas_udf(schema)
    def fit(values: pd.Series) -> pd.DataFrame:
        return fit_arima([np.asarray(v, dtype=float) for v in values], steps)

    return series.withColumn("fit", fit("values")).select(
        "sku_id", F.size("values").alias("months"), "fit.phi", "fit.theta", "fit.log_likelihood", "fit.forecasts"
    )
