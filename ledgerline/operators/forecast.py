"""Forecasts of period series: model choice, linear trend, ARIMA(1,1,1), additive Holt-Winters, backtest.

Spark sums rows by period; a series has a row for each period, so one series is small however many rows it stands for.
Many series are forecast side by side, one group of a grouped map each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import periods

LEAST, ARIMA_LEAST, BAND = 10, 30, 1.96


@dataclass(frozen=True)
class Forecast:
    model: str
    mean: np.ndarray
    width: np.ndarray  # half the band at each step
    fitted: np.ndarray  # NaN where the model has no fit


def season_of(days: Sequence) -> int:
    """7 for daily series, 12 for monthly ones, else 0. days: ordered dates."""
    if len(days) < 3:
        return 0
    step = float(np.median([(b - a).days for a, b in zip(days, days[1:], strict=False)]))
    return 7 if step <= 1.5 else 12 if 26 <= step <= 32 else 0


def seasonal_part(y: np.ndarray, season: int) -> np.ndarray:
    """The seasonal part of an additive decomposition. The centred moving average is carried on to both ends along a line
    through its nearest `season` points."""
    half = season // 2
    kernel = np.ones(season) / season if season % 2 else np.concatenate([[0.5], np.ones(season - 1), [0.5]]) / season
    trend = np.full(len(y), np.nan)
    trend[half : len(y) - half] = np.convolve(y, kernel, "valid")
    at = np.arange(len(y))
    for end, near in ((at[:half], at[half : half + season]), (at[len(y) - half :], at[len(y) - half - season : len(y) - half])):
        near = near[~np.isnan(trend[near])]
        trend[end] = np.polyval(np.polyfit(near, trend[near], 1), end) if len(near) > 1 else trend[near].mean()
    phases = np.array([(y - trend)[k::season].mean() for k in range(season)])
    return np.resize(phases - phases.mean(), len(y))


def deseasonalised(y: np.ndarray, grain: str) -> np.ndarray:
    """y without a weekly (D) or yearly (M) cycle, if it is long enough to show one."""
    season = {"D": 7, "M": 12}.get(grain)
    return y - seasonal_part(y, season) if season and len(y) >= 2 * season + 2 else y


def linear(y: np.ndarray, horizon: int) -> Forecast:
    at = np.arange(len(y))
    line = np.polyfit(at, y, 1)
    fitted = np.polyval(line, at)
    return Forecast("linear", np.polyval(line, len(y) + np.arange(horizon)), np.full(horizon, BAND * (y - fitted).std()), fitted)


def holt_winters(y: np.ndarray, horizon: int, season: int) -> Forecast:
    """Additive trend and season. Smoothing weights are the best of a grid, refined around it twice."""

    def run(weights: Sequence[float]) -> tuple[float, np.ndarray, float, float, np.ndarray]:
        alpha, beta, gamma = weights
        level, slope = y[:season].mean(), (y[season : 2 * season].mean() - y[:season].mean()) / season
        cycle = y[:season] - (level + slope * (np.arange(season) - (season - 1) / 2))
        level -= slope * (season + 1) / 2
        fitted = np.empty(len(y))
        for t, x in enumerate(y):
            fitted[t] = level + slope + cycle[t % season]
            before = level
            level = alpha * (x - cycle[t % season]) + (1 - alpha) * (level + slope)
            slope = beta * (level - before) + (1 - beta) * slope
            cycle[t % season] = gamma * (x - level) + (1 - gamma) * cycle[t % season]
        return float(((y - fitted) ** 2).sum()), fitted, level, slope, cycle

    best, step = (0.3, 0.1, 0.1), 0.3
    tried = [(a, b, g) for a in (0.1, 0.3, 0.6, 0.9) for b in (0.01, 0.1, 0.3) for g in (0.01, 0.1, 0.4)]
    for _ in range(3):
        best = min([best, *tried], key=lambda w: run(w)[0])
        step /= 2
        tried = [tuple(float(np.clip(w + d, 0.001, 0.999)) for w, d in zip(best, ds, strict=True)) for ds in np.array(np.meshgrid(*[(-step, 0, step)] * 3)).reshape(3, -1).T]
    best = min([best, *tried], key=lambda w: run(w)[0])
    _, fitted, level, slope, cycle = run(best)
    ahead = np.arange(1, horizon + 1)
    mean = level + slope * ahead + cycle[(len(y) + ahead - 1) % season]
    return Forecast(f"holt-winters({season})", mean, np.full(horizon, BAND * (y - fitted).std(ddof=1)), fitted)


def arima(y: np.ndarray, horizon: int) -> Forecast:
    """ARIMA(1,1,1) by least conditional squares; the band widens as the weights of past shocks add up."""
    d = np.diff(y)

    def shocks(phi: float, theta: float) -> np.ndarray:
        e = np.zeros(len(d))
        for t in range(1, len(d)):
            e[t] = d[t] - phi * d[t - 1] - theta * e[t - 1]
        return e

    best, step = (0.0, 0.0), 0.4
    for _ in range(5):
        tried = [(float(np.clip(best[0] + a, -0.98, 0.98)), float(np.clip(best[1] + b, -0.98, 0.98))) for a in (-2 * step, -step, 0, step, 2 * step) for b in (-2 * step, -step, 0, step, 2 * step)]
        best, step = min(tried, key=lambda w: float((shocks(*w)[1:] ** 2).sum())), step / 3
    phi, theta = best
    e = shocks(phi, theta)
    move, level, mean = phi * d[-1] + theta * e[-1], y[-1], []
    for _ in range(horizon):
        level += move
        mean.append(level)
        move *= phi
    weights = np.cumsum(np.concatenate([[1.0], (phi + theta) * phi ** np.arange(horizon - 1)]))
    sd = e[1:].std()
    return Forecast("arima(1,1,1)", np.array(mean), BAND * sd * np.sqrt(np.cumsum(weights**2)), np.concatenate([[np.nan, np.nan], (y[1:] - e)[1:]]))


def choose(y: np.ndarray, days: Sequence, horizon: int) -> Forecast | None:
    """None below LEAST points; Holt-Winters with two seasons and six points more; a line below ARIMA_LEAST; else ARIMA."""
    if len(y) < LEAST:
        return None
    season = season_of(days)
    if season and len(y) >= 2 * season + 6:
        return holt_winters(y, horizon, season)
    return linear(y, horizon) if len(y) < ARIMA_LEAST else arima(y, horizon)


def mape(actual: np.ndarray, guess: np.ndarray) -> float | None:
    """Mean error in percent over points that are not 0."""
    some = (actual != 0) & ~np.isnan(guess)
    return float((np.abs(actual - guess)[some] / np.abs(actual[some])).mean() * 100) if some.any() else None


def backtest(y: np.ndarray, days: Sequence) -> float | None:
    """MAPE of the last min(4, n // 4) points, two at least, forecast from those before; None if there are too few."""
    held = min(4, len(y) // 4)
    made = choose(y[:-held], days[:-held], held) if held >= 2 else None
    return mape(y[-held:], made.mean) if made else None


def outlook(df: DataFrame, when: str, value: str, horizon: int | None = None) -> tuple[DataFrame | None, str]:
    """The forecast of the value's full periods and their grain, or None and why there is none.

    Fewer than LEAST months or quarters are read by week, if that gives LEAST. The horizon is a third of the periods,
    between three and eight, unless it is given. Weeks without rows are absent, as in any period series.
    """

    def read(g: str | None) -> tuple[DataFrame, str, int]:
        w = periods.bounds(df, when, g)
        s = periods.series(df, when, periods.money(value), w.grain, w).where("value is not null").select("period", "value")
        return s, w.grain, s.count()

    series, g, n = read(None)
    if n < LEAST and g in ("M", "Q"):
        weekly = read("W")
        series, g, n = weekly if weekly[2] >= LEAST else (series, g, n)
    if n < LEAST:
        return None, f"{n} full periods, and a model needs {LEAST}"
    return forecasts(series, horizon or min(8, max(3, n // 3))), g


def forecasts(series: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, model, step, period, mean, lower, upper, fit_mape, backtest_mape of each series (keys, period, value).

    Future periods follow the last by the median spacing. A series of fewer than LEAST points gives one row with a null
    model. Rows with a null period or value are left out; a null key is a series of its own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        days, y = list(pdf.period), pdf.value.to_numpy(float)
        made, head = choose(y, days, horizon), {k: [pdf[k].iloc[0]] for k in keys}
        if made is None:
            return pd.DataFrame(head | {"model": [None], "step": [0], "period": [days[-1]], "mean": [None], "lower": [None], "upper": [None], "fit_mape": [None], "backtest_mape": [None]})
        step = float(np.median([(b - a).days for a, b in zip(days, days[1:], strict=False)]))
        ahead = [days[-1] + timedelta(days=round(step * k)) for k in range(1, horizon + 1)]
        rows = {"model": made.model, "step": range(1, horizon + 1), "period": ahead, "mean": made.mean, "lower": made.mean - made.width, "upper": made.mean + made.width, "fit_mape": mape(y, made.fitted), "backtest_mape": backtest(y, days)}
        return pd.DataFrame({k: v * horizon for k, v in head.items()} | rows)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in keys)
    out = (types + ", " if types else "") + "model string, step int, period date, mean double, lower double, upper double, fit_mape double, backtest_mape double"
    whole = series.where("period is not null and value is not null").select(*keys, F.to_date("period").alias("period"), F.col("value").cast("double").alias("value"))
    return (whole.groupBy(*keys) if keys else whole.withColumn("_one", F.lit(1)).groupBy("_one")).applyInPandas(run, out)
