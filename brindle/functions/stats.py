"""Tail probabilities and tests without SciPy: Poisson, hypergeometric (Fisher), normal scores, false-discovery control."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: shifted above 10, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(10):
        low = z < 10
        shift[low] += np.log(z[low])
        z[low] += 1
    i = 1 / (z * z)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def _series(n: int, ratio) -> np.ndarray:
    """1 + r1 + r1 r2 + ... of n series at once, each until its terms no longer count; ``ratio(rows, step)`` gives the next factors."""
    total, term, live, step = np.ones(n), np.ones(n), np.arange(n), 0
    while len(live):
        step += 1
        term[live] *= ratio(live, step)
        total[live] += term[live]
        # terms may still grow before they shrink; they count as long as one of them could matter
        live = live[(term[live] > total[live] * 1e-17) & (term[live] > 0)]
    return total


def log_poisson_sf(k, mean) -> np.ndarray:
    """log P(X >= k) of Poisson variables."""
    k, mean = np.broadcast_arrays(np.atleast_1d(np.asarray(k, dtype=float)), np.atleast_1d(np.asarray(mean, dtype=float)))
    k, out = np.ceil(k - 1e-12), np.full(k.shape, np.nan)
    out[k <= 0] = 0.0
    out[(k > 0) & (mean <= 0)] = -np.inf
    low = np.flatnonzero((k > 0) & (mean > 0) & (k <= mean))  # 1 - P(X < k), summed downwards from k - 1
    if len(low):
        a, m = k[low], mean[low]
        total = _series(len(low), lambda at, j: np.maximum(a[at] - j, 0) / m[at])
        below = np.exp((a - 1) * np.log(m) - m - _log_gamma(a)) * total
        out[low] = np.log1p(-np.minimum(below, 1 - 1e-16))
    high = np.flatnonzero((k > 0) & (mean > 0) & (k > mean))
    if len(high):
        a, m = k[high], mean[high]
        total = _series(len(high), lambda at, j: m[at] / (a[at] + j))
        out[high] = a * np.log(m) - m - _log_gamma(a + 1) + np.log(total)
    return out


def poisson_sf(k, mean) -> np.ndarray:
    return np.exp(log_poisson_sf(k, mean))


def fisher_greater(a, b, c, d) -> np.ndarray:
    """One-sided Fisher exact tests of [[a, b], [c, d]]: P(first cell >= a) with the margins fixed."""
    a, b, c, d = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    out = np.ones(len(a))
    at = np.flatnonzero(a > np.maximum(0, row + col - n))
    if len(at):
        a, row, col, n = a[at], row[at], col[at], n[at]
        lg = lambda v: _log_gamma(v + 1)
        log_p = lg(row) - lg(a) - lg(row - a) + lg(n - row) - lg(col - a) - lg(n - row - col + a) - (lg(n) - lg(col) - lg(n - col))

        def ratio(i, j):
            x = a[i] + j - 1
            return np.maximum(row[i] - x, 0) * np.maximum(col[i] - x, 0) / ((x + 1) * (n[i] - row[i] - col[i] + x + 1))

        out[at] = np.minimum(1.0, np.exp(log_p + np.log(_series(len(at), ratio))))
    return out


@F.pandas_udf(T.DoubleType())
def poisson_sf_udf(k: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(poisson_sf(k.to_numpy(dtype=float), mean.to_numpy(dtype=float)))


@F.pandas_udf(T.DoubleType())
def fisher_greater_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_greater(a.to_numpy(), b.to_numpy(), c.to_numpy(), d.to_numpy()))


def false_discovery(df: DataFrame, p: str, family: list[str] | None = None, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg values per family; a null or NaN p counts as 1. Equal p get equal values.

    The family's rows are ordered in one task, so a family is a table of tests and not of data rows.
    """
    by = [F.col(c) for c in family or []] or [F.lit(1)]
    value = F.when(F.col(p).isNull() | F.isnan(p), F.lit(1.0)).otherwise(F.col(p))
    up = Window.partitionBy(*by).orderBy("_p")
    rank = F.count(F.lit(1)).over(up)  # peers share the last rank
    tail = Window.partitionBy(*by).orderBy(F.desc("_p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = df.withColumn("_p", value).withColumn("_v", F.col("_p") * n / rank)
    return rows.withColumn(out, F.least(F.lit(1.0), F.min("_v").over(tail))).drop("_p", "_v")


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))
