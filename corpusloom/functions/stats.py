"""Statistics of 2x2 contingency tables over document counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score: the cap of each part, and the weight of the overlap ratio.
SCORE_CAP = 323.0
RATIO_WEIGHT = 2500.0


def contingency(both: Column, first: Column, second: Column, total: Column) -> list[Column]:
    """Both terms, only the first, only the second, neither."""
    return [both, first - both, second - both, total - first - second + both]


_SMALL = np.r_[0.0, np.cumsum(np.log(np.arange(1, 256)))]


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log(n!) of whole numbers: a table of sums below 256, Stirling's series above."""
    x = np.maximum(n, 1).astype(float)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 256, _SMALL[np.clip(n, 0, 255)], series)


def hypergeometric_tails(ab: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(X >= ab) for the overlap X of random sets of sizes a and b among n; 1 if a margin is empty. All tables at once."""
    ab, a, b, n = (np.asarray(x, np.int64) for x in (ab, a, b, n))
    out = np.ones(len(ab))
    some = np.flatnonzero((ab > 0) & (a > 0) & (b > 0) & (a < n) & (b < n) & (ab >= a + b - n + 1))
    ab, a, b, n = ab[some], a[some], b[some], n[some]
    below = ab <= a / n * b  # the smaller tail is summed
    k = np.where(below, ab - 1, ab)
    f = _log_factorial
    start = f(a) - f(k) - f(a - k) + f(n - a) - f(b - k) - f(n - a - b + k) - f(n) + f(b) + f(n - b)
    last = np.where(below, np.maximum(0, a + b - n), np.minimum(a, b))
    term, total = np.ones(len(ab)), np.zeros(len(ab))
    at = np.flatnonzero(np.where(below, k >= last, k <= last))
    while len(at):
        total[at] += term[at]
        x, y, z, m, down = (v[at].astype(float) for v in (k, a, b, n, below))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(down > 0, x * (m - y - z + x) / ((y - x + 1) * (z - x + 1)), (y - x) * (z - x) / ((x + 1) * (m - y - z + x + 1)))
        term[at] *= ratio
        k[at] += np.where(below[at], -1, 1)
        at = at[np.where(below[at], k[at] >= last[at], k[at] <= last[at]) & (term[at] >= total[at] * 1e-17)]
    tail = total * np.exp(start)
    out[some] = np.where(below, np.maximum(0.0, 1.0 - tail), np.minimum(1.0, tail))
    return out


def hypergeometric_tail(ab: int, a: int, b: int, n: int) -> float:
    """hypergeometric_tails of one table."""
    return float(hypergeometric_tails(*([x] for x in (ab, a, b, n)))[0])


def yates_ps(ab: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided chi-square p-values with continuity correction; 1 if a margin is empty."""
    ab, a, b, n = (np.asarray(x, float) for x in (ab, a, b, n))
    c, d = n - a, n - b
    full = np.minimum(np.minimum(a, b), np.minimum(c, d)) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        diff = np.abs(ab * n - a * b) / n
        diff = diff - np.minimum(0.5, diff)
        x2 = diff * diff * sum(1 / (r * s / n) for r in (a, c) for s in (b, d))
    return np.array([math.erfc(math.sqrt(x / 2)) if ok else 1.0 for x, ok in zip(x2.tolist(), full.tolist())])


def yates_p(ab: int, a: int, b: int, n: int) -> float:
    """yates_ps of one table."""
    return float(yates_ps(*([x] for x in (ab, a, b, n)))[0])


def p_value(both: Column, first: Column, second: Column, total: Column, scoring: str = "fet") -> Column:
    """One-sided Fisher's exact test ('fet') or chi-square ('chi-square') of a batch of tables at once."""
    test = {"fet": hypergeometric_tails, "chi-square": yates_ps}.get(scoring)
    if test is None:
        raise ValueError(f"unknown scoring method {scoring!r}")

    def run(ab: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(test(ab.to_numpy(), a.to_numpy(), b.to_numpy(), n.to_numpy()), dtype="float64")

    return F.pandas_udf(run, "double")(*[c.cast("long") for c in (both, first, second, total)])


def sort_ratio(both: Column, second: Column) -> Column:
    """Share of the second term's documents that hold both."""
    return F.coalesce(F.try_divide(both.cast("double"), second.cast("double")), F.lit(0.0))


def prediction_score(p: Column, ratio: Column) -> Column:
    """In [0, 2]: how unlikely the overlap is, plus how much of the second term it covers."""
    unlikely = F.when(p == 0, F.lit(SCORE_CAP)).otherwise(F.least(F.lit(SCORE_CAP), -F.log10(p)))
    covered = F.when(ratio == 1, F.lit(SCORE_CAP)).otherwise(F.least(F.lit(SCORE_CAP), -F.log10(1 - ratio) * RATIO_WEIGHT))
    return (unlikely + covered) / SCORE_CAP + F.lit(0.0)
