"""Distributions and Sharpe-ratio statistics, as Columns where rows are many and as plain
functions for what is already a handful of numbers. Fixed values are the published constants."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26 (fixed values)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Acklam's inverse normal (fixed values)
INV_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
INV_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
INV_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INV_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
INV_LOW = 0.02425
EULER_GAMMA = 0.5772156649015329


def _poly(x, coefficients):
    total = 0.0
    for c in coefficients:
        total = total * x + c
    return total


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    return F.signum(x) * (1 - _poly(t, reversed(ERF_A)) * t * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / math.sqrt(2))) / 2


def normal_cdf_sql(x: str) -> str:
    """The same as an SQL expression of ``x``, for the twins."""
    t = f"(1 / (1 + {ERF_P!r} * abs({x}) / sqrt(2)))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"({poly} * {t} + {a!r})"
    return f"((1 + sign({x}) * (1 - {poly} * {t} * exp(-({x}) * ({x}) / 2))) / 2)"


def normal_cdf_value(x: float) -> float:
    t = 1 / (1 + ERF_P * abs(x) / math.sqrt(2))
    e = 1 - _poly(t, reversed(ERF_A)) * t * math.exp(-x * x / 2)
    return (1 + math.copysign(e, x)) / 2


def normal_inv_cdf(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p == 0 else math.inf if p == 1 else math.nan
    if p < INV_LOW or p > 1 - INV_LOW:
        q = math.sqrt(-2 * math.log(min(p, 1 - p)))
        x = _poly(q, INV_C) / (_poly(q, INV_D) * q + 1)
        return x if p < INV_LOW else -x
    q = p - 0.5
    r = q * q
    return _poly(r, INV_A) * q / (_poly(r, INV_B) * r + 1)


def sharpe(x: str, periods: float = 1.0) -> Column:
    """Mean over sample deviation: null under two values, 0 if they do not vary."""
    s = F.stddev_samp(x)
    return F.when(F.count(x) >= 2, F.when(s > 1e-15, F.avg(x) / s * math.sqrt(periods)).otherwise(0.0))


def _spread(sr: Column, skew: Column, kurt: Column) -> Column:
    return 1 - skew * sr + (kurt - 1) / 4 * sr * sr


def sharpe_standard_error(sr: Column, n: Column, skew: Column, kurt: Column) -> Column:
    v = _spread(sr, skew, kurt)
    return F.when((n >= 2) & (v >= 0), F.sqrt(v / (n - 1)))


def probabilistic_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: Column | float = 0.0) -> Column:
    v = _spread(sr, skew, kurt)
    return F.when((n >= 2) & (v > 0), normal_cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(v)))


def expected_max_factor(trials: int) -> float:
    """How many deviations the best of ``trials`` worthless strategies is expected to show."""
    if trials <= 1:
        return 0.0
    return (1 - EULER_GAMMA) * normal_inv_cdf(1 - 1 / trials) + EULER_GAMMA * normal_inv_cdf(1 - 1 / (trials * math.e))


def deflated_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, trials: int) -> Column:
    hurdle = F.sqrt((1 + sr * sr / 2) / (n - 1)) * expected_max_factor(trials)
    return probabilistic_sharpe(sr, n, skew, kurt, hurdle)


def minimum_track_record(sr: Column, skew: Column, kurt: Column, benchmark: float = 0.0, prob: float = 0.95) -> Column:
    """Observations needed; null where the ratio does not exceed the benchmark."""
    z = normal_inv_cdf(prob)
    return F.when(sr > benchmark, 1 + _spread(sr, skew, kurt) * F.pow(z / (sr - benchmark), F.lit(2)))


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def regularized_incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by the Lentz continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - regularized_incomplete_beta(b, a, 1 - x)
    return math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) * _beta_cf(a, b, x) / a


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_t_p(t: float, df: float, two_sided: bool = True) -> float:
    tail = regularized_incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return min(1.0, 2 * tail) if two_sided else (tail if t > 0 else 1 - tail)


def student_t_critical(df: float, alpha: float = 0.05, two_sided: bool = False) -> float:
    want, lo, hi = (alpha / 2 if two_sided else alpha), 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_t_p(mid, df, False) > want else (lo, mid)
    return (lo + hi) / 2


def sign_test(wins: int, n: int) -> float:
    """Chance of at least ``wins`` of ``n`` fair coins."""
    return sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n if n else 1.0


def sign_test_floor(n: int) -> float:
    return 2.0**-n
