"""Gamma distribution and normal quantile for Arrow batches (numpy only)."""

import math

import numpy as np

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_cdf(x, shape):
    """Regularised lower incomplete gamma function P(shape, x)."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(shape, float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & np.isfinite(x)
    out[ok & (x <= 0)] = 0.0
    low, high = ok & (x > 0) & (x < a + 1), ok & (x > 0) & (x >= a + 1)
    if low.any():
        out[low] = _series(x[low], a[low])
    if high.any():
        out[high] = 1.0 - _fraction(x[high], a[high])
    return out


def _front(x, a):
    return np.exp(a * np.log(x) - x - _log_gamma(a))


def _series(x, a):
    term = 1.0 / a
    total = term.copy()
    n = a.copy()
    for _ in range(10_000):
        n += 1
        term = term * x / n
        total += term
        if (np.abs(term) <= 1e-16 * np.abs(total)).all():
            break
    return total * _front(x, a)


def _fraction(x, a):
    tiny = 1e-300
    b = x + 1 - a
    c = np.full_like(x, 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, 10_000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h *= step
        if (np.abs(step - 1) <= 1e-15).all():
            break
    return h * _front(x, a)


def normal_cdf(z):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(z, float) / math.sqrt(2))


# Coefficients of a published rational approximation of the normal
# quantile (central part numerator and denominator, tail numerator and denominator).
CENTRE = ([-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
           1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00],
          [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
           6.680131188771972e+01, -1.328068155288572e+01, 1.0])
TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00],
        [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0])


def normal_quantile(p):
    """Inverse of the normal distribution function: approximation, then one Halley step."""
    p = np.asarray(p, float)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        q = p - 0.5
        centre = q * np.polyval(CENTRE[0], q * q) / np.polyval(CENTRE[1], q * q)
        t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
        tail = np.sign(-q) * np.polyval(TAIL[0], t) / np.polyval(TAIL[1], t)
        z = np.where(np.abs(q) <= 0.47575, centre, tail)
        error = (normal_cdf(z) - p) * np.sqrt(2 * np.pi) * np.exp(z * z / 2)
        z = np.where(np.isfinite(error), z - error / (1 + z * error / 2), z)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, z))
