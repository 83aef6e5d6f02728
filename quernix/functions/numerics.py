"""Numerics of the modelling steps: special functions, distributions, solvers, least squares and a replayable generator."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from quernix.errors import FitError

EPS = 2.0**-52


# Elementary and special functions


def normal_density(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Bisection to a bracket, then Newton steps on the tail that keeps its digits."""
    if not 0 <= p <= 1:
        return math.nan
    if p in (0.0, 1.0):
        return math.inf if p else -math.inf
    if p > 0.5:
        return -normal_quantile(1 - p)
    lo, hi = -40.0, 0.0
    while hi - lo > 1e-3:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    x = (lo + hi) / 2
    for _ in range(6):
        d = normal_density(x)
        if d == 0:
            break
        x -= (normal_cdf(x) - p) / d
    return x


def gamma_ln(x: float) -> float:
    return math.lgamma(x) if x > 0 else math.nan


def beta_ln(a: float, b: float) -> float:
    return gamma_ln(a) + gamma_ln(b) - gamma_ln(a + b)


def beta(a: float, b: float) -> float:
    return math.exp(beta_ln(a, b))


_BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def digamma(x: float) -> float:
    if x <= 0 and x == math.floor(x):
        return math.nan
    if x < 0:
        return digamma(1 - x) - math.pi / math.tan(math.pi * x)
    shift = 0.0
    while x < 12:
        shift -= 1 / x
        x += 1
    return shift + math.log(x) - 0.5 / x - sum(b / (2 * k * x ** (2 * k)) for k, b in enumerate(_BERNOULLI, 1))


def polygamma(n: int, x: float) -> float:
    """The n-th derivative of digamma, n >= 1, x > 0."""
    if n == 0:
        return digamma(x)
    if x <= 0:
        return math.nan
    total, f = 0.0, math.factorial(n)
    while x < 15 + n:
        total += f / x ** (n + 1)
        x += 1
    total += math.factorial(n - 1) / x**n + f / (2 * x ** (n + 1))
    total += sum(b * math.factorial(2 * k + n - 1) / (math.factorial(2 * k) * x ** (2 * k + n)) for k, b in enumerate(_BERNOULLI, 1))
    return total if n % 2 else -total


def trigamma(x: float) -> float:
    return polygamma(1, x)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    return 1 - gamma_q(a, x) if x >= a + 1 else _gamma_series(a, x)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if not (a > 0 and x >= 0):
        return math.nan
    if x < a + 1:
        return 1 - _gamma_series(a, x)
    if math.isinf(x):
        return 0.0
    return math.exp(a * math.log(x) - x - gamma_ln(a)) * _lentz(lambda i: (1.0, x + 1 - a) if i == 1 else (-(i - 1) * (i - 1 - a), x + 2 * i - 1 - a))


def _gamma_series(a: float, x: float) -> float:
    if not (a > 0 and x >= 0):
        return math.nan
    if x == 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * EPS / 4:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - gamma_ln(a))


def _lentz(part: Callable[[int], tuple[float, float]]) -> float:
    """Value of the continued fraction with numerators and denominators part(1), part(2), ..."""
    tiny = 1e-300
    f = c = tiny
    d = 0.0
    for i in range(1, 5000):
        a, b = part(i)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < EPS:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if not (a > 0 and b > 0 and 0 <= x <= 1):
        return math.nan
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def part(i: int) -> tuple[float, float]:
        if i == 1:
            return 1.0, 1.0
        m, k = divmod(i - 1, 2)
        if k:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return math.exp(a * math.log(x) + b * math.log1p(-x) - beta_ln(a, b)) / a * _lentz(part)


def beta_inc_complement(a: float, b: float, x: float) -> float:
    return beta_inc(b, a, 1 - x)


def beta_inc_inverse(a: float, b: float, p: float) -> float:
    if not 0 <= p <= 1:
        return math.nan
    return p if p in (0.0, 1.0) else bisect(lambda x: beta_inc(a, b, x) - p, 0.0, 1.0)


def beta_inc_complement_inverse(a: float, b: float, p: float) -> float:
    return 1 - beta_inc_inverse(b, a, p)


# Solvers


def bisect(f: Callable[[float], float], lo: float, hi: float, steps: int = 2000) -> float:
    """A root of f in [lo, hi], to the last bit the bracket allows."""
    up = f(hi) > 0
    if (f(lo) > 0) == up:
        return lo if f(lo) == 0 else hi if f(hi) == 0 else math.nan
    for _ in range(steps):
        mid = lo + (hi - lo) / 2
        if mid in (lo, hi):
            break
        if (f(mid) > 0) == up:
            hi = mid
        else:
            lo = mid
    return lo + (hi - lo) / 2


def bracketed_newton(f: Callable[[float], float], df: Callable[[float], float], lo: float, hi: float, tol: float = 1e-14, steps: int = 200) -> float:
    """Newton steps that fall back to halving when they leave the bracket."""
    up, x = f(hi) > 0, (lo + hi) / 2
    for _ in range(steps):
        v, g = f(x), df(x)
        lo, hi = (lo, x) if (v > 0) == up else (x, hi)
        new = x - v / g if g else math.nan
        new = new if lo < new < hi else (lo + hi) / 2
        if abs(new - x) <= tol * max(1.0, abs(x)):
            return new
        x = new
    return x


def integer_search(ok: Callable[[int], bool], lo: int, hi: int) -> int | None:
    """The least whole number in [lo, hi] from which on ok holds."""
    if not ok(hi):
        return None
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
    return lo


def golden_section(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-10) -> float:
    r = (math.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol * max(1.0, abs(lo), abs(hi)):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def damped(step: Callable[[float], float], x: float, damping: float = 0.5, tol: float = 1e-12, steps: int = 1000) -> float:
    """Fixed point of step, moving a share of the way each time."""
    for _ in range(steps):
        new = x + damping * (step(x) - x)
        if abs(new - x) <= tol * max(1.0, abs(x)):
            return new
        x = new
    return x


# Distributions: cdf and quantile; NaN for bad parameters


def student_t_cdf(x: float, df: float) -> float:
    if not df > 0:
        return math.nan
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def student_t_quantile(p: float, df: float) -> float:
    if not (df > 0 and 0 <= p <= 1):
        return math.nan
    if p == 0.5:
        return 0.0
    if p > 0.5:
        return -student_t_quantile(1 - p, df)
    if p == 0:
        return -math.inf
    lo = -1.0
    while student_t_cdf(lo, df) > p:
        lo *= 2
    return bisect(lambda x: student_t_cdf(x, df) - p, lo, 0.0)


def chi_square_cdf(x: float, df: float) -> float:
    return math.nan if not df > 0 else 0.0 if x <= 0 else gamma_p(df / 2, x / 2)


def fisher_f_cdf(x: float, d1: float, d2: float) -> float:
    return math.nan if not (d1 > 0 and d2 > 0) else 0.0 if x <= 0 else beta_inc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def _upward_quantile(cdf: Callable[[float], float], p: float) -> float:
    if not 0 <= p <= 1 or math.isnan(cdf(1.0)):
        return math.nan
    if p in (0.0, 1.0):
        return math.inf if p else 0.0
    hi = 1.0
    while cdf(hi) < p:
        hi *= 2
    return bisect(lambda x: cdf(x) - p, 0.0, hi)


def chi_square_quantile(p: float, df: float) -> float:
    return _upward_quantile(lambda x: chi_square_cdf(x, df), p)


def fisher_f_quantile(p: float, d1: float, d2: float) -> float:
    return _upward_quantile(lambda x: fisher_f_cdf(x, d1, d2), p)


# Linear algebra


def triangle(rows: np.ndarray) -> np.ndarray:
    """The upper triangle R of a QR factorisation; stacked triangles give the triangle of all rows."""
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, rows.shape[1]))
    return r if len(r) == rows.shape[1] else np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def independent(r: np.ndarray, p: int, n: int) -> list[int]:
    """Columns, in order, that those before them do not explain: |rest| > max(n, p) * 2^-52 * |column|."""
    basis: list[np.ndarray] = []
    kept, tau = [], max(n, p) * EPS
    for j in range(p):
        v = r[:, j].copy()
        size = np.linalg.norm(v)
        for _ in range(2):
            for b in basis:
                v -= b * (b @ v)
        rest = np.linalg.norm(v)
        if size > 0 and rest > tau * size:
            kept.append(j)
            basis.append(v / rest)
    return kept


def least_squares(r: np.ndarray, p: int, n: int, ridge: np.ndarray | None = None) -> tuple[np.ndarray, list[int], np.ndarray, float]:
    """(coefficients with NaN where aliased, kept columns, inverse of X'X over them, residual sum of squares)
    from the triangle of [X | y]."""
    if ridge is not None and ridge.any():
        r0 = r
        r = triangle(np.vstack([r, np.hstack([np.diag(np.sqrt(ridge)), np.zeros((p, r.shape[1] - p))])]))
    kept = independent(r[:, :p], p, n)
    out = np.full(p, np.nan)
    if kept:
        qm, rk = np.linalg.qr(r[:, kept])
        b = np.linalg.solve(rk, qm.T @ r[:, p])
        out[kept] = b
        inv = np.linalg.inv(rk)
        cov = inv @ inv.T
    else:
        b, cov = np.zeros(0), np.zeros((0, 0))
    base = r0 if ridge is not None and ridge.any() else r
    return out, kept, cov, float(np.sum((base[:, p] - base[:, kept] @ b) ** 2))


# Random numbers: SplitMix64 with streams

_GAMMA, _MASK = 0x9E3779B97F4A7C15, 2**64 - 1


def _mix64(z: int) -> int:
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


class Rng:
    def __init__(self, seed: int, stream: int | None = None):
        self.state = seed & _MASK if stream is None else _mix64((seed + (stream + 1) * _GAMMA) & _MASK)

    def next(self) -> int:
        self.state = (self.state + _GAMMA) & _MASK
        return _mix64(self.state)

    def uniform53(self) -> float:
        return (self.next() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        """Uniform in [0, n) by rejection on the top 32 bits."""
        if not 0 < n <= 2**32:
            raise FitError(f"no draw below {n}")
        least = (2**32 - n) % n
        while True:
            v = self.next() >> 32
            if v >= least:
                return v % n
