"""Small dense linear algebra on numpy arrays, with shapes checked by name, and Gram matrices of tables.

Matrices here are what fits a driver: triangles, coefficients, Gram matrices. A tall table is reduced to one of them first,
by ``gram`` in one aggregation or by ``Accumulator`` a part at a time.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernix.errors import CodecError, LinAlgRefused
from quernix.functions import numerics as N


@dataclass(frozen=True, eq=False)
class Matrix:
    """Rows by columns of floats; nothing changes it."""

    values: np.ndarray

    def __post_init__(self):
        v = np.array(self.values, float, ndmin=2)
        v.setflags(write=False)
        object.__setattr__(self, "values", v)

    @property
    def shape(self) -> tuple[int, int]:
        return self.values.shape

    def column(self, j: int) -> np.ndarray:
        """A view, not a copy."""
        if not 0 <= j < self.shape[1]:
            raise LinAlgRefused(f"column {j} of {self.shape[1]}")
        return self.values[:, j]

    def transpose(self) -> Matrix:
        return Matrix(self.values.T)

    def __eq__(self, other) -> bool:
        return isinstance(other, Matrix) and self.shape == other.shape and self.values.tobytes() == other.values.tobytes()


def init(rows: int, cols: int, f) -> Matrix:
    if rows < 0 or cols < 0:
        raise LinAlgRefused(f"a matrix of {rows} by {cols}")
    return Matrix(np.array([[f(i, j) for j in range(cols)] for i in range(rows)], float).reshape(rows, cols))


def identity(n: int) -> Matrix:
    return init(n, n, lambda i, j: float(i == j))


def of_columns(columns) -> Matrix:
    cs = [np.asarray(c, float) for c in columns]
    for c in cs:
        _alike("of_columns", cs[0], c)
    return Matrix(np.column_stack(cs) if cs else np.zeros((0, 0)))


def _alike(what: str, x, y) -> None:
    if np.shape(x) != np.shape(y):
        raise LinAlgRefused(f"{what}: {np.shape(x)} against {np.shape(y)}")


def dot(x, y) -> float:
    _alike("dot", x, y)
    return float(np.dot(np.asarray(x, float), np.asarray(y, float)))


def axpy(a: float, x, y) -> np.ndarray:
    """a x + y"""
    _alike("axpy", x, y)
    return a * np.asarray(x, float) + np.asarray(y, float)


def scale(a: float, x) -> np.ndarray:
    return a * np.asarray(x, float)


def add(x, y) -> np.ndarray:
    return axpy(1.0, x, y)


def sub(x, y) -> np.ndarray:
    return axpy(-1.0, y, x)


def norm2(x) -> float:
    """Euclidean length, without overflow or underflow on the way."""
    x = np.abs(np.asarray(x, float))
    if np.isinf(x).any():
        return math.inf
    top = float(x.max(initial=0.0))
    if not top > 0:
        return top
    # Scaling by a power of two is exact.
    e = math.frexp(top)[1]
    return math.ldexp(math.sqrt(float(np.sum(np.ldexp(x, -e) ** 2))), e)


def gemv(a: Matrix, x) -> np.ndarray:
    if a.shape[1] != len(x):
        raise LinAlgRefused(f"gemv: {a.shape} times {len(x)}")
    return a.values @ np.asarray(x, float)


def gemm(a: Matrix, b: Matrix) -> Matrix:
    if a.shape[1] != b.shape[0]:
        raise LinAlgRefused(f"gemm: {a.shape} times {b.shape}")
    return Matrix(a.values @ b.values)


def gram(a: Matrix) -> Matrix:
    """The products of all pairs of columns."""
    return Matrix(a.values.T @ a.values)


def table_gram(df: DataFrame, columns: list[str]) -> Matrix:
    """``gram`` of a table's columns, by one aggregation; rows with a null in them do not count."""
    c = [F.col(f"`{n}`").cast("double") for n in columns]
    whole = df.where(~F.greatest(*[x.isNull().cast("int") for x in c], F.lit(0)).cast("boolean"))
    pairs = [(i, j) for i in range(len(c)) for j in range(i, len(c))]
    r = whole.agg(*[F.coalesce(F.sum(c[i] * c[j]), F.lit(0.0)).alias(f"p{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(c), len(c)))
    for i, j in pairs:
        out[i, j] = out[j, i] = r[f"p{i}_{j}"]
    return Matrix(out)


def solve_triangular(t: Matrix, b, lower: bool = False) -> np.ndarray:
    """x of t x = b for a triangle t; what stands on its other side is not read."""
    n = t.shape[0]
    if t.shape != (n, n) or len(b) != n:
        raise LinAlgRefused(f"a triangle of {t.shape} against {len(b)}")
    x = np.zeros(n)
    for i in range(n) if lower else reversed(range(n)):
        if t.values[i, i] == 0:
            raise LinAlgRefused(f"a zero at {i} on the diagonal")
        rest = slice(0, i) if lower else slice(i + 1, n)
        x[i] = (b[i] - t.values[i, rest] @ x[rest]) / t.values[i, i]
    return x


def givens(a: float, b: float) -> tuple[float, float, float]:
    """(c, s, r) of the rotation that takes (a, b) to (r, 0)."""
    r = math.hypot(a, b)
    return (1.0, 0.0, 0.0) if r == 0 else (a / r, b / r, r)


def householder(a: Matrix) -> tuple[Matrix, Matrix]:
    """(Q, R) with a nonnegative diagonal of R."""
    q, r = np.linalg.qr(a.values)
    turn = np.where(np.diag(r) < 0, -1.0, 1.0)
    return Matrix(q * turn), Matrix(r * turn[:, None])


def pivoted(a: Matrix) -> tuple[Matrix, Matrix, list[int], int]:
    """(Q, R, columns in the order taken, rank): the column with the most left comes next, and the rank is where
    what is left is negligible beside the column itself, max(n, p) * 2^-52."""
    n, p = a.shape
    rest, size = a.values.copy(), np.linalg.norm(a.values, axis=0)
    order, qs, r = list(range(p)), [], np.zeros((min(n, p), p))
    rank = 0
    for k in range(min(n, p)):
        left = np.linalg.norm(rest[:, order[k:]], axis=0)
        best = k + int(left.argmax())
        if left.max(initial=0.0) <= max(n, p) * N.EPS * size[order[best]]:
            break
        order[k], order[best] = order[best], order[k]
        r[:k, [k, best]] = r[:k, [best, k]]
        v = rest[:, order[k]]
        for u in qs:  # once more against what came before
            v = v - u * (u @ v)
        qs.append(v / np.linalg.norm(v))
        r[k, k:] = qs[-1] @ rest[:, order[k:]]
        rest[:, order[k:]] -= np.outer(qs[-1], r[k, k:])
        rank += 1
    return Matrix(np.column_stack(qs) if qs else np.zeros((n, 0))), Matrix(r[:rank]), order, rank


def encode(m: Matrix) -> str:
    """Canonical text: shape and elements by column; floats that are none are named."""
    name = lambda v: v if math.isfinite(v) else "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    return json.dumps({"cols": m.shape[1], "data": [name(v) for v in m.values.T.ravel().tolist()], "rows": m.shape[0]}, separators=(",", ":"))


def decode(text: str) -> Matrix:
    try:
        t = json.loads(text)
        rows, cols, data = t["rows"], t["cols"], [float(v) if not isinstance(v, bool) else None for v in t["data"]]
        if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in (rows, cols)) or len(data) != rows * cols:
            raise CodecError("a shape that the elements do not fill")
        return Matrix(np.array(data, float).reshape(cols, rows).T)
    except (ValueError, KeyError, TypeError) as e:
        raise CodecError(f"not a matrix: {e}") from None


@dataclass
class Accumulator:
    """Least squares over rows that come a part at a time: what it holds is the triangle of [X | y]."""

    p: int
    n: int = 0
    triangle: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __post_init__(self):
        if not self.triangle.size:
            self.triangle = np.zeros((self.p + 1, self.p + 1))

    def add(self, x, y, weights=None) -> Accumulator:
        x, y = np.asarray(x, float).reshape(-1, self.p), np.asarray(y, float)
        if len(x) != len(y):
            raise LinAlgRefused(f"{len(x)} rows against {len(y)} responses")
        root = np.sqrt(np.ones(len(y)) if weights is None else np.asarray(weights, float))[:, None]
        rows = root * np.column_stack([x, y])
        return Accumulator(self.p, self.n + len(y), N.triangle(np.vstack([self.triangle, rows])))

    def merge(self, other: Accumulator) -> Accumulator:
        if other.p != self.p:
            raise LinAlgRefused(f"{self.p} against {other.p} predictors")
        return Accumulator(self.p, self.n + other.n, N.triangle(np.vstack([self.triangle, other.triangle])))

    def fit(self, ridge: float = 0.0) -> dict:
        """coefficients (NaN where aliased), kept columns, covariance without scale, residual sum of squares."""
        b, kept, cov, rss = N.least_squares(self.triangle, self.p, self.n, np.full(self.p, ridge) if ridge else None)
        return {"coefficients": b, "kept": kept, "covariance": cov, "rss": rss, "n": self.n}

    def encode(self) -> str:
        return json.dumps({"n": self.n, "p": self.p, "triangle": json.loads(encode(Matrix(self.triangle)))}, separators=(",", ":"))

    @staticmethod
    def decode(text: str) -> Accumulator:
        try:
            t = json.loads(text)
            m = decode(json.dumps(t["triangle"])).values
            if m.shape != (t["p"] + 1, t["p"] + 1) or t["n"] < 0:
                raise CodecError("a triangle of another size")
            return Accumulator(t["p"], t["n"], m.copy())
        except (ValueError, KeyError, TypeError) as e:
            raise CodecError(f"not an accumulator: {e}") from None
