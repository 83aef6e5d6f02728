"""Least squares and generalized linear models over grouped rows of any size.

Every task reduces its rows, per group, to the triangle of a QR factorisation of the weighted [X | z];
stacked triangles of the tasks give the group's triangle, so no task and no driver ever holds a group's rows.
A generalized model repeats that pass once per iteration. What reaches the driver is one small
triangle per group: groups times terms must fit in driver memory. Scoring is column arithmetic in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernix.errors import FitError, TypeMismatch, UnsupportedFit
from quernix.functions import expr as E
from quernix.functions import numerics as N
from quernix.functions import units
from quernix.functions.compile import Field, compile_expr, numeric, spark_type
from quernix.operators import outputs
from quernix.plans import steps as S
from quernix.plans.engine import ORD, State, need, q

#: Family: admitted links, the default first.
LINKS = {
    "gaussian": ("identity", "log", "inverse"),
    "binomial": ("logit", "probit", "cloglog"),
    "quasiBinomial": ("logit", "probit", "cloglog"),
    "poisson": ("log", "identity", "sqrt"),
    "quasiPoisson": ("log", "identity", "sqrt"),
    "gamma": ("inverse", "identity", "log"),
    "inverseGaussian": ("inverseSquare", "inverse", "identity", "log"),
    "negativeBinomial": ("log", "sqrt", "identity"),
    "tweedie": ("log",),
}
FIXED_DISPERSION = ("binomial", "poisson", "negativeBinomial")
ERRORS = ("classical", "hc0", "hc1", "hc2", "hc3")
#: Levels of a factor are columns of a dense triangle on the driver; more are refused.
MAX_LEVELS = 5000


@dataclass
class Model:
    beta: np.ndarray
    kept: list[int]
    cov: np.ndarray  # over kept columns, unscaled
    n: int
    deviance: float
    null_deviance: float
    dispersion: float
    iterations: int
    converged: bool
    theta: float | None = None
    theta_se: float | None = None
    alternations: int = 0
    errors: np.ndarray | None = None  # robust standard errors

    @property
    def df(self) -> int:
        return self.n - len(self.kept)

    def std_errors(self) -> np.ndarray:
        out = np.full(len(self.beta), np.nan)
        out[self.kept] = self.errors if self.errors is not None else np.sqrt(np.maximum(0, self.dispersion * np.diag(self.cov)))
        return out


@dataclass
class Design:
    terms: list[str]
    columns: list[Column]
    units: list[str | None]
    checks: list[Column] = field(default_factory=list)


# Links and families, on numpy arrays


def link_inverse(link: str, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and its derivative by the linear predictor."""
    if link == "identity":
        return eta, np.ones_like(eta)
    if link == "log":
        mu = np.exp(np.minimum(eta, 700))
        return mu, mu
    if link == "inverse":
        return 1 / eta, -1 / eta**2
    if link == "inverseSquare":
        return 1 / np.sqrt(eta), -0.5 / eta**1.5
    if link == "sqrt":
        return eta**2, 2 * eta
    lo, hi = N.EPS, 1 - N.EPS
    if link == "logit":
        mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        mu = np.clip(mu, lo, hi)
        return mu, mu * (1 - mu)
    if link == "probit":
        mu = np.array([N.normal_cdf(x) for x in eta.tolist()])
        return np.clip(mu, lo, hi), np.maximum(np.exp(-0.5 * eta**2) / math.sqrt(2 * math.pi), N.EPS)
    e = np.exp(np.clip(eta, -700, 700))
    return np.clip(-np.expm1(-e), lo, hi), np.maximum(e * np.exp(-e), N.EPS)


def link_of(link: str, mu: np.ndarray) -> np.ndarray:
    if link in ("identity", "log", "inverse", "inverseSquare", "sqrt"):
        return {"identity": lambda: mu, "log": lambda: np.log(mu), "inverse": lambda: 1 / mu, "inverseSquare": lambda: mu**-2.0, "sqrt": lambda: np.sqrt(mu)}[link]()
    if link == "logit":
        return np.log(mu / (1 - mu))
    if link == "probit":
        return np.array([N.normal_quantile(x) for x in mu.tolist()])
    return np.log(-np.log1p(-mu))


def variance(family: str, mu: np.ndarray, theta: float | None, power: float) -> np.ndarray:
    if family == "gaussian":
        return np.ones_like(mu)
    if family in ("binomial", "quasiBinomial"):
        return mu * (1 - mu)
    if family in ("poisson", "quasiPoisson"):
        return mu
    if family == "gamma":
        return mu**2
    if family == "inverseGaussian":
        return mu**3
    return mu + mu**2 / theta if family == "negativeBinomial" else mu**power


def deviance(family: str, y: np.ndarray, mu: np.ndarray, w: np.ndarray, theta: float | None, power: float) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        ylog = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0)
        if family == "gaussian":
            d = (y - mu) ** 2
        elif family in ("binomial", "quasiBinomial"):
            d = 2 * (ylog + np.where(y < 1, (1 - y) * np.log(np.where(y < 1, 1 - y, 1) / (1 - mu)), 0))
        elif family in ("poisson", "quasiPoisson"):
            d = 2 * (ylog - (y - mu))
        elif family == "gamma":
            d = -2 * (np.log(np.where(y > 0, y, mu) / mu) - (y - mu) / mu)
        elif family == "inverseGaussian":
            d = (y - mu) ** 2 / (y * mu**2)
        elif family == "negativeBinomial":
            d = 2 * (ylog - (y + theta) * np.log((y + theta) / (mu + theta)))
        else:
            p = power
            d = 2 * (np.where(y > 0, y ** (2 - p), 0) / ((1 - p) * (2 - p)) - y * mu ** (1 - p) / (1 - p) + mu ** (2 - p) / (2 - p))
    return float(np.sum(w * d))


def start(family: str, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    if family in ("binomial", "quasiBinomial"):
        return (w * y + 0.5) / (w + 1)
    if family in ("poisson", "quasiPoisson"):
        return y + 0.1
    return np.where(y == 0, {"negativeBinomial": 1 / 6, "tweedie": 0.1}.get(family, 0.0), y) if family in ("negativeBinomial", "tweedie") else y


def in_range(family: str, y: np.ndarray) -> bool:
    if family in ("binomial", "quasiBinomial"):
        return bool(((y >= 0) & (y <= 1)).all())
    if family in ("poisson", "quasiPoisson", "negativeBinomial", "tweedie"):
        return bool((y >= 0).all())
    return bool((y > 0).all()) if family in ("gamma", "inverseGaussian") else True


# Design


def setting(v) -> E.Expr | None:
    return E.Col(v) if isinstance(v, str) else v


def check(s: S.Fit, schema: dict[str, Field]) -> S.Fit:
    if s.family not in LINKS:
        raise UnsupportedFit(f"no family {s.family}; there are {', '.join(LINKS)}")
    s = replace(s, link=s.link or LINKS[s.family][0])
    if s.link not in LINKS[s.family]:
        raise UnsupportedFit(f"{s.family} under {s.link}; it takes {', '.join(LINKS[s.family])}")
    if s.std_errors not in ERRORS and s.std_errors != "robust":
        raise UnsupportedFit(f"no errors {s.std_errors}")
    if s.output not in ("coefficients", "summary", "fitted", "residuals"):
        raise UnsupportedFit(f"no output {s.output}")
    need(schema, s.response, *s.group_by)
    if not numeric(schema[s.response].type):
        raise TypeMismatch(f"a response of {schema[s.response].type}")
    return replace(s, std_errors="hc3" if s.std_errors == "robust" else s.std_errors)


def design(st: State, s: S.Fit, levels: dict[str, list[str]] | None = None) -> tuple[Design, dict[str, list[str]]]:
    """Terms and their columns: numbers as they are, strings and booleans against their first level."""
    terms, cols, us, checks = [], [], [], []
    response = st.schema[s.response].unit if s.response in st.schema else None
    if s.intercept:
        terms.append("(Intercept)")
        cols.append(F.lit(1.0))
        us.append(response)
    found = {} if levels is None else levels
    full = s.intercept
    for name, e in s.predictors:
        x = compile_expr(e, st.schema)
        if numeric(x.type):
            terms.append(name)
            cols.append(x.col.cast("double"))
            us.append(units.combine(response, x.unit, -1))
            continue
        if x.type not in ("string", "bool"):
            raise TypeMismatch(f"a predictor of {x.type}")
        c = x.col.cast("string")
        if levels is None:
            have = [r[0] for r in st.df.where(c.isNotNull()).select(c.alias("v")).distinct().limit(MAX_LEVELS + 1).collect()]
            if len(have) > MAX_LEVELS:
                raise FitError(f"{name} has more than {MAX_LEVELS} levels")
            found[name] = sorted(have)
        else:
            known = found[name]
            checks.append(F.when(c.isNotNull() & ~c.isin(known), F.raise_error(F.concat(F.lit(f"FitError: {name} has an unseen level "), c)).cast("double")))
        # The first factor keeps all its levels where there is no intercept.
        for lv in found[name][1 if full else 0 :]:
            terms.append(f"{name}[{lv}]")
            cols.append(F.when(c.isNotNull(), F.when(c == lv, 1.0).otherwise(0.0)))
            us.append(response)
        full = True
    if not terms:
        raise FitError("no terms")
    return Design(terms, cols, us, checks), found


def rows_of(st: State, s: S.Fit, d: Design) -> DataFrame:
    """__k0.. (groups), y, w, o, x0..: listwise complete rows of positive weight."""
    w = compile_expr(setting(s.weights), st.schema).col.cast("double") if s.weights is not None else F.lit(1.0)
    o = compile_expr(setting(s.offset), st.schema).col.cast("double") if s.offset is not None else F.lit(0.0)
    r = st.df.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(s.group_by)], q(s.response).cast("double").alias("y"), w.alias("w"), o.alias("o"), *[c.alias(f"x{j}") for j, c in enumerate(d.columns)])
    ok = (F.col("w") > 0) & F.col("y").isNotNull() & F.col("o").isNotNull()
    for j in range(len(d.columns)):
        ok &= F.col(f"x{j}").isNotNull()
    return r.where(ok)


def each_group(rows: DataFrame, s: S.Fit, p: int, reduce, width: int) -> dict[tuple, np.ndarray]:
    """reduce(key, y, w, o, x) -> (triangle rows of ``width``, sums) over all rows, by group."""
    keys = [f"__k{i}" for i in range(len(s.group_by))]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    ddl = f"{kinds}{', ' if kinds else ''}tri binary, sums binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            y, w, o = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("y", "w", "o"))
            x = np.column_stack([b.column(b.schema.get_field_index(f"x{j}")).to_numpy(zero_copy_only=False) for j in range(p)])
            if keys:
                groups: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(*[b.column(j).to_pylist() for j in range(len(keys))])):
                    groups.setdefault(k, []).append(i)
            else:
                groups = {(): slice(None)}
            for k, at in groups.items():
                t, sums = reduce(k, y[at], w[at], o[at], x[at])
                if k in held:
                    old = held[k]
                    held[k] = [N.triangle(np.vstack([old[0], t])), old[1] + sums]
                else:
                    held[k] = [N.triangle(t), sums]
        yield pack(held)

    def pack(held) -> pa.RecordBatch:
        ks = list(held)
        arrays = [pa.array([k[i] for k in ks], type=pa_types[i]) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([held[k][0].tobytes() for k in ks], pa.binary()), pa.array([held[k][1].tobytes() for k in ks], pa.binary())], [*keys, "tri", "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_types = [to_arrow_type(rows.schema[k].dataType) for k in keys]

    def merge(table: pa.Table) -> pa.Table:
        tri = [np.frombuffer(t, float).reshape(-1, width) for t in table.column("tri").to_pylist()]
        sums = sum(np.frombuffer(v, float) for v in table.column("sums").to_pylist())
        b = pack({tuple(table.column(k)[0].as_py() for k in keys): [N.triangle(np.vstack(tri)), sums]})
        return pa.Table.from_batches([b])

    parts = rows.mapInArrow(local, ddl)
    out = parts.groupBy(*[F.col(k) for k in keys]).applyInArrow(merge, ddl)
    return {tuple(r[k] for k in keys): (np.frombuffer(r["tri"], float).reshape(-1, width), np.frombuffer(r["sums"], float)) for r in out.collect()}


def fit_models(st: State, s: S.Fit) -> tuple[Design, dict[str, list[str]], dict[tuple, Model], S.Fit]:
    s = check(s, st.schema)
    d, levels = design(st, s)
    rows, once = rows_of(st, s, d), s.family == "gaussian" and s.link == "identity" and s.std_errors == "classical"
    if once:
        return d, levels, passes(rows, s, d), s
    # Every iteration reads the rows again; held by the executors (spilling), and computed anew where one is lost.
    rows = rows.persist()
    try:
        return d, levels, passes(rows, s, d), s
    finally:
        rows.unpersist()


def passes(rows: DataFrame, s: S.Fit, d: Design) -> dict[tuple, Model]:
    p = len(d.terms)
    ridge = np.full(p, float(s.ridge))
    if s.intercept:
        ridge[0] = 0
    penal = ridge if s.ridge else None
    family, link, power = s.family, s.link, s.power
    plain = family == "gaussian" and link == "identity"
    models: dict[tuple, Model] = {}
    thetas: dict[tuple, float] = {}

    def one_pass(betas: dict[tuple, np.ndarray] | None, means: dict[tuple, float]):
        th = dict(thetas)

        def reduce(k, y, w, o, x):
            if not in_range(family, y):
                raise FitError(f"a response out of the range of {family}")
            theta = th.get(k, s.theta or 1.0)
            if plain:
                z, ww, mu = y - o, w, None
            else:
                with np.errstate(all="ignore"):
                    eta = link_of(link, start(family, y, w)) if betas is None else x @ np.nan_to_num(betas[k]) + o
                    mu, slope = link_inverse(link, eta)
                    z = eta - o + (y - mu) / slope
                    ww = w * slope**2 / variance(family, mu, theta, power)
                if not (np.isfinite(z).all() and np.isfinite(ww).all()):
                    raise FitError("the iteration left the family's range")
            root = np.sqrt(ww)[:, None]
            dev = 0.0 if plain else deviance(family, y, mu, w, theta, power)
            null = deviance(family, y, np.full_like(y, means[k]), w, theta, power) if k in means else 0.0
            chi = 0.0 if plain else float(np.sum(w * (y - mu) ** 2 / variance(family, mu, theta, power)))
            edge = 0.0 if plain or family not in ("binomial", "quasiBinomial") else float(np.sum(np.minimum(mu, 1 - mu) > 1e-7))
            sums = np.array([len(y), w.sum(), (w * (y - (o if plain else 0))).sum(), (w * (y - (o if plain else 0)) ** 2).sum(), dev, chi, null, edge])
            return np.hstack([root * x, root * z[:, None]]), sums

        return each_group(rows, s, p, reduce, p + 1)

    def theta_pass(betas, th):
        def reduce(k, y, w, o, x):
            mu, _ = link_inverse(link, x @ np.nan_to_num(betas[k]) + o)
            t = th[k]
            dg = np.array([N.digamma(v) for v in (y + t).tolist()]) - N.digamma(t)
            tg = np.array([N.trigamma(v) for v in (y + t).tolist()]) - N.trigamma(t)
            score = w * (dg + math.log(t) + 1 - np.log(t + mu) - (y + t) / (mu + t))
            info = -w * (tg + 1 / t - 2 / (mu + t) + (y + t) / (mu + t) ** 2)
            return np.zeros((1, 1)), np.array([score.sum(), info.sum()])

        return each_group(rows, s, p, reduce, 1)

    first = one_pass(None, {})
    if plain:
        for k, (tri, sums) in first.items():
            n = int(sums[0])
            beta, kept, cov, rss = N.least_squares(tri, p, n, penal)
            null = sums[3] - sums[2] ** 2 / sums[1] if s.intercept else sums[3]
            if s.intercept:  # centred by the triangle, not by a difference of squares
                null = N.least_squares(np.column_stack([tri[:, 0], tri[:, p]]), 1, n)[3]
            models[k] = Model(beta, kept, cov, n, rss, null, rss / (n - len(kept)) if n > len(kept) else math.nan, 1, True)
    else:
        if family == "negativeBinomial" and s.theta is None:
            for k, (_, sm) in first.items():
                mean = sm[2] / sm[1]
                spread = sm[3] / sm[1] - mean**2
                thetas[k] = min(max(mean**2 / (spread - mean), 0.1), 1e4) if spread > mean > 0 else 100.0
        for alternation in range(25 if family == "negativeBinomial" and s.theta is None else 1):
            state = first if alternation == 0 else one_pass(betas, {})
            means = {k: sm[2] / sm[1] for k, (_, sm) in state.items()}
            devs, done, iterations, betas = {k: sm[4] for k, (_, sm) in state.items()}, {}, {}, {}
            for i in range(1, s.max_iter + 1):
                for k, (tri, sm) in state.items():
                    if k not in done:
                        betas[k] = N.least_squares(tri, p, int(sm[0]), penal)[0]
                state = one_pass(betas, means)
                for k, (tri, sm) in state.items():
                    if k not in done:
                        if abs(sm[4] - devs[k]) <= s.tol * (abs(sm[4]) + 0.1):
                            done[k] = iterations[k] = i
                        devs[k] = sm[4]
                if len(done) == len(state):
                    break
            if bad := [k for k in state if k not in done]:
                raise FitError(f"not converged after {s.max_iter} iterations: {bad[:3]}")
            if not thetas:
                break
            old = dict(thetas)
            for _ in range(30):
                got = theta_pass(betas, thetas)
                step = {k: sm[0] / sm[1] if sm[1] > 0 else thetas[k] for k, (_, sm) in got.items()}
                thetas = {k: max(thetas[k] / 10, min(thetas[k] * 10, thetas[k] + step[k])) for k in thetas}
                if all(abs(step[k]) <= 1e-9 * thetas[k] for k in thetas):
                    break
            if all(abs(thetas[k] - old[k]) <= 1e-8 * old[k] for k in thetas):
                break
        theta_info = theta_pass(betas, thetas) if thetas else {}
        for k, (tri, sm) in state.items():
            n = int(sm[0])
            if family in ("binomial", "quasiBinomial") and sm[7] == 0:
                raise FitError("separation: every fitted mean is at an edge")
            _, kept, cov, _ = N.least_squares(tri, p, n, penal)
            df = n - len(kept)
            phi = 1.0 if family in FIXED_DISPERSION else sm[5] / df if df > 0 else math.nan
            models[k] = Model(np.where(np.isin(np.arange(p), kept), betas[k], np.nan), kept, cov, n, sm[4], sm[6], phi, iterations[k], True)
            if family == "negativeBinomial":
                models[k].theta = thetas.get(k, s.theta)
                if k in theta_info:
                    models[k].theta_se = 1 / math.sqrt(theta_info[k][1][1])
                    models[k].alternations = alternation + 1
    if s.std_errors != "classical":
        robust(rows, s, p, models)
    return models


def robust(rows: DataFrame, s: S.Fit, p: int, models: dict[tuple, Model]) -> None:
    """Sandwich errors: one more pass over the rows for the filling."""
    kind, family, link = s.std_errors, s.family, s.link

    def reduce(k, y, w, o, x):
        m = models[k]
        xk = x[:, m.kept]
        mu, slope = link_inverse(link, xk @ m.beta[m.kept] + o)
        v = variance(family, mu, m.theta or s.theta or 1.0, s.power)
        score = w * (y - mu) * slope / v
        h = np.einsum("ij,jk,ik->i", xk, m.cov, xk) * w * slope**2 / v
        adj = {"hc0": 1.0, "hc1": math.sqrt(m.n / max(1, m.df)), "hc2": 1 / np.sqrt(np.maximum(1e-12, 1 - h)), "hc3": 1 / np.maximum(1e-12, 1 - h)}[kind]
        out = np.zeros((len(y), p))
        out[:, m.kept] = xk * (score * adj)[:, None]
        return out, np.zeros(1)

    for k, (tri, _) in each_group(rows, s, p, reduce, p).items():
        m = models[k]
        t = tri[:, m.kept]
        m.errors = np.sqrt(np.diag(m.cov @ (t.T @ t) @ m.cov))


# Steps


def table(st: State, schema: dict[str, Field], rows: list[tuple]) -> State:
    ddl = ", ".join(f"`{n}` {spark_type(f.type)}" for n, f in schema.items())
    if st.ordered:
        ddl += f", {ORD} bigint"
        rows = [(*r, i) for i, r in enumerate(rows)]
    return State(st.df.sparkSession.createDataFrame(rows, ddl), schema, st.ordered)


def real(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def in_order(models: dict) -> list:
    return sorted(models, key=lambda k: tuple((x is None, str(type(x)), x) for x in k))


def mean_column(link: str, eta: Column) -> Column:
    if link == "identity":
        return eta
    if link == "log":
        return F.exp(eta)
    if link == "inverse":
        return F.lit(1.0) / eta
    if link == "inverseSquare":
        return F.lit(1.0) / F.sqrt(eta)
    if link == "sqrt":
        return eta * eta
    if link == "logit":
        return F.lit(1.0) / (F.exp(-eta) + 1)
    if link == "cloglog":
        return -F.expm1(-F.exp(eta))
    import pandas as pd

    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        return v.map(N.normal_cdf)

    return cdf(eta)


def with_models(st: State, s: S.Fit, models: dict[tuple, Model], p: int) -> tuple[DataFrame, Column]:
    """Rows beside their group's model columns (b, cov, phi, tq); unknown groups have none."""
    keys = [f"__g{i}" for i in range(len(s.group_by))]
    kinds = [f"{k} {spark_type(st.schema[g].type)}" for k, g in zip(keys, s.group_by)]
    rows = []
    for k, m in models.items():
        cov = np.zeros((p, p))
        cov[np.ix_(m.kept, m.kept)] = m.cov
        rows.append((*k, np.nan_to_num(m.beta).tolist(), cov.ravel().tolist(), real(m.dispersion), m.df))
    ms = st.df.sparkSession.createDataFrame(rows, ", ".join([*kinds, "__b array<double>, __cov array<double>, __phi double, __df int"]))
    if not keys:
        return st.df.crossJoin(F.broadcast(ms)), F.col("__b")  # one row
    cond = None
    for k, g in zip(keys, s.group_by):
        c = q(g).eqNullSafe(F.col(k))
        cond = c if cond is None else cond & c
    return st.df.join(ms, cond, "left"), F.col("__b")


def linear(d: Design, b: Column) -> Column:
    out = None
    for j, c in enumerate(d.columns):
        out = c * b[j] if out is None else out + c * b[j]
    return out


def fit_step(st: State, s: S.Fit) -> State:
    d, _, models, s = fit_models(st, s)
    schema = outputs.fit_schema(s, st.schema)
    if s.output == "coefficients":
        rows = []
        for k in in_order(models):
            m = models[k]
            se = m.std_errors()
            rows += [(*k, t, real(b), real(e), real(b / e) if e and not math.isnan(e) else None, u) for t, b, e, u in zip(d.terms, m.beta.tolist(), se.tolist(), d.units)]
        return table(st, schema, rows)
    if s.output == "summary":
        rows = []
        for k in in_order(models):
            m = models[k]
            r2 = 1 - m.deviance / m.null_deviance if s.family == "gaussian" and m.null_deviance else math.nan
            row = (*k, m.n, m.df, real(math.sqrt(m.dispersion)) if m.dispersion == m.dispersion else None, real(r2), len(m.kept), m.deviance, m.null_deviance, real(m.dispersion), m.iterations, m.converged)
            rows.append(row + ((m.theta, m.theta_se, m.alternations) if s.family == "negativeBinomial" else ()))
        return table(st, schema, rows)
    df, b = with_models(st, s, models, len(d.terms))
    o = compile_expr(setting(s.offset), st.schema).col.cast("double") if s.offset is not None else F.lit(0.0)
    mu = mean_column(s.link, linear(d, b) + o)
    w = compile_expr(setting(s.weights), st.schema).col if s.weights is not None else F.lit(1.0)
    y = q(s.response).cast("double")
    mu = F.when((w > 0) & y.isNotNull(), mu)
    name = "fitted" if s.output == "fitted" else "residual"
    if name in st.schema:
        raise FitError(f"{name} is already a column")
    c = mu if name == "fitted" else y - mu
    return State(df.withColumn(name, c).select(*[q(n) for n in schema], *([ORD] if st.ordered else [])), schema, st.ordered)


def predict_step(st: State, s: S.Predict, src: State) -> State:
    if s.interval and (s.interval[0] not in ("confidence", "prediction") or not 0 < s.interval[1] < 1):
        raise FitError(f"no interval {s.interval}")
    if s.scale not in ("link", "response"):
        raise FitError(f"no scale {s.scale}")
    if s.model_from == "coefficients":
        fit = check_link(s.fit)
        return from_coefficients(st, s, fit, src)
    if s.fit.std_errors != "classical":
        raise UnsupportedFit("predictions of a model with robust errors")
    d0, levels, models, fit = fit_models(src, s.fit)
    if s.interval and s.interval[0] == "prediction" and fit.link != "identity":
        raise UnsupportedFit("a prediction interval needs the identity link")
    for name, e in fit.predictors:
        units.same(name, compile_expr(e, src.schema).unit, compile_expr(e, st.schema).unit)
    schema = outputs.predict_schema(s, st.schema)
    for n in schema:
        if n not in st.schema and n in st.df.columns:
            raise FitError(f"{n} is already a column")
    d, _ = design(st, fit, levels)
    p = len(d.terms)
    df, b = with_models(st, fit, models, p)
    known = F.when(b.isNull(), F.raise_error("FitError: a group that was not fitted").cast("double")).otherwise(0.0)
    o = compile_expr(setting(fit.offset), st.schema).col.cast("double") if fit.offset is not None else F.lit(0.0)
    eta = known + linear(d, b) + o
    for c in d.checks:
        eta = eta + F.coalesce(c, F.lit(0.0))
    xs = F.array(*d.columns)
    quad = F.aggregate(F.sequence(F.lit(0), F.lit(p * p - 1)), F.lit(0.0), lambda acc, k: acc + F.col("__cov")[k] * F.get(F.col("__xs"), F.floor(k / p).cast("int")) * F.get(F.col("__xs"), k % p))
    df = df.withColumn("__eta", eta).withColumn("__xs", xs).withColumn("__se", F.when(F.col("__eta").isNotNull(), F.sqrt(F.col("__phi") * quad)))
    mean = mean_column(fit.link, F.col("__eta"))
    e, se = F.col("__eta"), F.col("__se")
    spread = F.sqrt(se * se + F.col("__phi"))
    on_link = s.scale == "link"
    slope = F.lit(1.0) if on_link or fit.link == "identity" else slope_column(fit.link, e)
    cols = {"predicted": e if on_link else mean, "se_fit": se * slope, "se_pred": spread if fit.link == "identity" else F.lit(None).cast("double")}
    if s.interval:
        kind, level = s.interval
        tail = (1 - level) / 2
        dfs = sorted({m.df for m in models.values()})
        qs = {n: -N.normal_quantile(tail) if fit.family in FIXED_DISPERSION else -N.student_t_quantile(tail, n) if n > 0 else math.nan for n in dfs}
        t = F.lit(None).cast("double")
        for n, v in qs.items():
            t = F.when(F.col("__df") == n, F.lit(v)).otherwise(t)
        half = t * (se if kind == "confidence" else spread)
        lo, hi = (e - half, e + half) if on_link else (mean_column(fit.link, e - half), mean_column(fit.link, e + half))
        cols |= {"lower": F.least(lo, hi), "upper": F.greatest(lo, hi)}
    out = df.select(*[q(n) for n in st.schema], *[c.alias(n) for n, c in cols.items()], *([ORD] if st.ordered else []))
    return State(out, schema, st.ordered)


def slope_column(link: str, e: Column) -> Column:
    """Absolute derivative of the mean by the linear predictor."""
    if link == "log":
        return F.exp(e)
    if link == "logit":
        m = mean_column("logit", e)
        return m * (1 - m)
    if link == "cloglog":
        return F.exp(e - F.exp(e))
    if link == "probit":
        return F.exp(e * e * -0.5) / math.sqrt(2 * math.pi)
    return {"inverse": 1 / (e * e), "inverseSquare": F.pow(e, F.lit(-1.5)) * 0.5, "sqrt": F.abs(e) * 2}[link]


def check_link(fit: S.Fit) -> S.Fit:
    link = fit.link or LINKS.get(fit.family, (None,))[0]
    if link is None or link not in LINKS[fit.family]:
        raise UnsupportedFit(f"{fit.family} under {fit.link}")
    return replace(fit, link=link)


def from_coefficients(st: State, s: S.Predict, fit: S.Fit, src: State) -> State:
    """Scores by a table of (groups, term, estimate): factors follow the terms it has."""
    need(src.schema, "term", "estimate", *fit.group_by)
    by: dict[tuple, dict[str, float]] = {}
    for r in src.df.select(*[q(g) for g in fit.group_by], q("term"), q("estimate")).collect():  # groups times terms
        by.setdefault(tuple(r[: len(fit.group_by)]), {})[r["term"]] = r["estimate"]
    names = {t for m in by.values() for t in m}
    cols, terms = [], []
    if fit.intercept:
        cols.append(F.lit(1.0))
        terms.append("(Intercept)")
    for name, e in fit.predictors:
        x = compile_expr(e, st.schema)
        if numeric(x.type):
            cols.append(x.col.cast("double"))
            terms.append(name)
            continue
        for t in sorted(t for t in names if t.startswith(f"{name}[")):
            c = x.col.cast("string")
            cols.append(F.when(c.isNotNull(), F.when(c == t[len(name) + 1 : -1], 1.0).otherwise(0.0)))
            terms.append(t)
    models = {}
    for k, m in by.items():
        if missing := [t for t in terms if t not in m]:
            raise FitError(f"no coefficient for {', '.join(missing)}")
        models[k] = Model(np.array([np.nan if m[t] is None else m[t] for t in terms]), [], np.zeros((0, 0)), 0, 0, 0, 0, 0, True)
    df, b = with_models(st, fit, models, len(terms))
    o = compile_expr(setting(fit.offset), st.schema).col.cast("double") if fit.offset is not None else F.lit(0.0)
    known = F.when(b.isNull(), F.raise_error("FitError: a group without coefficients").cast("double")).otherwise(0.0)
    eta = known + linear(Design(terms, cols, []), b) + o
    c = eta if s.scale == "link" else mean_column(fit.link, eta)
    schema = outputs.predict_schema(s, st.schema)
    return State(df.withColumn("predicted", c).select(*[q(n) for n in schema], *([ORD] if st.ordered else [])), schema, st.ordered)

