"""Pipelines as data: a tuple of steps over one table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from quernix.errors import AggError, UnboundParam, UnresolvedSource
from quernix.functions import expr as E

AGGS = ("sum", "mean", "min", "max", "count", "countDistinct", "median", "stddev", "first", "last")
WINDOWS = ("rowNumber", "rank", "denseRank", "competitionRank", "ntile", "lag", "lead", "cumulSum", "cumulMax", "cumulMin", "rollingSum", "rollingMean")
JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer", "semi": "left_semi", "anti": "left_anti"}


@dataclass(frozen=True)
class Step:
    pass


@dataclass(frozen=True)
class Ref:
    """A source the host resolves by name."""

    name: str


@dataclass(frozen=True)
class Embedded:
    """A small table written into the pipeline: ((name, type[, unit]), ...) and rows."""

    schema: tuple[tuple, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Filter(Step):
    pred: E.Expr


@dataclass(frozen=True)
class Project(Step):
    columns: tuple[tuple[str, str], ...]  # (source, output)


@dataclass(frozen=True)
class Derive(Step):
    name: str
    expr: E.Expr


@dataclass(frozen=True)
class Define(Step):
    fn: E.FnDef


@dataclass(frozen=True)
class Agg:
    name: str
    fn: str
    of: str

    def __post_init__(self):
        if self.fn not in AGGS:
            raise AggError(f"no aggregate {self.fn}; there are {', '.join(AGGS)}")


@dataclass(frozen=True)
class GroupBy(Step):
    keys: tuple[str, ...]
    aggs: tuple[Agg, ...]


@dataclass(frozen=True)
class Join(Step):
    how: str
    source: Any
    on: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Window(Step):
    fn: str
    as_: str
    of: str | None = None
    partition_by: tuple[str, ...] = ()
    order_by: tuple[tuple[Any, str], ...] = ()
    n: int | None = None


@dataclass(frozen=True)
class Pivot(Step):
    index: tuple[str, ...]
    on: str
    values: str
    agg: str


@dataclass(frozen=True)
class Unpivot(Step):
    ids: tuple[str, ...]
    values: tuple[str, ...]


@dataclass(frozen=True)
class Sort(Step):
    by: tuple[tuple[Any, str], ...]  # (column or Param, asc or desc)


@dataclass(frozen=True)
class Limit(Step):
    n: Any
    offset: Any = 0


@dataclass(frozen=True)
class Distinct(Step):
    pass


@dataclass(frozen=True)
class Union(Step):
    source: Any


@dataclass(frozen=True)
class Intersect(Step):
    source: Any


@dataclass(frozen=True)
class Except(Step):
    source: Any


@dataclass(frozen=True)
class Fit(Step):
    response: str
    predictors: tuple[tuple[str, E.Expr], ...]
    intercept: bool = True
    group_by: tuple[str, ...] = ()
    weights: str | None = None
    offset: str | None = None
    ridge: float = 0.0
    family: str = "gaussian"
    link: str | None = None
    std_errors: str = "classical"
    theta: float | None = None
    power: float = 1.5
    max_iter: int = 25
    tol: float = 1e-8
    output: str = "coefficients"


@dataclass(frozen=True)
class Predict(Step):
    fit: Fit
    source: Any
    model_from: str = "training"  # or coefficients
    scale: str = "response"  # or link
    interval: tuple[str, float] | None = None  # (confidence or prediction, level)


@dataclass(frozen=True)
class KMeans(Step):
    features: tuple[tuple[str, E.Expr], ...]
    k: int
    seed: Any
    group_by: tuple[str, ...] = ()
    restarts: int = 1
    max_iterations: int = 100
    standardise: bool = False
    silhouette: bool = False
    output: str = "assignments"


@dataclass(frozen=True)
class Bootstrap(Step):
    aggregates: tuple[Agg, ...]
    replicates: int
    seed: Any
    group_by: tuple[str, ...] = ()
    cluster: str | None = None
    level: float = 0.95
    output: str = "summary"


def slot(v):
    """The value of a setting that may have been a parameter."""
    if isinstance(v, E.Lit):
        return v.value
    if isinstance(v, E.Param):
        raise UnboundParam(v.name)
    return v


def bind(steps, env: dict | None = None, clock: dict | None = None) -> tuple[Step, ...]:
    """Functions inlined, parameters and the clock replaced by literals."""
    defs: dict[str, E.FnDef] = {}
    out = []
    for s in steps:
        if isinstance(s, Define):
            defs[s.fn.name] = s.fn
            E.expand(s.fn.body, defs, (s.fn.name,))
        else:
            out.append(E.expand(s, defs))
    out = E.substitute(tuple(out), env or {}, strict=True)
    return E.substitute_now(out, clock)


def params_of(steps) -> set[str]:
    return E.params_of(tuple(steps))


def sources_of(steps) -> set[str]:
    """Names of the Ref sources a pipeline reads."""
    return {s.source.name for s in steps if isinstance(getattr(s, "source", None), Ref)}


def reads_order(steps) -> bool:
    """Whether some step's answer depends on the order of its rows."""
    for s in steps:
        aggs = s.aggs if isinstance(s, GroupBy) else s.aggregates if isinstance(s, Bootstrap) else ()
        if isinstance(s, (Window, KMeans, Bootstrap, Limit)) or any(a.fn in ("first", "last") for a in aggs) or isinstance(s, Pivot) and s.agg in ("first", "last"):
            return True
    return False


def resolve(source, tables: dict):
    if isinstance(source, Ref):
        if source.name not in tables:
            raise UnresolvedSource(f"{source.name}; there are {', '.join(sorted(tables)) or 'none'}")
        return tables[source.name]
    return source


def with_output(fit: Fit, output: str) -> Fit:
    return replace(fit, output=output)
