"""Expressions as data. Operators on nodes build nodes; nothing is evaluated here."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields, is_dataclass, replace
from decimal import Decimal
from typing import Any

from quernix.errors import ArityError, ExpansionTooLarge, FunctionError, RecursiveFunction, UnboundParam, UnpinnedClock

MAX_NODES = 512


@dataclass(frozen=True)
class Expr:
    def __add__(self, o): return Binary("add", self, wrap(o))
    def __radd__(self, o): return Binary("add", wrap(o), self)
    def __sub__(self, o): return Binary("sub", self, wrap(o))
    def __rsub__(self, o): return Binary("sub", wrap(o), self)
    def __mul__(self, o): return Binary("mul", self, wrap(o))
    def __rmul__(self, o): return Binary("mul", wrap(o), self)
    def __truediv__(self, o): return Binary("div", self, wrap(o))
    def __rtruediv__(self, o): return Binary("div", wrap(o), self)
    def __mod__(self, o): return Binary("mod", self, wrap(o))
    def __lt__(self, o): return Binary("lt", self, wrap(o))
    def __le__(self, o): return Binary("le", self, wrap(o))
    def __gt__(self, o): return Binary("gt", self, wrap(o))
    def __ge__(self, o): return Binary("ge", self, wrap(o))
    def __and__(self, o): return Binary("and", self, wrap(o))
    def __or__(self, o): return Binary("or", self, wrap(o))
    def __invert__(self): return Not(self)
    def eq(self, o): return Binary("eq", self, wrap(o))
    def ne(self, o): return Binary("ne", self, wrap(o))
    def contains(self, o): return Binary("contains", self, wrap(o))
    def startswith(self, o): return Binary("startsWith", self, wrap(o))
    def endswith(self, o): return Binary("endsWith", self, wrap(o))
    def is_null(self): return IsNull(self)
    def is_in(self, *items): return In(self, tuple(map(wrap, items)))
    def cast(self, kind: str): return Cast(self, kind)
    def convert(self, unit: str): return Convert(self, unit)


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Lit(Expr):
    kind: str  # int bigint float bool string date timestamp decimal null
    value: Any = None


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Now(Expr):
    grain: str  # date or timestamp


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    expr: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    expr: Expr


@dataclass(frozen=True)
class Coalesce(Expr):
    exprs: tuple[Expr, ...]


@dataclass(frozen=True)
class Case(Expr):
    cases: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr


@dataclass(frozen=True)
class Cast(Expr):
    expr: Expr
    type: str


@dataclass(frozen=True)
class In(Expr):
    expr: Expr
    items: tuple[Expr, ...] = ()
    param: str | None = None


@dataclass(frozen=True)
class Apply(Expr):
    fn: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Convert(Expr):
    expr: Expr
    unit: str


@dataclass(frozen=True)
class Quotient(Expr):
    dividend: Expr
    divisor: Expr
    scale: int
    mode: str = "halfEven"


@dataclass(frozen=True)
class Rounded(Expr):
    expr: Expr
    scale: int
    mode: str = "halfEven"


@dataclass(frozen=True)
class Call(Expr):
    fn: str
    args: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Arg(Expr):
    name: str


@dataclass(frozen=True)
class Interpolate(Expr):
    expr: Expr
    knots: tuple[tuple[float, float], ...]
    kind: str = "linear"
    outside: str = "clamp"


@dataclass(frozen=True)
class FnDef:
    """A named function: parameters with optional defaults, and a body over Arg nodes."""

    name: str
    params: tuple[tuple[str, Expr | None], ...]
    body: Expr


def col(name: str) -> Col:
    return Col(name)


def lit(v) -> Lit:
    return wrap(v)


def param(name: str) -> Param:
    return Param(name)


def fn(name: str, *args) -> Apply:
    return Apply(name, tuple(map(wrap, args)))


def coalesce(*es) -> Coalesce:
    return Coalesce(tuple(map(wrap, es)))


def case(*cases, otherwise=None) -> Case:
    return Case(tuple((wrap(a), wrap(b)) for a, b in cases), wrap(otherwise))


def wrap(v) -> Expr:
    """A Python value as a literal; nodes pass through."""
    if isinstance(v, Expr):
        return v
    if v is None:
        return Lit("null")
    if isinstance(v, bool):
        return Lit("bool", v)
    if isinstance(v, int):
        return Lit("int" if -(2**31) <= v < 2**31 else "bigint", v)
    for t, k in ((float, "float"), (str, "string"), (Decimal, "decimal"), (dt.datetime, "timestamp"), (dt.date, "date")):
        if isinstance(v, t):
            return Lit(k, v)
    raise TypeError(f"no literal for {type(v).__name__}")


def rewrite(node, f):
    """Rebuilds a dataclass tree bottom-up through f, which sees every Expr."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, f) for x in node)
    if is_dataclass(node) and not isinstance(node, type):
        node = replace(node, **{x.name: rewrite(getattr(node, x.name), f) for x in fields(node)})
        return f(node) if isinstance(node, Expr) else node
    return node


def walk(node):
    """Every Expr of a tree, parents first."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node) and not isinstance(node, type):
        if isinstance(node, Expr):
            yield node
        for x in fields(node):
            yield from walk(getattr(node, x.name))


def columns_of(node) -> set[str]:
    return {e.name for e in walk(node) if isinstance(e, Col)}


def params_of(node) -> set[str]:
    return {e.name for e in walk(node) if isinstance(e, Param)} | {e.param for e in walk(node) if isinstance(e, In) and e.param}


def uses_now(node) -> bool:
    return any(isinstance(e, Now) for e in walk(node))


def substitute(node, env: dict, strict: bool = True):
    """Parameters by literals; list parameters of In by their items."""

    def one(e):
        if isinstance(e, Param):
            if e.name in env:
                return wrap(env[e.name])
            if strict:
                raise UnboundParam(f"{e.name}; bound: {', '.join(sorted(env)) or 'none'}")
        if isinstance(e, In) and e.param is not None:
            if e.param in env:
                return In(e.expr, tuple(map(wrap, env[e.param])))
            if strict:
                raise UnboundParam(f"{e.param}; bound: {', '.join(sorted(env)) or 'none'}")
        return e

    return rewrite(node, one)


def substitute_now(node, clock: dict | None):
    def one(e):
        if isinstance(e, Now):
            if not clock or e.grain not in clock:
                raise UnpinnedClock(e.grain)
            return wrap(clock[e.grain])
        return e

    return rewrite(node, one)


def expand(node, defs: dict[str, FnDef], trail: tuple[str, ...] = ()):
    """Inlines every Call."""

    def one(e):
        if not isinstance(e, Call):
            return e
        if e.fn in trail:
            raise RecursiveFunction(" -> ".join((*trail, e.fn)))
        if e.fn not in defs:
            raise FunctionError(f"unknown function {e.fn}")
        d = defs[e.fn]
        given = dict(e.args)
        if unknown := set(given) - {p for p, _ in d.params}:
            raise ArityError(f"{e.fn} has no parameter {', '.join(sorted(unknown))}")
        bound = {}
        for p, default in d.params:
            if p not in given and default is None:
                raise ArityError(f"{e.fn} needs {p}")
            bound[p] = given.get(p, default)
        body = expand(d.body, defs, (*trail, e.fn))
        return rewrite(body, lambda x: bound[x.name] if isinstance(x, Arg) and x.name in bound else x)

    out = rewrite(node, one)
    if sum(1 for _ in walk(out)) > MAX_NODES and any(isinstance(x, Call) for x in walk(node)):
        raise ExpansionTooLarge(f"more than {MAX_NODES} nodes")
    return out
