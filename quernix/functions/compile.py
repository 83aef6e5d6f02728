"""Expressions to Spark columns: types and units are decided first, and what Spark would coerce is refused."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernix.errors import ArityError, FunctionError, InvalidKnots, OverflowRefused, TypeMismatch, UnboundParam, UnknownColumn, UnpinnedClock
from quernix.functions import expr as E
from quernix.functions import units


@dataclass(frozen=True)
class Field:
    """A column's type name and unit."""

    type: str
    unit: str | None = None


@dataclass(frozen=True)
class Typed:
    col: Column
    type: str
    unit: str | None = None


WHOLE = ("int", "bigint")
SPARK = {"int": "int", "bigint": "bigint", "float": "double", "bool": "boolean", "string": "string", "date": "date", "timestamp": "timestamp"}
FUNCTIONS = (
    "abs round floor ceil sqrt least greatest pow exp ln log10 length lower upper trim substr replace concat indexOf datePart dateDiffDays"
).split()
MODES = ("halfEven", "halfUp", "halfDown", "up", "down", "ceiling", "floor")


def is_decimal(t: str) -> bool:
    return t.startswith("decimal")


def precision(t: str) -> tuple[int, int]:
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", t)
    return int(m[1]), int(m[2])


def decimal_type(p: int, s: int) -> str:
    if p > 38:
        raise OverflowRefused(f"a decimal of {p} digits; 38 is the most")
    return f"decimal({p},{s})"


def spark_type(t: str) -> str:
    return SPARK.get(t, t)


def type_name(t: T.DataType) -> str:
    for kind, name in ((T.IntegerType, "int"), (T.ShortType, "int"), (T.ByteType, "int"), (T.LongType, "bigint"), (T.DoubleType, "float"), (T.FloatType, "float"), (T.BooleanType, "bool"), (T.StringType, "string"), (T.DateType, "date"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp")):
        if isinstance(t, kind):
            return name
    return f"decimal({t.precision},{t.scale})" if isinstance(t, T.DecimalType) else "opaque"


def schema_of(struct: T.StructType) -> dict[str, Field]:
    return {f.name: Field(type_name(f.dataType), f.metadata.get("unit")) for f in struct.fields}


def numeric(t: str) -> bool:
    return t in ("int", "bigint", "float") or is_decimal(t)


def widen(what: str, *kinds: str) -> str:
    """The least type that holds all; null holds nothing. Decimal beside float is refused."""
    have = [k for k in dict.fromkeys(kinds) if k != "null"]
    if not have:
        return "string"
    if len(have) == 1:
        return have[0]
    if all(map(numeric, have)):
        if any(map(is_decimal, have)):
            if "float" in have:
                raise TypeMismatch(f"{what}: decimal beside float")
            ps = [precision(k) if is_decimal(k) else ((10, 0) if k == "int" else (19, 0)) for k in have]
            s = max(x for _, x in ps)
            return decimal_type(min(38, max(p - x for p, x in ps) + s), s)
        return "float" if "float" in have else "bigint"
    raise TypeMismatch(f"{what}: {' beside '.join(have)}")


def to(x: Typed, t: str) -> Column:
    return x.col if x.type == t else x.col.cast(spark_type(t))


def literal(kind: str, v) -> Typed:
    if kind == "null" or v is None:
        return Typed(F.lit(None), "null")
    if kind == "decimal":
        d = Decimal(str(v))
        s = max(0, -d.as_tuple().exponent)
        t = decimal_type(max(len(d.as_tuple().digits), s + 1), s)
        return Typed(F.lit(str(d)).cast(t), t)
    if kind == "float":
        return Typed(F.lit(float(v)), "float")
    if kind == "date":
        return Typed(F.lit(str(v)).cast("date"), "date")
    if kind == "timestamp":
        return Typed(F.lit(v.isoformat() if isinstance(v, dt.datetime) else str(v)).cast("timestamp"), "timestamp")
    return Typed(F.lit(v).cast(spark_type(kind)), kind)


def show_float(c: Column) -> Column:
    """A float as text: the shortest digits, whole numbers without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, F.when(c == 0, F.lit("0")).otherwise(c.cast("decimal(20,0)").cast("string"))).otherwise(F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"\.0e", "e"), r"e(\d)", "e+$1"))


def text(x: Typed) -> Column:
    if x.type == "float":
        return show_float(x.col)
    if is_decimal(x.type):
        s = x.col.cast("string")
        return F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)
    return x.col.cast("string")


def compile_expr(e: E.Expr, schema: dict[str, Field]) -> Typed:
    c = lambda x: compile_expr(x, schema)
    if isinstance(e, E.Col):
        if e.name not in schema:
            raise UnknownColumn(f"{e.name}; there are {', '.join(schema)}")
        return Typed(F.col(f"`{e.name}`"), schema[e.name].type, schema[e.name].unit)
    if isinstance(e, E.Lit):
        return literal(e.kind, e.value)
    if isinstance(e, E.Param):
        raise UnboundParam(e.name)
    if isinstance(e, E.Now):
        raise UnpinnedClock(e.grain)
    if isinstance(e, (E.Call, E.Arg)):
        raise FunctionError(f"{getattr(e, 'fn', None) or e.name} outside of a definition")
    if isinstance(e, E.Binary):
        return _binary(e.op, c(e.left), c(e.right))
    if isinstance(e, E.Not):
        x = _bool("not", c(e.expr))
        return Typed(~x.col, "bool")
    if isinstance(e, E.IsNull):
        return Typed(c(e.expr).col.isNull(), "bool")
    if isinstance(e, E.Coalesce):
        if not e.exprs:
            raise ArityError("coalesce of nothing")
        return _joined("coalesce", [c(x) for x in e.exprs], lambda xs: F.coalesce(*xs))
    if isinstance(e, E.Case):
        whens = [_bool("case", c(w)).col for w, _ in e.cases]
        arms = [c(t) for _, t in e.cases] + [c(e.otherwise)]

        def build(xs):
            out = None
            for w, x in zip(whens, xs):
                out = F.when(w, x) if out is None else out.when(w, x)
            return xs[-1] if out is None else out.otherwise(xs[-1])

        return _joined("case", arms, build)
    if isinstance(e, E.Cast):
        return _cast(c(e.expr), e.type)
    if isinstance(e, E.In):
        if e.param is not None:
            raise UnboundParam(e.param)
        x, items = c(e.expr), [c(i) for i in e.items]
        t = widen("in", x.type, *(i.type for i in items))
        units.same("in", x.unit, *(i.unit for i in items))
        return Typed(to(x, t).isin(*[to(i, t) for i in items]) if items else F.when(x.col.isNotNull(), F.lit(False)), "bool")
    if isinstance(e, E.Apply):
        return _apply(e.fn, [c(a) for a in e.args], e.args)
    if isinstance(e, E.Convert):
        x = c(e.expr)
        _need("convert", x, numeric(x.type))
        return Typed(x.col.cast("double") * F.lit(units.factor(x.unit, e.unit)), "float", units.show(units.parse(e.unit)))
    if isinstance(e, E.Rounded):
        x = c(e.expr)
        _need("rounded", x, numeric(x.type) and x.type != "float")
        return _rounded(x, e.scale, e.mode)
    if isinstance(e, E.Quotient):
        a, b = c(e.dividend), c(e.divisor)
        for x in (a, b):
            _need("quotient", x, numeric(x.type) and x.type != "float")
        return _quotient(a, b, e.scale, e.mode)
    if isinstance(e, E.Interpolate):
        return _interpolate(c(e.expr), e.knots, e.kind, e.outside)
    raise TypeMismatch(f"not an expression: {e!r}")


def _need(what: str, x: Typed, ok: bool) -> None:
    if not ok and x.type != "null":
        raise TypeMismatch(f"{what} of {x.type}")


def _bool(what: str, x: Typed) -> Typed:
    _need(what, x, x.type == "bool")
    return Typed(x.col.cast("boolean"), "bool") if x.type == "null" else x


def _joined(what: str, xs: list[Typed], build) -> Typed:
    t = widen(what, *(x.type for x in xs))
    return Typed(build([to(x, t) for x in xs]), t, units.same(what, *(x.unit for x in xs)))


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("and", "or"):
        x, y = _bool(op, a).col, _bool(op, b).col
        return Typed(x & y if op == "and" else x | y, "bool")
    if op in ("contains", "startsWith", "endsWith"):
        for x in (a, b):
            _need(op, x, x.type == "string")
        return Typed(getattr(a.col.cast("string"), op.lower())(b.col.cast("string")), "bool")
    if op in ("eq", "ne", "lt", "le", "gt", "ge"):
        t = widen(op, a.type, b.type)
        if t == "opaque":
            raise TypeMismatch(f"{op} of an opaque column")
        units.same(op, a.unit, b.unit)
        x, y = to(a, t), to(b, t)
        return Typed({"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op], "bool")
    for x in (a, b):
        _need(op, x, numeric(x.type))
    t = widen(op, a.type, b.type)
    if t == "string":
        return Typed(F.lit(None).cast("int"), "int")
    if op in ("add", "sub"):
        unit = units.same(op, a.unit, b.unit)
    elif op == "mod":
        unit = units.same(op, a.unit, b.unit)
    else:
        unit = units.combine(a.unit, b.unit, 1 if op == "mul" else -1)
    if op == "div":
        if is_decimal(t):
            raise TypeMismatch("div of decimals; use a quotient")
        return Typed(F.try_divide(a.col.cast("double"), b.col.cast("double")), "float", unit)
    if op == "mod":
        if t == "float":
            raise TypeMismatch("mod of floats")
        return Typed(F.try_mod(to(a, t), to(b, t)), t, unit)
    if is_decimal(t):
        (p1, s1), (p2, s2) = (precision(x.type) if is_decimal(x.type) else ((10, 0) if x.type == "int" else (19, 0)) for x in (a, b))
        if op == "mul":
            out = decimal_type(min(38, p1 + p2 + 1), s1 + s2)
        else:
            out = decimal_type(min(38, max(p1 - s1, p2 - s2) + max(s1, s2) + 1), max(s1, s2))
        x, y = (v.col.cast(f"decimal({p},{s})") for v, p, s in ((a, p1, s1), (b, p2, s2)))
        return Typed({"add": x + y, "sub": x - y, "mul": x * y}[op].cast(out), out, unit)
    x, y = to(a, t), to(b, t)
    return Typed({"add": x + y, "sub": x - y, "mul": x * y}[op], t, unit)


def _cast(x: Typed, t: str) -> Typed:
    if t == "decimal":
        t = x.type if is_decimal(x.type) else "decimal(38,10)" if x.type in ("string", "float") else "decimal(10,0)" if x.type == "int" else "decimal(19,0)"
    if t not in SPARK and not is_decimal(t):
        raise TypeMismatch(f"cast to {t}")
    if x.type in ("opaque",) or (x.type, t) in {(a, b) for a in ("date", "timestamp") for b in ("int", "bigint", "float", "bool")}:
        raise TypeMismatch(f"cast of {x.type} to {t}")
    if t == "string":
        return Typed(text(x), t)
    if t == "date" and x.type == "string":
        return Typed(F.when(x.col.rlike(r"^\d{4}-\d\d-\d\d$") | x.col.isNull(), x.col.cast("date")).otherwise(F.raise_error(F.concat(F.lit("TypeMismatch: not a date: "), x.col)).cast("date")), t)
    return Typed(x.col.cast(spark_type(t)), t, x.unit if numeric(x.type) and numeric(t) else None)


def round_mode(c: Column, scale: int, mode: str) -> Column:
    """Rounds a decimal column at a scale, exactly."""
    if mode not in MODES:
        raise TypeMismatch(f"no rounding mode {mode}")
    if mode == "halfUp":
        return F.round(c, scale)
    if mode == "halfEven":
        return F.bround(c, scale)
    up, down = F.ceil(c, F.lit(scale)), F.floor(c, F.lit(scale))
    if mode == "ceiling":
        return up
    if mode == "floor":
        return down
    if mode == "up":
        return F.when(c < 0, down).otherwise(up)
    if mode == "down":
        return F.when(c < 0, up).otherwise(down)
    toward, away = F.when(c < 0, up).otherwise(down), F.when(c < 0, down).otherwise(up)
    return F.when(F.abs(c - toward) <= F.abs(away - c), toward).otherwise(away)


def _rounded(x: Typed, scale: int, mode: str) -> Typed:
    p, s = precision(x.type) if is_decimal(x.type) else ((10, 0) if x.type == "int" else (19, 0))
    c = x.col.cast(f"decimal({p},{s})")
    if scale >= s:
        t = decimal_type(p - s + scale, scale)
        return Typed(c.cast(t), t, x.unit)
    t = decimal_type(min(38, p - s + scale + 1), scale)
    return Typed(round_mode(c, scale, mode).cast(t), t, x.unit)


#: Decimal digits of one step of a long division, at most and at least.
_DIGITS = (30, 6)
#: Digits of a step in longs, at least.
_SHORT = 3


def _quotient(a: Typed, b: Typed, scale: int, mode: str) -> Typed:
    """One correct rounding of an exact quotient: a long division of scaled integers, some digits at a time."""
    if not 0 <= scale <= 38:
        raise OverflowRefused(f"a quotient of scale {scale}; decimals have 38 digits")
    if mode not in MODES:
        raise TypeMismatch(f"no rounding mode {mode}")
    t, whole = decimal_type(38, scale), "decimal(38,0)"
    lit = lambda v: F.lit(Decimal(v)).cast(whole)
    widths = [precision(x.type) if is_decimal(x.type) else ((10, 0) if x.type == "int" else (19, 0)) for x in (a, b)]
    up = max(w[1] for w in widths)
    room = 18 - (widths[1][0] - widths[1][1] + up)
    if room >= _SHORT and widths[0][0] - widths[0][1] + up <= 18:
        return Typed(_short_quotient(a, b, widths, up, room, scale, mode).cast(t), t, units.combine(a.unit, b.unit, -1))
    n, d = ((x.col.cast(f"decimal(38,{w[1]})") * lit(10**up)).cast(whole) for x, w in zip((a, b), widths))
    d = F.nullif(d, lit(0))
    negative, size = (n < 0) != (d < 0), F.abs(d)
    # A remainder times so many powers of ten stays within 38 digits.
    step = max(_DIGITS[1], min(_DIGITS[0], 37 - (widths[1][0] - widths[1][1] + up)))
    powers = [lit(10 ** min(step, scale - i)) for i in range(0, scale, step)]
    both = lambda n, q: F.struct((q + ((n - n % size) / size).cast(whole)).cast(whole).alias("q"), (n % size).cast(whole).alias("r"))

    def finish(x):
        q, r = x["q"], x["r"]
        rest, twice = r != 0, (r * 2).cast(whole)
        over = {
            "up": rest, "down": F.lit(False), "ceiling": rest & ~negative, "floor": rest & negative, "halfUp": twice >= size,
            "halfDown": twice > size, "halfEven": (twice > size) | ((twice == size) & (q % 2 == 1)),
        }[mode]
        q = (q + F.when(over, lit(1)).otherwise(lit(0))).cast(whole)
        # The point is set by an exponent: a division would round at Spark's own scale.
        return F.concat(F.when(negative & (q != 0), "-").otherwise(""), q.cast("string"), F.lit(f"E-{scale}")).cast(t)

    first = both(F.abs(n), lit(0))
    more = lambda acc, p: both((acc["r"] * p).cast(whole), (acc["q"] * p).cast(whole))
    out = F.aggregate(F.array(*powers), first, more, finish) if powers else F.transform(F.array(first), finish)[0]
    unit = units.combine(a.unit, b.unit, -1)
    return Typed(F.when(n.isNotNull() & d.isNotNull(), out), t, unit)


def _short_quotient(a: Typed, b: Typed, widths, up: int, room: int, scale: int, mode: str) -> Column:
    """The quotient as text, in longs: a remainder times ``room`` digits has 18 digits at most.

    Every remainder names the one before it once, so that the expressions stay small, and nothing is under a condition,
    so that Spark takes what they share out of them. Null in, null out.
    """
    n, d = (x.col.cast("bigint") * F.lit(10**up).cast("bigint") if w[1] == 0 else (x.col.cast(f"decimal({w[0]},{w[1]})") * F.lit(Decimal(10**up)).cast(f"decimal({up + 1},0)")).cast("bigint") for x, w in zip((a, b), widths))
    whole = lambda x, y: F.call_function("div", x, y)
    power = lambda k: F.lit(10**k).cast("bigint")
    # Not nullif: each use of it would be planned as a column of its own, which shares nothing with the others.
    d = F.when(d != 0, d)
    negative, size = (n < 0) != (d < 0), F.abs(d)
    last, r = whole(F.abs(n), size), F.abs(n) % size
    # Groups of digits that a long holds: the whole part, then the fraction's digits from the left.
    groups = [(last, 0)]
    done = 0
    while done < scale:
        k = min(room, scale - done)
        last, r = whole(r * power(k), size), (r * power(k)) % size
        v, digits = groups[-1]
        if len(groups) > 1 and digits + k <= 18:
            groups[-1] = (v * power(k) + last, digits + k)
        else:
            groups.append((last, k))
        done += k
    rest, twice = r != 0, r * 2
    over = {
        "up": rest, "down": None, "ceiling": rest & ~negative, "floor": rest & negative, "halfUp": twice >= size,
        "halfDown": twice > size, "halfEven": (twice > size) | ((twice == size) & (last % 2 == 1)),
    }[mode]
    carry, out = None if over is None else over.cast("bigint"), []
    for v, digits in reversed(groups):
        v = v if carry is None else v + carry
        if digits:
            carry = None if over is None else whole(v, power(digits))
            v = F.lpad((v if over is None else v % power(digits)).cast("string"), digits, "0")
        out.insert(0, v.cast("string"))
    return F.concat(F.when(negative, "-").otherwise(""), out[0], *([F.lit("."), *out[1:]] if scale else []))


def _whole(name: str, c: Column) -> Column:
    """floor or ceil of a double; from 2^53 on, and for NaN and infinities, the value itself."""
    return F.when(F.abs(c) < float(2**53), getattr(F, name)(c).cast("double")).otherwise(c)


def _apply(name: str, xs: list[Typed], raw: tuple[E.Expr, ...]) -> Typed:
    if name not in FUNCTIONS:
        raise FunctionError(f"no function {name}; there are {', '.join(FUNCTIONS)}")
    arity = {"pow": 2, "substr": 3, "replace": 3, "indexOf": 2, "datePart": 2, "dateDiffDays": 2}.get(name, 1)
    if name in ("least", "greatest", "concat"):
        if not xs:
            raise ArityError(f"{name} of nothing")
    elif len(xs) != arity:
        raise ArityError(f"{name} takes {arity}, not {len(xs)}")
    x = xs[0]
    num = lambda *ys: [_need(name, y, numeric(y.type)) for y in ys]
    strings = lambda *ys: [_need(name, y, y.type == "string") for y in ys]
    if name == "abs":
        num(x)
        return Typed(F.abs(x.col), x.type, x.unit)
    if name in ("round", "floor", "ceil"):
        num(x)
        if is_decimal(x.type):
            return _rounded(x, 0, {"round": "halfUp", "floor": "floor", "ceil": "ceiling"}[name])
        c = x.col.cast("double")
        return Typed(F.round(c) if name == "round" else _whole(name, c), "float", x.unit)
    if name in ("sqrt", "exp", "ln", "log10"):
        num(x)
        if is_decimal(x.type):
            raise TypeMismatch(f"{name} of a decimal")
        c = x.col.cast("double")
        if name == "exp":
            return Typed(F.exp(c), "float")
        ok = c >= 0 if name == "sqrt" else c > 0
        return Typed(F.when(ok | F.isnan(c), getattr(F, name)(c)), "float")
    if name in ("least", "greatest"):
        t = widen(name, *(y.type for y in xs))
        unit = units.same(name, *(y.unit for y in xs))
        cols = [to(y, t) for y in xs]
        any_null = cols[0].isNull()
        for c in cols[1:]:
            any_null = any_null | c.isNull()
        return Typed(F.when(~any_null, getattr(F, name)(*cols) if len(cols) > 1 else cols[0]), t, unit)
    if name == "pow":
        num(*xs)
        a, b = xs
        if is_decimal(a.type) or is_decimal(b.type):
            raise TypeMismatch("pow of a decimal")
        u, v = a.col.cast("double"), b.col.cast("double")
        bad = ((u == 0) & (v < 0)) | ((u < 0) & (v != _whole("floor", v)) & ~F.isnan(v))
        nan = F.isnan(u) | F.isnan(v)
        p = F.when(nan, F.lit(math.nan)).when(~bad, F.pow(u, v))
        if a.type == "int" and b.type == "int" and isinstance(raw[1], E.Lit) and raw[1].value >= 0:
            return Typed(p.cast("int"), "int")
        return Typed(p, "float")
    if name == "length":
        strings(x)
        return Typed(F.char_length(x.col.cast("string")), "int")
    if name in ("lower", "upper"):
        strings(x)
        return Typed(getattr(F, name)(x.col), "string")
    if name == "trim":
        strings(x)
        return Typed(F.btrim(x.col, F.lit(" \t\r\n")), "string")
    if name == "substr":
        strings(x)
        for y in xs[1:]:
            _need(name, y, y.type in WHOLE)
        return Typed(F.substring(x.col, xs[1].col.cast("int") + 1, xs[2].col.cast("int")), "string")
    if name == "replace":
        strings(*xs)
        return Typed(F.when(xs[1].col == "", x.col).otherwise(F.replace(x.col, xs[1].col, xs[2].col)), "string")
    if name == "concat":
        return Typed(F.concat(*[text(y) for y in xs]), "string")
    if name == "indexOf":
        strings(*xs)
        return Typed(F.when(xs[1].col == "", F.when(x.col.isNotNull(), 0)).otherwise(F.call_function("instr", x.col, xs[1].col) - 1), "int")
    if name == "datePart":
        part, d = xs
        if isinstance(raw[0], E.Lit) and raw[0].value not in ("year", "month", "day"):
            raise TypeMismatch(f"no date part {raw[0].value}")
        _need(name, part, part.type == "string")
        _need(name, d, d.type in ("date", "timestamp", "string"))
        day = _cast(d, "date").col
        if isinstance(raw[0], E.Lit):
            return Typed({"year": F.year, "month": F.month, "day": F.dayofmonth}[raw[0].value](day), "int")
        return Typed(F.when(part.col == "year", F.year(day)).when(part.col == "month", F.month(day)).when(part.col == "day", F.dayofmonth(day)).when(part.col.isNotNull(), F.raise_error("TypeMismatch: no such date part").cast("int")), "int")
    a, b = (_cast(y, "date").col for y in xs)
    for y in xs:
        _need(name, y, y.type in ("date", "timestamp", "string"))
    return Typed(F.datediff(b, a), "int")


def _interpolate(x: Typed, knots, kind: str, outside: str) -> Typed:
    _need("interpolate", x, numeric(x.type) and not is_decimal(x.type))
    ks = [(float(a), float(b)) for a, b in knots]
    if len(ks) < 2 or any(not (math.isfinite(a) and math.isfinite(b)) for a, b in ks) or any(a >= b for (a, _), (b, _) in zip(ks, ks[1:])):
        raise InvalidKnots("at least two finite knots, strictly increasing")
    if kind not in ("linear", "step", "monotoneCubic") or outside not in ("clamp", "null"):
        raise InvalidKnots(f"{kind}, {outside}")
    c = x.col.cast("double")
    out = F.when(F.isnan(c), F.lit(math.nan))
    low, high = (ks[0][1], ks[-1][1]) if outside == "clamp" else (None, None)
    out = out.when(c < ks[0][0], F.lit(low).cast("double"))
    slopes = _fritsch_carlson(ks) if kind == "monotoneCubic" else None
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(ks, ks[1:])):
        if kind == "step":
            v = F.lit(y0)
        elif kind == "linear":
            v = F.lit(y0) + F.lit(y1 - y0) * ((c - x0) / F.lit(x1 - x0))
        else:
            h = x1 - x0
            t = (c - x0) / F.lit(h)
            v = (1 + 2 * t) * (1 - t) * (1 - t) * y0 + t * (1 - t) * (1 - t) * (h * slopes[i]) + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * (h * slopes[i + 1])
        out = out.when(c == x0, F.lit(y0)).when(c < x1, v)
    out = out.when(c == ks[-1][0], F.lit(ks[-1][1])).when(c > ks[-1][0], F.lit(high).cast("double"))
    return Typed(out, "float")


def _fritsch_carlson(ks):
    d = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(ks, ks[1:])]
    m = [d[0]] + [0.0 if a * b <= 0 else (a + b) / 2 for a, b in zip(d, d[1:])] + [d[-1]]
    for i, s in enumerate(d):
        if s == 0:
            m[i] = m[i + 1] = 0.0
            continue
        a, b = m[i] / s, m[i + 1] / s
        r = a * a + b * b
        if r > 9:
            m[i], m[i + 1] = 3 * a / math.sqrt(r) * s, 3 * b / math.sqrt(r) * s
    return m
