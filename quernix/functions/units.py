"""Units of measure: products of base units with integer powers; conversion by fixed factors."""

from __future__ import annotations

import re
from collections import Counter

from quernix.errors import UnitMismatch

#: Unit: (base, factor to the base).
FACTORS = {
    "m": ("m", 1.0), "km": ("m", 1000.0), "cm": ("m", 0.01), "mm": ("m", 0.001), "mi": ("m", 1609.344), "ft": ("m", 0.3048),
    "s": ("s", 1.0), "ms": ("s", 0.001), "min": ("s", 60.0), "h": ("s", 3600.0), "d": ("s", 86400.0),
    "kg": ("kg", 1.0), "g": ("kg", 0.001), "lb": ("kg", 0.45359237),
}


def parse(text: str | None) -> Counter | None:
    """``kg*m/s^2`` to powers by unit; None is unitless-unconstrained."""
    if not text:
        return None
    out: Counter = Counter()
    for k, part in enumerate(re.split(r"(?=[*/])", text)):
        sign = -1 if part[0] == "/" else 1
        m = re.fullmatch(r"[*/]?(1|[A-Za-z]+)(?:\^(-?\d+))?", part)
        if not m:
            raise UnitMismatch(f"not a unit: {text!r}")
        if m[1] != "1":
            out[m[1]] += sign * int(m[2] or 1)
    return Counter({k: v for k, v in out.items() if v})


def show(u: Counter | None) -> str | None:
    if not u:
        return None
    up = [k + (f"^{v}" if v != 1 else "") for k, v in sorted(u.items()) if v > 0]
    down = ["/" + k + (f"^{-v}" if v != -1 else "") for k, v in sorted(u.items()) if v < 0]
    return ("*".join(up) or "1") + "".join(down)


def same(what: str, *units: str | None) -> str | None:
    """The one unit of operands; operands without a unit agree with any."""
    have = {show(parse(u)) for u in units if u}
    if len(have) > 1:
        raise UnitMismatch(f"{what}: {' and '.join(sorted(have))}")
    return have.pop() if have else None


def combine(a: str | None, b: str | None, sign: int) -> str | None:
    if not a and not b:
        return None
    out = Counter(parse(a) or {})
    for k, v in (parse(b) or {}).items():
        out[k] += sign * v
    return show(Counter({k: v for k, v in out.items() if v}))


def factor(source: str | None, target: str) -> float:
    """What a value in source is multiplied by to be in target."""
    if not source:
        raise UnitMismatch(f"no unit to convert to {target}")

    def base(text):
        dims, f = Counter(), 1.0
        for k, v in parse(text).items():
            b, x = FACTORS.get(k, (k, 1.0))
            dims[b] += v
            f *= x**v
        return Counter({k: v for k, v in dims.items() if v}), f

    (da, fa), (db, fb) = base(source), base(target)
    if da != db:
        raise UnitMismatch(f"{source} does not convert to {target}")
    return fa / fb
