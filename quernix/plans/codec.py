"""Pipelines as canonical JSON: keys in order, strict decoding that names what it refuses, and a hash over the bytes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import re
from decimal import Decimal

from quernix.errors import CodecError
from quernix.functions import expr as E
from quernix.plans import steps as S

HASH_RULE = "compute-pipeline-sha256-v1"
_KINDS = {"int": "Int", "bigint": "BigInt", "float": "Float", "bool": "Bool", "string": "Str", "date": "Date", "timestamp": "Timestamp", "decimal": "Decimal", "null": "Null"}
_CELLS = {v: k for k, v in _KINDS.items()}
_DATE = re.compile(r"\d{4}-\d\d-\d\d")
_OPS = ("add", "sub", "mul", "div", "mod", "eq", "ne", "lt", "le", "gt", "ge", "and", "or", "contains", "startsWith", "endsWith")
#: Other spellings that the lenient decoder takes.
_FN = {"avg": "mean", "average": "mean", "std": "stddev", "count_distinct": "countDistinct", "cumsum": "cumulSum", "cumSum": "cumulSum", "row_number": "rowNumber", "dense_rank": "denseRank", "nTile": "ntile"}


def dumps(v) -> str:
    def check(x):
        if isinstance(x, float) and not math.isfinite(x):
            raise CodecError("a literal that is not finite")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(v)
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _no_repeats(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise CodecError(f"repeated member {k}")
        out[k] = v
    return out


def loads(text: str):
    try:
        return json.loads(text, object_pairs_hook=_no_repeats, parse_constant=lambda c: (_ for _ in ()).throw(CodecError(f"{c} is not a number")))
    except json.JSONDecodeError as e:
        raise CodecError(str(e)) from None


# Encoding


def _lit(kind: str, v):
    if kind == "null" or v is None:
        return {"$type": "Null"}
    if kind in ("date", "timestamp", "decimal"):
        v = v.isoformat() if hasattr(v, "isoformat") else str(v)
    if kind == "bigint":
        v = str(v)
    return {"$type": _KINDS[kind], "value": v}


def encode_expr(e: E.Expr) -> dict:
    x = encode_expr
    if isinstance(e, E.Col):
        return {"$type": "col", "name": e.name}
    if isinstance(e, E.Lit):
        return {"$type": "lit", "cell": _lit(e.kind, e.value)}
    if isinstance(e, E.Param):
        return {"$type": "param", "name": e.name}
    if isinstance(e, E.Now):
        return {"$type": "now", "grain": e.grain}
    if isinstance(e, E.Binary):
        return {"$type": "binary", "op": e.op, "left": x(e.left), "right": x(e.right)}
    if isinstance(e, (E.Not, E.IsNull)):
        return {"$type": "not" if isinstance(e, E.Not) else "isNull", "expr": x(e.expr)}
    if isinstance(e, E.Coalesce):
        return {"$type": "coalesce", "exprs": [x(a) for a in e.exprs]}
    if isinstance(e, E.Case):
        return {"$type": "case", "cases": [{"when": x(w), "then": x(t)} for w, t in e.cases], "else": x(e.otherwise)}
    if isinstance(e, E.Cast):
        return {"$type": "cast", "expr": x(e.expr), "type": e.type}
    if isinstance(e, E.In):
        return {"$type": "in", "expr": x(e.expr)} | ({"param": e.param} if e.param is not None else {"items": [x(i) for i in e.items]})
    if isinstance(e, E.Apply):
        return {"$type": "apply", "fn": e.fn, "args": [x(a) for a in e.args]}
    if isinstance(e, E.Convert):
        return {"$type": "convert", "expr": x(e.expr), "unit": e.unit}
    if isinstance(e, E.Quotient):
        return {"$type": "quotient", "dividend": x(e.dividend), "divisor": x(e.divisor), "rounding": {"scale": e.scale, "mode": e.mode}}
    if isinstance(e, E.Rounded):
        return {"$type": "rounded", "expr": x(e.expr), "rounding": {"scale": e.scale, "mode": e.mode}}
    if isinstance(e, E.Call):
        return {"$type": "invoke", "fn": e.fn, "args": {k: x(v) for k, v in e.args}}
    if isinstance(e, E.Arg):
        return {"$type": "arg", "name": e.name}
    if isinstance(e, E.Interpolate):
        return {"$type": "interpolate", "expr": x(e.expr), "knots": [list(k) for k in e.knots], "kind": e.kind, "outside": e.outside}
    raise CodecError(f"not an expression: {e!r}")


def _slot(v):
    return {"$param": v.name} if isinstance(v, E.Param) else v.value if isinstance(v, E.Lit) else v


def _source(s) -> dict:
    if isinstance(s, S.Ref):
        return {"ref": s.name}
    cols = {}
    for i, c in enumerate(s.schema):
        vals = [r[i] for r in s.rows]
        blank = {"string": "", "date": "", "timestamp": "", "decimal": "0", "bool": False}.get(c[1].split("(")[0], 0)
        cols[c[0]] = {"validity": [v is not None for v in vals], "values": [blank if v is None else str(v) if isinstance(v, (dt.date, Decimal)) else v for v in vals]}
    return {"columns": cols, "schema": [{"name": c[0], "type": c[1]} | ({"unit": c[2]} if len(c) > 2 and c[2] else {}) for c in s.schema]}


def _by(pairs):
    return [{"column": _slot(k), "dir": d} for k, d in pairs]


def _features(fs):
    return [{"name": n, "expr": encode_expr(e)} for n, e in fs]


def encode_step(s: S.Step) -> dict:
    t = {"$type": type(s).__name__[0].lower() + type(s).__name__[1:]}
    if isinstance(s, S.Filter):
        return t | {"pred": encode_expr(s.pred)}
    if isinstance(s, S.Project):
        return t | {"columns": [{"a": a, "b": b} for a, b in s.columns]}
    if isinstance(s, S.Derive):
        return t | {"name": s.name, "expr": encode_expr(s.expr)}
    if isinstance(s, S.Define):
        return t | {"name": s.fn.name, "params": [{"name": p} | ({"default": encode_expr(d)} if d is not None else {}) for p, d in s.fn.params], "body": encode_expr(s.fn.body)}
    if isinstance(s, S.GroupBy):
        return t | {"keys": list(s.keys), "aggs": [{"name": a.name, "fn": a.fn, "of": a.of} for a in s.aggs]}
    if isinstance(s, S.Join):
        return t | {"how": s.how, "on": [{"a": a, "b": b} for a, b in s.on], "source": _source(s.source)}
    if isinstance(s, S.Window):
        return t | {"fn": s.fn, "as": s.as_, "partitionBy": list(s.partition_by), "orderBy": _by(s.order_by)} | ({"of": s.of} if s.of else {}) | ({"n": _slot(s.n)} if s.n is not None else {})
    if isinstance(s, S.Pivot):
        return t | {"index": list(s.index), "on": s.on, "values": s.values, "agg": s.agg}
    if isinstance(s, S.Unpivot):
        return t | {"idVars": list(s.ids), "valueVars": list(s.values)}
    if isinstance(s, S.Sort):
        return t | {"by": _by(s.by)}
    if isinstance(s, S.Limit):
        return t | {"n": _slot(s.n), "offset": _slot(s.offset)}
    if isinstance(s, S.Distinct):
        return t
    if isinstance(s, (S.Union, S.Intersect, S.Except)):
        return t | {"source": _source(s.source)}
    if isinstance(s, S.Fit):
        out = t | {"response": s.response, "predictors": _features(s.predictors), "intercept": s.intercept, "groupBy": list(s.group_by), "family": s.family, "control": {"maxIter": s.max_iter, "tol": s.tol}, "output": s.output, "stdErrors": s.std_errors}
        for k, v in (("link", s.link), ("weights", s.weights), ("offset", s.offset), ("ridge", s.ridge or None), ("theta", s.theta), ("power", s.power if s.family == "tweedie" else None)):
            out |= {k: v} if v is not None else {}
        return out
    if isinstance(s, S.Predict):
        return t | {"fit": encode_step(s.fit), "model": {"from": s.model_from, "source": _source(s.source)}, "scale": s.scale} | ({"interval": {"kind": s.interval[0], "level": s.interval[1]}} if s.interval else {})
    if isinstance(s, S.KMeans):
        return {"$type": "kmeans", "features": _features(s.features), "k": s.k, "seed": _seed(s.seed), "groupBy": list(s.group_by), "restarts": s.restarts, "maxIterations": s.max_iterations, "standardise": s.standardise, "silhouette": s.silhouette, "output": s.output}
    if isinstance(s, S.Bootstrap):
        return t | {"aggregates": [{"name": a.name, "fn": a.fn, "of": a.of} for a in s.aggregates], "replicates": s.replicates, "seed": _seed(s.seed), "groupBy": list(s.group_by), "level": s.level, "output": s.output} | ({"cluster": s.cluster} if s.cluster else {})
    raise CodecError(f"not a step: {s!r}")


def _seed(v):
    return _slot(v) if isinstance(v, E.Param) else str(_slot(v))


def encode(steps) -> str:
    return dumps([encode_step(s) for s in steps])


def pipeline_hash(steps) -> str:
    return "sha256:" + hashlib.sha256(encode(steps).encode()).hexdigest()


# Decoding


def _get(d: dict, key: str, kind=None, *also: str):
    if not isinstance(d, dict):
        raise CodecError(f"an object with {key} was expected")
    have = [k for k in (key, *also) if k in d]
    if len(have) > 1:
        raise CodecError(f"both {' and '.join(have)}")
    if not have:
        raise CodecError(f"{d.get('$type', 'object')} has no {key}; it has {', '.join(sorted(d))}")
    v = d[have[0]]
    if kind is not None and (not isinstance(v, kind) or isinstance(v, bool) and kind is int):
        raise CodecError(f"{key} is ill-typed")
    return v


def _int(v, what: str) -> int:
    if isinstance(v, bool) or not isinstance(v, int):
        raise CodecError(f"{what} is not a whole number")
    if not -(2**31) <= v < 2**31:
        raise CodecError(f"{what} is past 32 bits")
    return v


def _cell(d: dict) -> E.Lit:
    t = _get(d, "$type", str)
    if t not in _CELLS:
        raise CodecError(f"no cell {t}; there are {', '.join(_CELLS)}")
    kind = _CELLS[t]
    if kind == "null":
        return E.Lit("null")
    v = _get(d, "value")
    if kind == "int":
        return E.Lit("int", _int(v, "an Int"))
    if kind == "bigint":
        if isinstance(v, bool) or not re.fullmatch(r"0|-?[1-9]\d*", str(v)) or not -(2**63) <= int(v) < 2**63:
            raise CodecError(f"not a BigInt: {v}")
        return E.Lit("bigint", int(v))
    if kind == "float":
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise CodecError("a Float that is not a number")
        return E.Lit("float", float(v))
    if kind == "decimal":
        if not re.fullmatch(r"-?\d+(\.\d+)?", str(v)):
            raise CodecError(f"not a decimal: {v}")
        return E.Lit("decimal", Decimal(str(v)))
    if kind == "date":
        if not isinstance(v, str) or not _DATE.fullmatch(v):
            raise CodecError(f"not a date: {v}")
        try:
            return E.Lit("date", dt.date.fromisoformat(v))
        except ValueError:
            raise CodecError(f"not a date: {v}") from None
    if kind == "timestamp":
        try:
            at = dt.datetime.fromisoformat(v)
        except (TypeError, ValueError):
            raise CodecError(f"not a timestamp: {v}") from None
        if at.isoformat() != v:
            raise CodecError(f"not a canonical timestamp: {v}")
        return E.Lit("timestamp", at)
    if not isinstance(v, bool if kind == "bool" else str):
        raise CodecError(f"an ill-typed {t}")
    return E.Lit(kind, v)


def decode_expr(d) -> E.Expr:
    x = decode_expr
    t = _get(d, "$type", str)
    if t == "col":
        return E.Col(_get(d, "name", str))
    if t == "lit":
        return _cell(_get(d, "cell", dict))
    if t in ("param", "arg"):
        return (E.Param if t == "param" else E.Arg)(_get(d, "name", str))
    if t == "now":
        g = _get(d, "grain", str)
        if g not in ("date", "timestamp"):
            raise CodecError(f"no grain {g}")
        return E.Now(g)
    if t == "binary":
        op = _get(d, "op", str)
        if op not in _OPS:
            raise CodecError(f"no operator {op}; there are {', '.join(_OPS)}")
        return E.Binary(op, x(_get(d, "left")), x(_get(d, "right")))
    if t in ("and", "or"):
        items = [x(a) for a in _get(d, "exprs", list, "args")]
        if not items:
            raise CodecError(f"{t} of nothing")
        out = items[0]
        for i in items[1:]:
            out = E.Binary(t, out, i)
        return out
    if t in _OPS:
        return E.Binary(t, x(_get(d, "left")), x(_get(d, "right")))
    if t in ("not", "isNull"):
        return (E.Not if t == "not" else E.IsNull)(x(_get(d, "expr")))
    if t == "coalesce":
        return E.Coalesce(tuple(x(a) for a in _get(d, "exprs", list)))
    if t == "case":
        return E.Case(tuple((x(_get(c, "when")), x(_get(c, "then"))) for c in _get(d, "cases", list)), x(_get(d, "else")))
    if t == "cast":
        return E.Cast(x(_get(d, "expr")), _get(d, "type", str))
    if t == "in":
        if ("items" in d) == ("param" in d):
            raise CodecError("in takes items or param, exactly one")
        return E.In(x(_get(d, "expr")), tuple(x(i) for i in d.get("items", ())), d.get("param"))
    if t == "apply":
        return E.Apply(_get(d, "fn", str), tuple(x(a) for a in _get(d, "args", list)))
    if t == "convert":
        return E.Convert(x(_get(d, "expr")), _get(d, "unit", str))
    if t in ("quotient", "rounded"):
        r = _get(d, "rounding", dict)
        scale, mode = _int(_get(r, "scale"), "a scale"), _get(r, "mode", str)
        return E.Quotient(x(_get(d, "dividend")), x(_get(d, "divisor")), scale, mode) if t == "quotient" else E.Rounded(x(_get(d, "expr")), scale, mode)
    if t == "invoke":
        return E.Call(_get(d, "fn", str), tuple((k, x(v)) for k, v in sorted(_get(d, "args", dict).items())))
    if t == "interpolate":
        return E.Interpolate(x(_get(d, "expr")), tuple((float(a), float(b)) for a, b in _get(d, "knots", list)), d.get("kind", "linear"), d.get("outside", "clamp"))
    raise CodecError(f"no expression {t}")


def _decode_slot(v):
    return E.Param(_get(v, "$param", str)) if isinstance(v, dict) else v


def _decode_by(rows):
    out = []
    for r in rows:
        r = {"column": r} if isinstance(r, str) else r
        d = r.get("dir", "asc")
        if d not in ("asc", "desc"):
            raise CodecError(f"no direction {d}")
        out.append((_decode_slot(_get(r, "column", None, "col")), d))
    return tuple(out)


def decode_source(d):
    if "ref" in d:
        return S.Ref(_get(d, "ref", str))
    schema = tuple((_get(f, "name", str), _get(f, "type", str), *([f["unit"]] if f.get("unit") else [])) for f in _get(d, "schema", list))
    cols = []
    for n, t, *_ in schema:
        c = _get(_get(d, "columns", dict), n, dict)
        ok, vals = _get(c, "validity", list), _get(c, "values", list)
        if len(ok) != len(vals):
            raise CodecError(f"{n}: {len(ok)} validity flags for {len(vals)} values")
        read = {"date": dt.date.fromisoformat, "timestamp": dt.datetime.fromisoformat, "float": float}.get(t, Decimal if t.startswith("decimal") else lambda v: v)
        cols.append([read(v) if k else None for k, v in zip(ok, vals)])
    if len({len(c) for c in cols}) > 1:
        raise CodecError("columns of different lengths")
    return S.Embedded(schema, tuple(zip(*cols)))


def encode_table(src: S.Embedded) -> str:
    return dumps(_source(src))


def _aggs(rows):
    return tuple(S.Agg(_get(a, "name", str, "as"), _FN.get(f := _get(a, "fn", str, "agg"), f), _get(a, "of", str, "column", "col")) for a in rows)


def _decode_features(rows):
    return tuple((_get(f, "name", str), decode_expr(_get(f, "expr"))) for f in rows)


def _decode_seed(v):
    if isinstance(v, dict):
        return _decode_slot(v)
    if not isinstance(v, str) or not re.fullmatch(r"0|-?[1-9]\d*", v) or not -(2**63) <= int(v) < 2**63:
        raise CodecError(f"not a seed: {v!r}")
    return int(v)


def decode_step(d) -> S.Step:
    t = _get(d, "$type", str)
    if t == "filter":
        if "column" in d:  # the flat form
            v = E.Param(d["param"]) if "param" in d else E.wrap(_get(d, "value"))
            if "param" in d and "value" in d:
                raise CodecError("both param and value")
            return S.Filter(E.Binary(_get(d, "op", str), E.Col(_get(d, "column", str)), v))
        return S.Filter(decode_expr(_get(d, "pred", None, "predicate")))
    if t == "project":
        cols = _get(d, "columns", list, "cols")
        return S.Project(tuple((c, c) if isinstance(c, str) else (_get(c, "a", str), _get(c, "b", str)) for c in cols))
    if t == "derive":
        return S.Derive(_get(d, "name", str), decode_expr(_get(d, "expr")))
    if t == "define":
        return S.Define(E.FnDef(_get(d, "name", str), tuple((_get(p, "name", str), decode_expr(p["default"]) if "default" in p else None) for p in _get(d, "params", list)), decode_expr(_get(d, "body"))))
    if t == "groupBy":
        return S.GroupBy(tuple(_get(d, "keys", list, "by")), _aggs(_get(d, "aggs", list, "aggregations")))
    if t == "join":
        how = _get(d, "how", str)
        if how not in S.JOINS:
            raise CodecError(f"no join {how}; there are {', '.join(S.JOINS)}")
        return S.Join(how, decode_source(_get(d, "source", dict)), tuple((_get(o, "a", str), _get(o, "b", str)) for o in _get(d, "on", list)))
    if t == "window":
        fn = _FN.get(f := _get(d, "fn", str), f)
        if fn not in S.WINDOWS:
            raise CodecError(f"no window function {fn}; there are {', '.join(S.WINDOWS)}")
        return S.Window(fn, _get(d, "as", str), d.get("of"), tuple(d.get("partitionBy", ())), _decode_by(d.get("orderBy", ())), _decode_slot(d.get("n")))
    if t == "pivot":
        return S.Pivot(tuple(_get(d, "index", list)), _get(d, "on", str), _get(d, "values", str), _FN.get(f := _get(d, "agg", str), f))
    if t == "unpivot":
        return S.Unpivot(tuple(_get(d, "idVars", list)), tuple(_get(d, "valueVars", list)))
    if t == "sort":
        return S.Sort(_decode_by(_get(d, "by", list)))
    if t == "limit":
        n = _get(d, "n", None, "count")
        return S.Limit(_decode_slot(n) if isinstance(n, dict) else _int(n, "n"), _decode_slot(d.get("offset", 0)))
    if t == "distinct":
        return S.Distinct()
    if t in ("union", "intersect", "except"):
        return {"union": S.Union, "intersect": S.Intersect, "except": S.Except}[t](decode_source(_get(d, "source", dict)))
    if t == "fit":
        c = d.get("control", {})
        return S.Fit(_get(d, "response", str), _decode_features(_get(d, "predictors", list)), d.get("intercept", True), tuple(d.get("groupBy", ())), d.get("weights"), d.get("offset"), float(d.get("ridge", 0.0)), d.get("family", "gaussian"), d.get("link"), d.get("stdErrors", "classical"), d.get("theta"), d.get("power", 1.5), c.get("maxIter", 25), c.get("tol", 1e-8), d.get("output", "coefficients"))
    if t == "predict":
        m, i = _get(d, "model", dict), d.get("interval")
        return S.Predict(decode_step(_get(d, "fit", dict)), decode_source(_get(m, "source", dict)), _get(m, "from", str), d.get("scale", "response"), (_get(i, "kind", str), _get(i, "level", float)) if i else None)
    if t == "kmeans":
        return S.KMeans(_decode_features(_get(d, "features", list)), _int(_get(d, "k"), "k"), _decode_seed(_get(d, "seed")), tuple(d.get("groupBy", ())), d.get("restarts", 1), d.get("maxIterations", 100), d.get("standardise", False), d.get("silhouette", False), d.get("output", "assignments"))
    if t == "bootstrap":
        return S.Bootstrap(_aggs(_get(d, "aggregates", list)), _int(_get(d, "replicates"), "replicates"), _decode_seed(_get(d, "seed")), tuple(d.get("groupBy", ())), d.get("cluster"), d.get("level", 0.95), d.get("output", "summary"))
    raise CodecError(f"no step {t}")


def decode(text: str) -> tuple[S.Step, ...]:
    rows = loads(text)
    if not isinstance(rows, list):
        raise CodecError("a pipeline is an array")
    return tuple(map(decode_step, rows))
