"""Semantics, refusals, codec, models, change sets and edits on small fixtures."""

import datetime as dt
import json
import math
from dataclasses import replace
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernix import errors as X
from quernix.functions import expr as E
from quernix.functions import numerics as N
from quernix.functions.compile import Field
from quernix.functions.expr import col, fn, lit, param
from quernix.plans import codec, registry, tree
from quernix.plans import steps as S
from quernix.plans.engine import run, schema_walk
from quernix.sources import tables
from quernix.streaming import column_ops, delta

PEOPLE = S.Embedded((("dept", "string"), ("name", "string"), ("salary", "int"), ("bonus", "float")), (("eng", "ana", 100, 1.5), ("eng", "bob", 120, None), ("sales", "cy", 90, 2.0), ("sales", "dee", 90, 2.5), ("eng", "el", None, 0.5)))
DEPTS = S.Embedded((("dept", "string"), ("region", "string")), (("eng", "north"), ("sales", "south")))
LEFT = S.Embedded((("k", "int"), ("lv", "string")), ((1, "a"), (2, "b"), (None, "c"), (1, "d"), (4, "e"), (0, "f")))
RIGHT = S.Embedded((("k", "float"), ("rv", "string")), ((1.0, "p"), (3.0, "q"), (None, "r"), (1.0, "s"), (2.0, "t"), (-0.0, "u")))


def got(spark, steps, table=PEOPLE, **kw):
    return [tuple(r) for r in run(spark, tuple(steps), table, ordered=True, **kw).collect()]


def one(spark, e, schema=(("x", "int"),), row=(1,)):
    return run(spark, (S.Derive("y", e),), S.Embedded(schema, (row,))).first()["y"]


def test_group_order_and_nulls(spark):
    a = [S.Agg(f, f, "bonus") for f in ("sum", "mean", "min", "max", "count", "first", "last")]
    assert got(spark, [S.GroupBy(("dept",), tuple(a))]) == [("eng", 2.0, 1.0, 0.5, 1.5, 2, 1.5, 0.5), ("sales", 4.5, 2.25, 2.0, 2.5, 2, 2.0, 2.5)]
    assert got(spark, [S.Filter(col("salary") > 1000), S.GroupBy((), (S.Agg("n", "count", "name"),))]) == []


def test_odd_floats_are_one_group(spark):
    t = S.Embedded((("f", "float"),), ((math.nan,), (math.nan,), (-0.0,), (0.0,), (None,)))
    assert [n for _, n in got(spark, [S.GroupBy(("f",), (S.Agg("n", "countDistinct", "f"),))], t)] == [1, 1, 0]
    assert len(got(spark, [S.Distinct()], t)) == 3


@pytest.mark.parametrize("how, want", [
    ("inner", [(1, "a", 1.0, "p"), (1, "a", 1.0, "s"), (2, "b", 2.0, "t"), (1, "d", 1.0, "p"), (1, "d", 1.0, "s"), (0, "f", -0.0, "u")]),
    ("left", [(1, "a", 1.0, "p"), (1, "a", 1.0, "s"), (2, "b", 2.0, "t"), (None, "c", None, None), (1, "d", 1.0, "p"), (1, "d", 1.0, "s"), (4, "e", None, None), (0, "f", -0.0, "u")]),
    ("semi", [(1, "a"), (2, "b"), (1, "d"), (0, "f")]),
    ("anti", [(None, "c"), (4, "e")]),
])
def test_joins(spark, how, want):
    assert got(spark, [S.Join(how, RIGHT, (("k", "k"),))], LEFT) == want


def test_outer_joins_put_right_rows_last(spark):
    assert [r[3] for r in got(spark, [S.Join("right", RIGHT, (("k", "k"),))], LEFT)] == ["p", "s", "t", "p", "s", "u", "q", "r"]
    assert [r[3] for r in got(spark, [S.Join("outer", RIGHT, (("k", "k"),))], LEFT)][-2:] == ["q", "r"]


def test_join_names_and_decimal_keys(spark):
    left = S.Embedded((("k", "int"), ("x", "int"), ("x_right", "int")), ((1, 2, 3),))
    right = S.Embedded((("kk", "int"), ("x", "int")), ((1, 9),))
    assert run(spark, (S.Join("inner", right, (("k", "kk"),)),), left).columns == ["k", "x", "x_right", "kk", "x_right_2"]
    dec = S.Embedded((("d", "decimal(5,2)"),), ((Decimal("1.00"),),))
    assert got(spark, [S.Join("inner", dec, (("k", "d"),))], left) == []


def test_set_operations(spark):
    a = S.Embedded((("k", "int"), ("v", "string")), ((1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "z")))
    b = S.Embedded((("k", "int"), ("v", "string")), ((2, "b"), (3, "x"), (None, "z")))
    assert got(spark, [S.Intersect(b)], a) == [(2, "b"), (2, "b"), (None, "z")]
    assert got(spark, [S.Except(b)], a) == [(1, "a"), (3, "c")]
    assert got(spark, [S.Union(b)], a)[-1] == (None, "z")
    f = S.Embedded((("k", "float"), ("v", "string")), ((2.0, "b"),))
    assert got(spark, [S.Intersect(f)], a) == []
    with pytest.raises(X.JoinError):
        run(spark, (S.Union(DEPTS),), a)


def test_sort_is_stable_with_nulls_last(spark):
    assert [r[1] for r in got(spark, [S.Sort((("salary", "desc"),))])] == ["bob", "ana", "cy", "dee", "el"]
    assert [r[1] for r in got(spark, [S.Sort((("salary", "asc"),)), S.Limit(2, 1)])] == ["dee", "ana"]
    assert [r[1] for r in got(spark, [S.Limit(2, 1)])] == ["bob", "cy"]


def test_windows_restore_order(spark):
    t = S.Embedded((("s", "int"),), ((10,), (10,), (20,), (30,), (None,)))
    w = lambda f, n=None: [r[1] for r in got(spark, [S.Window(f, "w", "s", (), (("s", "asc"),), n)], t)]
    assert w("denseRank") == w("rank") == [1, 1, 2, 3, 4] and w("competitionRank") == [1, 1, 3, 4, 5]
    assert w("ntile", 2) == [1, 1, 1, 2, 2] and w("lag") == [None, 10, 10, 20, 30]
    assert w("cumulSum") == [10.0, 20.0, 40.0, 70.0, 70.0] and w("rollingSum") == [10.0, 20.0, 40.0, 60.0, 50.0]
    with pytest.raises(X.ArityError):
        w("ntile", 0)
    with pytest.raises(X.AggError):
        run(spark, (S.Window("rowNumber", "s"),), t)


@pytest.mark.parametrize("fn_, n", [("rowNumber", None), ("rank", None), ("denseRank", None), ("competitionRank", None), ("ntile", 7), ("ntile", 300), ("lag", None), ("lead", None), ("cumulSum", None), ("cumulMax", None), ("cumulMin", None), ("rollingSum", None), ("rollingMean", None)])
def test_windows_without_partitions_are_cut_into_ranges(spark, fn_, n):
    """Against one window over all rows, with ties, nulls and fewer rows than ranges."""
    from pyspark.sql import Window as W

    df = spark.range(0, 230, 1, 5).selectExpr("id", "CASE WHEN id % 13 <> 0 THEN CAST(id * 37 % 50 AS INT) END AS k", "CASE WHEN id % 7 <> 0 THEN CAST(id * 11 % 29 AS DOUBLE) END AS v")
    for rows in (df, df.limit(3), df.limit(0)):
        by = (("k", "desc"), ("id", "asc")) if fn_ not in ("rank", "denseRank", "competitionRank") else (("k", "asc"),)
        out = run(spark, (S.Window(fn_, "w", "v", (), by, n),), rows)
        key = [F.col("k").desc_nulls_last(), F.col("id")] if len(by) == 2 else [F.col("k").asc_nulls_last()]
        w = W.orderBy(*key)
        run_, roll = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(-2, 0)
        one_ = {
            "rowNumber": lambda: F.row_number().over(w), "rank": lambda: F.dense_rank().over(w), "denseRank": lambda: F.dense_rank().over(w), "competitionRank": lambda: F.rank().over(w), "ntile": lambda: F.ntile(n).over(w),
            "lag": lambda: F.lag("v").over(w), "lead": lambda: F.lead("v").over(w), "cumulSum": lambda: F.coalesce(F.sum("v").over(run_), F.lit(0.0)), "cumulMax": lambda: F.max("v").over(run_), "cumulMin": lambda: F.min("v").over(run_),
            "rollingSum": lambda: F.sum("v").over(roll), "rollingMean": lambda: F.avg("v").over(roll),
        }[fn_]()
        assert {r["id"]: r["w"] for r in out.collect()} == {r["id"]: r["w"] for r in rows.withColumn("w", one_).collect()} and out.columns == ["id", "k", "v", "w"]


def test_pivot_and_unpivot(spark):
    p = got(spark, [S.Pivot(("dept",), "salary", "name", "count")])
    assert p == [("eng", 1, 1, 0), ("sales", 0, 0, 2)]
    assert run(spark, (S.Pivot(("dept",), "salary", "name", "count"),), PEOPLE).columns == ["dept", "100", "120", "90"]
    u = got(spark, [S.Unpivot(("name",), ("salary", "bonus"))])
    assert u[:2] == [("ana", "salary", 100.0), ("ana", "bonus", 1.5)] and len(u) == 10


def test_expressions(spark):
    assert one(spark, col("x") / 0) is None and one(spark, col("x") % 0) is None
    assert one(spark, fn("greatest", col("x"), lit(None))) is None
    assert one(spark, fn("pow", 0.0, -1)) is None and one(spark, fn("pow", -8.0, 1 / 3)) is None and one(spark, fn("pow", 2, 10)) == 1024
    assert one(spark, fn("concat", lit(1.0), "/", lit(1e300), "/", lit(True))) == "1/1e+300/true"
    assert one(spark, fn("round", 2.5)) == 3.0 and one(spark, fn("sqrt", -1.0)) is None
    assert one(spark, fn("substr", "hello", 1, 3)) == "ell" and one(spark, fn("indexOf", "abc", "")) == 0
    assert one(spark, E.Rounded(lit(Decimal("2.25")), 1, "halfEven")) == Decimal("2.2")
    assert [one(spark, E.Quotient(lit(Decimal(-7)), lit(Decimal(2)), 0, m)) for m in ("halfEven", "halfUp", "halfDown", "up", "down", "ceiling", "floor")] == [Decimal(x) for x in (-4, -4, -3, -4, -3, -3, -4)]
    assert one(spark, E.Quotient(lit(1), lit(0), 2)) is None
    for m, want in zip(("up", "down", "halfDown", "ceiling", "floor"), ("-2.3", "-2.2", "-2.2", "-2.2", "-2.3")):
        assert one(spark, E.Rounded(lit(Decimal("-2.25")), 1, m)) == Decimal(want)
    k = ((0.0, 0.0), (1.0, 1.0), (2.0, 1.5), (3.0, 1.0))
    assert one(spark, E.Interpolate(lit(0.5), k)) == 0.5 and one(spark, E.Interpolate(lit(9.0), k, "linear", "null")) is None
    assert 1.0 < one(spark, E.Interpolate(lit(1.5), k, "monotoneCubic")) < 1.5 and math.isnan(one(spark, E.Interpolate(lit(math.nan), k)))


@pytest.mark.parametrize("mode", ("halfEven", "halfUp", "halfDown", "up", "down", "ceiling", "floor"))
def test_quotients_are_exact_at_every_scale(spark, mode):
    """Against exact fractions, on terminating and other quotients of either sign."""
    import random
    from fractions import Fraction

    rnd = random.Random(mode)
    rows = tuple((Decimal(rnd.randrange(-(10**8), 10**8)) / 100, Decimal(rnd.choice(("2", "-4", "0.5", "8", "1.25", "3", "7", "-0.3", "0", str(rnd.randrange(1, 10**5)))))) for _ in range(60))
    scales = (0, 1, 2, 6, 7, 8, 10, 13, 20, 27)
    t = S.Embedded((("a", "decimal(12,2)"), ("b", "decimal(10,4)")), rows)
    out = run(spark, tuple(S.Derive(f"q{s}", E.Quotient(col("a"), col("b"), s, mode)) for s in scales), t).collect()

    def want(a, b, scale):
        if b == 0:
            return None
        x = Fraction(a) / Fraction(b) * 10**scale
        n, d = abs(x.numerator), x.denominator
        w, r = divmod(n, d)
        more = {"up": r > 0, "down": False, "ceiling": r > 0 and x > 0, "floor": r > 0 and x < 0, "halfUp": 2 * r >= d, "halfDown": 2 * r > d, "halfEven": 2 * r > d or 2 * r == d and w % 2 == 1}[mode]
        return Decimal((int(x < 0), tuple(map(int, str(w + more))), -scale))

    for r in out:
        for s in scales:
            assert r[f"q{s}"] == want(r["a"], r["b"], s), (r["a"], r["b"], s)


def test_quotient_limits(spark):
    q = lambda a, b, s: one(spark, E.Quotient(lit(Decimal(a)), lit(Decimal(b)), s))
    assert q("1", "3", 37) == Decimal("0." + "3" * 37) and q("-1", "8", 30) == Decimal("-0.125") and q("1", "3", 0) == 0
    assert q("12345678901234567890", "7", 10) == Decimal("1763668414462081127.1428571429")
    with pytest.raises(X.OverflowRefused):
        q("1", "3", 39)


def test_narrow_quotients_are_divided_in_longs(spark):
    """Integers at their limits, carries into the whole part and over groups of digits; no lambda and no pattern is run row by row."""
    from fractions import Fraction

    low, high = -(2**31), 2**31 - 1
    rows = tuple((x, y) for x in (low, high, -1, 0, 2, 999_999_999, None) for y in (low, high, -3, 0, 1, 7, 1_000_000_000, None))
    kinds = {"a": (3, "halfEven"), "b": (8, "up"), "c": (19, "ceiling"), "d": (26, "floor")}
    steps = tuple(S.Derive(n, E.Quotient(col("x"), col("y"), *k)) for n, k in kinds.items()) + tuple(S.Derive(f"t{n}", fn("concat", col(n))) for n in kinds)
    df = run(spark, steps, S.Embedded((("x", "int"), ("y", "int")), rows))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "lambda" not in plan and "regexp" not in plan
    for r in df.collect():
        for n, (scale, mode) in kinds.items():
            if r["x"] is None or not r["y"]:
                assert r[n] is None and r[f"t{n}"] is None
                continue
            v = Fraction(r["x"], r["y"]) * 10**scale
            w = {"halfEven": round, "up": lambda z: math.ceil(z) if z > 0 else math.floor(z), "ceiling": math.ceil, "floor": math.floor}[mode](v)
            want = Decimal((int(w < 0), tuple(map(int, str(abs(w)))), -scale))
            text = format(want, "f")
            assert r[n] == want and r[f"t{n}"] == (text.rstrip("0").rstrip(".") if "." in text else text), (r, n)


def test_floor_and_ceil_of_any_float(spark):
    for v in (1e300, -1e300, math.inf, -math.inf, 2.0**53 + 2, -(2.0**63), 2.0**63):
        assert one(spark, fn("floor", v)) == v and one(spark, fn("ceil", v)) == v
    assert math.isnan(one(spark, fn("floor", math.nan))) and math.isnan(one(spark, fn("ceil", math.nan)))
    assert one(spark, fn("floor", -0.5)) == -1.0 and one(spark, fn("ceil", 0.5)) == 1.0 and one(spark, fn("pow", -2.0, 1e300)) == math.inf


@pytest.mark.parametrize("e, err", [
    (col("nope"), X.UnknownColumn), (col("x") + "a", X.TypeMismatch), (lit("5").eq(5), X.TypeMismatch), (lit(1.5) + lit(Decimal(1)), X.TypeMismatch),
    (param("p"), X.UnboundParam), (E.Now("date"), X.UnpinnedClock), (fn("nope", 1), X.FunctionError), (fn("abs", 1, 2), X.ArityError),
    (E.Interpolate(col("x"), ((0.0, 1.0),)), X.InvalidKnots), (E.Call("f", ()), X.FunctionError), (fn("sqrt", lit(Decimal(4))), X.TypeMismatch), (lit(Decimal(1)) / lit(Decimal(2)), X.TypeMismatch),
])
def test_refusals_before_any_row(spark, e, err):
    with pytest.raises(err):
        run(spark, (S.Derive("y", e),), S.Embedded((("x", "int"),), ()))


def test_int_overflow_is_refused(spark):
    t = S.Embedded((("x", "int"),), ((2**31 - 1,), (1,)))
    for s in (S.Derive("y", col("x") + 1), S.GroupBy((), (S.Agg("t", "sum", "x"),))):
        with pytest.raises(Exception, match="OVERFLOW"):
            run(spark, (s,), t).collect()


def test_functions(spark):
    f = S.Define(E.FnDef("f", (("a", None),), E.Call("g", (("b", E.Arg("a")),))))
    g = S.Define(E.FnDef("g", (("b", None),), E.Arg("b") * 2))
    loop = S.Define(E.FnDef("g", (("b", None),), E.Call("g", (("b", E.Arg("b")),))))
    use = S.Derive("y", E.Call("f", (("a", col("salary")),)))
    assert got(spark, [g, f, use])[0][-1] == 200
    with pytest.raises(X.RecursiveFunction):
        run(spark, (loop,), PEOPLE)
    with pytest.raises(X.ArityError):
        run(spark, (g, S.Derive("y", E.Call("g", ()))), PEOPLE)


def test_units(spark):
    t = S.Embedded((("d", "float", "km"), ("h", "float", "h"), ("n", "int")), ((3.6, 1.0, 2),))
    s = run(spark, (S.Derive("v", col("d") / col("h")), S.Derive("m", E.Convert(col("d"), "m"))), t)
    assert s.schema["v"].metadata["unit"] == "km/h" and s.first()["m"] == 3600.0
    for e in (col("d") + col("h"), col("d") < col("h"), E.Convert(col("n"), "m"), E.Convert(col("d"), "kg")):
        with pytest.raises(X.UnitMismatch):
            run(spark, (S.Derive("y", e),), t)


def test_codec_round_trip_and_hash(spark):
    steps = (
        S.Define(E.FnDef("f", (("a", lit(1)),), E.Arg("a"))), S.Filter(E.In(col("x"), (), "p") & ~col("y").is_null()), S.Derive("z", E.case((col("x") > 1, lit(dt.date(2020, 1, 2))), otherwise=None)),
        S.Derive("q", E.Quotient(lit(Decimal("1.50")), col("x"), 2)), S.Derive("i", E.Interpolate(col("y"), ((0.0, 1.0), (2.0, 3.0)))), S.Derive("c", E.Call("f", (("a", col("x")),))), S.Project((("x", "y"),)),
        S.GroupBy(("y",), (S.Agg("n", "count", "y"),)), S.Join("left", DEPTS, (("y", "dept"),)), S.Window("ntile", "w", None, ("y",), ((param("k"), "desc"),), 3), S.Pivot(("y",), "n", "w", "sum"), S.Unpivot(("a",), ("b",)),
        S.Sort(((param("k"), "asc"),)), S.Limit(param("n"), 2), S.Distinct(), S.Union(S.Ref("r")), S.Intersect(S.Ref("r")), S.Except(S.Ref("r")), S.Fit("y", (("x", col("x")),), family="poisson"), S.Predict(S.Fit("y", (("x", col("x")),)), S.Ref("r"), interval=("confidence", 0.9)), S.KMeans((("x", col("x")),), 3, 42), S.Bootstrap((S.Agg("m", "mean", "x"),), 10, param("s")),
    )
    assert codec.decode(codec.encode(steps)) == steps
    assert codec.encode(codec.decode(codec.encode(steps))) == codec.encode(steps) and codec.pipeline_hash(steps).startswith("sha256:")
    t = codec.decode_source(json.loads(codec.encode_table(PEOPLE)))
    assert t == PEOPLE and tables.to_json(tables.from_json(spark, codec.encode_table(PEOPLE))) == codec.encode_table(PEOPLE)


@pytest.mark.parametrize("text", [
    '[{"$type":"nope"}]', '[{"$type":"filter"}]', '[{"$type":"limit","n":1.5}]', '[{"$type":"limit","n":3000000000}]', '[{"$type":"sort","by":[],"by":[]}]', "{}", "[",
    '[{"$type":"join","how":"cross","on":[],"source":{"ref":"x"}}]', '[{"$type":"derive","name":"a","expr":{"$type":"lit","cell":{"$type":"Date","value":"2020-1-2"}}}]',
    '[{"$type":"filter","pred":{"$type":"lit","cell":{"$type":"BigInt","value":"1x"}}}]', '[{"$type":"filter","pred":{"$type":"lit","cell":{"$type":"BigInt","value":"9223372036854775808"}}}]', '[{"$type":"filter","pred":{"$type":"lit","cell":{"$type":"Timestamp","value":"2020-01-02"}}}]',
    '[{"$type":"kmeans","features":[],"k":2,"seed":"007"}]', '[{"$type":"filter","pred":{"$type":"in","expr":{"$type":"col","name":"a"}}}]', '[{"$type":"groupBy","keys":[],"by":[],"aggs":[]}]',
])
def test_decoder_refuses(text):
    with pytest.raises(X.CodecError):
        codec.decode(text)


def test_lenient_decoding():
    a = codec.decode('[{"$type":"filter","column":"x","op":"gt","value":3},{"$type":"groupBy","by":["x"],"aggregations":[{"as":"m","fn":"avg","column":"y"}]},{"$type":"limit","count":2}]')
    assert a == (S.Filter(col("x") > 3), S.GroupBy(("x",), (S.Agg("m", "mean", "y"),)), S.Limit(2))


def test_schema_walk(spark):
    s = {"a": Field("int"), "b": Field("float", "m")}
    out, closed = schema_walk(spark, (S.Derive("c", col("a") * col("b")), S.GroupBy(("a",), (S.Agg("t", "sum", "c"),))), s)
    assert closed and out == {"a": Field("int"), "t": Field("float", "m")}
    assert not schema_walk(spark, (S.Pivot(("a",), "a", "b", "sum"),), s)[1]


# Numerics


def test_numerics():
    assert N.normal_quantile(0.975) == pytest.approx(1.959963984540054, rel=1e-13) and N.normal_cdf(1.96) == pytest.approx(0.9750021048517795, rel=1e-13)
    assert N.student_t_quantile(0.975, 6) == pytest.approx(2.4469118511449692, rel=1e-12)
    assert N.chi_square_quantile(0.95, 3) == pytest.approx(7.814727903251179, rel=1e-12) and N.fisher_f_cdf(4.0, 2, 10) == pytest.approx(1 - (1 + 0.8) ** -5, rel=1e-12)
    assert N.digamma(1.0) == pytest.approx(-0.5772156649015329, rel=1e-13) and N.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-13)
    assert N.gamma_p(2.0, 3.0) == pytest.approx(1 - 4 * math.exp(-3), rel=1e-13) and N.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-12)
    assert N.bracketed_newton(lambda x: x * x - 2, lambda x: 2 * x, 0, 2) == pytest.approx(math.sqrt(2)) and N.integer_search(lambda n: n * n >= 50, 0, 100) == 8
    assert N.golden_section(lambda x: (x - 3) ** 2, 0, 10) == pytest.approx(3, abs=1e-4) and N.damped(math.cos, 1.0) == pytest.approx(0.7390851332151607)
    assert math.isnan(N.student_t_cdf(1, -1)) and [N.Rng(0).next()] == [0xE220A8397B1DCDAF]
    r = N.Rng(5, 2)
    assert all(0 <= r.below(7) < 7 and 0 <= r.uniform53() < 1 for _ in range(100))
    # A draw whose top 32 bits are below 2^32 mod n is rejected.
    n, tops = 3 * 2**30, []
    while not any(t < 2**30 for t in tops):
        seed = len(tops)
        tops.append(N.Rng(seed, 0).next() >> 32)
    r, first = N.Rng(seed, 0), N.Rng(seed, 0)
    first.next()
    second = first.next() >> 32
    while second < 2**30:
        second = first.next() >> 32
    assert r.below(n) == second % n


def test_linear_algebra(spark):
    from quernix.functions import linalg as L

    rng = np.random.default_rng(3)
    a, b = L.Matrix(rng.normal(size=(6, 4))), L.Matrix(rng.normal(size=(4, 3)))
    assert L.gemm(a, b).values == pytest.approx(a.values @ b.values) and L.gram(a).values == pytest.approx(a.values.T @ a.values)
    assert L.gemm(a, L.identity(4)) == a and a.transpose().transpose() == a and L.gemv(a, [1, 0, 0, 0]) == pytest.approx(a.column(0))
    assert L.of_columns([a.column(j) for j in range(4)]) == a and L.of_columns([]).shape == (0, 0) and not a.values.flags.writeable
    assert L.dot([1, 2], [3, 4]) == 11 and L.add([1, 2], [3, 4]).tolist() == [4, 6] and L.sub([1, 2], [3, 5]).tolist() == [-2, -3] and L.scale(2, [1]).tolist() == [2]
    assert L.norm2([3e200, 4e200]) == pytest.approx(5e200) and L.norm2([3, 4]) == 5 and L.norm2([3e-200, 4e-200]) == pytest.approx(5e-200) and L.norm2([]) == 0 and math.isnan(L.norm2([math.nan, 1]))
    q, r = L.householder(a)
    assert q.values @ r.values == pytest.approx(a.values) and (np.diag(r.values) >= 0).all() and L.gram(q).values == pytest.approx(np.eye(4))
    x = L.solve_triangular(r, np.ones(4))
    assert r.values @ x == pytest.approx(np.ones(4)) and r.values.T @ L.solve_triangular(r.transpose(), np.ones(4), lower=True) == pytest.approx(np.ones(4))
    thin = L.of_columns([a.column(0), a.column(1), a.column(0) * 2 - a.column(1), 1000 * a.column(2)])
    q, r, order, rank = L.pivoted(thin)
    assert rank == 3 and order[0] == 3 and q.values @ r.values == pytest.approx(thin.values[:, order]) and L.pivoted(L.init(3, 2, lambda i, j: 0.0))[3] == 0
    c, s_, h = L.givens(3.0, 4.0)
    assert (c * 3 + s_ * 4, c * 4 - s_ * 3) == pytest.approx((h, 0.0)) and L.givens(0.0, 0.0) == (1.0, 0.0, 0.0)
    odd = L.Matrix(np.array([[1.5, math.nan], [-math.inf, math.inf]]))
    assert L.encode(L.decode(L.encode(odd))) == L.encode(odd) and L.decode(L.encode(a)) == a
    for text in ("{}", '{"rows":1,"cols":2,"data":[1]}', '{"rows":true,"cols":1,"data":[1]}', "x"):
        with pytest.raises(X.CodecError):
            L.decode(text)
    for f in (lambda: L.gemm(b, a), lambda: L.dot([1], [1, 2]), lambda: L.gemv(a, [1]), lambda: a.column(4), lambda: L.init(-1, 2, max), lambda: L.solve_triangular(L.init(2, 2, lambda i, j: 0.0), [1, 1])):
        with pytest.raises(X.LinAlgRefused):
            f()
    t = spark.createDataFrame([(1.0, 2), (3.0, None), (-1.0, 5)], "x double, y int")
    assert L.table_gram(t, ["x", "y"]).values.tolist() == [[2.0, -3.0], [-3.0, 29.0]]


def test_least_squares_accumulator():
    from quernix.functions import linalg as L

    rng = np.random.default_rng(5)
    x, w = np.column_stack([np.ones(50), rng.normal(size=(50, 2))]), rng.uniform(0.5, 2, 50)
    y = x @ [1.0, 2.0, -3.0] + rng.normal(size=50)
    whole = L.Accumulator(3).add(x, y, w)
    parts = L.Accumulator(3).add(x[:20], y[:20], w[:20]).merge(L.Accumulator(3).add(x[20:], y[20:], w[20:]))
    want = np.linalg.lstsq(np.sqrt(w)[:, None] * x, np.sqrt(w) * y, rcond=None)
    for acc in (whole, parts, L.Accumulator.decode(parts.encode())):
        got = acc.fit()
        assert got["coefficients"] == pytest.approx(want[0]) and got["rss"] == pytest.approx(float(want[1][0])) and got["n"] == 50 and got["kept"] == [0, 1, 2]
    assert np.isnan(L.Accumulator(2).add(x[:, [1, 1]], y).fit()["coefficients"]).tolist() == [False, True]
    with pytest.raises(X.LinAlgRefused):
        whole.merge(L.Accumulator(2))
    with pytest.raises(X.CodecError):
        L.Accumulator.decode('{"n":1,"p":3,"triangle":{"rows":1,"cols":1,"data":[0]}}')


def test_cells_and_rows(spark):
    agg = lambda fn_, cells, kind="float": tables.aggregate_cells(spark, fn_, kind, cells)
    assert agg("sum", [1.0, None, 2.5]) == 3.5 and agg("count", []) == 0 and agg("mean", []) is None and agg("median", [3.0, 1.0, 2.0]) == 2.0 and agg("first", [None, 1.0]) is None
    assert agg("max", [Decimal("1.5"), Decimal("2")], "decimal(5,1)") == 2 and tables.eval_in_row(spark, col("x") * param("k"), (("x", "int"),), (4,), {"k": 3}) == 12


def test_tree_derive_and_log(spark):
    a = (S.Filter(col("x") > 1), S.Derive("y", col("x") * 2), S.Limit(3))
    one_ = tree.lift(a)
    two = tree.apply_script(one_, [("update", one_.nodes[1].id, S.Derive("y", col("x") * 3)), ("move", one_.nodes[2].id, None), ("insertAfter", one_.nodes[0].id, S.Distinct()), ("remove", one_.nodes[0].id)])
    for before, after in ((one_, two), (two, one_), (one_, one_), (tree.lift(()), one_), (one_, tree.lift(()))):
        edits = tree.derive(before, after)
        assert tree.lower(tree.apply_script(before, edits)) == tree.lower(after)
        assert [tree.decode_edit(tree.encode_edit(e)) for e in edits] == edits
        assert tree.lower(tree.Stream().replay(before, [tree.encode_edit(e) for e in edits])) == tree.lower(after)
    assert tree.derive(one_, one_) == [] and tree.derive(one_, two)[0][0] == "remove"
    with pytest.raises(X.EditRejected):
        tree.Stream(spark, {"x": Field("int")}).apply(one_, ("insertAfter", None, S.Filter(col("z") > 1)))
    with pytest.raises(X.EditRejected):
        tree.decode_edit('["nope"]')


SALES = S.Embedded(
    (("id", "int"), ("region", "string"), ("x", "float", "m"), ("colour", "string"), ("w", "float"), ("y", "float", "s")),
    tuple((i, "north" if i % 2 else "south", float(i), ("blue", "green", "red")[i % 3], 1.0 + i % 2, 2.0 + 0.5 * i + (0.3 if i % 3 else -0.4)) for i in range(1, 13)),
)


def ols(rows, cols):
    x = np.array([[1.0, *[r[c] for c in cols]] for r in rows])
    y = np.array([r[5] for r in rows])
    b, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    return b, float(rss[0]), np.linalg.inv(x.T @ x), x, y


def test_fit_ols(spark):
    b, rss, inv, x, y = ols(SALES.rows, [2])
    f = S.Fit("y", (("x", col("x")),))
    c = got(spark, [f], SALES)
    assert [r[0] for r in c] == ["(Intercept)", "x"] and [r[4] for r in c] == ["s", "s/m"] or [r[4] for r in c] == ["s", "1/m*s"]
    assert [r[1] for r in c] == pytest.approx(b, rel=1e-9)
    assert [r[2] for r in c] == pytest.approx(np.sqrt(rss / 10 * np.diag(inv)), rel=1e-9)
    sm = run(spark, (S.with_output(f, "summary"),), SALES).first()
    assert (sm["n"], sm["df"], sm["rank"], sm["iterations"]) == (12, 10, 2, 1) and sm["deviance"] == pytest.approx(rss) and sm["r2"] == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
    e = y - x @ b
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    for kind, adj in (("hc0", 1), ("hc3", 1 / (1 - h) ** 2)):
        meat = (x * (e**2 * adj)[:, None]).T @ x
        r = got(spark, [S.Fit("y", (("x", col("x")),), std_errors=kind)], SALES)
        assert [v[2] for v in r] == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv)), rel=1e-8)


def test_fit_coding_and_aliasing(spark):
    c = got(spark, [S.Fit("y", (("x", col("x")), ("colour", col("colour"))))], SALES)
    assert [r[0] for r in c] == ["(Intercept)", "x", "colour[green]", "colour[red]"]
    c = got(spark, [S.Fit("y", (("x", col("x")), ("colour", col("colour"))), intercept=False)], SALES)
    assert [r[0] for r in c] == ["x", "colour[blue]", "colour[green]", "colour[red]"]
    c = got(spark, [S.Fit("y", (("x", col("x")), ("twice", col("x") * 2.0)))], SALES)
    assert c[2][:3] == ("twice", None, None)
    with pytest.raises(X.UnsupportedFit):
        run(spark, (S.Fit("y", (("x", col("x")),), family="gamma", link="logit"),), SALES)


def test_fit_glm_and_groups(spark):
    rows = tuple((g, x, k) for g in ("a", "b") for x, k in ((0.0, 1), (0.0, 3), (1.0, 4), (1.0, 8)))
    t = S.Embedded((("g", "string"), ("x", "float"), ("k", "int")), rows)
    c = got(spark, [S.Fit("k", (("x", col("x")),), family="poisson", group_by=("g",))], t)
    assert [r[:2] for r in c] == [("a", "(Intercept)"), ("a", "x"), ("b", "(Intercept)"), ("b", "x")]
    assert [r[2] for r in c[:2]] == pytest.approx([math.log(2), math.log(3)], rel=1e-7)
    b = S.Embedded((("x", "float"), ("k", "int")), tuple((x, k) for x, k, n in ((0.0, 1, 1), (0.0, 0, 3), (1.0, 1, 3), (1.0, 0, 1)) for _ in range(n)))
    c = got(spark, [S.Fit("k", (("x", col("x")),), family="binomial")], b)
    assert [r[1] for r in c] == pytest.approx([math.log(1 / 3), 2 * math.log(3)], rel=1e-6)
    with pytest.raises(Exception, match="out of the range"):
        run(spark, (S.Fit("x", (("k", col("k")),), family="gamma"),), b)


def test_predict(spark):
    f = S.Fit("y", (("x", col("x")),), group_by=("region",))
    fitted = [r[-1] for r in got(spark, [S.with_output(f, "fitted")], SALES)]
    p = got(spark, [S.Predict(f, SALES, interval=("prediction", 0.95))], SALES)
    assert [r[6] for r in p] == pytest.approx(fitted)
    rows = [r for r in SALES.rows if r[1] == "north"]
    b, rss, inv, *_ = ols(rows, [2])
    north = [r for r in p if r[1] == "north"][0]
    v = np.array([1.0, north[2]])
    se = math.sqrt(rss / 4 * (v @ inv @ v))
    assert north[7] == pytest.approx(se) and north[10] - north[6] == pytest.approx(-N.student_t_quantile(0.025, 4) * math.hypot(se, math.sqrt(rss / 4)))
    coefs = run(spark, (f,), SALES)
    q = got(spark, [S.Predict(f, S.Ref("c"), "coefficients")], SALES, tables={"c": coefs})
    assert [r[6] for r in q] == pytest.approx(fitted)
    with pytest.raises(Exception, match="unseen level"):
        new = S.Embedded(SALES.schema, ((1, "north", 1.0, "pink", 1.0, 1.0),))
        run(spark, (S.Predict(S.Fit("y", (("c", col("colour")),)), SALES),), new).collect()


PLANE = S.Embedded((("id", "int"), ("truth", "int"), ("x", "float"), ("y", "float"), ("n", "int")), tuple((i, i % 4, (i % 4 // 2) * 10.0 + (i // 4) * 0.1, (i % 2) * 10.0 - (i // 4) * 0.1, i) for i in range(16)))


def test_kmeans(spark):
    k = S.KMeans((("x", col("x")), ("y", col("y"))), 4, 20, restarts=4)
    a = got(spark, [k], PLANE)
    assert len({(r[1], r[5]) for r in a}) == 4 and {r[5] for r in a} == {1, 2, 3, 4}
    from dataclasses import replace

    c = got(spark, [replace(k, output="centres")], PLANE)
    assert sorted(r[3] for r in c) == [4, 4, 4, 4] and got(spark, [k], PLANE) == a
    line = S.Embedded((("x", "float"),), ((0.0,), (1.0,), (10.0,), (11.0,)))
    sm = got(spark, [S.KMeans((("x", col("x")),), 2, 3, silhouette=True, output="summary")], line)
    assert sm[0][-1] == pytest.approx(((10.5 - 1) / 10.5 + (9.5 - 1) / 9.5) / 2)
    same = S.Embedded((("x", "float"),), ((2.5,),) * 5)
    assert [r[1] for r in got(spark, [S.KMeans((("x", col("x")),), 2, 1)], same)] == [2, 1, 1, 1, 1]
    for bad in (replace(k, k=1), replace(k, k=17), replace(k, restarts=0), replace(k, features=())):
        with pytest.raises(X.KMeansError):
            run(spark, (bad,), PLANE)


def test_silhouette_in_blocks(spark, monkeypatch):
    """Against all pairs of each group, with blocks far smaller than a group and a row alone in its cluster."""
    from quernix.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [("a", float(x), float(y)) for x, y in rng.normal(size=(40, 2)) + rng.integers(0, 3, (40, 1)) * 4] + [("b", float(i), 0.0) for i in range(9)] + [("b", 500.0, 1.0)]
    t = S.Embedded((("g", "string"), ("x", "float"), ("y", "float")), tuple(rows))
    k = S.KMeans((("x", col("x")), ("y", col("y"))), 3, 5, group_by=("g",), silhouette=True, output="summary")
    got_ = {r[0]: r[-1] for r in got(spark, [k], t)}
    who = got(spark, [replace(k, output="assignments", silhouette=False)], t)
    for g in "ab":
        v, c = np.array([r[1:3] for r in who if r[0] == g]), np.array([r[3] for r in who if r[0] == g])
        far, w = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), []
        for i in range(len(v)):
            own = c == c[i]
            if own.sum() == 1:
                w.append(0.0)
                continue
            near, other = far[i][own].sum() / (own.sum() - 1), min(far[i][c == o].mean() for o in set(c.tolist()) - {c[i]})
            w.append((other - near) / max(near, other))
        assert got_[g] == pytest.approx(np.mean(w))


def test_bootstrap(spark):
    b = S.Bootstrap((S.Agg("total", "sum", "n"), S.Agg("mx", "mean", "x")), 25, 7, output="replicates")
    r = got(spark, [b], PLANE)
    rng = N.Rng(7, 0)
    want = []
    for _ in range(25):
        at = [rng.below(16) for _ in range(16)]
        want.append((sum(PLANE.rows[i][4] for i in at), sum(PLANE.rows[i][2] for i in at) / 16))
    assert [v[0] for v in r] == list(range(1, 26)) and [v[1] for v in r] == [t for t, _ in want] and [v[2] for v in r] == pytest.approx([m for _, m in want])
    from dataclasses import replace

    s = got(spark, [replace(b, output="summary", level=0.9)], PLANE)
    totals = np.array([float(t) for t, _ in want])
    assert s[0][0] == "total" and s[0][1] == sum(range(16)) and s[0][2] == pytest.approx(totals.std(ddof=1)) and s[0][3:] == pytest.approx(tuple(np.quantile(totals, [0.05, 0.95])))
    c = got(spark, [replace(b, cluster="truth", aggregates=(S.Agg("rows", "count", "n"),))], PLANE)
    assert {v[1] for v in c} == {16}


@pytest.mark.parametrize("cluster", (None, "c"))
def test_bootstrap_sends_no_rows_to_the_driver(spark, monkeypatch, tmp_path, cluster):
    """A small file may hold many rows: nothing is broadcast, whatever the planner estimates; draws cross blocks, and null is a group and a cluster."""
    from quernix.operators import bootstrap

    monkeypatch.setattr(bootstrap, "_BLOCK", 7, raising=False)
    rows = [(None if i % 3 == 0 else i % 3, None if i % 5 == 0 else i % 5 - 2.0, i) for i in range(90)]
    spark.createDataFrame(rows, "g int, c double, x int").repartition(1).sortWithinPartitions("x").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    b = S.Bootstrap((S.Agg("total", "sum", "x"), S.Agg("head", "first", "x")), 4, 11, cluster=cluster, group_by=("g",), output="replicates")
    want = set()
    for stream, g in enumerate((None, 1, 2)):
        units: dict = {}
        for _, c, x in (r for r in rows if r[0] == g):
            units.setdefault(c if cluster else x, []).append(x)
        units, rng = list(units.values()), N.Rng(11, stream)
        for r in range(1, 5):
            drawn = [units[rng.below(len(units))] for _ in units]
            want.add((g, r, sum(map(sum, drawn)), drawn[0][0]))
    assert {tuple(v) for v in run(spark, [b], t).collect()} == want
    df = run(spark, [replace(b, output="summary", aggregates=b.aggregates[:1])], t)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(v["g"], v["estimate"]) for v in df.collect()} == {(g, sum(x for h, _, x in rows if h == g)) for g in (None, 1, 2)}


# Change sets and edits


def test_delta(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string")
    d = delta.diff(old, new, ("k",))
    assert {tuple(r) for r in d.collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    then = spark.createDataFrame([(4, "removed"), (3, "added"), (2, "removed")], "k int, change string")
    assert {tuple(r) for r in delta.compose(d, then, ("k",)).collect()} == {(4, "transient"), (3, "changed"), (2, "removed")}
    with pytest.raises(X.DeltaError):
        delta.diff(old.union(old), new, ("k",))


def test_change_sets(spark, tmp_path):
    from quernix.streaming import changes as C

    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string")
    last = spark.createDataFrame([(1, "x"), (2, "c"), (3, "z")], "k int, v string")
    a, b = C.between(old, new, ("k",)), C.between(new, last, ("k",))
    read = lambda d: {tuple(r) for r in d.rows.collect()}
    ab = C.compose_checked(a, b)
    assert read(ab) == {(1, "changed"), (2, "changed"), (3, "changed"), (4, "transient")}
    assert read(C.compose_all([a, b])) == read(ab) == read(C.compose(C.empty(old, ("k",)), ab)) and C.empty(old, ("k",)).is_quiet()
    assert C.compose(C.full(("k",)), a).is_full and C.compose(a, replace(b, keys=("v",))).is_full
    assert {tuple(r) for r in C.resolve(a, new).collect()} == {(2, "c"), (4, "d")} and C.resolve(C.full(("k",)), new) is None
    back = C.decode(spark, C.encode(ab))
    assert read(back) == read(ab) and C.encode(back) == C.encode(ab) and C.decode(spark, C.encode(C.full(("k",)))).is_full
    bad = spark.createDataFrame([(1, "added"), (1, "gone"), (None, "added")], "k int, change string")
    d = C.ChangeSet(("k",), bad, ("c", "", "c"))
    assert C.defects(d) == ["a column without a name", "column invalidated more than once: c", "a null key", "a row named more than once", "a change that is none of added, changed, removed, transient"]
    assert C.defects(C.ChangeSet((), None)) == ["a change set names its keys"] and C.defects(a) == []
    for f in (lambda: C.validate(d), lambda: C.compose_checked(a, d), lambda: C.compose_checked(a, replace(b, keys=("v",)))):
        with pytest.raises(X.DeltaError):
            f()
    for text in ("[]", '{"$type":"rowSet","keys":["k"],"columns":[]}', '{"$type":"x","keys":["k"]}', C.encode(ab).replace("changed", "moved")):
        with pytest.raises(X.CodecError):
            C.decode(spark, text)
    c = C.of_change(old, ("k",), "columnValuesChanged", "v")
    assert C.to_change(c) == ("columnValuesChanged", "v") and C.of_change(old, ("k",), "rowsAppended").is_full and C.to_change(a) == ("unknown", None)


REFRESHED = [
    (S.Filter(col("v") > 1), S.Derive("w", col("v") * 2)),
    (S.Filter(col("v") > 1), S.Project((("g", "g"), ("v", "v"))), S.GroupBy(("g",), (S.Agg("t", "sum", "v"), S.Agg("m", "median", "v"))), S.Filter(col("t") > 3)),
    (S.Window("cumulMax", "w", "v", ("g",), (("v", "asc"),)), S.Sort((("w", "desc"), ("k", "asc"))), S.Limit(3)),
    (S.GroupBy((), (S.Agg("n", "count", "v"),)),),
    (S.Distinct(),),
    (S.Filter(col("v") > 0), S.Fit("v", (("x", col("k")),), group_by=("g",))),
    (S.Derive("x", col("k") * 2), S.Fit("v", (("x", col("x")),), output="summary")),
]


@pytest.mark.parametrize("steps", REFRESHED)
def test_refresh_equals_full(spark, steps, tmp_path):
    old = spark.createDataFrame([(i, "abc"[i % 3], i % 7) for i in range(20)], "k int, g string, v int")
    new = old.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") == 7, 50).otherwise(F.col("v"))).union(spark.createDataFrame([(99, "d", 4)], "k int, g string, v int"))
    pr = delta.prime(old, steps, ("k",), str(tmp_path))
    re = delta.refresh(pr, delta.diff(old, new, ("k",)), new)
    rows = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=str)
    assert rows(delta.result(re, new)) == rows(run(spark, steps, new)) and rows(delta.result(pr, old)) == rows(run(spark, steps, old))
    full = any(c == "FallBack" for c, _ in delta.plan(steps))
    assert re.footprint.kind == ("full" if full else "incremental") and (full or re.footprint.rows == 6)
    assert delta.refresh(re, delta.diff(new, new, ("k",)), new).footprint.kind == ("full" if full else "reused")


def test_state_codec_and_reasons(spark, tmp_path):
    old = spark.createDataFrame([(i, "abc"[i % 3], i % 7) for i in range(20)], "k int, g string, v int")
    steps = (S.Filter(col("v") > param("p")), S.GroupBy(("g",), (S.Agg("t", "sum", "v"),)))
    pr = delta.prime(old, steps, ("k",), str(tmp_path), env={"p": 1})
    text = delta.encode_state(pr, "v1")
    back = delta.decode_state(text, source="v1")
    assert back == pr and delta.encode_state(back, "v1") == text
    assert sorted(map(tuple, delta.result(back, old).collect())) == sorted(map(tuple, run(spark, steps, old, env={"p": 1}).collect()))
    for broken in (text.replace("abc", "abd") if "abc" in text else text[:-20] + "x" + text[-19:], text.replace(pr.hash, "sha256:0"), "{}", "x"):
        with pytest.raises(X.CodecError):
            delta.decode_state(broken)
    with pytest.raises(X.CodecError):
        delta.decode_state(text, source="v2")
    with pytest.raises(X.CodecError):
        delta.decode_state(text, steps=(S.Distinct(),))
    d = delta.diff(old, old, ("k",))
    why = lambda **kw: delta.refresh(pr, kw.pop("d", d), kw.pop("new", old), **kw).footprint.reason
    assert why() is None and why(d=None) == "DeltaIsFullRefresh" and why(new=old.withColumn("v", F.col("v").cast("long"))) == "SourceSchemaMoved"
    assert why(steps=steps, env={"p": 2}) == "EnvChanged" and why(steps=(S.Filter(col("v") > 3),)) == "PipelineChanged" and why(keys=("g", "k")) == "RowIdentityUnusable"
    moved = delta.refresh(pr, d, old, steps=steps, env={"p": 2})
    assert sorted(map(tuple, delta.result(moved, old).collect())) == sorted(map(tuple, run(spark, steps, old, env={"p": 2}).collect()))
    classes = lambda *ss: [c for c, _ in delta.plan(ss)]
    fit = S.Fit("v", (("x", col("k")),))
    assert classes(S.Filter(col("v") > 1), fit) == ["PropagateRows", "MaintainFits"] and delta.plan((fit, S.Limit(1)))[0] == ("FallBack", "AggregateStepNotLast: Fit")
    assert delta.plan((S.Join("left", DEPTS, (("g", "dept"),)),))[0] == ("FallBack", "JoinNotRowPreserving: left") and delta.plan((S.Distinct(),))[0] == ("FallBack", "StepNotRowLocal: Distinct")


def test_follow_goes_on_after_a_restart(spark, tmp_path):
    """Batches with several changes of a key; a query that ends and starts again; stored states; deleted snapshots."""
    import os

    schema, at = "k int, g string, v int", {"n": 0}
    versions = [spark.createDataFrame(rows, schema) for rows in (
        [(1, "a", 1), (2, "b", 2)], [(1, "a", 5), (2, "b", 2), (3, "b", 7)], [(1, "a", 5), (3, "b", 9), (4, "c", 1)], [(3, "b", 9), (4, "c", 2)],
    )]
    changes = [[(1, "changed"), (3, "transient"), (3, "added")], [(2, "removed"), (3, "changed"), (4, "added"), (5, "transient")], [(1, "removed"), (4, "changed")]]
    steps = (S.GroupBy(("g",), (S.Agg("t", "sum", "v"), S.Agg("n", "count", "v"))),)
    pr = delta.prime(versions[0], steps, ("k",), str(tmp_path / "snap"))
    seen = {}

    def on_result(state, batch_id):
        seen.setdefault(batch_id, []).append(sorted(map(tuple, delta.result(state, versions[at["n"]]).collect())))

    def step(n):
        at["n"] = n
        spark.createDataFrame(changes[n - 1], "k int, change string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, change string").parquet(str(tmp_path / "in"))
        # Every batch is a query of its own: it starts from the stored state.
        w = delta.follow(stream, pr, lambda: versions[at["n"]], on_result, checkpoint=str(tmp_path / "check"))
        try:
            w.processAllAvailable()
        finally:
            w.stop()

    for n in (1, 2, 3):
        step(n)
        want = sorted(map(tuple, run(spark, steps, versions[n]).collect()))
        assert seen[n - 1] == [want]
    assert sorted(n for n in os.listdir(tmp_path / "check" / "quernix-state") if n.isdigit()) == ["1", "2"]
    assert len(os.listdir(tmp_path / "snap")) <= 2 + 2 * 2


def test_column_ops(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, b int").coalesce(1)
    O = column_ops  # noqa: E741, N806
    ops = [O.SetCell("b", 1, 99), O.SetCell("b", 0, 7), O.InsertColumn(1, "m", "decimal(4,1)", (Decimal("1.5"), None, Decimal("2.5"))), O.SetColumn("a", (4, 5, 6)), O.AppendRows(((7, None, 70),)), O.ApplyTransform(S.Filter(col("a") > 4))]
    out = [tuple(r) for r in O.table(O.apply_all(t, ops)).collect()]
    assert out == [(5, None, 99), (6, Decimal("2.5"), 30), (7, None, 70)]
    for op in ops[:4]:
        if isinstance(op, O.SetColumn):
            continue
        back = O.apply(O.apply(t, op), O.invert(t, op))
        assert O.table(back).collect() == t.collect()
    assert O.to_ops(t, t.withColumn("b", F.when(F.col("a") == 2, 5).otherwise(F.col("b")))) == [O.SetCell("b", 1, 5)]
    assert not O.can_apply(t, O.SetCell("b", 3, 1)) and not O.can_apply(t, O.RemoveColumn("z"))
    log = O.log([ops[0], ops[5]])
    assert [tuple(r) for r in O.table(O.replay(t, log)).collect()] == []
    with pytest.raises(X.EditRejected):
        O.replay(t, [(*log[0][:3], "x"), log[1]])
    with pytest.raises(X.EditRejected):
        O.invert(t, ops[4])
    assert O.delta_of(ops[:2], 3) == [(0, "changed"), (1, "changed")] and O.delta_of(ops, 3) is None


def test_registry_and_tree(spark):
    s = {"a": Field("int"), "b": Field("float")}
    steps = (S.Filter(col("a") > param("p")), S.Derive("c", col("b") * 2.0))
    q = registry.PipelineQuery("q", "t", steps, {"p": "int"}, {"t": s}, tuple((s | {"c": Field("float")}).items()))
    r = registry.Registry(spark)
    r.register(q)
    df = spark.createDataFrame([(1, 1.0), (3, 2.0)], "a int, b double")
    assert [tuple(x) for x in r.dispatch("q", {"p": 2}, lambda n: df).collect()] == [(3, 2.0, 4.0)]
    assert registry.decode(registry.encode(q)) == q and r.enumerate() == ["q"] and r.restrict(["q"]).enumerate() == ["q"]
    for bad in (lambda: r.dispatch("z", {}, None), lambda: r.dispatch("q", {}, None), lambda: r.dispatch("q", {"p": "x"}, None), lambda: r.register(q)):
        with pytest.raises(X.Refusal):
            bad()
    t = tree.lift(steps)
    assert tree.lower(t) == steps and tree.lift(steps) == t and tree.footprint(t) == {"a", "b"}
    u = tree.apply(t, ("insertAfter", t.nodes[0].id, S.Limit(5)))
    assert tree.lower(tree.apply(u, ("remove", u.nodes[1].id))) == steps and tree.pipeline_hash(u) != tree.pipeline_hash(t)
    assert tree.content_address(u, u.nodes[0].id) == tree.content_address(t, t.nodes[0].id)
    with pytest.raises(X.EditRejected):
        tree.apply(tree.lift((S.Derive("c", col("b")), S.Derive("d", col("c")))), ("remove", tree.lift((S.Derive("c", col("b")),)).nodes[0].id), spark, s)


def test_prepared(spark):
    p = tables.prepare(spark.createDataFrame([(i, i % 2) for i in range(10)], "a int, b int"))
    out = p.run_many({"n": (S.GroupBy(("b",), (S.Agg("n", "count", "a"),)),), "f": (S.Filter(col("a") > 5),)})
    assert out["n"].df.count() == 2 and out["f"].df.count() == 4
    with pytest.raises(X.ArityError):
        tables.from_rows(spark, (("a", "int"),), [(1, 2)])
    p.release()


def test_plans_stay_in_the_jvm(spark):
    from quernix.plans import catalogue
    from tests.conftest import SF

    for name in ("flagship_by_month", "group_all_aggs", "join_three_way", "window_rollingMean", "topn_offset", "pivot_sum"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan or name == "topn_offset"
    plan = catalogue.QUERIES["filter_cmp"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_comment" not in plan
    assert "TakeOrdered" in catalogue.QUERIES["topn_offset"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(200).selectExpr("CAST(id AS INT) AS a", "CAST(id % 7 AS INT) AS b")
    steps = (S.GroupBy(("b",), (S.Agg("f", "first", "a"), S.Agg("l", "last", "a"))), S.Sort((("f", "asc"),)))
    one_, many = (run(spark, steps, df.coalesce(1), ordered=True).collect(), run(spark, steps, df.repartitionByRange(7, "a"), ordered=True).collect())
    assert one_ == many


def test_laws(spark):
    from quernix.plans import laws

    assert len(laws.LAWS) >= 13
    assert [x for x in laws.run_laws(spark, 7, 2) if x[1]] == []
    laws.LAWS["broken"] = lambda spark, r: "always"
    try:
        assert laws.run_laws(spark, 1, 1, ["broken"]) == [("broken", "always")]
    finally:
        del laws.LAWS["broken"]


def test_law_vectors(spark, tmp_path):
    from quernix.plans import laws

    path = str(tmp_path / "vectors.jsonl")
    laws.write_vectors(spark, path, 3, 10)
    lines = (tmp_path / "vectors.jsonl").read_text().splitlines()
    assert len(lines) == 10 and laws.check_vectors(spark, path) == [] and lines == laws.vectors(spark, 3, 10)
    v = json.loads(lines[0])
    (tmp_path / "other.jsonl").write_text("\n".join([json.dumps(v | {"hash": "sha256:0"}), lines[1][:-1], json.dumps(v | {"answer": v["table"]}), lines[2]]))
    wrong = laws.check_vectors(spark, str(tmp_path / "other.jsonl"))
    assert [w.split(":")[0] for w in wrong] == ["line 0", "line 1", "line 2"]


def test_edits_of_a_held_table(spark):
    O = column_ops  # noqa: E741, N806
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, b int").coalesce(1)
    held = O.edit(t)
    ops = [O.SetCell("b", 1, 99), O.AppendRows(((7, None),)), O.SetColumn("a", (4, 5, 6, 8))]
    after = held.apply(ops)
    assert after.table().collect() == O.table(O.apply_all(t, ops)).collect() and held.table().collect() == t.collect()
    assert held.delta(ops[:2]) == [(1, "changed"), (3, "added")] and held.delta(ops) is None
    back = held.invert(ops[0])
    assert held.apply([ops[0]]).apply([back]).table().collect() == t.collect()
    p = after.prepared()
    assert [tuple(r) for r in p.run((S.Filter(col("b") > 20),)).collect()] == [(5, 99), (6, 30)]
    for x in (held, after, p):
        x.release()
    with pytest.raises(X.EditRejected):
        held.apply([O.RemoveColumn("z")])
