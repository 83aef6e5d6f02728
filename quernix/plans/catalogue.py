"""Every query of the engine over the driver's tables, and its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernix.functions import expr as E
from quernix.functions.expr import Call, FnDef, Interpolate, Now, Quotient, Rounded, case, coalesce, col, fn, lit, param
from quernix.plans import steps as S
from quernix.plans.engine import run
from quernix.sources.tables import parquet

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def pipeline(name: str, table: str, steps, sql: str | None = None, **kw) -> None:
    """Registers a pipeline over one table; the tables its sources name are read beside it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = {table, *S.sources_of(steps)}
        ts = parquet(spark, sf_dir, *names)
        return run(spark, steps, ts[table], tables=ts, **kw)

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def agg(name: str, f: str, of: str) -> S.Agg:
    return S.Agg(name, f, of)


def project(*names: str) -> S.Project:
    return S.Project(tuple((n, n) for n in names))


def rounded(name: str, digits: int = 4) -> S.Derive:
    """Float results are compared at a few digits: sums reassociate."""
    return S.Derive(name, fn("round", col(name) * float(10**digits)) / float(10**digits))



def r4(x: str) -> str:
    return f"(round(({x}) * 10000.0) / 10000.0)"


_AMOUNT = col("l_extendedprice") * (lit(1) - col("l_discount"))
_MONTH = fn("datePart", "month", col("day"))
_LINE = (S.Derive("day", col("l_shipdate").cast("date")), S.Derive("amount", _AMOUNT))

pipeline(
    "flagship_by_month",
    "lineitem",
    (
        S.Filter((col("l_shipdate") >= lit(dt.datetime(1994, 1, 1))) & (col("l_shipdate") < lit(dt.datetime(2030, 1, 1)))),
        *_LINE,
        S.Derive("month", _MONTH),
        S.GroupBy(("month",), (agg("total", "sum", "amount"), agg("n", "count", "amount"))),
        S.Derive("total", fn("round", col("total") * 100.0) / 100.0),
        S.Sort((("month", "asc"),)),
    ),
    "SELECT CAST(month(l_shipdate) AS INT) AS month, round(sum(l_extendedprice * (1 - l_discount)) * 100) / 100 AS total, CAST(count(*) AS INT) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '2030-01-01' GROUP BY 1",
)

# Row-local

pipeline("filter_cmp", "lineitem", (S.Filter((col("l_quantity") >= 24.0) & (col("l_discount") < 0.05)), project("l_orderkey", "l_linenumber", "l_quantity")), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 24 AND l_discount < 0.05")
pipeline("filter_kleene", "orders", (S.Derive("p", case((col("o_orderstatus").eq("P"), lit(None)), otherwise=col("o_totalprice"))), S.Filter(~(col("p") > 1000.0) | col("p").is_null()), project("o_orderkey")), "SELECT o_orderkey FROM orders WHERE NOT ((CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END) > 1000) OR (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END) IS NULL")
pipeline("filter_inlist_null", "orders", (S.Filter(~col("o_orderpriority").is_in("1-URGENT", "5-LOW")), project("o_orderkey", "o_orderpriority")), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
pipeline("filter_in_param", "orders", (S.Filter(E.In(col("o_orderstatus"), (), "wanted")), S.GroupBy(("o_orderstatus",), (agg("n", "count", "o_orderkey"),))), "SELECT o_orderstatus, CAST(count(*) AS INT) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1", env={"wanted": ["F", "O"]})
pipeline("project_rename", "nation", (S.Project((("n_name", "nation"), ("n_regionkey", "region"))),), "SELECT n_name AS nation, n_regionkey AS region FROM nation")
pipeline("derive_arith", "lineitem", (S.Derive("net", _AMOUNT), S.Derive("gross", col("net") * (lit(1) + col("l_tax"))), S.Derive("odd", col("l_linenumber") % 2), project("l_orderkey", "l_linenumber", "net", "gross", "odd"), rounded("net"), rounded("gross")), f"SELECT l_orderkey, l_linenumber, {r4('l_extendedprice * (1 - l_discount)')} AS net, {r4('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS gross, l_linenumber % 2 AS odd FROM lineitem")
pipeline("derive_div_zero_null", "lineitem", (S.Derive("ratio", col("l_quantity") / col("l_discount")), S.Derive("rest", col("l_linenumber") % (col("l_linenumber") - 1)), project("l_orderkey", "l_linenumber", "ratio", "rest"), rounded("ratio")), f"SELECT l_orderkey, l_linenumber, {r4('l_quantity / nullif(l_discount, 0)')} AS ratio, l_linenumber % nullif(l_linenumber - 1, 0) AS rest FROM lineitem")
pipeline("derive_replace", "part", (S.Derive("p_size", col("p_size") * 2), project("p_partkey", "p_size")), "SELECT p_partkey, p_size * 2 AS p_size FROM part")
pipeline("case_bands", "orders", (S.Derive("band", case((col("o_totalprice") < 1000.0, "low"), (col("o_totalprice") < 10000.0, "mid"), otherwise="high")), S.GroupBy(("band",), (agg("n", "count", "o_orderkey"),))), "SELECT CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 10000 THEN 'mid' ELSE 'high' END AS band, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1")
pipeline("coalesce_chain", "documents", (S.Derive("where", coalesce(col("lang"), col("source"), "none")), S.GroupBy(("where",), (agg("n", "count", "doc_id"),))), "SELECT coalesce(lang, source, 'none') AS \"where\", CAST(count(doc_id) AS INT) AS n FROM documents GROUP BY 1")
pipeline("filter_now", "orders", (S.Filter(col("o_orderdate").cast("date") < Now("date")), S.GroupBy((), (agg("n", "count", "o_orderkey"),))), "SELECT CAST(count(*) AS INT) AS n FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-06-01' HAVING count(*) > 0", clock={"date": dt.date(1996, 6, 1)})

# Scalars

pipeline("fn_string", "part", (S.Derive("up", fn("upper", col("p_name"))), S.Derive("low", fn("lower", col("p_brand"))), S.Derive("n", fn("length", col("p_type"))), S.Derive("has", col("p_name").contains("e")), S.Derive("starts", col("p_brand").startswith("Brand#1")), S.Derive("ends", col("p_type").endswith("L")), project("p_partkey", "up", "low", "n", "has", "starts", "ends")), "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, CAST(length(p_type) AS INT) AS n, contains(p_name, 'e') AS has, starts_with(p_brand, 'Brand#1') AS starts, ends_with(p_type, 'L') AS ends FROM part")
pipeline("fn_substr_indexof", "part", (S.Derive("s", fn("substr", col("p_name"), 1, 3)), S.Derive("at", fn("indexOf", col("p_brand"), "#")), S.Derive("none", fn("indexOf", col("p_brand"), "zzz")), project("p_partkey", "s", "at", "none")), "SELECT p_partkey, substring(p_name, 2, 3) AS s, CAST(instr(p_brand, '#') - 1 AS INT) AS \"at\", CAST(-1 AS INT) AS \"none\" FROM part")
pipeline("fn_concat", "nation", (S.Derive("s", fn("concat", col("n_name"), ":", col("n_regionkey"), "/", lit(1.5))), project("n_nationkey", "s")), "SELECT n_nationkey, n_name || ':' || n_regionkey || '/1.5' AS s FROM nation")
pipeline("fn_replace_trim", "part", (S.Derive("r", fn("replace", col("p_name"), "a", "__")), S.Derive("t", fn("trim", fn("concat", " \t", col("p_brand"), "\r\n "))), project("p_partkey", "r", "t")), "SELECT p_partkey, replace(p_name, 'a', '__') AS r, p_brand AS t FROM part")
pipeline("fn_round_floor_ceil", "customer", (S.Derive("r", fn("round", col("c_acctbal"))), S.Derive("f", fn("floor", col("c_acctbal"))), S.Derive("c", fn("ceil", col("c_acctbal"))), S.Derive("a", fn("abs", col("c_acctbal"))), S.Derive("q", fn("sqrt", col("c_acctbal"))), project("c_custkey", "r", "f", "c", "a", "q"), rounded("q")), f"SELECT c_custkey, round(c_acctbal) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, abs(c_acctbal) AS a, CASE WHEN c_acctbal >= 0 THEN {r4('sqrt(CASE WHEN c_acctbal >= 0 THEN c_acctbal END)')} END AS q FROM customer")
pipeline("fn_floor_ceil_large", "customer", (S.Derive("x", col("c_acctbal") * case((col("c_nationkey") < 5, 1e300), (col("c_nationkey") < 10, 1e15), (col("c_nationkey") < 15, 1e-3), otherwise=1.0)), S.Derive("f", fn("floor", col("x"))), S.Derive("c", fn("ceil", col("x"))), project("c_custkey", "f", "c")), "SELECT c_custkey, floor(x) + 0.0 AS f, ceil(x) + 0.0 AS c FROM (SELECT c_custkey, c_acctbal * CASE WHEN c_nationkey < 5 THEN 1e300 WHEN c_nationkey < 10 THEN 1e15 WHEN c_nationkey < 15 THEN 1e-3 ELSE 1.0 END AS x FROM customer)")
pipeline("fn_pow_exp_ln", "part", (S.Derive("p", fn("pow", col("p_size"), 2)), S.Derive("h", fn("pow", col("p_retailprice"), 0.5)), S.Derive("e", fn("exp", col("p_size") / 50.0)), S.Derive("l", fn("ln", col("p_retailprice"))), S.Derive("g", fn("log10", col("p_size") - 1)), project("p_partkey", "p", "h", "e", "l", "g"), *map(rounded, "helg")), f"SELECT p_partkey, p_size * p_size AS p, {r4('sqrt(p_retailprice)')} AS h, {r4('exp(p_size / 50.0::DOUBLE)')} AS e, {r4('ln(p_retailprice)')} AS l, CASE WHEN p_size > 1 THEN {r4('log10(CASE WHEN p_size > 1 THEN p_size - 1 END)')} END AS g FROM part")
pipeline("fn_least_greatest_null", "documents", (S.Derive("lo", fn("least", col("lang"), col("source"))), S.Derive("hi", fn("greatest", col("lang"), col("source"))), project("doc_id", "lo", "hi")), "SELECT doc_id, CASE WHEN lang IS NOT NULL AND source IS NOT NULL THEN least(lang, source) END AS lo, CASE WHEN lang IS NOT NULL AND source IS NOT NULL THEN greatest(lang, source) END AS hi FROM documents")
pipeline("fn_datepart", "orders", tuple(S.Derive(p, fn("datePart", p, col("o_orderdate"))) for p in ("year", "month", "day")) + (S.GroupBy(("year", "month", "day"), (agg("n", "count", "o_orderkey"),)),), "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1, 2, 3")
pipeline("fn_datediff", "orders", (S.Derive("d", fn("dateDiffDays", lit("1995-03-15"), col("o_orderdate"))), project("o_orderkey", "d")), "SELECT o_orderkey, CAST(date_diff('day', DATE '1995-03-15', CAST(o_orderdate AS DATE)) AS INT) AS d FROM orders")
pipeline("cast_matrix", "lineitem", (S.Derive("i", col("l_extendedprice").cast("int")), S.Derive("s", col("l_linenumber").cast("string")), S.Derive("f", col("l_linenumber").cast("float")), S.Derive("d", col("l_shipdate").cast("date")), S.Derive("b", (col("l_linenumber") > 2).cast("string")), project("l_orderkey", "l_linenumber", "i", "s", "f", "d", "b")), "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS INT) AS i, CAST(l_linenumber AS VARCHAR) AS s, CAST(l_linenumber AS DOUBLE) AS f, CAST(l_shipdate AS DATE) AS d, CAST(l_linenumber > 2 AS VARCHAR) AS b FROM lineitem")

# Aggregates

_ALL = tuple(agg(f, f, "l_quantity") for f in ("sum", "mean", "min", "max", "count", "countDistinct", "median", "stddev"))
pipeline("group_all_aggs", "lineitem", (S.GroupBy(("l_returnflag",), _ALL), *map(rounded, ("sum", "mean", "stddev"))), f"SELECT l_returnflag, {r4('sum(l_quantity)')} AS sum, {r4('avg(l_quantity)')} AS mean, min(l_quantity) AS min, max(l_quantity) AS max, CAST(count(l_quantity) AS INT) AS count, CAST(count(DISTINCT l_quantity) AS INT) AS \"countDistinct\", median(l_quantity) AS median, {r4('stddev_samp(l_quantity)')} AS stddev FROM lineitem GROUP BY 1")
pipeline("group_multi_key", "lineitem", (S.GroupBy(("l_returnflag", "l_linestatus"), (agg("price", "sum", "l_extendedprice"), agg("lines", "sum", "l_linenumber"), agg("n", "count", "l_orderkey"))), S.Derive("price", fn("round", col("price")))), "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice)) AS price, CAST(sum(l_linenumber) AS INT) AS lines, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1, 2")
pipeline("group_count_distinct", "orders", (S.GroupBy(("o_orderpriority",), (agg("customers", "countDistinct", "o_custkey"),)),), "SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS INT) AS customers FROM orders GROUP BY 1")
pipeline("group_median_stddev", "customer", (S.GroupBy(("c_mktsegment",), (agg("mid", "median", "c_acctbal"), agg("sd", "stddev", "c_acctbal"))), rounded("mid"), rounded("sd")), f"SELECT c_mktsegment, {r4('median(c_acctbal)')} AS mid, {r4('stddev_samp(c_acctbal)')} AS sd FROM customer GROUP BY 1")
pipeline("group_first_last", "events", (S.Sort((("event_id", "asc"),)), S.GroupBy(("event_type",), (agg("first_user", "first", "user_id"), agg("last_user", "last", "user_id")))), "SELECT event_type, arg_min(user_id, event_id) AS first_user, arg_max(user_id, event_id) AS last_user FROM events GROUP BY 1")
pipeline("having", "orders", (S.GroupBy(("o_custkey",), (agg("n", "count", "o_orderkey"),)), S.Filter(col("n") > param("least"))), "SELECT o_custkey, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", env={"least": 12})
pipeline("group_empty", "orders", (S.Filter(col("o_totalprice") < -1.0), S.GroupBy((), (agg("n", "count", "o_orderkey"),))), "SELECT CAST(count(*) AS INT) AS n FROM orders WHERE o_totalprice < -1 HAVING count(*) > 0")

# Joins

_C = S.Ref("customer")
_ON = (("o_custkey", "c_custkey"),)
_ODD = S.Filter((col("o_custkey") % 3).ne(0))
_SOME = "(SELECT * FROM orders WHERE o_custkey % 3 <> 0)"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    pipeline(f"join_{_how}", "orders", (_ODD, S.Join(_how, _C, _ON), S.Filter(col("c_acctbal").is_null() | (col("c_acctbal") > 0.0)), project("o_orderkey", "o_custkey", "c_custkey", "c_name")), f"SELECT o_orderkey, o_custkey, c_custkey, c_name FROM {_SOME} o {_sql} customer c ON o_custkey = c_custkey WHERE c_acctbal IS NULL OR c_acctbal > 0")
_RICH = S.Join("semi", S.Ref("orders"), (("c_custkey", "o_custkey"),))
pipeline("join_semi", "customer", (_RICH, project("c_custkey", "c_name")), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
pipeline("join_anti", "customer", (S.Join("anti", S.Ref("orders"), (("c_custkey", "o_custkey"),)), project("c_custkey", "c_name")), "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
pipeline("join_two_keys", "lineitem", (S.Join("inner", S.Ref("lineitem"), (("l_orderkey", "l_orderkey"), ("l_suppkey", "l_suppkey"))), S.GroupBy((), (agg("n", "count", "l_orderkey_right"), agg("q", "sum", "l_quantity_right")))), "SELECT CAST(count(*) AS INT) AS n, sum(b.l_quantity) AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
pipeline("join_three_way", "orders", (S.Join("inner", _C, _ON), S.Join("inner", S.Ref("nation"), (("c_nationkey", "n_nationkey"),)), S.GroupBy(("n_name",), (agg("total", "sum", "o_totalprice"),)), S.Derive("total", fn("round", col("total")))), "SELECT n_name, round(sum(o_totalprice)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
pipeline("join_collision_names", "nation", (S.Join("inner", S.Ref("nation"), (("n_regionkey", "n_nationkey"),)), S.Join("inner", S.Ref("nation"), (("n_regionkey_right", "n_nationkey"),))), "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right, b.n_regionkey AS n_regionkey_right, c.n_nationkey AS n_nationkey_right_2, c.n_name AS n_name_right_2, c.n_regionkey AS n_regionkey_right_2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey JOIN nation c ON b.n_regionkey = c.n_nationkey")
pipeline("join_mixed_types", "nation", (S.Derive("k", col("n_regionkey").cast("float")), S.Join("inner", S.Ref("region"), (("k", "r_regionkey"),)), project("n_name", "r_name")), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")

# Windows

_OVER = "PARTITION BY user_id ORDER BY ts, event_id"
_RANK = "PARTITION BY user_id ORDER BY event_type NULLS LAST"
for _fn, _sql, _kind in (
    ("rowNumber", f"row_number() OVER ({_OVER})", "INT"), ("ntile", f"ntile(4) OVER ({_OVER})", "INT"),
    ("lag", f"lag(value) OVER ({_OVER})", None), ("lead", f"lead(value) OVER ({_OVER})", None),
    ("cumulSum", r4(f"coalesce(sum(value) OVER ({_OVER} ROWS UNBOUNDED PRECEDING), 0)"), None),
    ("cumulMax", f"max(value) OVER ({_OVER} ROWS UNBOUNDED PRECEDING)", None), ("cumulMin", f"min(value) OVER ({_OVER} ROWS UNBOUNDED PRECEDING)", None),
    ("rollingSum", r4(f"sum(value) OVER ({_OVER} ROWS 2 PRECEDING)"), None), ("rollingMean", r4(f"avg(value) OVER ({_OVER} ROWS 2 PRECEDING)"), None),
):
    _w = S.Window(_fn, "w", None if _kind else "value", ("user_id",), (("ts", "asc"), ("event_id", "asc")), 4 if _fn == "ntile" else None)
    _more = (rounded("w"),) if _fn in ("cumulSum", "rollingSum", "rollingMean") else ()
    pipeline(f"window_{_fn}", "events", (_w, *_more, project("event_id", "w")), f"SELECT event_id, {f'CAST({_sql} AS {_kind})' if _kind else _sql} AS w FROM events")
for _fn, _sql in (("rank", "dense_rank"), ("denseRank", "dense_rank"), ("competitionRank", "rank")):
    pipeline(f"window_{_fn}", "events", (S.Window(_fn, "w", None, ("user_id",), (("event_type", "asc"),)), project("event_id", "w")), f"SELECT event_id, CAST({_sql}() OVER ({_RANK}) AS INT) AS w FROM events")

# Reshape, order, sets

_FLAGS = "sum(CASE WHEN l_linestatus = '{0}' THEN l_quantity END) AS \"{0}\""
pipeline("pivot_sum", "lineitem", (S.Pivot(("l_returnflag",), "l_linestatus", "l_quantity", "sum"),), f"SELECT l_returnflag, {_FLAGS.format('F')}, {_FLAGS.format('O')} FROM lineitem GROUP BY 1")
pipeline("pivot_count_zero", "orders", (S.Filter((col("o_custkey") % 50).eq(1)), S.Pivot(("o_custkey",), "o_orderstatus", "o_orderkey", "count")), "SELECT o_custkey, " + ", ".join(f"CAST(count(CASE WHEN o_orderstatus = '{x}' THEN 1 END) AS INT) AS \"{x}\"" for x in "FOP") + " FROM orders WHERE o_custkey % 50 = 1 GROUP BY 1")
pipeline("unpivot_measures", "lineitem", (S.Unpivot(("l_orderkey", "l_linenumber"), ("l_quantity", "l_tax")),), "SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
pipeline("sort_nulls_last", "documents", (S.Sort((("lang", "desc"), ("doc_id", "asc"))), S.Limit(50), project("doc_id", "lang")), "SELECT doc_id, lang FROM documents ORDER BY lang DESC NULLS LAST, doc_id LIMIT 50")
pipeline("topn_offset", "orders", (S.Sort(((param("key"), "desc"), ("o_orderkey", "asc"))), S.Limit(param("n"), 5), project("o_orderkey", "o_totalprice")), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", env={"key": "o_totalprice", "n": 10})
pipeline("distinct_rows", "lineitem", (project("l_returnflag", "l_linestatus", "l_linenumber"), S.Distinct()), "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_KEYS = S.Project((("c_nationkey", "k"),))
_SUPP = S.Embedded((("k", "int"),), tuple((i,) for i in (1, 3, 3, 5, 7, None)))
_VALS = "(VALUES (1), (3), (3), (5), (7), (NULL)) AS v(k)"
pipeline("union_widen", "customer", (_KEYS, S.Union(S.Embedded((("k", "float"),), ((0.5,), (None,)))), S.GroupBy(("k",), (agg("n", "count", "k"),))), "SELECT k, CAST(count(k) AS INT) AS n FROM (SELECT CAST(c_nationkey AS DOUBLE) AS k FROM customer UNION ALL VALUES (0.5::DOUBLE), (NULL)) GROUP BY 1")
pipeline("intersect_bag", "customer", (_KEYS, S.Intersect(_SUPP)), f"SELECT c_nationkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM {_VALS} WHERE v.k IS NOT DISTINCT FROM c.c_nationkey)")
pipeline("except_bag", "customer", (_KEYS, S.Except(_SUPP)), f"SELECT c_nationkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {_VALS} WHERE v.k IS NOT DISTINCT FROM c.c_nationkey)")
pipeline("intersect_distinct", "customer", (_KEYS, S.Intersect(_SUPP), S.Distinct()), f"SELECT DISTINCT c_nationkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM {_VALS} WHERE v.k IS NOT DISTINCT FROM c.c_nationkey)")

# Decimals

_MONEY = S.Derive("m", col("l_extendedprice").cast("decimal(12,2)"))
pipeline("decimal_sum_exact", "lineitem", (_MONEY, S.GroupBy(("l_returnflag",), (agg("total", "sum", "m"),))), "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total FROM lineitem GROUP BY 1")
pipeline("decimal_round_modes", "lineitem", (_MONEY, S.Derive("up", Rounded(col("m"), 1, "halfUp")), S.Derive("even", Rounded(col("m"), 1, "halfEven")), S.Derive("low", Rounded(col("m"), 0, "floor")), S.Derive("high", Rounded(col("m"), 0, "ceiling")), project("l_orderkey", "l_linenumber", "up", "even", "low", "high")), "SELECT l_orderkey, l_linenumber, CAST(round(m, 1) AS DECIMAL(12,1)) AS up, CAST(CASE WHEN (CAST(m * 100 AS BIGINT) % 10) = 5 AND (CAST(trunc(m * 10) AS BIGINT) % 2) = 0 THEN trunc(m * 10) / 10 ELSE round(m, 1) END AS DECIMAL(12,1)) AS even, CAST(floor(m) AS DECIMAL(11,0)) AS low, CAST(ceil(m) AS DECIMAL(11,0)) AS high FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS m FROM lineitem)")
pipeline("decimal_quotient", "lineitem", (_MONEY, S.Derive("each", Quotient(col("m"), col("l_linenumber"), 2, "down")), project("l_orderkey", "l_linenumber", "each")), "SELECT l_orderkey, l_linenumber, CAST(CAST((CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) // l_linenumber) AS DECIMAL(36,0)) * 0.01 AS DECIMAL(38,2)) AS each FROM lineitem")

_MODES = ("halfEven", "halfUp", "halfDown", "up", "down", "ceiling", "floor")


def _quotient_sql(scale: int, mode: str) -> str:
    """(cents / 100) / n at a scale, by whole numbers of up to 38 digits; cents may be negative, n not."""
    n, d = f"(CAST(c AS HUGEINT) * {10**scale})", "(100 * CAST(l_linenumber AS HUGEINT))"
    q, r = f"(abs({n}) // {d})", f"(abs({n}) % {d})"
    over = {
        "up": f"{r} <> 0", "down": "false", "ceiling": f"{r} <> 0 AND c > 0", "floor": f"{r} <> 0 AND c < 0", "halfUp": f"2 * {r} >= {d}",
        "halfDown": f"2 * {r} > {d}", "halfEven": f"2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1)",
    }[mode]
    whole, shift = f"({q} + CASE WHEN {over} THEN 1 ELSE 0 END)", f"CAST({10**scale} AS HUGEINT)"
    part = f"rtrim(lpad(CAST({whole} % {shift} AS VARCHAR), {scale}, '0'), '0')"
    return f"CASE WHEN c < 0 AND {whole} <> 0 THEN '-' ELSE '' END || CAST({whole} // {shift} AS VARCHAR) || CASE WHEN {part} = '' THEN '' ELSE '.' || {part} END"


_SCALES = {f"q{s}": s for s in (8, 12, 20)} | {f"m{i}": 10 for i in range(len(_MODES))}
_CENTS = (_MONEY, S.Derive("m", case((col("l_linenumber").eq(2), lit(Decimal(0)) - col("m")), otherwise=col("m"))))
pipeline(
    "decimal_quotient_scales",
    "lineitem",
    (*_CENTS, *[S.Derive(n, Quotient(col("m"), col("l_linenumber"), s, "halfEven" if n[0] == "q" else _MODES[int(n[1:])])) for n, s in _SCALES.items()], *[S.Derive(n, fn("concat", col(n))) for n in _SCALES], project("l_orderkey", "l_linenumber", *_SCALES)),
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{_quotient_sql(s, 'halfEven' if n[0] == 'q' else _MODES[int(n[1:])])} AS {n}" for n, s in _SCALES.items())
    + " FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) * CASE WHEN l_linenumber = 2 THEN -1 ELSE 1 END AS c FROM lineitem)",
)

# Functions and curves

_TAXED = S.Define(FnDef("taxed", (("x", None), ("rate", lit(0.1))), E.Arg("x") * (lit(1.0) + E.Arg("rate"))))
pipeline("define_macro", "orders", (_TAXED, S.Derive("a", Call("taxed", (("x", col("o_totalprice")),))), S.Derive("b", Call("taxed", (("rate", lit(0.5)), ("x", col("o_totalprice"))))), project("o_orderkey", "a", "b"), rounded("a"), rounded("b")), f"SELECT o_orderkey, {r4('o_totalprice * 1.1::DOUBLE')} AS a, {r4('o_totalprice * 1.5::DOUBLE')} AS b FROM orders")
_KNOTS = ((0.0, 0.0), (10.0, 5.0), (30.0, 6.0))
pipeline("interp_linear", "lineitem", (S.Derive("y", Interpolate(col("l_quantity"), _KNOTS)), project("l_orderkey", "l_linenumber", "y"), rounded("y")), f"SELECT l_orderkey, l_linenumber, {r4('CASE WHEN l_quantity < 10 THEN 5.0::DOUBLE * (l_quantity / 10.0::DOUBLE) WHEN l_quantity < 30 THEN 5.0::DOUBLE + 1.0::DOUBLE * ((l_quantity - 10) / 20.0::DOUBLE) ELSE 6.0::DOUBLE END')} AS y FROM lineitem")
pipeline("interp_step", "lineitem", (S.Derive("y", Interpolate(col("l_quantity"), _KNOTS, "step", "null")), project("l_orderkey", "l_linenumber", "y")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 0.0::DOUBLE WHEN l_quantity < 30 THEN 5.0::DOUBLE WHEN l_quantity = 30 THEN 6.0::DOUBLE END AS y FROM lineitem")
# Slopes at the knots by Fritsch and Carlson: secants 0.5 and 0.05; ends 0.5 and 0.05, between them the mean 0.275, drawn in where a^2 + b^2 > 9.
_BOTH = 3 / (((0.275 / 0.05) ** 2 + 1) ** 0.5)
_SLOPES = (0.5, _BOTH * 0.275, _BOTH * 0.05)


def _hermite(x0: float, x1: float, y0: float, y1: float, m0: float, m1: float) -> str:
    t, h = f"((l_quantity - {x0}::DOUBLE) / {x1 - x0}::DOUBLE)", x1 - x0
    return f"({y0}::DOUBLE * (2 * {t} ** 3 - 3 * {t} ** 2 + 1) + {h * m0!r}::DOUBLE * ({t} ** 3 - 2 * {t} ** 2 + {t}) + {y1}::DOUBLE * (3 * {t} ** 2 - 2 * {t} ** 3) + {h * m1!r}::DOUBLE * ({t} ** 3 - {t} ** 2))"


_CUBIC = f"CASE WHEN l_quantity < 10 THEN {_hermite(0, 10, 0, 5, _SLOPES[0], _SLOPES[1])} WHEN l_quantity < 30 THEN {_hermite(10, 30, 5, 6, _SLOPES[1], _SLOPES[2])} ELSE 6.0::DOUBLE END"
pipeline("interp_cubic", "lineitem", (S.Derive("y", Interpolate(col("l_quantity"), _KNOTS, "monotoneCubic")), project("l_orderkey", "l_linenumber", "y"), rounded("y")), f"SELECT l_orderkey, l_linenumber, {r4(_CUBIC)} AS y FROM lineitem")

# Modelling

_OLS = S.Fit("l_extendedprice", (("q", col("l_quantity")),), group_by=("l_returnflag",))
pipeline("fit_ols_by_group", "lineitem", (_OLS, project("l_returnflag", "term", "estimate"), rounded("estimate", 3)), "SELECT l_returnflag, '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity) * 1000.0) / 1000.0 AS estimate FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'q', round(regr_slope(l_extendedprice, l_quantity) * 1000.0) / 1000.0 FROM lineitem GROUP BY 1")
pipeline("fit_ols_summary", "lineitem", (S.Fit("l_extendedprice", (("q", col("l_quantity")),), group_by=("l_returnflag",), output="summary"), project("l_returnflag", "n", "df", "r2"), rounded("r2")), f"SELECT l_returnflag, CAST(count(*) AS INT) AS n, CAST(count(*) - 2 AS INT) AS df, {r4('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY 1")
pipeline("predict_training", "lineitem", (S.Predict(_OLS, S.Ref("lineitem")), S.Derive("e", col("l_extendedprice") - col("predicted")), S.GroupBy(("l_returnflag",), (agg("mean_predicted", "mean", "predicted"),)), rounded("mean_predicted", 2)), "SELECT l_returnflag, round(avg(l_extendedprice) * 100.0) / 100.0 AS mean_predicted FROM lineitem GROUP BY 1")
pipeline("fit_residuals", "lineitem", (S.Fit("l_extendedprice", (("q", col("l_quantity")),), output="residuals"), S.GroupBy((), (agg("total", "sum", "residual"),)), S.Derive("total", fn("round", col("total")) + 0.0)), "SELECT CAST(0 AS DOUBLE) AS total")
pipeline("fit_logit", "lineitem", (S.Derive("late", case((col("l_linestatus").eq("F"), 1), otherwise=0)), S.Fit("late", (("q", col("l_quantity")), ("tax", col("l_tax"))), family="binomial")))


def _score(name: str, family: str, y: str, ps: tuple[str, ...], before: tuple = ()) -> None:
    """A canonical model's score equations: its means and the responses have the same totals, plain and times each predictor."""
    fit = S.Fit(y, tuple((p, col(p)) for p in ps), family=family, output="fitted")
    names = {"total": "fitted", **{f"total_{p}": f"t_{p}" for p in ps}}
    sums = S.GroupBy((), tuple(agg(n, "sum", c) for n, c in names.items()))
    steps = (*before, fit, *[S.Derive(f"t_{p}", col("fitted") * col(p)) for p in ps], sums, *[rounded(n, 2) for n in names])
    of = "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END" if before else y
    pipeline(name, "lineitem", steps, "SELECT " + ", ".join(f"round(sum({of} * {p}) * 100.0) / 100.0 AS {n}" for n, p in zip(names, ("1.0", *ps))) + " FROM lineitem")


_score("fit_logit_score", "binomial", "late", ("l_quantity", "l_tax"), (S.Derive("late", case((col("l_linestatus").eq("F"), 1), otherwise=0)),))
_score("fit_poisson_score", "poisson", "l_linenumber", ("l_discount",))
pipeline("fit_poisson_robust", "lineitem", (S.Fit("l_linenumber", (("d", col("l_discount")),), family="poisson", std_errors="hc3"),))
# Two clusters on a line, whichever cut they settle on: every row is in the cluster of the nearer mean, and no row is lost.
_TWO = S.KMeans((("bal", col("c_acctbal")),), 2, 7)
_ENDS = S.GroupBy(("cluster",), (agg("n", "count", "c_custkey"), agg("lo", "min", "c_acctbal"), agg("hi", "max", "c_acctbal"), agg("m", "mean", "c_acctbal")))
_CUT = S.GroupBy((), (agg("n", "sum", "n"), agg("lo", "min", "lo"), agg("hi", "max", "hi"), agg("hi_low", "min", "hi"), agg("lo_high", "max", "lo"), agg("m_low", "min", "m"), agg("m_high", "max", "m")))
_MID = (col("m_low") + col("m_high")) / 2.0
pipeline("kmeans_assign", "customer", (_TWO, _ENDS, _CUT, S.Derive("nearest", (col("hi_low") <= _MID) & (col("lo_high") >= _MID)), project("n", "lo", "hi", "nearest")), "SELECT CAST(count(*) AS INT) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, true AS nearest FROM customer")
pipeline("kmeans_centres", "customer", (S.KMeans((("bal", col("c_acctbal")),), 3, 7, output="centres"),))
pipeline("kmeans_summary", "customer", (S.KMeans((("bal", col("c_acctbal")),), 3, 7, group_by=("c_mktsegment",), standardise=True, output="summary"),))
pipeline("bootstrap_summary", "customer", (S.Bootstrap((agg("m", "mean", "c_acctbal"), agg("n", "count", "c_custkey")), 30, 7, group_by=("c_mktsegment",)),))
pipeline("bootstrap_estimate", "customer", (S.Bootstrap((agg("m", "mean", "c_acctbal"),), 10, 7, group_by=("c_mktsegment",)), project("c_mktsegment", "estimate"), rounded("estimate")), f"SELECT c_mktsegment, {r4('avg(c_acctbal)')} AS estimate FROM customer GROUP BY 1")

# Change sets and edits


def _edited(orders: DataFrame) -> DataFrame:
    """Every 17th order dropped, every 13th repriced, and one new."""
    new = orders.where("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.when(F.expr("o_orderkey % 13 = 0"), 1.0).otherwise(F.col("o_totalprice")))
    return new.unionByName(orders.orderBy("o_orderkey").limit(1).withColumn("o_orderkey", F.lit(-1).cast("long")))


_EDITED_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL (SELECT -1, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1))"


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM orders a FULL JOIN {_EDITED_SQL} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice")
def delta_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.streaming import delta

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return delta.diff(orders, _edited(orders), ("o_orderkey",))


@query(f"SELECT o_orderstatus, CAST(count(*) AS INT) AS n, round(sum(o_totalprice)) AS total FROM {_EDITED_SQL} WHERE o_custkey > 5 GROUP BY 1")
def refresh_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.sources.snapshots import folder
    from quernix.streaming import delta

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    new = _edited(orders)
    steps = (S.Filter(col("o_custkey") > 5), S.GroupBy(("o_orderstatus",), (agg("n", "count", "o_orderkey"), agg("total", "sum", "o_totalprice"))), S.Derive("total", fn("round", col("total"))))
    pr = delta.prime(orders, steps, ("o_orderkey",), folder(spark))
    return delta.result(delta.refresh(pr, delta.diff(orders, new, ("o_orderkey",)), new), new)


@query("SELECT n_nationkey, CASE WHEN rn = 3 THEN 'Atlantis' ELSE n_name END AS n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation) UNION ALL SELECT 99, 'New'")
def column_ops_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.streaming import column_ops as ops

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    log = ops.log([ops.SetCell("n_name", 3, "Atlantis"), ops.RemoveColumn("n_regionkey"), ops.AppendRows(((99, "New"),))])
    return ops.table(ops.replay(nation, log), ordered=False)


@query("SELECT o_orderstatus, CAST(count(*) AS INT) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def registry_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.functions.compile import Field, schema_of
    from quernix.plans.registry import PipelineQuery, Registry

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    steps = (S.Filter(col("o_totalprice") > param("least")), S.GroupBy(("o_orderstatus",), (agg("n", "count", "o_orderkey"),)))
    reg = Registry(spark)
    reg.register(PipelineQuery("by_status", "orders", steps, {"least": "float"}, {"orders": schema_of(orders.schema)}, (("o_orderstatus", Field("string")), ("n", Field("int")))))
    return reg.dispatch("by_status", {"least": 1000.0}, lambda n: orders)


@query("SELECT l_returnflag, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.plans import codec

    steps = (S.GroupBy(("l_returnflag",), (agg("n", "count", "l_orderkey"),)),)
    return run(spark, codec.decode(codec.encode(steps)), spark.read.parquet(f"{sf_dir}/lineitem.parquet"))

