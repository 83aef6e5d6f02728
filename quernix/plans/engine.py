"""Pipelines to lazy DataFrames: each step is checked against the schema so far, then becomes DataFrame operations.

Row order is part of some answers (first and last, windows, limits). Where a pipeline reads it, a hidden
column ``__ord`` carries it: monotone ids at the source, ``(left, right)`` after a join, the first
row of a group. A sort stays pending until something reads the order, so that a sort before a limit is a top-n and
a sort at the end is one range exchange. A window without partitions is cut into ranges of its order: every range is
scanned by itself and takes over what the ranges before it sum up to, so no task holds the table; the ranges are
written once, to the shared folder, as Spark would draw others when it computes them again.

Ids at the source rise within a file split; over several files they follow Spark's order of splits, so the first and
the last row of such a table are those of that order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernix.errors import AggError, ArityError, JoinError, TypeMismatch, UnknownColumn
from quernix.functions import units
from quernix.functions.compile import Field, Typed, compile_expr, is_decimal, numeric, precision, schema_of, spark_type, text, to, widen
from quernix.plans import steps as S

ORD = "__ord"


@dataclass(frozen=True)
class State:
    df: DataFrame
    schema: dict[str, Field]
    ordered: bool = False
    pending: tuple[Column, ...] = ()
    #: Only the schema is wanted.
    dry: bool = False


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def need(schema: dict[str, Field], *names: str) -> None:
    for n in names:
        if n not in schema:
            raise UnknownColumn(f"{n}; there are {', '.join(schema)}")


def unique(what: type, names) -> None:
    seen = set()
    for n in names:
        if n in seen:
            raise what(f"repeated output {n}")
        seen.add(n)


def typed(schema: dict[str, Field], name: str) -> Typed:
    need(schema, name)
    return Typed(q(name), schema[name].type, schema[name].unit)


def embedded(spark: SparkSession, src: S.Embedded) -> State:
    """A literal table. Ragged rows are refused."""
    for r in src.rows:
        if len(r) != len(src.schema):
            raise ArityError(f"a row of {len(r)} cells under {len(src.schema)} columns")
    schema = {c[0]: Field(c[1], c[2] if len(c) > 2 else None) for c in src.schema}
    ddl = ", ".join(f"`{n}` {spark_type(f.type)}" for n, f in schema.items())
    return State(spark.createDataFrame([tuple(r) for r in src.rows], ddl), schema)


def source(spark: SparkSession, src, tables: dict, ordered: bool) -> State:
    src = S.resolve(src, tables)
    st = embedded(spark, src) if isinstance(src, S.Embedded) else src if isinstance(src, State) else State(src, schema_of(src.schema))
    if isinstance(src, DataFrame):
        # Session-independent types: floats as double, small integers as int.
        casts = [q(f.name).cast(spark_type(st.schema[f.name].type)).alias(f.name) if st.schema[f.name].type != "opaque" and f.dataType.simpleString() != spark_type(st.schema[f.name].type) else q(f.name) for f in src.schema.fields]
        st = replace(st, df=src.select(*casts))
    return numbered(st) if ordered else st


def numbered(st: State) -> State:
    return st if st.ordered else replace(st, df=st.df.withColumn(ORD, F.monotonically_increasing_id()), ordered=True)


def settled(st: State) -> State:
    """A pending sort becomes row order: ids over range partitions rise in sort order."""
    if not st.pending:
        return st
    df = st.df.orderBy(*st.pending, *([ORD] if st.ordered else []))
    return replace(st, df=df.withColumn(ORD, F.monotonically_increasing_id()) if st.ordered else df, pending=())


def hidden(st: State) -> list[str]:
    return [ORD] if st.ordered else []


def sort_columns(schema: dict[str, Field], by) -> tuple[Column, ...]:
    out = []
    for k, d in by:
        k = S.slot(k)
        need(schema, k)
        if d not in ("asc", "desc"):
            raise TypeMismatch(f"no direction {d}")
        out.append(q(k).asc_nulls_last() if d == "asc" else q(k).desc_nulls_last())
    return tuple(out)


def aggregate(a: S.Agg, schema: dict[str, Field], ordered: bool, when: Column | None = None) -> tuple[Column, Field]:
    """An aggregate column (over the rows where ``when`` is true) and its type."""
    x = typed(schema, a.of)
    c = x.col if when is None else F.when(when, x.col)
    if a.fn == "count":
        return F.count(c).cast("int"), Field("int")
    if a.fn == "countDistinct":
        return F.count_distinct(c).cast("int"), Field("int")
    if a.fn in ("first", "last"):
        if not ordered:
            raise AggError(f"{a.fn} without an order")
        at = q(ORD) if when is None else F.when(when, q(ORD))
        pick = F.min_by if a.fn == "first" else F.max_by
        return pick(F.struct(x.col.alias("v")), at)["v"], Field(x.type, x.unit)
    if a.fn in ("min", "max"):
        if x.type == "opaque":
            raise AggError(f"{a.fn} of an opaque column")
        return getattr(F, a.fn)(c), Field(x.type, x.unit)
    if not numeric(x.type):
        raise AggError(f"{a.fn} of {x.type}")
    if a.fn == "sum":
        if is_decimal(x.type):
            t = f"decimal(38,{precision(x.type)[1]})"
            return F.sum(c).cast(t), Field(t, x.unit)
        # The wide sum is checked against the narrow type by the cast.
        return F.sum(c).cast(spark_type(x.type)), Field(x.type, x.unit)
    d = c.cast("double")
    return {"mean": F.avg, "median": F.median, "stddev": F.stddev_samp}[a.fn](d), Field("float", x.unit)


def group_by(st: State, s: S.GroupBy) -> State:
    need(st.schema, *s.keys)
    unique(AggError, [*s.keys, *(a.name for a in s.aggs)])
    st = settled(st)
    cols, schema = [], {k: st.schema[k] for k in s.keys}
    for a in s.aggs:
        c, f = aggregate(a, st.schema, st.ordered)
        cols.append(c.alias(a.name))
        schema[a.name] = f
    if st.ordered:
        cols.append(F.min(ORD).alias(ORD))
    # A constant key gives no row over no rows; a global aggregate would give one.
    keys = [q(k) for k in s.keys] or [F.lit(1).alias("__one")]
    g = st.df.groupBy(*keys).agg(*(cols or [F.count("*").alias("__n")]))
    return State(g.select(*[q(n) for n in schema], *hidden(st)), schema, st.ordered)


def joined_names(left, right) -> dict[str, str]:
    """Output names of the right columns: a collision gets _right, then _right_2 and so on."""
    out: dict[str, str] = {}
    used = set(left)
    for n in right:
        name, k = n, 1
        while name in used or (name != n and name in right):
            name = f"{n}_right" if k == 1 else f"{n}_right_{k}"
            k += 1
        used.add(name)
        out[n] = name
    return out


def join(st: State, s: S.Join, right: State) -> State:
    if s.how not in S.JOINS:
        raise JoinError(f"no join {s.how}; there are {', '.join(S.JOINS)}")
    if not s.on:
        raise JoinError("a join without keys")
    for a, _ in s.on:
        need(st.schema, a)
    for _, b in s.on:
        need(right.schema, b)
    st, right = settled(st), settled(right)
    keeps = s.how not in ("semi", "anti")
    names = joined_names(st.schema, right.schema) if keeps else {n: f"__r_{i}" for i, n in enumerate(right.schema)}
    used = list(right.schema) if keeps else list(dict.fromkeys(b for _, b in s.on))
    r = right.df.select(*[q(n).alias(names[n]) for n in used], *([F.col(ORD).alias("__rord")] if right.ordered and keeps else []))
    left = st.df.withColumnRenamed(ORD, "__lord") if st.ordered and keeps else st.df
    cond = None
    for a, b in s.on:
        x, y = typed(st.schema, a), right.schema[b]
        units.same("join", x.unit, y.unit)
        if is_decimal(x.type) != is_decimal(y.type):
            c = F.lit(False)  # a decimal only matches a decimal
        else:
            try:
                t = widen("join", x.type, y.type)
            except TypeMismatch:
                raise JoinError(f"{a} is {x.type}, {b} is {y.type}") from None
            c = to(x, t) == to(Typed(q(names[b]), y.type), t)
        cond = c if cond is None else cond & c
    j = left.join(r, cond, S.JOINS[s.how])
    if not keeps:
        return replace(st, df=j)
    schema = dict(st.schema) | {names[n]: f for n, f in right.schema.items()}
    cols = [q(n) for n in schema]
    if st.ordered:
        lo, ro = F.col("__lord"), F.col("__rord")
        cols.append(F.struct(lo.isNull().alias("z"), lo.alias("l"), ro.alias("r")).alias(ORD))
    return State(j.select(*cols), schema, st.ordered)


def window(st: State, s: S.Window) -> State:
    from pyspark.sql import Window as W

    if s.fn not in S.WINDOWS:
        raise AggError(f"no window function {s.fn}; there are {', '.join(S.WINDOWS)}")
    if s.fn == "ntile" and (s.n is None or S.slot(s.n) < 1):
        raise ArityError("ntile of less than one bucket")
    reads = s.fn not in ("rowNumber", "rank", "denseRank", "competitionRank", "ntile")
    if reads:
        need(st.schema, s.of)
    need(st.schema, *s.partition_by)
    keys = sort_columns(st.schema, s.order_by)
    if s.as_ in st.schema:
        raise AggError(f"{s.as_} is already a column")
    st = settled(numbered(st))
    ranged = not s.partition_by and not st.dry and (keys or s.fn not in ("rank", "denseRank", "competitionRank"))
    if ranged:
        st, sums = ranges(st, s, keys)
    part = W.partitionBy(*([RANGE] if ranged else [q(p) for p in s.partition_by]))
    w = part.orderBy(*keys, ORD)
    ranks = part.orderBy(*(keys or (F.lit(0),)))
    run, roll = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(-2, 0)
    if not reads and not s.partition_by and not keys and s.fn in ("rank", "denseRank", "competitionRank"):
        c, f = F.lit(1), Field("int")  # all rows tie
    elif not reads and ranged and s.fn == "ntile":
        c, f = F.row_number().over(w), Field("int")  # tiles are cut once all rows are counted
    elif not reads:
        c = {"rowNumber": lambda: F.row_number().over(w), "rank": lambda: F.dense_rank().over(ranks), "denseRank": lambda: F.dense_rank().over(ranks), "competitionRank": lambda: F.rank().over(ranks), "ntile": lambda: F.ntile(S.slot(s.n)).over(w)}[s.fn]()
        f = Field("int")
    else:
        x = typed(st.schema, s.of)
        if s.fn in ("cumulSum", "rollingSum", "rollingMean") and not numeric(x.type):
            raise AggError(f"{s.fn} of {x.type}")
        exact = is_decimal(x.type)
        n = x.col if exact else x.col.cast("double")
        total = Field(f"decimal(38,{precision(x.type)[1]})" if exact else "float", x.unit)
        if s.fn == "lag":
            c, f = F.lag(x.col).over(w), Field(x.type, x.unit)
        elif s.fn == "lead":
            c, f = F.lead(x.col).over(w), Field(x.type, x.unit)
        elif s.fn == "cumulSum":
            c, f = F.coalesce(F.sum(n).over(run), F.lit(0)).cast(spark_type(total.type)), total
        elif s.fn in ("cumulMax", "cumulMin"):
            c, f = (F.max if s.fn == "cumulMax" else F.min)(x.col).over(run), Field(x.type, x.unit)
        elif s.fn == "rollingSum":
            c, f = F.sum(n).over(roll).cast(spark_type(total.type)), total
        else:
            c, f = F.avg(x.col.cast("double")).over(roll), Field("float", x.unit)
    d = st.df.withColumn(s.as_, c)
    return replace(st, df=carried(d, s, f, sums) if ranged else d, schema=st.schema | {s.as_: f})


RANGE, HALO = "__range", "__halo"


def ranges(st: State, s: S.Window, keys: tuple[Column, ...]) -> tuple[State, DataFrame]:
    """Rows in numbered ranges of the window's order, and a row per range of what the ranges before it come to.

    Functions that look at rows nearby get those of the ranges beside them too, marked as a halo.
    """
    from pyspark.sql import Window as W

    from quernix.sources.snapshots import folder

    spark = st.df.sparkSession
    ties = s.fn in ("rank", "denseRank", "competitionRank")
    # Ties of a rank stay in one range.
    cut = st.df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *([] if ties else [ORD]))
    path = folder(spark)
    cut.withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    d = spark.read.schema(cut.withColumn(RANGE, F.spark_partition_id()).schema).parquet(path)
    each = [F.count("*").alias("n")]
    if s.fn == "denseRank" or s.fn == "rank":
        each.append(F.count_distinct(F.struct(*[q(S.slot(k)) for k, _ in s.order_by])).alias("v"))
    elif s.fn in ("cumulSum", "cumulMax", "cumulMin"):
        x = q(s.of) if is_decimal(st.schema[s.of].type) or s.fn != "cumulSum" else q(s.of).cast("double")
        each.append({"cumulSum": F.sum, "cumulMax": F.max, "cumulMin": F.min}[s.fn](x).alias("v"))
    else:
        each.append(F.count("*").alias("v"))
    # One row per range from here on.
    by = W.partitionBy(F.lit(0)).orderBy(RANGE)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    over = {"cumulMax": F.max, "cumulMin": F.min}.get(s.fn, F.sum)
    sums = d.groupBy(RANGE).agg(*each)
    sums = sums.select(RANGE, over("v").over(before).alias("__before"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("__total"), F.row_number().over(by).alias("__i"))
    if s.fn in ("lag", "lead", "rollingSum", "rollingMean"):
        ahead = s.fn == "lead"
        near = 1 if s.fn in ("lag", "lead") else 2
        back = W.partitionBy(RANGE).orderBy(*[_turned(c) for c in s.order_by], q(ORD).desc()) if not ahead else W.partitionBy(RANGE).orderBy(*keys, ORD)
        edge = d.withColumn("__e", F.row_number().over(back)).where(F.col("__e") <= near)
        # Every range listed has a row, so the next ``near`` of them are all that an edge can reach.
        at = sums.select(RANGE, "__i")
        shift = F.explode(F.array(*[F.lit(-j if ahead else j) for j in range(1, near + 1)]))
        edge = edge.join(F.broadcast(at), RANGE).withColumn("__far", shift)
        to = at.select(F.col(RANGE).alias("__to"), F.col("__i").alias("__at"))
        pick = W.partitionBy("__to").orderBy(F.abs("__far"), "__e")
        halo = edge.join(F.broadcast(to), F.col("__i") + F.col("__far") == F.col("__at")).withColumn("__k", F.row_number().over(pick)).where(F.col("__k") <= near)
        halo = halo.drop(RANGE, "__e", "__k", "__i", "__far", "__at").withColumnRenamed("__to", RANGE)
        d = d.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))
    return replace(st, df=d), sums


def _turned(by) -> Column:
    k, direction = by
    c = q(S.slot(k))
    return c.desc_nulls_first() if direction == "asc" else c.asc_nulls_first()


def carried(d: DataFrame, s: S.Window, f: Field, sums: DataFrame) -> DataFrame:
    """A range's own values of a window function put behind those of the ranges before it."""
    if HALO in d.columns:
        return d.where(~F.col(HALO)).drop(HALO, RANGE)
    own, kind = q(s.as_), spark_type(f.type)
    before, total = F.col("__before"), F.col("__total")
    if s.fn == "cumulSum":
        value = own + F.coalesce(before.cast(kind), F.lit(0).cast(kind))
    elif s.fn in ("cumulMax", "cumulMin"):
        value = (F.greatest if s.fn == "cumulMax" else F.least)(own, before)
    elif s.fn == "ntile":
        tiles, at = F.lit(S.slot(s.n)).cast("long"), own + F.coalesce(before, F.lit(0))
        small, large = F.floor(total / tiles), total % tiles
        wide = large * (small + 1)
        value = F.when(at <= wide, F.floor((at - 1) / (small + 1)) + 1).otherwise(large + F.floor((at - 1 - wide) / F.greatest(small, F.lit(1))) + 1)
    else:
        value = own + F.coalesce(before, F.lit(0))
    rest = [c for c in d.columns if c not in (s.as_, RANGE)]
    j = d.join(F.broadcast(sums), RANGE)
    return j.select(*[q(c) for c in rest], value.cast(kind).alias(s.as_))


#: A pivot's columns are data; more of them than this is refused rather than planned.
MAX_PIVOT = 10_000


def pivot(st: State, s: S.Pivot) -> State:
    need(st.schema, *s.index, s.on, s.values)
    st = settled(st)
    on = typed(st.schema, s.on)
    name = text(on) if on.type != "float" else F.when(F.isnan(on.col), F.lit('"NaN"')).otherwise(text(on))
    values = [r[0] for r in st.df.where(on.col.isNotNull()).select(name.alias("v")).distinct().limit(MAX_PIVOT + 1).collect()]
    if len(values) > MAX_PIVOT:
        raise AggError(f"a pivot of more than {MAX_PIVOT} columns")
    values.sort()
    unique(AggError, [*s.index, *values])
    schema, cols = {k: st.schema[k] for k in s.index}, []
    for v in values:
        c, schema[v] = aggregate(S.Agg(v, s.agg, s.values), st.schema, st.ordered, F.coalesce(name == v, F.lit(False)))
        cols.append(c.alias(v))
    if st.ordered:
        cols.append(F.min(ORD).alias(ORD))
    g = st.df.groupBy(*([q(k) for k in s.index] or [F.lit(1).alias("__one")])).agg(*(cols or [F.count("*").alias("__n")]))
    return State(g.select(*[q(n) for n in schema], *hidden(st)), schema, st.ordered)


def unpivot(st: State, s: S.Unpivot) -> State:
    need(st.schema, *s.ids, *s.values)
    unique(AggError, [*s.ids, "variable", "value"])
    st = settled(st)
    t = widen("unpivot", *(st.schema[v].type for v in s.values))
    unit = units.same("unpivot", *(st.schema[v].unit for v in s.values))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("variable"), to(typed(st.schema, v), t).alias("value")) for i, v in enumerate(s.values)])
    d = st.df.select(*[q(i) for i in s.ids], *hidden(st), F.explode(cells).alias("__cell"))
    cols = [*[q(i) for i in s.ids], F.col("__cell.variable").alias("variable"), F.col("__cell.value").alias("value")]
    if st.ordered:
        cols.append(F.struct(F.col(ORD).alias("o"), F.col("__cell.i").alias("i")).alias(ORD))
    return State(d.select(*cols), {i: st.schema[i] for i in s.ids} | {"variable": Field("string"), "value": Field(t, unit)}, st.ordered)


def limit(st: State, s: S.Limit) -> State:
    n, off = S.slot(s.n), S.slot(s.offset)
    if n < 0 or off < 0:
        raise ArityError("a negative limit or offset")
    d = st.df.orderBy(*st.pending, *hidden(st)) if st.pending or st.ordered else st.df
    return replace(st, df=(d.offset(off) if off else d).limit(n))


def distinct(st: State) -> State:
    if any(f.type == "opaque" for f in st.schema.values()):
        raise TypeMismatch("distinct over an opaque column")
    st = settled(st)
    if not st.ordered:
        return replace(st, df=st.df.distinct())
    g = st.df.groupBy(*[q(n) for n in st.schema]).agg(F.min(ORD).alias(ORD))
    return replace(st, df=g.select(*[q(n) for n in st.schema], ORD))


def set_operand(what: str, st: State, right: State) -> None:
    if list(st.schema) != list(right.schema):
        raise JoinError(f"{what}: columns {', '.join(st.schema)} against {', '.join(right.schema)}")
    for n in st.schema:
        units.same(what, st.schema[n].unit, right.schema[n].unit)


def union(st: State, right: State) -> State:
    set_operand("union", st, right)
    st, right = settled(st), settled(right)
    types = {n: widen("union", st.schema[n].type, right.schema[n].type) for n in st.schema}

    def side(x: State, k: int) -> DataFrame:
        at = [F.struct(F.lit(k).alias("s"), F.col(ORD).alias("o")).alias(ORD)] if st.ordered else []
        return x.df.select(*[to(typed(x.schema, n), t).alias(n) for n, t in types.items()], *at)

    if st.ordered and st.df.schema[ORD].dataType != right.df.schema[ORD].dataType:
        st, right = renumbered(st), renumbered(right)
    schema = {n: Field(t, st.schema[n].unit or right.schema[n].unit) for n, t in types.items()}
    return State(side(st, 0).union(side(right, 1)), schema, st.ordered)


def renumbered(st: State) -> State:
    return replace(st, df=st.df.orderBy(ORD).withColumn(ORD, F.monotonically_increasing_id()))


def member(st: State, right: State, how: str) -> State:
    what = "intersect" if how == "left_semi" else "except"
    set_operand(what, st, right)
    st = settled(st)
    names = list(st.schema)
    r = right.df.select(*[q(n).alias(f"__m{i}") for i, n in enumerate(names)])
    cond = None
    for i, n in enumerate(names):
        a, b = st.schema[n].type, right.schema[n].type
        alike = a == b or is_decimal(a) and is_decimal(b)
        if not alike and not (numeric(a) and numeric(b)):
            raise JoinError(f"{what}: {n} is {a} and {b}")
        # Cells of different number types are different, but nulls are alike.
        c = q(n).eqNullSafe(F.col(f"__m{i}")) if alike else q(n).isNull() & F.col(f"__m{i}").isNull()
        cond = c if cond is None else cond & c
    return replace(st, df=st.df.join(r, cond, how))


def apply(st: State, s, tables: dict, spark: SparkSession) -> State:
    other = lambda ordered=None: source(spark, s.source, tables, st.ordered if ordered is None else ordered)
    if isinstance(s, S.Filter):
        p = compile_expr(s.pred, st.schema)
        if p.type not in ("bool", "null"):
            raise TypeMismatch(f"a filter of {p.type}")
        return replace(st, df=st.df.where(p.col.cast("boolean")))
    if isinstance(s, S.Project):
        need(st.schema, *(a for a, _ in s.columns))
        unique(UnknownColumn, [b for _, b in s.columns])
        st = settled(st)
        return replace(st, df=st.df.select(*[q(a).alias(b) for a, b in s.columns], *hidden(st)), schema={b: st.schema[a] for a, b in s.columns})
    if isinstance(s, S.Derive):
        st = settled(st) if s.name in st.schema else st
        x = compile_expr(s.expr, st.schema)
        t = "string" if x.type == "null" else x.type
        return replace(st, df=st.df.withColumn(s.name, x.col.cast("string") if x.type == "null" else x.col), schema=st.schema | {s.name: Field(t, x.unit)})
    if isinstance(s, S.GroupBy):
        return group_by(st, s)
    if isinstance(s, S.Join):
        return join(st, s, other(st.ordered and s.how not in ("semi", "anti")))
    if isinstance(s, S.Window):
        return window(st, s)
    if isinstance(s, S.Pivot):
        return pivot(st, s)
    if isinstance(s, S.Unpivot):
        return unpivot(st, s)
    if isinstance(s, S.Sort):
        st = settled(st)
        return replace(st, pending=sort_columns(st.schema, s.by))
    if isinstance(s, S.Limit):
        return limit(st, s)
    if isinstance(s, S.Distinct):
        return distinct(st)
    if isinstance(s, S.Union):
        return union(st, other())
    if isinstance(s, S.Intersect):
        return member(st, other(False), "left_semi")
    if isinstance(s, S.Except):
        return member(st, other(False), "left_anti")
    from quernix.operators import bootstrap, cluster, regression

    if isinstance(s, S.Fit):
        return regression.fit_step(settled(st), s)
    if isinstance(s, S.Predict):
        return regression.predict_step(settled(st), s, source(spark, s.source, tables, False))
    if isinstance(s, S.KMeans):
        return cluster.kmeans_step(settled(numbered(st)), s)
    if isinstance(s, S.Bootstrap):
        return bootstrap.bootstrap_step(settled(numbered(st)), s)
    raise TypeMismatch(f"not a step: {s!r}")


def compile_steps(spark: SparkSession, steps, table, *, tables: dict | None = None, env: dict | None = None, clock: dict | None = None, ordered: bool = False) -> State:
    """The state after all steps; nothing runs, but for the names of a pivot's columns and the models."""
    bound = S.bind(steps, env, clock)
    st = source(spark, table, tables or {}, ordered or S.reads_order(bound))
    for s in bound:
        st = apply(st, s, tables or {}, spark)
    return st


def finish(st: State, ordered: bool = False) -> DataFrame:
    """The answer without hidden columns, with units as field metadata."""
    d = st.df.orderBy(*st.pending, *hidden(st)) if st.pending or ordered and st.ordered else st.df
    return d.select(*[q(n).alias(n, metadata={"unit": f.unit}) if f.unit else q(n) for n, f in st.schema.items()])


def run(spark: SparkSession, steps, table, *, tables: dict | None = None, env: dict | None = None, clock: dict | None = None, ordered: bool = False) -> DataFrame:
    """A pipeline over a table (DataFrame, Embedded or Ref) as a lazy DataFrame."""
    return finish(compile_steps(spark, steps, table, tables=tables, env=env, clock=clock, ordered=ordered), ordered)


def schema_walk(spark: SparkSession, steps, schema: dict[str, Field], *, tables: dict[str, dict[str, Field]] | None = None, env: dict | None = None, clock: dict | None = None) -> tuple[dict[str, Field], bool]:
    """(output schema, closed) without data; a pivot or an unknown source opens it."""
    empty = lambda s: State(dry=True, df=spark.createDataFrame([], ", ".join(f"`{n}` {spark_type(f.type) if f.type != 'opaque' else 'binary'}" for n, f in s.items())), schema=s)
    known = {n: empty(s) for n, s in (tables or {}).items()}
    closed = not any(isinstance(s, S.Pivot) for s in steps) and S.sources_of(steps) <= set(known)
    bound = S.bind(steps, env, clock)
    st = empty(schema)
    st = numbered(st) if S.reads_order(bound) else st
    for s in bound:
        if isinstance(s, (S.Pivot,)) or isinstance(getattr(s, "source", None), S.Ref) and s.source.name not in known:
            return st.schema, False
        if isinstance(s, (S.Fit, S.Predict, S.KMeans, S.Bootstrap)):
            from quernix.operators import outputs

            st = replace(st, schema=outputs.schema_after(s, st.schema), df=empty(outputs.schema_after(s, st.schema)).df, ordered=False)
            continue
        st = apply(st, s, known, spark)
    return st.schema, closed
