"""A replayable stream of edits over a table: each one applied, checked, inverted, encoded and chained by hash."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernix.errors import EditRejected
from quernix.functions.compile import schema_of, spark_type
from quernix.plans import codec
from quernix.plans.engine import q, run

ROW = "__row"


@dataclass(frozen=True)
class SetCell:
    column: str
    row: int
    value: Any


@dataclass(frozen=True)
class SetColumn:
    column: str
    values: tuple


@dataclass(frozen=True)
class InsertColumn:
    at: int
    name: str
    type: str
    values: tuple


@dataclass(frozen=True)
class RemoveColumn:
    column: str


@dataclass(frozen=True)
class AppendRows:
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class ApplyTransform:
    step: Any


OPS = {c.__name__: c for c in (SetCell, SetColumn, InsertColumn, RemoveColumn, AppendRows, ApplyTransform)}


def numbered(df: DataFrame) -> DataFrame:
    """Rows with their dense position: the position within a partition plus the rows of the partitions before it."""
    if ROW in df.columns:
        return df
    d = df.withColumn("__id", F.monotonically_increasing_id())
    d = d.withColumn("__part", F.shiftright("__id", 33))
    counts = sorted((r["__part"], r["count"]) for r in d.groupBy("__part").count().collect())  # one row per partition
    offsets, at = [], 0
    for part, n in counts:
        offsets.append((part, at))
        at += n
    o = df.sparkSession.createDataFrame(offsets, "__part bigint, __off bigint")
    return d.join(o, "__part").withColumn(ROW, F.col("__off") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__part", "__id", "__off")


def _column(spark: SparkSession, name: str, kind: str, values: tuple) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"{ROW} bigint, `{name}` {kind}")


def apply(df: DataFrame, op) -> DataFrame:
    """One edit. The result keeps row positions in a hidden column until ``table`` drops it."""
    spark, d = df.sparkSession, numbered(df)
    names = [c for c in d.columns if c != ROW]
    if isinstance(op, SetCell):
        _has(names, op.column)
        if op.row < 0 or d.where(F.col(ROW) == op.row).limit(1).count() == 0:
            raise EditRejected(f"no row {op.row}")
        kind = d.schema[op.column].dataType
        return d.withColumn(op.column, F.when(F.col(ROW) == op.row, F.lit(op.value).cast(kind)).otherwise(q(op.column)))
    if isinstance(op, SetColumn):
        _has(names, op.column)
        _length(d, op.values)
        v = _column(spark, "__v", d.schema[op.column].dataType.simpleString(), op.values)
        return d.join(v, ROW, "left").withColumn(op.column, F.col("__v")).select(*map(q, names), ROW)
    if isinstance(op, InsertColumn):
        if op.name in names:
            raise EditRejected(f"{op.name} is already a column")
        if not 0 <= op.at <= len(names):
            raise EditRejected(f"no place {op.at}")
        _length(d, op.values)
        j = d.join(_column(spark, op.name, spark_type(op.type), op.values), ROW, "left")
        return j.select(*map(q, [*names[: op.at], op.name, *names[op.at :]]), ROW)
    if isinstance(op, RemoveColumn):
        _has(names, op.column)
        return d.drop(op.column)
    if isinstance(op, AppendRows):
        if any(len(r) != len(names) for r in op.rows):
            raise EditRejected("a ragged row")
        n = d.count()
        more = spark.createDataFrame([(*r, n + i) for i, r in enumerate(op.rows)], d.select(*map(q, names), ROW).schema)
        return d.select(*map(q, names), ROW).unionByName(more)
    if isinstance(op, ApplyTransform):
        return numbered(run(spark, (op.step,), d.orderBy(ROW).drop(ROW), ordered=True))
    raise EditRejected(f"not an edit: {op!r}")


def _has(names, column: str) -> None:
    if column not in names:
        raise EditRejected(f"no column {column}; there are {', '.join(names)}")


def _length(d: DataFrame, values: tuple) -> None:
    if (n := d.count()) != len(values):
        raise EditRejected(f"{len(values)} values for {n} rows")


def can_apply(df: DataFrame, op) -> bool:
    try:
        apply(df, op)
    except EditRejected:
        return False
    return True


def table(df: DataFrame, ordered: bool = True) -> DataFrame:
    if ROW not in df.columns:
        return df
    return (df.orderBy(ROW) if ordered else df).drop(ROW)


def apply_all(df: DataFrame, ops) -> DataFrame:
    """Runs of cell edits of one column become one expression."""
    df, i, ops = numbered(df), 0, list(ops)
    while i < len(ops):
        run_ = [ops[i]]
        while isinstance(run_[0], SetCell) and i + len(run_) < len(ops) and isinstance(ops[i + len(run_)], SetCell) and ops[i + len(run_)].column == run_[0].column:
            run_.append(ops[i + len(run_)])
        if len(run_) > 1:
            col = run_[0].column
            _has(df.columns, col)
            last = {o.row: o.value for o in run_}
            if df.where(F.col(ROW).isin(list(last))).count() != len(last):
                raise EditRejected("no such row")
            kind, c = df.schema[col].dataType, None
            for r, v in last.items():
                c = F.when(F.col(ROW) == r, F.lit(v).cast(kind)) if c is None else c.when(F.col(ROW) == r, F.lit(v).cast(kind))
            df = df.withColumn(col, c.otherwise(q(col)))
        else:
            df = apply(df, run_[0])
        i += len(run_)
    return df


def invert(df: DataFrame, op):
    """The edit that undoes op on the table before it."""
    d = numbered(df)
    if isinstance(op, SetCell):
        r = d.where(F.col(ROW) == op.row).select(q(op.column)).first()
        if r is None:
            raise EditRejected(f"no row {op.row}")
        return SetCell(op.column, op.row, r[0])
    if isinstance(op, InsertColumn):
        return RemoveColumn(op.name)
    if isinstance(op, (SetColumn, RemoveColumn)):
        _has(d.columns, op.column)
        values = tuple(r[0] for r in d.orderBy(ROW).select(q(op.column)).collect())
        if isinstance(op, SetColumn):
            return SetColumn(op.column, values)
        names = [c for c in d.columns if c != ROW]
        return InsertColumn(names.index(op.column), op.column, schema_of(d.schema)[op.column].type, values)
    raise EditRejected(f"{type(op).__name__} is not invertible")


def to_ops(old: DataFrame, new: DataFrame) -> list:
    """Cell edits between two tables of one shape."""
    if old.columns != new.columns:
        raise EditRejected("different columns")
    a, b = numbered(old).alias("a"), numbered(new).alias("b")
    out = []
    j = a.join(b, F.col(f"a.{ROW}") == F.col(f"b.{ROW}"), "full_outer")
    if j.where(F.col(f"a.{ROW}").isNull() | F.col(f"b.{ROW}").isNull()).limit(1).count():
        raise EditRejected("different numbers of rows")
    for c in old.columns:
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        out += [SetCell(c, r[0], r[1]) for r in j.where(~x.eqNullSafe(y)).select(F.col(f"a.{ROW}"), y).orderBy(ROW).collect()]
    return out


def changed_columns(ops) -> set[str]:
    return {getattr(o, "column", getattr(o, "name", None)) for o in ops if not isinstance(o, (AppendRows, ApplyTransform))}


def delta_of(ops, rows_before: int) -> list[tuple[int, str]] | None:
    """(row, change) pairs of the edits; None where only a full refresh will do."""
    out: dict[int, str] = {}
    for o in ops:
        if isinstance(o, SetCell):
            out.setdefault(o.row, "changed")
        elif isinstance(o, AppendRows):
            for _ in o.rows:
                out[rows_before] = "added"
                rows_before += 1
        else:
            return None
    return sorted(out.items())


def encode(op) -> str:
    d = {"$type": type(op).__name__}
    for f in fields(op):
        v = getattr(op, f.name)
        d[f.name] = codec.encode_step(v) if isinstance(op, ApplyTransform) else [list(r) if isinstance(r, tuple) else r for r in v] if isinstance(v, tuple) else v
    return codec.dumps(d)


def decode(text: str):
    d = codec.loads(text)
    t = d.pop("$type", None)
    if t not in OPS:
        raise EditRejected(f"no edit {t}")
    if t == "ApplyTransform":
        return ApplyTransform(codec.decode_step(d["step"]))
    return OPS[t](**{k: tuple(tuple(r) if isinstance(r, list) else r for r in v) if isinstance(v, list) else v for k, v in d.items()})


def log(ops, start: str = "") -> list[tuple[int, str, str, str]]:
    """(seq, op, previous hash, hash) rows."""
    out, prev = [], start
    for i, o in enumerate(ops):
        text = encode(o)
        h = hashlib.sha256(f"{prev}\n{text}".encode()).hexdigest()
        out.append((i, text, prev, h))
        prev = h
    return out


def replay(df: DataFrame, rows) -> DataFrame:
    """Applies a log after checking its chain."""
    prev, ops = None, []
    for _, text, before, h in sorted(rows):
        if (prev is not None and before != prev) or hashlib.sha256(f"{before}\n{text}".encode()).hexdigest() != h:
            raise EditRejected("the log's chain is broken")
        prev = h
        ops.append(decode(text))
    return apply_all(df, ops)


@dataclass
class Edited:
    """A held table under edit: numbered and read once, however many edits follow."""

    df: DataFrame

    def apply(self, ops) -> Edited:
        """The table after the edits, held in its turn; this one stays as it is until it is released."""
        return Edited(apply_all(self.df, ops).persist())

    def table(self, ordered: bool = True) -> DataFrame:
        return table(self.df, ordered)

    def prepared(self):
        """A held source for pipelines."""
        from quernix.sources.tables import prepare

        return prepare(self.table())

    def delta(self, ops) -> list[tuple[int, str]] | None:
        """``delta_of`` the edits on this table."""
        return delta_of(ops, self.df.count())

    def invert(self, op):
        return invert(self.df, op)

    def release(self) -> None:
        self.df.unpersist()


def edit(df: DataFrame) -> Edited:
    return Edited(numbered(df).persist())
