"""Change sets as values: which rows of a keyed table changed, which columns are no longer to be trusted, or everything.

A change set over rows has one row per key with its change; the change says whether the row was there before and
whether it is there after, so composing two in turn takes the first's before and the second's after. ``rows`` None is
the top element, a full refresh: it absorbs every other one, and change sets over different keys compose to it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernix.errors import CodecError, DeltaError
from quernix.functions.compile import schema_of, spark_type
from quernix.plans import codec
from quernix.plans import steps as S
from quernix.plans.engine import q
from quernix.streaming import delta

#: The key of tables whose rows have no identity but their place.
ORDINAL = "ordinal"
#: A change set in text is one document; larger ones are written as files.
MAX_TEXT_ROWS = 100_000


@dataclass(frozen=True)
class ChangeSet:
    keys: tuple[str, ...]
    rows: DataFrame | None
    columns: tuple[str, ...] = ()

    @property
    def is_full(self) -> bool:
        return self.rows is None

    def is_quiet(self) -> bool:
        """Nothing changed."""
        return self.rows is not None and not self.columns and self.rows.isEmpty()


def full(keys: tuple[str, ...]) -> ChangeSet:
    return ChangeSet(tuple(keys), None)


def of_rows(rows: DataFrame, keys: tuple[str, ...]) -> ChangeSet:
    return ChangeSet(tuple(keys), rows.select(*map(q, keys), "change"))


def empty(like: DataFrame, keys: tuple[str, ...]) -> ChangeSet:
    """The quiet change set of a table's keys."""
    return of_rows(like.select(*map(q, keys), F.lit("added").alias("change")).limit(0), keys)


def of_columns(like: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> ChangeSet:
    """These columns changed in rows unknown."""
    return replace(empty(like, keys), columns=tuple(columns))


def between(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> ChangeSet:
    return ChangeSet(tuple(keys), delta.diff(old, new, tuple(keys)))


def defects(d: ChangeSet) -> list[str]:
    """Every defect, in a fixed order; none means that it is well-formed."""
    out = []
    if not d.keys or "" in d.keys:
        out.append("a change set names its keys")
    if "" in d.columns:
        out.append("a column without a name")
    out += [f"column invalidated more than once: {c}" for c in dict.fromkeys(d.columns) if d.columns.count(c) > 1]
    if d.rows is None or not d.keys:
        return out
    if missing := [k for k in (*d.keys, "change") if k not in d.rows.columns]:
        return [*out, f"no column {', '.join(missing)}"]
    null = F.lit(False)
    for k in d.keys:
        null = null | q(k).isNull()
    below = q(ORDINAL) < 0 if d.keys == (ORDINAL,) else F.lit(False)
    known = F.coalesce(q("change").isin(*delta.CHANGES), F.lit(False))
    r = d.rows.groupBy(*map(q, d.keys)).agg(F.count("*").alias("n"), F.bool_or(null).alias("null"), F.bool_or(~known).alias("odd"), F.bool_or(below).alias("below"))
    r = r.agg(F.max("n").alias("n"), F.bool_or("null").alias("null"), F.bool_or("odd").alias("odd"), F.bool_or("below").alias("below")).first()
    named = (("a null key", r["null"]), ("a negative ordinal", r["below"]), ("a row named more than once", (r["n"] or 0) > 1), (f"a change that is none of {', '.join(delta.CHANGES)}", r["odd"]))
    return out + [what for what, there in named if there]


def validate(d: ChangeSet) -> ChangeSet:
    """The change set itself, or a refusal by its first defect."""
    if found := defects(d):
        raise DeltaError(found[0])
    return d


def normalise(d: ChangeSet) -> ChangeSet:
    """Rows by key and columns by name; repeated ones stay, as they are defects."""
    return d if d.rows is None else ChangeSet(d.keys, d.rows.orderBy(*map(q, d.keys), "change"), tuple(sorted(d.columns)))


def compose(first: ChangeSet, then: ChangeSet) -> ChangeSet:
    """One change set for two in turn; associative, defined for every pair."""
    if first.is_full or then.is_full or first.keys != then.keys:
        return full(first.keys)
    return ChangeSet(first.keys, delta.compose(first.rows, then.rows, first.keys), tuple(sorted({*first.columns, *then.columns})))


def compose_checked(first: ChangeSet, then: ChangeSet) -> ChangeSet:
    """``compose``, refusing what is not well-formed and different keys."""
    validate(first)
    validate(then)
    if not first.is_full and not then.is_full and first.keys != then.keys:
        raise DeltaError(f"change sets over {', '.join(first.keys)} and {', '.join(then.keys)}")
    return compose(first, then)


def compose_all(sets: list[ChangeSet]) -> ChangeSet:
    out = sets[0]
    for d in sets[1:]:
        out = compose(out, d)
    return out


def resolve(d: ChangeSet, table: DataFrame) -> DataFrame | None:
    """The rows of the table after the change that were added or changed; None where that may be all of them."""
    if d.rows is None:
        return None
    named = d.rows.where(q("change").isin("added", "changed")).select(*map(q, d.keys)).distinct()
    return table.join(named, list(d.keys), "left_semi")


def of_change(like: DataFrame, keys: tuple[str, ...], kind: str, column: str | None = None) -> ChangeSet:
    """A change of a whole table as a change set: only new values of one column are less than a full refresh."""
    if kind == "columnValuesChanged":
        if not column:
            raise DeltaError("a column change names its column")
        return of_columns(like, keys, (column,))
    if kind not in ("rowsAppended", "columnAdded", "columnRemoved", "unknown"):
        raise DeltaError(f"no change {kind}")
    return full(keys)


def to_change(d: ChangeSet) -> tuple[str, str | None]:
    """The other way: one column in rows unknown is a column change; anything else is unknown."""
    if d.rows is not None and len(d.columns) == 1 and d.rows.isEmpty():
        return "columnValuesChanged", d.columns[0]
    return "unknown", None


def encode(d: ChangeSet) -> str:
    """Canonical text: the same for equal change sets."""
    if d.rows is None:
        return codec.dumps({"$type": "fullRefresh", "keys": list(d.keys)})
    rows = normalise(d).rows.limit(MAX_TEXT_ROWS + 1).collect()
    if len(rows) > MAX_TEXT_ROWS:
        raise CodecError(f"more than {MAX_TEXT_ROWS} rows; write files instead")
    fields = schema_of(d.rows.schema)
    table = S.Embedded(tuple((k, fields[k].type) for k in (*d.keys, "change")), tuple(map(tuple, rows)))
    return codec.dumps({"$type": "rowSet", "keys": list(d.keys), "columns": sorted(d.columns), "rows": json.loads(codec.encode_table(table))})


def decode(spark: SparkSession, text: str) -> ChangeSet:
    """Refuses text that is no change set, and a change set with a defect."""
    t = codec.loads(text)
    keys = t.get("keys") if isinstance(t, dict) else None
    if not isinstance(keys, list) or not all(isinstance(k, str) for k in keys):
        raise CodecError("a change set names its keys")
    if t.get("$type") == "fullRefresh":
        return full(tuple(keys))
    if t.get("$type") != "rowSet" or not isinstance(t.get("columns"), list) or not isinstance(t.get("rows"), dict):
        raise CodecError("neither a full refresh nor a row set")
    table = codec.decode_source(t.get("rows"))
    if not isinstance(table, S.Embedded):
        raise CodecError("rows are a table")
    ddl = ", ".join(f"`{c[0]}` {spark_type(c[1])}" for c in table.schema)
    d = ChangeSet(tuple(keys), spark.createDataFrame(list(table.rows), ddl), tuple(t["columns"]))
    if found := defects(d):
        raise CodecError(found[0])
    return d
