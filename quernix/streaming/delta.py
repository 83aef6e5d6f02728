"""Keyed change sets and the refresh of a result from them.

A change set is a DataFrame of key columns and ``change`` (added, changed, removed, transient). ``refresh`` gives what
a full evaluation of the new source would give: row-local steps run over the changed keys only, a group-by
re-aggregates the groups those rows were in or are in now, a fit at the end refits them, a window its partitions,
and what follows runs over the maintained rows. Snapshots are parquet in a shared folder; the state itself is a small
text with a digest, so that another process can go on from it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernix.errors import CodecError, DeltaError
from quernix.functions.compile import schema_of
from quernix.functions.expr import uses_now
from quernix.plans import codec
from quernix.plans import steps as S
from quernix.plans.engine import ORD, State, apply, finish, q, settled
from quernix.sources import snapshots

CHANGES = ("added", "changed", "removed", "transient")


def check_keys(df: DataFrame, keys: tuple[str, ...]) -> None:
    """Refuses a null or repeated identity."""
    if missing := [k for k in keys if k not in df.columns]:
        raise DeltaError(f"no key column {', '.join(missing)}")
    bad = None
    for k in keys:
        bad = q(k).isNull() if bad is None else bad | q(k).isNull()
    r = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.max(bad).alias("b")).first()
    if r["b"]:
        raise DeltaError("a null key")
    if (r["n"] or 0) > 1:
        raise DeltaError("a repeated key")


def _same(a: str, b: str, names) -> Column:
    return F.struct(*[F.col(f"{a}.`{n}`") for n in names]).eqNullSafe(F.struct(*[F.col(f"{b}.`{n}`") for n in names]))


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The change set from old to new, by one full outer join on the key."""
    if old.columns != new.columns:
        raise DeltaError("different columns; refresh in full")
    for d in (old, new):
        check_keys(d, keys)
    a, b = old.withColumn("__in", F.lit(1)).alias("a"), new.withColumn("__in", F.lit(1)).alias("b")
    cond = None
    for k in keys:
        c = F.col(f"a.`{k}`") == F.col(f"b.`{k}`")
        cond = c if cond is None else cond & c
    j = a.join(b, cond, "full_outer")
    rest = [n for n in old.columns if n not in keys]
    moved = ~_same("a", "b", rest) if rest else F.lit(False)
    change = F.when(F.col("a.__in").isNull(), "added").when(F.col("b.__in").isNull(), "removed").when(moved, "changed")
    return j.select(*[F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")).alias(k) for k in keys], change.alias("change")).where("change IS NOT NULL")


def diff_by_ordinal(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The change set of tables whose rows are told apart by a position column."""
    return diff(old, new, (order,))


def compose(first: DataFrame, then: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One change set for two in turn; a row that comes and goes is transient."""
    u = first.select(*keys, F.lit(0).alias("t"), "change").unionByName(then.select(*keys, F.lit(1).alias("t"), "change"))
    g = u.groupBy(*keys).agg(F.min_by("change", "t").alias("f"), F.max_by("change", "t").alias("l"))
    before, after = ~F.col("f").isin("added", "transient"), ~F.col("l").isin("removed", "transient")
    return g.select(*keys, F.when(before & after, "changed").when(before, "removed").when(after, "added").otherwise("transient").alias("change"))


def compose_all(deltas: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    out = deltas[0]
    for d in deltas[1:]:
        out = compose(out, d, keys)
    return out


def validate(delta: DataFrame, keys: tuple[str, ...]) -> None:
    """Refuses a null or repeated key and an unknown change, in one pass."""
    if missing := [k for k in (*keys, "change") if k not in delta.columns]:
        raise DeltaError(f"no key column {', '.join(missing)}")
    null = F.lit(False)
    for k in keys:
        null = null | q(k).isNull()
    odd = ~F.coalesce(F.col("change").isin(*CHANGES), F.lit(False))
    r = delta.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(null).alias("b"), F.bool_or(odd).alias("o")).agg(F.max("n").alias("n"), F.max("b").alias("b"), F.max("o").alias("o")).first()
    if r["b"]:
        raise DeltaError("a null key")
    if (r["n"] or 0) > 1:
        raise DeltaError("a repeated key")
    if r["o"]:
        raise DeltaError(f"a change that is none of {', '.join(CHANGES)}")


@dataclass(frozen=True)
class Footprint:
    kind: str  # primed, reused, incremental or full
    rows: int = 0
    groups: int = 0
    reason: str | None = None


@dataclass(frozen=True)
class Primed:
    steps: tuple
    keys: tuple[str, ...]
    hash: str
    schema: tuple
    folder: str
    prefix: str | None
    maintained: str
    footprint: Footprint
    env: tuple = ()


LOCAL = (S.Filter, S.Project, S.Derive)


def plan(steps) -> list[tuple[str, str]]:
    """(class, why) of each step of a bound pipeline before anything runs."""
    out, open_, broken = [], True, None
    for i, s in enumerate(steps):
        ordered = any(a.fn in ("first", "last") for a in getattr(s, "aggs", ()))
        last = i == len(steps) - 1
        if broken:
            out.append(("FallBack", broken))
        elif isinstance(s, LOCAL) and open_:
            out.append(("PropagateRows", ""))
        elif isinstance(s, S.Join) and s.how in ("semi", "anti") and open_:
            out.append(("FilterByRelation", ""))
        elif isinstance(s, S.GroupBy) and open_ and not ordered:
            out.append(("MaintainGroups", ""))
            open_ = False
        elif isinstance(s, S.Fit) and open_ and last and s.output in ("coefficients", "summary"):
            out.append(("MaintainFits", ""))
            open_ = False
        elif isinstance(s, S.Window) and open_ and s.partition_by:
            out.append(("RecomputeFrame", ""))
            open_ = False
        elif isinstance(s, S.Sort):
            out.append(("MergeOrder", ""))
            open_ = False
        elif isinstance(s, S.Limit):
            out.append(("TruncateOrder", ""))
            open_ = False
        elif not open_:
            out.append(("OverMaintained", ""))
        else:
            verb = type(s).__name__
            if isinstance(s, S.Join):
                broken = f"JoinNotRowPreserving: {s.how}"
            elif isinstance(s, (S.GroupBy, S.Fit)):
                broken = f"AggregateStepNotLast: {verb}" if isinstance(s, S.Fit) and not last else f"StepNotRowLocal: {verb} that reads row order or gives rows"
            else:
                broken = f"StepNotRowLocal: {verb}"
            out.append(("FallBack", broken))
    return out


def _split(steps) -> tuple[list, object | None, list]:
    """Row-local prefix, the maintained step if there is one, and the rest."""
    classes = [c for c, _ in plan(steps)]
    n = 0
    while n < len(steps) and classes[n] in ("PropagateRows", "FilterByRelation"):
        n += 1
    if n < len(steps) and classes[n] in ("MaintainGroups", "RecomputeFrame", "MaintainFits"):
        return list(steps[:n]), steps[n], list(steps[n + 1 :])
    return list(steps[:n]), None, list(steps[n:])


def _apply(st: State, steps, tables, spark) -> State:
    for s in steps:
        st = apply(st, s, tables, spark)
    return settled(st)


def _keyed(df: DataFrame, keys: tuple[str, ...]) -> State:
    """Rows ordered by their key, which also tells them apart after the key columns are projected away."""
    return State(df.withColumn(ORD, F.struct(*[q(k) for k in keys])), schema_of(df.schema), True)


def _save(df: DataFrame, folder: str) -> str:
    path = f"{folder}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _env(env: dict) -> tuple:
    return tuple(sorted((str(k), repr(v)) for k, v in env.items()))


def prime(df: DataFrame, steps, keys: tuple[str, ...], folder: str, *, tables: dict | None = None, env: dict | None = None, clock: dict | None = None) -> Primed:
    """Evaluates once and keeps what a refresh needs."""
    check_keys(df, keys)
    raw = tuple(steps)
    bound = S.bind(raw, env, clock)
    spark = df.sparkSession
    prefix, kept, _ = _split(bound)
    st = _apply(_keyed(df, keys), prefix, tables or {}, spark)
    p = _save(st.df, folder)
    m = p
    if kept is not None:
        held = State(spark.read.parquet(p), st.schema, True)
        m = _save(apply(held, kept, tables or {}, spark).df, folder)
    return Primed(bound, keys, codec.pipeline_hash(bound), tuple(df.dtypes), folder, p, m, Footprint("primed"), _env(env or {}))


def _schemas(pr: Primed, df: DataFrame, tables) -> tuple:
    """Schemas after the prefix and after the maintained step, without data."""
    spark = df.sparkSession
    prefix, kept, rest = _split(pr.steps)
    st = _apply(_keyed(df.limit(0), pr.keys), prefix, tables, spark)
    after = apply(st, kept, tables, spark) if kept is not None else st
    return st, after, kept, rest, prefix


def result(pr: Primed, df: DataFrame, *, tables: dict | None = None) -> DataFrame:
    """The answer a primed or refreshed state stands for."""
    spark = df.sparkSession
    _, after, _, rest, _ = _schemas(pr, df, tables or {})
    st = State(spark.read.parquet(pr.maintained), after.schema, True)
    for s in rest:
        st = apply(st, s, tables or {}, spark)
    return finish(st)


def refresh(pr: Primed, delta: DataFrame | None, new: DataFrame, *, tables: dict | None = None, moved_relations: bool = False, steps=None, env: dict | None = None, keys: tuple[str, ...] | None = None) -> Primed:
    """The state for the new source; delta None is a full refresh. Where steps, env or keys are given and are not
    those of the state, the answer is evaluated in full for the new ones, and the footprint says why."""
    raw, moved_env = pr.steps, env is not None and _env(env) != pr.env
    reason = None
    if steps is not None or moved_env:
        if steps is None:
            raise DeltaError("a new environment comes with the steps that it is for")
        raw = S.bind(tuple(steps), env, None)
        if codec.pipeline_hash(raw) != pr.hash:
            reason = "EnvChanged" if moved_env else "PipelineChanged"
    if reason:
        pr = replace(pr, steps=raw, env=_env(env or {}))
    elif keys is not None and tuple(keys) != pr.keys:
        pr, reason = replace(pr, keys=tuple(keys)), "RowIdentityUnusable"
    elif delta is None:
        reason = "DeltaIsFullRefresh"
    elif tuple(new.dtypes) != pr.schema:
        reason = "SourceSchemaMoved"
    elif moved_relations and S.sources_of(pr.steps):
        reason = "RelationMoved"
    elif any(c == "FallBack" for c, _ in plan(pr.steps)):
        reason = next(w for c, w in plan(pr.steps) if c == "FallBack")
    elif any(uses_now(s) for s in pr.steps):
        reason = "ClockMoved"
    if reason:
        return replace(prime(new, pr.steps, pr.keys, pr.folder, tables=tables), env=pr.env, footprint=Footprint("full", reason=reason))
    spark, keys, tables = new.sparkSession, pr.keys, tables or {}
    # Read three times below; a change set that is itself a join would run as often.
    delta = delta.select(*map(q, keys), "change").persist()
    validate(delta, keys)
    touched = delta.where("change <> 'transient'").select(*[q(k).alias(f"__d{i}") for i, k in enumerate(keys)]).persist()
    n = touched.count()
    delta.unpersist()
    if n == 0:
        touched.unpersist()
        return replace(pr, footprint=Footprint("reused"))
    st, after, kept, _, prefix = _schemas(pr, new, tables)

    def among(d: DataFrame, how: str, of=q) -> DataFrame:
        cond = None
        for i, k in enumerate(keys):
            c = of(k) == F.col(f"__d{i}")
            cond = c if cond is None else cond & c
        return d.join(touched, cond, how)

    old = spark.read.parquet(pr.prefix)
    by_ord = lambda k: F.col(f"{ORD}.`{k}`")
    fresh = _apply(_keyed(among(new, "left_semi"), keys), prefix, tables, spark).df
    p = _save(among(old, "left_anti", by_ord).unionByName(fresh), pr.folder)
    if kept is None:
        touched.unpersist()
        return replace(pr, prefix=p, maintained=p, footprint=Footprint("incremental", n))
    part = list(kept.keys if isinstance(kept, S.GroupBy) else kept.group_by if isinstance(kept, S.Fit) else kept.partition_by)
    current = spark.read.parquet(p)
    if not part:
        m, groups = _save(apply(State(current, st.schema, True), kept, tables, spark).df, pr.folder), 1
    else:
        gone = among(old, "left_semi", by_ord).select(*map(q, part)).unionByName(among(current, "left_semi", by_ord).select(*map(q, part))).distinct()
        hit = gone.select(*[q(k).alias(f"__p{i}") for i, k in enumerate(part)]).persist()
        groups = hit.count()

        def within(d: DataFrame, how: str) -> DataFrame:
            cond = None
            for i, k in enumerate(part):
                c = q(k).eqNullSafe(F.col(f"__p{i}"))
                cond = c if cond is None else cond & c
            return d.join(hit, cond, how)

        redone = apply(State(within(current, "left_semi"), st.schema, True), kept, tables, spark).df
        m = _save(within(spark.read.parquet(pr.maintained), "left_anti").unionByName(redone), pr.folder)
        hit.unpersist()
    touched.unpersist()
    return replace(pr, prefix=p, maintained=m, footprint=Footprint("incremental", n, groups))


def encode_state(pr: Primed, source: str = "") -> str:
    """The state as text: the pipeline, its hash, the snapshots and what they were made of. ``source`` names the
    source's version, if the caller has such a name; the last member is a digest of the rest."""
    t = asdict(replace(pr, steps=())) | {"steps": json.loads(codec.encode(pr.steps)), "source": source}
    body = json.dumps(t, sort_keys=True, ensure_ascii=False)
    return json.dumps({"digest": hashlib.sha256(body.encode()).hexdigest(), "state": body})


def decode_state(text: str, steps=None, source: str | None = None) -> Primed:
    """Refuses text that was damaged, and a state of another pipeline or source than those given."""
    try:
        outer = json.loads(text)
        body = outer["state"]
        if hashlib.sha256(body.encode()).hexdigest() != outer["digest"]:
            raise CodecError("a state whose digest does not match")
        t = json.loads(body)
        pr = Primed(
            codec.decode(json.dumps(t["steps"])), tuple(t["keys"]), t["hash"], tuple(map(tuple, t["schema"])), t["folder"], t["prefix"], t["maintained"], Footprint(**t["footprint"]), tuple(map(tuple, t["env"]))
        )
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise CodecError(f"not a state: {e}") from None
    if codec.pipeline_hash(pr.steps) != pr.hash or steps is not None and codec.pipeline_hash(tuple(steps)) != pr.hash:
        raise CodecError("a state of another pipeline")
    if source is not None and source != t["source"]:
        raise CodecError("a state of another source")
    return pr


def follow(stream: DataFrame, pr: Primed, source, on_result, *, checkpoint: str):
    """A structured stream of change rows (keys, change): each micro-batch refreshes the state from ``source()``.

    The rows of a batch have no order, so a key with several changes counts as changed: a refresh reads the
    source for every key named, and so finds out what it is. After ``on_result(state, batch)`` the state is stored in the
    checkpoint folder; a restart goes on from the last one stored, and calls on_result again for a batch that was
    interrupted before that. Snapshots that neither of the last two states has are deleted.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint}/quernix-state"

    def stored() -> list[int]:
        return sorted(int(n) for n in snapshots.names(spark, folder) if n.isdigit())

    held = {"state": pr, "batch": -1, "before": pr}
    if done := stored():
        before, state = (decode_state(snapshots.read_text(spark, f"{folder}/{n}"), pr.steps) for n in (done * 2)[-2:])
        held |= {"state": state, "batch": done[-1], "before": before}

    def batch(df: DataFrame, batch_id: int) -> None:
        if batch_id <= held["batch"]:
            return  # replayed after a restart
        g = df.groupBy(*pr.keys).agg(F.count("*").alias("n"), F.min("change").alias("change"))
        last = g.select(*map(q, pr.keys), F.when(F.col("n") == 1, F.col("change")).otherwise("changed").alias("change"))
        state = refresh(held["state"], last, source())
        on_result(state, batch_id)
        snapshots.write_text(spark, f"{folder}/{batch_id}", encode_state(state))
        files = lambda p: {p.prefix, p.maintained}
        for path in files(held["before"]) - files(held["state"]) - files(state) - files(pr):
            snapshots.delete(spark, path)
        for old in stored()[:-2]:
            snapshots.delete(spark, f"{folder}/{old}")
        held.update(state=state, batch=batch_id, before=held["state"])

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def reads(steps) -> set[str]:
    from quernix.functions.expr import columns_of

    out = set(columns_of(tuple(steps)))
    for s in steps:
        for name in ("keys", "partition_by", "index", "ids", "values", "group_by"):
            v = getattr(s, name, ())
            out |= {v} if isinstance(v, str) else set(v)
        out |= {a for a, _ in getattr(s, "columns", ())} | {a for a, _ in getattr(s, "on", ()) if not isinstance(s.on, str)}
        out |= {k for k, _ in [*getattr(s, "by", ()), *getattr(s, "order_by", ())] if isinstance(k, str)}
        out |= {a.of for a in [*getattr(s, "aggs", ()), *getattr(s, "aggregates", ())]} | {x for x in (getattr(s, "of", None), getattr(s, "on", None), getattr(s, "response", None)) if isinstance(x, str)}
    return out


def eval_from(prior: DataFrame, changed_columns: set[str], steps, df: DataFrame, **kw) -> DataFrame:
    """The prior answer where the changed columns are neither read nor returned, else a full evaluation."""
    from quernix.plans.engine import run

    passes = any(isinstance(s, (S.Project, S.GroupBy, S.Pivot)) for s in steps)
    whole = any(isinstance(s, (S.Distinct, S.Intersect, S.Except)) for s in steps)
    if passes and not whole and not (changed_columns & (reads(steps) | set(prior.columns))):
        return prior
    return run(df.sparkSession, steps, df, **kw)
