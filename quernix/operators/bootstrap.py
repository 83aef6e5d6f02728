"""Seeded resampling: draws are random access into a SplitMix64 stream per group, so replicates spread over all tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernix.errors import BootstrapError
from quernix.functions.compile import numeric
from quernix.operators import outputs
from quernix.plans import steps as S
from quernix.plans.engine import ORD, State, aggregate, need, q, unique

_G = 0x9E3779B97F4A7C15
#: Draws of a replicate that one row stands for until they are drawn.
_BLOCK = 1 << 16


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draws(seed: int):
    """Column function (stream, index, n): the index-th answer of a group's stream in [0, n).

    The top 32 bits of a draw are taken, all 64 where n is larger. A draw below 2^bits mod n is rejected
    and mixed again in place, so that one rejection does not shift the draws after it.
    """

    @F.pandas_udf("long")
    def draw(stream: pd.Series, index: pd.Series, n: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            s = _mix(np.uint64(seed % 2**64) + (stream.to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(_G))
            z = s + (index.to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(_G)
            v, size = _mix(z), n.to_numpy().astype(np.uint64)
            wide = size > np.uint64(2**32)
            top = lambda: np.where(wide, v, v >> np.uint64(32))
            least = np.where(wide, np.uint64(0) - size, np.uint64(2**32) - np.minimum(size, np.uint64(2**32))) % size
            while (bad := top() < least).any():
                v = np.where(bad, _mix(v + np.uint64(_G)), v)
            return pd.Series((top() % size).astype(np.int64))

    return draw


def bootstrap_step(st: State, s: S.Bootstrap) -> State:
    seed, reps = int(S.slot(s.seed)), int(S.slot(s.replicates))
    if reps < 1 or not s.aggregates:
        raise BootstrapError("at least one replicate and one aggregate")
    if not 0 < s.level < 1:
        raise BootstrapError(f"a level of {s.level}")
    need(st.schema, *s.group_by, *([s.cluster] if s.cluster else []))
    unique(BootstrapError, [*s.group_by, "replicate", *(a.name for a in s.aggregates)])
    if s.output == "summary" and any(not numeric(aggregate(a, st.schema, True)[1].type) for a in s.aggregates):
        raise BootstrapError("a summary of an aggregate that is not a number")
    keys = [f"__g{i}" for i in range(len(s.group_by))]
    d = st.df.withColumns({k: q(g) for k, g in zip(keys, s.group_by)})
    by = Window.partitionBy(*keys)

    def match(left: DataFrame, right: DataFrame, ons) -> DataFrame:
        """A merge join: row counts don't follow from the size of the input's files, and a broadcast would pass the driver."""
        cond = None
        for x, y in ons:
            c = F.col(x).eqNullSafe(F.col(y))
            cond = c if cond is None else cond & c
        return left.join(right.hint("merge"), cond)

    # Units drawn (rows or clusters), numbered by first appearance; groups are numbered likewise.
    if s.cluster:
        d = d.withColumn("__u", q(s.cluster))
        units = d.groupBy(*keys, "__u").agg(F.min(ORD).alias("__at"))
        numbers = units.withColumn("__i", F.row_number().over(by.orderBy("__at")) - 1).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("__u").alias("__u_"), "__i")
        rows = match(d, numbers, [*[(k, f"{k}_") for k in keys], ("__u", "__u_")]).drop(*[f"{k}_" for k in keys])
    else:
        units = d.select(*keys, F.col(ORD).alias("__at"))
        rows = d.withColumn("__i", F.row_number().over(by.orderBy(ORD)) - 1)
    groups = units.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__at")).where("__n > 0")
    groups = groups.withColumn("__s", (F.row_number().over(Window.orderBy("__at")) - 1).cast("long")) if keys else groups.withColumn("__s", F.lit(0).cast("long"))
    order = groups.select(*[F.col(k).alias(f"{k}_") for k in keys], "__n", "__s")
    rows = match(rows, order.drop("__n"), [(k, f"{k}_") for k in keys]) if keys else rows.withColumn("__s", F.lit(0).cast("long"))
    rows = rows.select(*[q(n) for n in st.schema], F.col(ORD).alias("__o"), F.col("__s").alias("__rs"), F.col("__i").cast("long").alias("__i"))
    # Blocks of draws are dealt before they are drawn, to a fixed number of tasks: one group's replicates would otherwise sit in one.
    t = order.select("__s", "__n", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("__r"))
    t = t.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(_BLOCK).cast("long"))))
    t = t.repartition(int(st.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__s", "__r", "__b")
    t = t.withColumn("__t", F.explode(F.sequence("__b", F.least(F.col("__b") + _BLOCK, "__n") - 1)))
    # A draw that could be null would be drawn twice: for the join's null check and for the join.
    draw = F.coalesce(draws(seed)("__s", (F.col("__r") - 1) * F.col("__n") + F.col("__t"), "__n"), F.lit(-1).cast("long"))
    t = t.select("__s", "__r", "__t", draw.alias("__d"))
    # The one join over units times replicates; the number drawn is the first key, as sorts compare its prefix first.
    rows = t.join(rows.hint("merge"), (F.col("__d") == F.col("__i")) & (F.col("__s") == F.col("__rs"))).withColumn(ORD, F.struct("__t", F.col("__o").alias("o")))
    aggs = [aggregate(a, st.schema, True) for a in s.aggregates]
    names = [a.name for a in s.aggregates]
    group_cols = [q(g) for g in s.group_by]
    g = rows.groupBy(*group_cols, F.col("__r").alias("replicate"), "__s").agg(*[c.alias(n) for n, (c, _) in zip(names, aggs)])
    schema = outputs.bootstrap_schema(s, st.schema)
    if s.output == "replicates":
        g = g.withColumn(ORD, F.struct("__s", "replicate"))
        return State(g.select(*[q(n) for n in schema], ORD), schema, True)
    if s.output != "summary":
        raise BootstrapError(f"no output {s.output}")
    tail = (1 - s.level) / 2
    own = d.groupBy(*group_cols).agg(*[c.alias(f"__e{i}") for i, (c, _) in enumerate(aggs)]) if keys else d.groupBy(F.lit(1).alias("__one")).agg(*[c.alias(f"__e{i}") for i, (c, _) in enumerate(aggs)])
    # percentile interpolates at (n - 1) q.
    parts = [
        F.struct(F.lit(n).alias("aggregate"), F.lit(i).alias("i"), F.stddev_samp(q(n).cast("double")).alias("std_error"), F.percentile(q(n).cast("double"), F.lit(tail)).alias("lower"), F.percentile(q(n).cast("double"), F.lit(1 - tail)).alias("upper"))
        for i, n in enumerate(names)
    ]
    sm = g.groupBy(*group_cols, "__s").agg(*[p.alias(f"__p{i}") for i, p in enumerate(parts)])
    sm = sm.select(*[q(k).alias(f"{g_}_") for k, g_ in zip(s.group_by, keys)], "__s", *[f"__p{i}" for i in range(len(names))])
    if keys:
        own = own.withColumns({g_: q(k) for k, g_ in zip(s.group_by, keys)})
        j = match(own, sm, [(g_, f"{g_}_") for g_ in keys])
    else:
        j = own.crossJoin(sm)  # one row each
    cell = F.explode(F.array(*[F.struct(F.col(f"__p{i}").alias("p"), F.col(f"__e{i}").cast("double").alias("estimate")) for i in range(len(names))])).alias("__cell")
    j = j.select(*group_cols, "__s", cell)
    c = lambda n: F.col(f"__cell.p.{n}").alias(n)
    out = j.select(*group_cols, c("aggregate"), F.col("__cell.estimate").alias("estimate"), c("std_error"), c("lower"), c("upper"), F.struct("__s", F.col("__cell.p.i")).alias(ORD))
    return State(out, schema, True)
