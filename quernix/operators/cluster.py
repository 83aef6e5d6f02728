"""Seeded k-means over grouped rows of any size.

Seeding draws each next centre with probability in proportion to the squared distance, by an exponential race: the
row with the least -ln(u) / d^2 wins, where u hashes the row's features with the seed. Draws so
depend on the seed and the data alone, not on the partitioning. Each pass is one aggregation; centres (groups times k) live on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernix.errors import KMeansError
from quernix.functions.compile import compile_expr, is_decimal, numeric
from quernix.operators import outputs
from quernix.operators.regression import in_order, table
from quernix.plans import steps as S
from quernix.plans.engine import ORD, State, need, q

#: Rows of a block of a silhouette, which compares all pairs of a group block by block.
BLOCK = 2048


def kmeans_step(st: State, s: S.KMeans) -> State:
    seed, k = int(S.slot(s.seed)), int(S.slot(s.k))
    if k < 2 or s.restarts < 1 or s.max_iterations < 1 or not s.features:
        raise KMeansError("at least two clusters, one feature, one restart and one pass")
    names = [n for n, _ in s.features]
    if len(set(names)) < len(names):
        raise KMeansError("repeated features")
    if s.output == "assignments" and "cluster" in st.schema:
        raise KMeansError("cluster is already a column")
    if s.output not in ("assignments", "centres", "summary"):
        raise KMeansError(f"no output {s.output}")
    need(st.schema, *s.group_by)
    fs = []
    for n, e in s.features:
        x = compile_expr(e, st.schema)
        if not numeric(x.type) or is_decimal(x.type):
            raise KMeansError(f"{n} is {x.type}")
        fs.append(x.col.cast("double"))
    groups = [f"__g{i}" for i in range(len(s.group_by))] or ["__g0"]
    keys = [q(g) for g in s.group_by] or [F.lit(1)]
    d = st.df.withColumns({g: c for g, c in zip(groups, keys)} | {f"__f{j}": c for j, c in enumerate(fs)})
    x = [F.col(f"__f{j}") for j in range(len(fs))]
    stats = d.groupBy(*groups).agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{j}") for j, c in enumerate(x)], *[F.avg(c).alias(f"m{j}") for j, c in enumerate(x)], *[F.stddev_samp(c).alias(f"s{j}") for j, c in enumerate(x)]).collect()
    gk = lambda r: tuple(r[g] for g in groups)
    for r in stats:
        if r["n"] < k:
            raise KMeansError(f"{k} clusters of {r['n']} rows")
        if any(r[f"c{j}"] < r["n"] for j in range(len(x))):
            raise KMeansError("a null feature")
    if not stats:
        return table(st, outputs.kmeans_schema(s, st.schema), []) if s.output != "assignments" else State(d.withColumn("cluster", F.lit(None).cast("int")).select(*[q(n) for n in st.schema], "cluster", ORD), outputs.kmeans_schema(s, st.schema), True)
    if s.standardise:
        scale = {gk(r): [(r[f"m{j}"], r[f"s{j}"] or 0.0) for j in range(len(x))] for r in stats}
        d = beside(d, groups, {g: [[m for m, _ in v], [t for _, t in v]] for g, v in scale.items()}, "__sc")
        d = d.withColumns({f"__f{j}": F.when(F.col("__sc")[1][j] > 0, (F.col(f"__f{j}") - F.col("__sc")[0][j]) / F.col("__sc")[1][j]).otherwise(0.0) for j in range(len(x))}).drop("__sc")
    best: dict[tuple, dict] = {}
    # Every pass reads the features again; held by the executors (spilling), and computed anew where one is lost.
    held = d.select(*groups, *x, ORD).persist()
    try:
        for restart in range(s.restarts):
            centres = seeded(held, groups, x, k, seed, restart, gk)
            for g, m in lloyd(held, groups, x, centres, k, s.max_iterations, gk).items():
                if g not in best or m["ss"] < best[g]["ss"] * (1 - 1e-12):
                    best[g] = m
    finally:
        held.unpersist()
    schema = outputs.kmeans_schema(s, st.schema)
    own = lambda g: g if s.group_by else ()
    if s.output == "assignments":
        a = assigned(d, groups, x, {g: m["centres"] for g, m in best.items()}, {g: m["moved"] for g, m in best.items()})
        return State(a.withColumn("cluster", F.col("__c") + 1).select(*[q(n) for n in schema], ORD), schema, True)
    order = in_order(best)
    if s.output == "centres":
        return table(st, schema, [(*own(g), c + 1, *best[g]["centres"][c], best[g]["sizes"][c], best[g]["within"][c]) for g in order for c in range(k)])
    from decimal import Decimal

    wide = silhouettes(d, groups, x, best, gk) if s.silhouette else {}
    return table(st, schema, [(*own(g), k, s.restarts, best[g]["passes"], best[g]["ss"], best[g]["converged"], Decimal(seed), *([wide[g]] if s.silhouette else [])) for g in order])


def beside(d: DataFrame, groups: list[str], values: dict[tuple, list], name: str) -> DataFrame:
    """d joined with an array per group; the small side is a local table, so its size is known to the planner."""
    kinds = ", ".join(f"{g}_ {d.schema[g].dataType.simpleString()}" for g in groups)
    v = d.sparkSession.createDataFrame([(*g, x) for g, x in values.items()], f"{kinds}, {name} array<array<double>>")
    cond = None
    for g in groups:
        c = F.col(g).eqNullSafe(F.col(f"{g}_"))
        cond = c if cond is None else cond & c
    return d.join(v, cond).drop(*[f"{g}_" for g in groups])


def distances(x: list[Column], n: int) -> Column:
    """Squared distances to the first n centres in __cs."""
    one = lambda c: sum(((f - F.col("__cs")[c][j]) * (f - F.col("__cs")[c][j]) for j, f in enumerate(x[1:], 1)), (x[0] - F.col("__cs")[c][0]) * (x[0] - F.col("__cs")[c][0]))
    return F.array(*[F.struct(one(c).alias("d"), F.lit(c).alias("c")) for c in range(n)])


def seeded(d: DataFrame, groups, x, k, seed, restart, gk) -> dict[tuple, list]:
    centres: dict[tuple, list] = {}
    for j in range(k):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(restart), F.lit(j), *x), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        if j == 0:
            race, src = -F.log(u), d
        else:
            src = beside(d, groups, centres, "__cs")
            near = F.array_min(distances(x, j))["d"]
            race = F.when(near > 0, -F.log(u) / near).otherwise(F.lit(math.inf))
        got = src.groupBy(*groups).agg(F.min_by(F.array(*x), F.struct(race, F.xxhash64(*x))).alias("v")).collect()
        for r in got:
            centres.setdefault(gk(r), []).append(list(r["v"]))
    return centres


def assigned(d: DataFrame, groups, x, centres, moved) -> DataFrame:
    k = len(next(iter(centres.values())))
    near = F.array_min(distances(x, k))
    a = beside(d, groups, centres, "__cs").withColumn("__near", near).withColumn("__c", F.col("__near.c"))
    for g, rows in moved.items():
        for at, c in rows.items():
            hit = F.col(ORD) == at
            for name, v in zip(groups, g):
                hit = hit & F.col(name).eqNullSafe(F.lit(v))
            a = a.withColumn("__c", F.when(hit, c).otherwise(F.col("__c")))
    return a


def lloyd(d: DataFrame, groups, x, centres, k, passes, gk) -> dict[tuple, dict]:
    moved: dict[tuple, dict] = {g: {} for g in centres}
    state = {g: {"converged": False, "passes": 0} for g in centres}
    for i in range(1, passes + 1):
        moved = {g: {} for g in centres}
        new = means(assigned(d, groups, x, centres, moved), groups, x, gk)
        for g in centres:
            empty = [c for c in range(k) if c not in new[g]]
            if empty:
                far = d.where(_is(groups, g))
                far = beside(far, groups, {g: centres[g]}, "__cs").withColumn("__n", F.array_min(distances(x, k))["d"]).orderBy(F.desc("__n"), ORD).limit(len(empty)).collect()
                moved[g] = {r[ORD]: c for r, c in zip(far, empty)}
        if any(moved.values()):
            new = means(assigned(d, groups, x, centres, moved), groups, x, gk)
        done = True
        for g in centres:
            after = [new[g][c]["m"] if c in new[g] else centres[g][c] for c in range(k)]
            shift = max(abs(a - b) / max(1.0, abs(b)) for p, o in zip(after, centres[g]) for a, b in zip(p, o))
            if not state[g]["converged"]:
                state[g]["passes"] = i
                state[g]["converged"] = shift <= 1e-12
            done &= state[g]["converged"]
            centres[g] = after
        if done:
            break
    final = means(assigned(d, groups, x, centres, moved), groups, x, gk)
    for g in centres:
        row = [final[g].get(c, {"n": 0, "ss": 0.0}) for c in range(k)]
        state[g] |= {"centres": centres[g], "moved": moved[g], "sizes": [r["n"] for r in row], "within": [r["ss"] for r in row], "ss": sum(r["ss"] for r in row)}
    return state


def _is(groups, g) -> Column:
    out = F.lit(True)
    for name, v in zip(groups, g):
        out = out & F.col(name).eqNullSafe(F.lit(v))
    return out


def means(a: DataFrame, groups, x, gk) -> dict[tuple, dict[int, dict]]:
    dist = F.aggregate(F.sequence(F.lit(0), F.lit(len(x) - 1)), F.lit(0.0), lambda t, j: t + F.pow(F.get(F.array(*x), j) - F.get(F.get(F.col("__cs"), F.col("__c")), j), F.lit(2.0)))
    out: dict[tuple, dict[int, dict]] = {}
    for r in a.groupBy(*groups, "__c").agg(F.count("*").alias("n"), F.sum(dist).alias("ss"), *[F.avg(c).alias(f"m{j}") for j, c in enumerate(x)]).collect():
        out.setdefault(gk(r), {})[r["__c"]] = {"n": r["n"], "ss": r["ss"], "m": [r[f"m{j}"] for j in range(len(x))]}
    return out


def silhouettes(d: DataFrame, groups, x, best, gk) -> dict[tuple, float]:
    """Mean silhouette width; a row alone in its cluster counts 0.

    The width needs every row's distance to every other row of its group. Rows are packed into blocks of about
    BLOCK; each pair of blocks is one row of work, which gives the sums of distances to every cluster; no task holds a group.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    k = len(next(iter(best.values()))["centres"])
    sizes = {g: np.array(m["sizes"], float) for g, m in best.items()}
    nb = max(1, math.ceil(max(v.sum() for v in sizes.values()) / BLOCK))
    a = assigned(d, groups, x, {g: m["centres"] for g, m in best.items()}, {g: m["moved"] for g, m in best.items()})
    a = a.select(*groups, F.pmod(F.xxhash64(ORD), F.lit(nb)).cast("int").alias("blk"), F.array(*x).alias("v"), F.col("__c").cast("int").alias("c"))
    ddl = ", ".join(f"{g} {d.schema[g].dataType.simpleString()}" for g in groups)
    kinds = [to_arrow_type(d.schema[g].dataType) for g in groups]
    p = len(x)

    def key_of(t, i: int = 0) -> tuple:
        return tuple(t.column(g)[i].as_py() for g in groups)

    def row(key: tuple, more: dict) -> pa.Table:
        return pa.table({**{g: pa.array([v], t) for g, v, t in zip(groups, key, kinds)}, **more})

    def pack(t: pa.Table) -> pa.Table:
        v, c = np.array(t.column("v").to_pylist(), float), t.column("c").to_numpy().astype("<i4")
        return row(key_of(t), {"blk": pa.array([t.column("blk")[0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary())})

    def sums(batches):
        for b in batches:
            out = []
            for v, w, c in zip(*(b.column(n).to_pylist() for n in ("v", "w", "wc"))):
                v, w, c = np.frombuffer(v).reshape(-1, p), np.frombuffer(w).reshape(-1, p), np.frombuffer(c, "<i4")
                far = np.zeros((len(v), len(w)))
                for j in range(p):
                    far += (v[:, j, None] - w[None, :, j]) ** 2
                far = np.sqrt(far)
                out.append(np.column_stack([far[:, c == o].sum(1) for o in range(k)]).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(g) for g in groups), b.column("blk"), b.column("c"), pa.array(out, pa.binary())], [*groups, "blk", "c", "s"])

    def widths(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(v).reshape(-1, k) for v in t.column("s").to_pylist())
        c, n, at = np.frombuffer(t.column("c")[0].as_py(), "<i4"), sizes[key_of(t)], np.arange(len(s))
        near = s[at, c] / np.maximum(1, n[c] - 1)
        means = np.where(n > 0, s / np.maximum(1, n), np.inf)
        means[at, c] = np.inf
        other = means.min(1)
        top = np.maximum(near, other)
        w = np.where((n[c] == 1) | ~np.isfinite(other) | (top == 0), 0.0, (other - near) / np.where((top > 0) & np.isfinite(top), top, 1.0))
        return row(key_of(t), {"w": pa.array([float(w.sum())]), "n": pa.array([len(w)], pa.int64())})

    blocks = a.groupBy(*groups, "blk").applyInArrow(pack, f"{ddl}, blk int, v binary, c binary").persist()
    try:
        other = blocks.select(*[F.col(g).alias(f"{g}_") for g in groups], F.col("v").alias("w"), F.col("c").alias("wc"))
        cond = F.lit(True)
        for g in groups:
            cond = cond & F.col(g).eqNullSafe(F.col(f"{g}_"))
        pairs = blocks.join(other, cond).drop(*[f"{g}_" for g in groups]).repartition(max(nb, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("v"), F.xxhash64("w"))
        s = pairs.mapInArrow(sums, f"{ddl}, blk int, c binary, s binary")
        rows = s.groupBy(*groups, "blk").applyInArrow(widths, f"{ddl}, w double, n long").groupBy(*groups).agg((F.sum("w") / F.sum("n")).alias("w")).collect()
    finally:
        blocks.unpersist()
    return {gk(r): r["w"] for r in rows}
