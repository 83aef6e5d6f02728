"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than the usual bits-plus-one, so that two linked
fingerprints agree in some segment up to one bit. Each segment is indexed under every one-wildcard
variant; equal variants meet in an equality join that verifies the full distance in its condition,
and of all the variants in which a pair meets only the first one counts. Links join distinct
fingerprints (copies never expand into pairs), and components come from alternating star
contractions, each round cut to the shared folder.

Defined results: a null or empty text has fingerprint zero and links like any other; a null id takes
part in links but is never the smallest id of a component unless all of its ids are null; repeated
rows are returned as often as they come; an empty table gives no rows; other columns are ignored. Ids are
whole numbers (or text that casts to them) above the least 64-bit number, which stands for null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernix.llm.common import NULL_ID, claim, cut, fresh, keyed, real_id, trim, word_bounds

SHINGLE, MAX_BITS, SEGMENTS = 4, 4, ((0, 21), (21, 21), (42, 22))

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(data: bytes, n: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text as a signed 64-bit number."""
    from xxhash import xxh64_intdigest as xx

    words = data.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= n:
        hashes = [xx(norm, 42)]
    else:
        starts, ends = word_bounds(np.frombuffer(norm, np.uint8))
        hashes = [xx(norm[a:b], 42) for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist())]
    total = np.zeros((8, 8), np.int64)
    for i in range(0, len(hashes), 1 << 16):
        lanes = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.bincount((lanes + _LANE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    on = (2 * total > len(hashes)).ravel()
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim()
    for b in batches:
        out = [fingerprint(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["did", "rk", "fp"])
    trim()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, rk, fp) for every row."""
    d = keyed(df, id_col, text_col).withColumn("tx", F.col("tx").cast("binary"))
    return d.mapInArrow(_fingerprints, "did long, rk long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints in column fp that differ in at most MAX_BITS bits; each once."""
    fp = F.col("fp")
    seg = lambda x, off, n: F.shiftrightunsigned(x, off).bitwiseAND((1 << n) - 1)
    variants = [
        F.lit((off + i) << 32).bitwiseOR(seg(fp, off, n).bitwiseAND(((1 << n) - 1) & ~(1 << i)))
        for off, n in SEGMENTS
        for i in range(n)
    ]
    # Spread before the rows multiply: few fingerprints make many variants.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = nodes.select("fp").repartition(tasks, "fp").select("fp", F.explode(F.array(*variants)).alias("k"))
    a, b = keys.alias("a"), keys.alias("b")
    fa, fb = F.col("a.fp"), F.col("b.fp")
    x = fa.bitwiseXOR(fb)
    pos = F.shiftright(F.col("a.k"), 32)
    first, earlier = F.lit(False), F.lit(True)
    for off, n in SEGMENTS:
        d = F.bit_count(seg(x, off, n))
        here = (pos >= off) & (pos < off + n)
        first = first | (earlier & here & ((d == 1) | ((d == 0) & (pos == off))))
        earlier = earlier & (d > 1)
    # The planner does not see that the rows multiply, and would broadcast them all.
    return a.hint("merge").join(b.hint("merge"), (F.col("a.k") == F.col("b.k")) & (fa < fb) & (F.bit_count(x) <= MAX_BITS) & first).select(fa.alias("a"), fb.alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) connect each node with; nodes without edges are absent.

    Large-star and small-star contractions alternate until the forest is made of stars; the rounds grow
    with the logarithm of a component's diameter, and no task ever holds a component.
    """
    star = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    size = lambda e: e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    e = cut(star(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    now = size(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = star(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e, before = cut(star(small)), now
        now = size(e)
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of near_duplicates and root, the least fingerprint of the component: ids may be null or repeat across components, roots do not."""
    spark = df.sparkSession
    fps = cut(fingerprints(df, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min(real_id()).alias("low"), F.count("*").alias("n"))
    nodes = cut(nodes)
    pairs = cut(links(nodes))
    degree = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(pairs).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp").join(degree, "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = linked.join(lowest, "root").select("fp", "component_id", "n_links", "root")
    alone = nodes.join(linked, "fp", "left_anti").select("fp", F.col("low").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("fp").alias("root"))
    known = linked.unionByName(alone)
    # Fingerprints of a large share of all rows (empty texts, mass copies) meet their rows by broadcast: at most 4 * tasks of them have that share.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = [r["fp"] for r in nodes.where(F.col("n") >= max(2, total / (4 * tasks))).select("fp").collect()]
    if not hot:
        return fps.join(known, "fp").select(*_ROOTED)
    known, is_hot = cut(known), F.col("fp").isin(hot)
    few = F.broadcast(known.where(is_hot))
    return fps.where(~is_hot).join(known.where(~is_hot), "fp").select(*_ROOTED).unionByName(fps.where(is_hot).join(few, "fp").select(*_ROOTED))


_ROOTED = ("did", "rk", "fp", "component_id", "n_links", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: did, rk, fp, component_id (smallest reachable id), n_links of its fingerprint."""
    return _rooted(df, id_col, text_col).drop("root")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with one document of each component: the one with the smallest id (of rows that repeat
    that id, the one with the smallest text key; of rows that repeat both, one). Columns stay as they are."""
    did, rk = fresh(df, "did", "rk")
    # Partial aggregation by root: a large component sends one row per task.
    least = F.min(F.struct(real_id().isNull().alias("no_id"), "did", "rk")).alias("at")
    keep = _rooted(df, id_col, text_col).groupBy("root").agg(least).select("at.did", "at.rk")
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    d = df.withColumn(did, k).withColumn(rk, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    keep = keep.select(F.col("did").alias(did), F.col("rk").alias(rk))
    return d.join(keep, [did, rk], "left_semi").dropDuplicates([did, rk]).drop(did, rk)
