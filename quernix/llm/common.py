"""What the operators share: table access, row keys, lineage cuts and byte-level word helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator; it sorts before every other id.
NULL_ID = -(2**63)

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to the given ones that the DataFrame does not use yet (case ignored)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset and all runs in one process (tests), one is made and set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quernix-"))
        root = sc.getCheckpointDir()
    return root


#: What ``cut`` wrote and ``discard`` has not deleted, oldest first.
_WRITTEN: list[str] = []


def written() -> int:
    """How many tables ``cut`` has written so far; a mark for ``discard``."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes what ``cut`` wrote after a mark, but for the last ``keep`` tables; for callers that know that nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    end = max(since, len(_WRITTEN) - keep)
    gone, _WRITTEN[since:end] = _WRITTEN[since:end], []
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table written once to the shared checkpoint folder and read back.

    Unlike ``checkpoint()`` it runs the last stage once, is compressed and columnar, and lets later
    reads prune columns; like it, it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quernix-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, rk, tx): the id with null as NULL_ID, a 64-bit key of the text, the text with null as empty.

    Rows that repeat an id are told apart by ``rk``; rows that repeat both are the same document twice.
    """
    tx = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(tx).alias("rk"), tx.alias("tx"))


def real_id(col: str = "did"):
    """The id as it was before ``keyed``."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


def among(df: DataFrame, h: str, wanted: DataFrame, bits: int = 22) -> DataFrame:
    """Rows whose 64-bit hash in column h may be among those in column h of wanted, by a bitmap of at most 2^(bits - 6) words (broadcast)."""
    slot, word, bit = fresh(df, "slot", "word", "bit")
    place = lambda c: F.shiftrightunsigned(c, 64 - bits)
    p = place(F.col("h"))
    bitmap = wanted.select(F.shiftright(p, 6).alias(word), p.bitwiseAND(63).cast("int").alias("b")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias(bit))
    d = df.withColumn(slot, place(F.col(h)))
    j = d.join(F.broadcast(bitmap), F.shiftright(F.col(slot), 6) == F.col(word))
    return j.where(F.expr(f"shiftrightunsigned(`{bit}`, CAST(`{slot}` & 63 AS INT)) & 1") == 1).drop(slot, word, bit)


#: Caches of this worker process; one process serves the tasks of all stages in turn.
_CACHES: list[dict] = []


def cache(d: dict) -> dict:
    """Registers a cache of an operator's workers; ``claim`` of another one empties it."""
    _CACHES.append(d)
    return d


def claim(mine: dict | None = None) -> None:
    """At the start of a task: empties the caches that other operators left in this process and returns their memory."""
    for d in _CACHES:
        if d is not mine:
            d.clear()
    trim()


def trim() -> None:
    """Gives memory that is free inside this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trim_driver(spark: SparkSession) -> str | None:
    """Gives memory that is free inside the driver's JVM, outside its heap, back to the system, and returns the JVM's answer; None where it has no such command.

    Compilers and the threads of each query leave it there, and it adds up over the queries of a session. The call goes by
    the interface's method, as the bean's own class is closed to reflection.
    """
    sc = spark.sparkContext
    java, javax, new = sc._jvm.java, sc._jvm.javax, sc._gateway.new_array

    def array(kind, *items):
        out = new(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    kinds = [java.lang.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    try:
        invoke = java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", array(java.lang.Class, *kinds))
        bean = javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = bean, "systemTrimNativeHeap", array(java.lang.Object, array(java.lang.String)), array(java.lang.String, "[Ljava.lang.String;")
        return invoke.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(java.lang.Object, *args))
    except Py4JError:  # another JVM
        return None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_P = 0x9E3779B97F4A7C55
_POW = np.array([pow(_P, i, 2**64) for i in range(64)], U64)


def _powers(n: int) -> np.ndarray:
    global _POW
    while len(_POW) < n:
        _POW = np.concatenate([_POW, _POW * U64(pow(_P, len(_POW), 2**64))])
    return _POW


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a buffer in which single spaces part them."""
    gaps = np.flatnonzero(buf == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word; blocks of words bound the scratch memory however long the text is."""
    out = np.empty(len(starts), U64)
    for a in range(0, len(starts), block):
        b = min(a + block, len(starts))
        s, e = starts[a:b], ends[a:b]
        lo, hi = int(s[0]), int(e[-1])
        piece = buf[lo:hi]
        width = np.diff(np.append(s, hi))
        at = np.arange(hi - lo) - np.repeat(s - lo, width)
        val = piece.astype(U64)
        val += U64(1)
        val[piece == 32] = 0
        val *= _powers(int(width.max()) + 1)[at]
        out[a:b] = mix(np.add.reduceat(val, s - lo) + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every k consecutive elements, by doubling."""
    q = 0xA24BAED4963EE407
    if len(h) < k:
        return np.empty(0, U64)
    parts, size, cur = {}, 1, h
    while True:
        parts[size] = cur
        if size * 2 > k:
            break
        cur = cur[: len(cur) - size] * U64(pow(q, size, 2**64)) + cur[size:]
        size *= 2
    out, done = None, 0
    for size in sorted(parts, reverse=True):
        while done + size <= k:
            p = parts[size]
            out = p if out is None else out[: len(p) - done] * U64(pow(q, size, 2**64)) + p[done : done + len(out)]
            done += size
    return mix(out[: len(h) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive elements, by doubling."""
    if len(x) < w:
        return x[:0]
    size, cur = 1, x
    while size * 2 <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    n = len(x) - w + 1
    return np.minimum(cur[:n], cur[w - size : w - size + n])
