"""Exact substring deduplication by super-k-mer partitioning.

A window is k consecutive words of one document. Consecutive windows that share a minimiser (the least
hash of their m-word pieces) travel as one packed string to the minimiser's bucket. A bucket sorts its
windows, compares equal hashes byte for byte, and every window that also starts earlier (smaller id,
or same id and smaller position) marks its words for removal.

Skew: copies of a packed string inside a batch collapse before the shuffle, because all windows of the
later copy are known to be repeats. Minimisers that carry a large share of all windows are counted
first over the whole input; their windows are dealt further by a second, longer minimiser, and go through
LANES first: a lane drops the copies that it sees of one packed string, so that a bucket gets at most LANES
copies of a passage, however many documents hold it. The number of buckets follows the counted words, so a
bucket's memory does not depend on the size of the input.

Defined results: null and empty texts have no words; documents of fewer than k words keep them all; a
null id sorts before all others; rows that repeat an id compare by position only, so they never remove
each other at the same position; an empty table gives no rows; other columns are ignored. Ids are whole
numbers (or text that casts to them) above the least 64-bit number, which stands for null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernix.llm.common import U64, cut, keyed, mix, real_id, roll, sliding_min, word_bounds, word_hashes

K, M, M2 = 20, 3, 8
#: Bytes of text per step of a map task, and windows a bucket should hold.
STEP, BUCKET_WINDOWS, LANES = 4 << 20, 400_000, 64
_ROW = "bucket int, lane int, blob binary"


def _chunks(batches: Iterator[pa.RecordBatch], k: int):
    """(dids, rks, word counts, buffer) of documents with k words or more, in steps of about STEP bytes."""
    held, size = [], 0
    for b in batches:
        ids, rks = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i, data in enumerate(b.column(2)):
            norm = b" ".join(data.as_py().split())
            n = norm.count(b" ") + 1
            if n >= k:
                held.append((ids[i], rks[i], n, norm))
                size += len(norm)
            if size >= STEP:
                yield held
                held, size = [], 0
    if held:
        yield held


def _windows(held: list, k: int):
    """What the windows of a step are: buffer, word bounds, each window's first word and document, both minimisers."""
    buf = b" ".join(x[3] for x in held)
    arr = np.frombuffer(buf, np.uint8)
    starts, ends = word_bounds(arr)
    h = word_hashes(arr, starts, ends)
    counts = np.array([x[2] for x in held])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    doc = np.repeat(np.arange(len(held)), counts)
    n = len(h) - k + 1
    ok = np.flatnonzero(doc[:n] == doc[k - 1 :])
    low = sliding_min(roll(h, M), k - M + 1)
    return buf, starts, ends, h, ok, doc, first, low


def _shares(batches: Iterator[pa.RecordBatch], k: int, share: float) -> Iterator[pa.RecordBatch]:
    """Minimisers with at least that share of a step's windows, and under total the step's windows."""
    for held in _chunks(batches, k):
        *_, ok, _, _, low = _windows(held, k)
        v, c = np.unique(low[ok], return_counts=True)
        big = c >= max(2, share * len(ok))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(v[big].view(np.int64), 0)), pa.array(np.append(c[big], len(ok)).astype(np.int64)), pa.array([False] * int(big.sum()) + [True])], ["m", "n", "total"]
        )


def _pack(arrays: list[np.ndarray], text: bytes) -> bytes:
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=6).compress(len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a, np.int64).tobytes() for a in arrays) + text)


def _unpack(blob: bytes, arrays: int) -> tuple[list[np.ndarray], bytes]:
    from zstandard import ZstdDecompressor

    data = ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    return [np.frombuffer(data, np.int64, n, 8 + 8 * n * i) for i in range(arrays)], data[8 + 8 * n * arrays :]


def _lead(pieces: list[bytes], at: list[tuple[int, int]]) -> np.ndarray:
    """Which pieces repeat an equal one that starts earlier; ties are none."""
    best: dict[bytes, tuple[int, int]] = {}
    for p, t in zip(pieces, at):
        if t < best.get(p, (2**63, 0)):
            best[p] = t
    return np.fromiter((t > best[p] for p, t in zip(pieces, at)), bool, len(pieces))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "lane", "blob"])


def _deal(batches: Iterator[pa.RecordBatch], k: int, buckets: int, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed super-k-mers by bucket and lane (-1: none), and ranges already known to go (bucket -1 - b)."""
    for held in _chunks(batches, k):
        buf, starts, ends, h, ok, doc, first, low = _windows(held, k)
        key = low[ok]
        hot = np.isin(key, heavy)
        if hot.any():
            second = sliding_min(mix(roll(h, M2) ^ U64(0x5851F42D4C957F2D)), k - M2 + 1)[ok]
            key = np.where(hot, mix(key ^ mix(second)), key)
        cuts = np.flatnonzero((np.diff(ok) != 1) | (key[1:] != key[:-1])) + 1
        a = np.concatenate([[0], cuts])
        z = np.concatenate([cuts, [len(ok)]]) - 1
        w0, w1 = ok[a], ok[z] + k - 1
        d = doc[w0]
        dids, rks = np.array([x[0] for x in held], np.int64)[d], np.array([x[1] for x in held], np.int64)[d]
        pos, words = w0 - first[d], w1 - w0 + 1
        bucket = (mix(key[a]) % U64(buckets)).astype(np.int64)
        # A step's hot pieces share a lane; steps are spread over the lanes by what they begin with.
        lane = np.where(hot[a], int(h[0] % U64(LANES)), -1)
        pieces = [buf[s:e] for s, e in zip(starts[w0].tolist(), ends[w1].tolist())]
        # Of equal pieces only the earliest travels on; the rest repeat it whole.
        gone = _lead(pieces, list(zip(dids.tolist(), pos.tolist())))
        out = []
        if gone.any():
            g = np.flatnonzero(gone)
            out.append((-1 - int(bucket[g[0]]), -1, _pack([dids[g], rks[g], pos[g], pos[g] + words[g]], b"")))
        stay = np.flatnonzero(~gone)
        place = bucket * 2 + (lane >= 0)
        stay = stay[np.argsort(place[stay], kind="stable")]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(place[stay])) + 1, [len(stay)]])
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            s = stay[i:j]
            if len(s):
                out.append((int(bucket[s[0]]), int(lane[s[0]]), _pack([dids[s], rks[s], pos[s], words[s]], b" ".join([pieces[x] for x in s.tolist()]))))
        yield _batch(out)


class _Thin:
    """Of the equal pieces of a lane, keeps the earliest (several where they tie)."""

    def __init__(self):
        self.best: dict[bytes, tuple[tuple[int, int], set[tuple[int, int]]]] = {}

    def add(self, blob: bytes) -> pa.RecordBatch:
        """Takes a blob's pieces; returns the ranges that this shows to repeat an earlier piece."""
        (did, rk, pos, words), text = _unpack(blob, 4)
        starts, ends = word_bounds(np.frombuffer(text, np.uint8))
        end = np.cumsum(words)
        gone = []
        for d, q, r, n, s, e in zip(did.tolist(), pos.tolist(), rk.tolist(), words.tolist(), starts[end - words].tolist(), ends[end - 1].tolist()):
            piece, at = text[s:e], (d, q)
            lead, rows = self.best.setdefault(piece, (at, set()))
            if at < lead:
                gone += [(*lead, *x) for x in rows]
                self.best[piece] = (at, {(r, n)})
            elif at == lead:
                rows.add((r, n))
            else:
                gone.append((d, q, r, n))
        d, q, r, n = (np.array(x, np.int64) for x in zip(*gone)) if gone else (np.empty(0, np.int64),) * 4
        return _ranges(d, r, q, q + n)

    def blob(self) -> bytes:
        """What is left, packed."""
        kept = [(p, *at, r, n) for p, (at, rows) in self.best.items() for r, n in rows]
        d, q, r, n = (np.array(x, np.int64) for x in list(zip(*kept))[1:])
        return _pack([d, r, q, n], b" ".join([x[0] for x in kept]))


def _ranges(did, rk, lo, hi, bucket: int | None = None, blob: bytes | None = None) -> pa.RecordBatch:
    n = max(len(did), int(blob is not None))
    parts = [pa.array(x if blob is None else [None], pa.int64()) for x in (did, rk, lo, hi)]
    return pa.RecordBatch.from_arrays([*parts, pa.array([bucket] * n, pa.int32()), pa.array([blob] * n, pa.binary())], ["did", "rk", "lo", "hi", "bucket", "blob"])


_OUT = "did long, rk long, lo long, hi long, bucket int, blob binary"


def _resolve(blobs: list[bytes], k: int) -> pa.RecordBatch | None:
    """Ranges of words that repeated windows of one bucket cover."""
    parts = [_unpack(b, 4) for b in blobs]
    did, rk, pos, words = (np.concatenate([p[0][i] for p in parts]) for i in range(4))
    buf = b" ".join(p[1] for p in parts)
    del parts
    arr = np.frombuffer(buf, np.uint8)
    starts, ends = word_bounds(arr)
    run = np.repeat(np.arange(len(words)), words)
    begin = np.cumsum(words) - words
    w = roll(word_hashes(arr, starts, ends), k)
    ok = np.flatnonzero(run[: len(w)] == run[k - 1 :])
    w = w[ok]
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[1:] |= same
    twice[:-1] |= same
    c = order[twice]
    if not len(c):
        return None
    at = ok[c]
    r = run[at]
    d, q = did[r], pos[r] + (at - begin[r])
    o = np.lexsort((q, d, w[c]))
    at, r, d, q, hw = at[o], r[o], d[o], q[o], w[c][o]
    edges = np.concatenate([[0], np.flatnonzero(hw[1:] != hw[:-1]) + 1, [len(hw)]])
    heads = np.repeat(edges[:-1], np.diff(edges))
    later = (d > d[heads]) | (q > q[heads])
    # Equal hashes are compared byte for byte; a group that differs anywhere is grouped by its bytes.
    s, e = starts[at].tolist(), ends[at + k - 1].tolist()
    texts = [buf[x:y] for x, y in zip(s, e)]
    differs = {int(heads[i]) for i, (t, j) in enumerate(zip(texts, heads.tolist())) if t != texts[j]}
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if i in differs:
            lead: dict[bytes, tuple] = {}
            for x in range(i, j):
                first = lead.setdefault(texts[x], (d[x], q[x]))
                later[x] = (d[x], q[x]) > first
    g = np.flatnonzero(later)
    if not len(g):
        return None
    d, q, y = d[g], q[g], rk[r[g]]
    o = np.lexsort((q, y, d))
    d, q, y = d[o], q[o], y[o]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (y[1:] != y[:-1]) | (q[1:] > q[:-1] + k)])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(d)]]) - 1
    return _ranges(d[lo], y[lo], q[lo], q[hi] + k)


def _gather(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and lane; one bucket or lane is held at a time. Buckets give ranges, lanes also a blob for their bucket."""
    now, held, thin = None, [], None

    def close():
        if held and (r := _resolve(held, k)) is not None:
            yield r
        if thin is not None:
            yield _ranges([], [], [], [], now[0], thin.blob())

    for b in batches:
        for bucket, lane, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
            if bucket < 0:
                yield _ranges(*_unpack(blob, 4)[0])
                continue
            if (bucket, lane) != now:
                yield from close()
                now, held, thin = (bucket, lane), [], _Thin() if lane >= 0 else None
            if thin is None:
                held.append(blob)
            elif (r := thin.add(blob)).num_rows:
                yield r
    yield from close()


def repeated_ranges(d: DataFrame, k: int = K) -> DataFrame:
    """(did, rk, lo, hi): word ranges [lo, hi) of ``keyed`` documents that repeated windows cover; they may overlap."""
    spark = d.sparkSession
    d = d.withColumn("tx", F.col("tx").cast("binary"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = 1 / (4 * tasks)
    seen = cut(d.mapInArrow(lambda it: _shares(it, k, share), "m long, n long, total boolean"))
    total = seen.where("total").agg(F.sum("n")).first()[0] or 0
    # At most 4 * tasks minimisers can have that share of all windows.
    hot = seen.where("NOT total").groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, share * total)).collect()
    heavy = np.array(sorted(x["m"] for x in hot), np.int64).view(U64)
    buckets = max(4 * tasks, total // BUCKET_WINDOWS + 1)
    dealt = d.mapInArrow(lambda it: _deal(it, k, buckets, heavy), _ROW)
    ranges = ("did", "rk", "lo", "hi")
    lanes = dealt.repartition(tasks, "bucket", "lane").sortWithinPartitions("bucket", "lane")
    out = lanes.mapInArrow(lambda it: _gather(it, k), _OUT)
    if not len(heavy):
        return out.select(*ranges)
    out = cut(out)
    # What the lanes left of the hot buckets.
    hot = out.where("blob IS NOT NULL").select("bucket", F.lit(-1).alias("lane"), "blob").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return out.where("blob IS NULL").select(*ranges).unionByName(hot.mapInArrow(lambda it: _gather(it, k), _OUT).select(*ranges))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, kept = [], [], []
        for data, spans in zip(b.column(2), b.column(3)):
            words = data.as_py().split()
            size, spans = len(words), spans.as_py()
            if spans:
                # Right to left over merged ranges, so that earlier positions stay valid.
                spans = sorted((x["lo"], x["hi"]) for x in spans)
                merged = [list(spans[0])]
                for lo, hi in spans[1:]:
                    if lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                keep, last = [], 0
                for lo, hi in merged:
                    keep += words[last:lo]
                    last = hi
                words = keep + words[last:]
            n.append(size)
            gone.append(size - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["did", "rk", "n_words", "n_removed", "kept"])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed and the kept text (words joined by one space)."""
    d = keyed(df, id_col, text_col)
    spans = repeated_ranges(d, k).groupBy("did", "rk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = d.withColumn("tx", F.col("tx").cast("binary")).join(spans, ["did", "rk"], "left").select("did", "rk", "tx", "spans")
    out = joined.mapInArrow(_keep, "did long, rk long, n_words long, n_removed long, kept binary")
    return out.select(real_id().alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("text"))
