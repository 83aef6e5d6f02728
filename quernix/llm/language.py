"""Language ID: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

Byte n-grams of the lower-cased text are hashed into BUCKETS rows of an embedding; a document is the
average of its rows. Embedding and softmax are trained in numpy, in one task, by stochastic gradient descent on at
most PER_LANGUAGE labelled documents of each language (a documented bound; they are chosen by a hash of
their ids). As the model is linear after averaging, prediction needs one small table of scores per
bucket. A temperature is fitted on a held-back part of the sample, and the rejection threshold is the
confidence that all but reject_share of its right answers reach, never above MAX_THRESHOLD.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if no
label can be learned from; a null id is held out like the text "null" would not be: its remainder is
taken as 0; repeated rows are predicted each; an empty table gives no rows; other columns are ignored.
Ids to learn from are whole numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernix.llm.common import claim, trim, trim_driver

BUCKETS, DIMS, PER_LANGUAGE, EPOCHS, SEED = 1 << 13, 16, 500, 12, 7
REJECT_SHARE, MAX_THRESHOLD = 0.001, 0.5
BLOCK = 1 << 20


def grams(data: bytes) -> np.ndarray:
    """How often each bucket occurs among the 2-, 3- and 4-grams of the bytes."""
    out = np.zeros(BUCKETS, np.int64)
    data = b" " + data.lower() + b" "
    for i in range(0, max(1, len(data) - 3), BLOCK):
        b = np.frombuffer(data[i : i + BLOCK + 3], np.uint8).astype(np.uint32)
        h = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        out += np.bincount((h[:BLOCK] ^ (h[:BLOCK] >> 15)) % BUCKETS, minlength=BUCKETS)
        for k, p in ((2, 0xC2B2AE3D), (3, 0x27D4EB2F)):
            h = h[:-1] * np.uint32(0x01000193) + b[k:] * np.uint32(p)
            out += np.bincount((h[:BLOCK] ^ (h[:BLOCK] >> 15)) % BUCKETS, minlength=BUCKETS)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(1, counts.sum()) + self.bias

    def predict(self, data: bytes) -> tuple[str, float]:
        z = self.logits(grams(data)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        i = int(p.argmax())
        return self.langs[i], float(p[i])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shares of the buckets, a row each; rows are (buckets, counts)."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, (at, n) in enumerate(rows):
        x[k, at] = n / max(1, n.sum())
    return x


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str]) -> Model:
    """SGD on average embeddings; every tenth row of the sample is held back for calibration. Rows stay sparse; a batch at a time is made dense."""
    rng = np.random.default_rng(SEED)
    back = np.arange(len(x)) % 10 == 9 if len(x) >= 20 else np.zeros(len(x), bool)
    fit = np.flatnonzero(~back)
    e = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIMS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    one = np.eye(len(langs), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = 4.0 * (1 - epoch / EPOCHS)
        for i in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            xs = dense([x[j] for j in i.tolist()])
            v = xs @ e
            z = v @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - one[y[i]]) / len(i)
            dv = d @ w.T
            w -= rate * (v.T @ d)
            b -= rate * 0.1 * d.sum(0)
            e -= 16 * rate * (xs.T @ dv)
    m = Model(langs, (e @ w).astype(np.float64), b.astype(np.float64))
    held = np.flatnonzero(back) if back.any() else fit
    z = np.concatenate([dense([x[j] for j in part.tolist()]) @ m.table + m.bias for part in np.array_split(held, len(held) // 256 + 1)])
    loss = lambda t: -np.mean((z / t)[np.arange(len(held)), y[held]] - np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1)) - z.max(1) / t)
    m.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = np.exp((z - z.max(1, keepdims=True)) / m.temperature)
    p = p / p.sum(1, keepdims=True)
    right = p.argmax(1) == y[held]
    m.threshold = float(min(np.quantile(p.max(1)[right], REJECT_SHARE), MAX_THRESHOLD)) if right.any() else 0.0
    return m


def learn(rows: list[tuple[str, int | None, bytes, bytes]]) -> Model:
    """The model of rows (language, id, buckets, counts), in whatever order they come."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0], r[2], r[3]))
    names = sorted({r[0] for r in rows})
    x = [(np.frombuffer(at, "<i4"), np.frombuffer(n, "<i4")) for *_, at, n in rows]
    return train(x, np.array([names.index(r[0]) for r in rows]), names)


def remainder(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Trains on a bounded sample of the labelled rows that are not held out; None if there are none."""
    d = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col) != 0))
    langs = d.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).collect()  # one row per language
    if not langs:
        return None
    slot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    share = F.lit(0).cast("long")
    for r in langs:
        share = F.when(F.col(lang_col) == r["l"], int(min(1.0, per_language / r["n"]) * (1 << 30))).otherwise(share)
    d = d.where(slot < share).select(F.col(lang_col).alias("l"), F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [grams(t.as_py()) for t in b.column(2)]
            at = [np.flatnonzero(g) for g in got]
            arrays = [b.column(0), b.column(1), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([g[a].astype("<i4").tobytes() for g, a in zip(got, at)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["l", "i", "at", "n"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        if rows := [tuple(r.values()) for b in batches for r in b.to_pylist()]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(rows))], pa.binary())], ["model"])
        rows.clear()
        trim()

    # The share bounds the sample but for ids that repeat; twice the quota is a hard bound, and which rows it keeps
    # depends on them alone. A row is bounded by the number of buckets. One task learns, so the driver gets the model only.
    f = d.mapInArrow(features, "l string, i long, at binary, n binary")
    f = f.orderBy(F.xxhash64("i", "l", "at", "n")).limit(2 * per_language * len(langs)).coalesce(1)
    got = f.mapInArrow(learned, "model binary").collect()
    trim_driver(df.sparkSession)
    return pickle.loads(got[0]["model"]) if got else None


def identify(df: DataFrame, model: Model | None, text_col: str = "text", columns: list[Column] = (), schema: str = "") -> DataFrame:
    """lang_pred, score and rejected after the given columns (their schema as DDL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1):
                t = t.as_py()
                if t is None or model is None or not has_letter(t):
                    out.append(("und", 0.0, True))
                else:
                    lang, score = model.predict(t.encode())
                    out.append((lang, score, score < model.threshold))
            got = list(zip(*out)) or [()] * 3
            arrays = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    text = df.select(*columns, F.col(text_col).alias("_text"))
    return text.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double, rejected boolean")


def drop_rejected(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language the calibrated model accepts; columns stay as they are."""
    model = fit(df, id_col, text_col, lang_col)
    at = df.columns.index(text_col)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in batches:
            ok = []
            for t in b.column(at):
                t = t.as_py()
                ok.append(t is not None and model is not None and has_letter(t) and model.predict(t.encode())[1] >= model.threshold)
            yield b.filter(pa.array(ok, pa.bool_()))
        trim()

    return df.mapInArrow(run, df.schema).toDF(*names)
