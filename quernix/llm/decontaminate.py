"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitals inside a sentence) and units after a number turn into
typed placeholders, other words lose case and outer punctuation. Windows of WINDOW template tokens of the
benchmark (whole items where those are shorter) meet those of the documents in a hash join. A capitalised word
that opens a sentence or a line may be a name or not, so its windows have both forms. Every window also has a literal
form (all its words without case, values included), which meets what the templates cannot: windows in
which placeholders outnumber words, and copies in other case.

Within one document, item, alignment and form the slot values must be consistent: one value of the item
always stands for one value of the document, and the other way round. The item is found in the document if
consistent windows cover at least MIN_COVER of the item's windows, or of its windows that have a template; it is
verbatim if all of its windows match literally (without case and outer punctuation), else re-parameterised or in part.

Documents shuffle only the windows that a bitmap of fixed size, built from the benchmark, lets through.
Items with equal templates and slots are one item (the smallest item_id stands for them).

Defined results: null and empty texts and items match nothing, as do items without letters; windows in
which placeholders outnumber words, and name forms with fewer than MIN_WORDS words, have no template and match
literally only; common words (_PLAIN) are never names; a null document id stays null; repeated rows
give repeated results; empty tables give no rows; other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quernix.llm.common import NULL_ID, U64, cache, claim, cut, fresh, keyed, real_id, roll, trim

WINDOW, MIN_COVER, MIN_WORDS, BITS = 8, 0.5, 4, 24
#: Words kept per worker (a speed-up alone), and characters of texts that are read at a time (a longer text is read by itself).
TABLE, STEP = 250_000, 1 << 18
#: form: 0 a template whose sentence openers are words, 1 one whose openers are names, 2 a template without openers, 3 literal.
_SCHEMA = "did long, rk long, pos long, w long, size int, form int, template string, slots array<string>"
#: Fixed values.
_DIGITS = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|k|m)?")
_NUMBER_WORDS = frozenset(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
)
_UNITS = frozenset("km m cm mm kg g mg lb lbs oz l ml mile miles meter meters metre metres foot feet inch inches hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees litre litres liter liters gram grams kilogram kilograms ton tons mph kmh".split())
_PLAIN = frozenset("a an the this that these those what which who whom whose how when where why if is are was were do does did can could should would has have had in on at of for from to by with and or but not no each every all some many it its he she they we you his her their our your there then after before during suppose find calculate compute".split())
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—·•¿¡"
_CLOSERS = "\"'”’)»"
_ENDS, _CAP, _NUMBER, _UNIT, _EMPTY = 1, 2, 4, 8, 16
_LITERAL = U64(0x4234567890ABCDE7)
_MARK = {k: U64(v) for k, v in {"N": 0x1234567890ABCDE1, "A": 0x2234567890ABCDE3, "U": 0x3234567890ABCDE5}.items()}


def is_number(low: str) -> bool:
    """Digits with signs and marks, or number words, also joined by hyphens."""
    return bool(_DIGITS.fullmatch(low)) or all(x in _NUMBER_WORDS for x in low.split("-"))


class _Words(dict):
    """Word to (59-bit hash of its literal form << 5 | flags) in eight bytes; bounded in words and their length, words beyond the bound are worked out each time."""

    def __missing__(self, w: str) -> bytes:
        core = w.strip(_EDGE)
        low = core.lower()
        last = w[-1]
        if last in _CLOSERS:
            last = w.rstrip(_CLOSERS)[-1:]
        flags = _ENDS * (last in (".", "!", "?"))
        if not core:
            flags |= _EMPTY
        elif low in _UNITS:
            flags |= _UNIT | _CAP * core[0].isupper()
        elif core[0].isupper():
            flags |= _CAP * (low not in _PLAIN) | _NUMBER * is_number(low)
        elif not core.isalpha() or low in _NUMBER_WORDS:
            flags |= _NUMBER * is_number(low)
        v = ((xxh64_intdigest(low) >> 5) << 5 | flags).to_bytes(8, "little")
        if len(self) < TABLE and len(w) < 64:
            self[w] = v
        return v


_WORDS = cache(_Words())


class Templates:
    """The tokens of some texts: ``doc`` (which text), ``pos`` (place in it) and the hashes and kinds of each form.

    Kinds: 0 a word, else the letter of its placeholder; ``named`` and ``opened`` have the openers of sentences and lines as names.
    """

    def __init__(self, texts: list[str]):
        lines = [[x.split() for x in t.splitlines()] for t in texts]
        self.words = list(chain.from_iterable(chain.from_iterable(lines)))
        v = np.frombuffer(b"".join(map(_WORDS.__getitem__, self.words)), "<u8")
        flags = (v & U64(31)).astype(np.uint8)
        # A token opens a sentence after an end mark, and at the start of a line.
        start = np.ones(len(v), bool)
        if len(v):
            start[1:] = (flags[:-1] & _ENDS) > 0
            ends = np.cumsum([len(x) for t in lines for x in t])
            start[ends[ends < len(v)]] = True
        sizes = [sum(map(len, t)) for t in lines]
        self.at = np.flatnonzero((flags & _EMPTY) == 0)
        v, flags, start = v[self.at], flags[self.at], start[self.at]
        self.doc = np.repeat(np.arange(len(texts)), sizes)[self.at]
        first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.pos = np.arange(len(v)) - first[self.doc]
        number = (flags & _NUMBER) > 0
        # A unit follows a number, also over the end of a line; in another text it does not.
        unit = (flags & _UNIT) > 0
        unit &= np.concatenate([[False], number[:-1]])[: len(v)] & (self.pos > 0)
        cap = ((flags & _CAP) > 0) & ~number & ~unit
        word = v >> U64(5)
        self.literal = word ^ _LITERAL
        self.hashes, self.kinds = word, np.zeros(len(v), np.uint8)
        for k, on in (("N", number), ("U", unit), ("A", cap & ~start)):
            self.hashes[on] = _MARK[k]
            self.kinds[on] = ord(k)
        self.opened, self.named = self.hashes.copy(), self.kinds.copy()
        self.opened[cap & start] = _MARK["A"]
        self.named[cap & start] = ord("A")

    def spell(self, a: int, b: int, kinds: np.ndarray | None) -> tuple[str, list[str]]:
        """The template of tokens [a, b) in letters, and its slot values; both without case."""
        low = [self.words[i].strip(_EDGE).lower() for i in self.at[a:b].tolist()]
        if kinds is None:
            return " ".join(low), []
        ks = kinds[a:b].tolist()
        return " ".join(chr(k) if k else w for k, w in zip(ks, low)), [w for k, w in zip(ks, low) if k]


def windows(t: Templates, sizes: list[int], bitmap: np.ndarray | None) -> Iterator[tuple]:
    """(text, position, window hash, size, form, template, slots) of the windows of the given sizes that may matter."""
    count = lambda x: np.concatenate([[0], np.cumsum(x > 0)])
    slots, more = count(t.kinds), count(t.named)
    for k in sizes:
        if len(t.doc) < k:
            continue
        whole = t.doc[k - 1 :] == t.doc[: len(t.doc) - k + 1]
        n, m = slots[k:] - slots[:-k], more[k:] - more[:-k]
        # Without an opener both templates are one.
        forms = [(t.hashes, t.kinds, whole & (2 * n <= k)), (t.literal, None, whole), (t.opened, t.named, whole & (m > n) & (2 * m <= k) & (k - m >= MIN_WORDS))]
        for i, (x, kinds, on) in enumerate(forms):
            if not on.any():
                continue
            w = roll(x, k) ^ U64(k * 0x9E3779B97F4A7C15 % 2**64)
            if bitmap is not None:
                p = w & U64((1 << BITS) - 1)
                on = on & (((bitmap[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1)) > 0)
            for j in np.flatnonzero(on).tolist():
                form = (2 if n[j] == m[j] else 0, 3, 1)[i]
                yield int(t.doc[j]), int(t.pos[j]), int(w[j].astype(np.int64)), k, form, *t.spell(j, j + k, kinds)


def _emit(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 8
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.string(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["did", "rk", "pos", "w", "size", "form", "template", "slots"])


def _item_windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for did, rk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            text = text.as_py()
            t = Templates([text])
            if len(t.doc) and any(map(str.isalpha, text)):
                rows += [(did, rk, *x[1:]) for x in windows(t, [min(len(t.doc), size)], None)]
        yield _emit(rows)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of about STEP characters at a time."""
    keys, texts, size = [], [], 0
    for b in batches:
        for did, rk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            keys.append((did, rk))
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= STEP:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def matches(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_cover: float = MIN_COVER) -> DataFrame:
    """(did, rk, item_id, n_windows, n_matched, n_slots, verbatim) for each item found in a document."""
    items = keyed(bench, item_col, item_text)
    # Items with one text are one item.
    items = items.groupBy("rk", "tx").agg(F.min("did").alias("did")).select("did", "rk", "tx")
    iw = cut(items.mapInArrow(lambda it: _item_windows(it, window), _SCHEMA))
    sizes = sorted(int(r[0]) for r in iw.select("size").distinct().collect())  # at most `window` values
    p = F.col("w").bitwiseAND((1 << BITS) - 1)
    words = iw.groupBy(F.shiftright(p, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(w & 63 AS INT))")).alias("m")).collect()  # at most 2^(BITS - 6) rows
    bitmap = np.zeros(1 << (BITS - 6), U64)
    for r in words:
        bitmap[r["i"]] = np.int64(r["m"]).astype(U64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches):
        claim(_WORDS)
        for keys, texts in _steps(batches):
            yield _emit([(*keys[x[0]], *x[1:]) for x in windows(Templates(texts), sizes, shared.value)])
        trim()

    dw = keyed(docs, id_col, text_col).mapInArrow(scan, _SCHEMA).select("did", "rk", F.col("pos").alias("dpos"), "w", "template", F.col("slots").alias("dslots"))
    template = F.col("form") != 3
    total = iw.groupBy("did", "rk").agg(F.countDistinct("pos").alias("n"), F.countDistinct(F.when(template, F.col("pos"))).alias("nt"))
    total = total.select(F.col("did").alias("item"), F.col("rk").alias("irk"), F.col("n").alias("n_windows"), F.col("nt"))
    iw = iw.select(F.col("did").alias("item"), F.col("rk").alias("irk"), F.col("pos").alias("ipos"), "w", "form", "template", F.col("slots").alias("islots"))
    pairs = F.arrays_zip("islots", "dslots")
    # Equal hashes are held against the templates themselves.
    j = dw.join(iw, ["w", "template"]).select("did", "rk", "item", "irk", (F.col("dpos") - F.col("ipos")).alias("line"), "ipos", "form", pairs.alias("pairs"))
    # Windows without an opener, and literal ones, count in both forms.
    both = F.array(F.lit(0), F.lit(1))
    j = j.withColumn("as", F.explode(F.when(F.col("form") < 2, F.array("form")).otherwise(both)))
    # One alignment of one item in one document: its size is bounded by the item's.
    a = j.groupBy("did", "rk", "item", "irk", "line", "as").agg(
        F.collect_set("ipos").alias("ip"),
        F.collect_set(F.when(template, F.col("ipos"))).alias("tp"),
        F.collect_set(F.when(~template, F.col("ipos"))).alias("lp"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("ps"),
    )
    # One value of the item stands for one of the document, and the other way round.
    a = a.where((F.size(F.array_distinct("ps.islots")) == F.size("ps")) & (F.size(F.array_distinct("ps.dslots")) == F.size("ps")))
    # Alignments are tried in turn by windows covered; parts of one item around an inserted word add up.
    many = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long")
    g = a.groupBy("did", "rk", "item", "irk").agg(
        many("ip").alias("n_matched"), many("tp").alias("mt"), many("ps").alias("n_slots"), many("lp").alias("n_literal")
    )
    covered = (F.col("n_matched") >= F.col("n_windows") * min_cover) | ((F.col("mt") > 0) & (F.col("mt") >= F.col("nt") * min_cover))
    g = g.join(total, ["item", "irk"]).where(covered)
    verbatim = F.col("n_literal") == F.col("n_windows")
    return g.select("did", "rk", F.when(F.col("item") != NULL_ID, F.col("item")).alias("item_id"), "n_windows", "n_matched", "n_slots", verbatim.alias("verbatim"))


def contaminated(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """Only what was found: doc_id, item_id, n_windows, n_matched, n_slots, verbatim."""
    return matches(docs, bench, **kw).select(real_id().alias("doc_id"), "item_id", "n_windows", "n_matched", "n_slots", "verbatim")


def drop_contaminated(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs in which no item is found; columns stay as they are."""
    did, rk = fresh(docs, "did", "rk")
    hit = cut(matches(docs, bench, id_col=id_col, text_col=text_col, **kw).select(F.col("did").alias(did), F.col("rk").alias(rk)).distinct())
    d = docs.withColumn(did, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(rk, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return d.join(hit, [did, rk], "left_anti").drop(did, rk)
