"""Hierarchical multi-length packing.

A document's token ids (a closing id 0 appended) first fill whole windows of the longest tier; the
rest is routed to the shortest tier that holds it. Tiers are packed from long to short: a window takes
one piece of its tier, then pieces of shorter tiers that fit, and at last the head of one that does
not, so every window is exactly as long as its tier, a power of two, and needs no padding. Each task
keeps what is left over for its next step; only a task's last sequence can be short.

Windows are dealt to step groups of exactly ``group`` tokens: long ones first, each to the group with the most
room. As all windows are powers of two that divide the group, groups fill to the last token, and all groups of a
packing step get alike shares of every tier, so that training steps cost about the same. Windows that do not fill
a group wait for the next step; a task's last group can be short.

Rows of a task depend on its own input only, so a lost task is simply run again. Memory holds one step
of documents, whatever the size of the input. Document ids are whole numbers; tiers are powers of two.

Ids are those of the ``tokenizers`` vocabulary with control tokens read as ordinary text. Characters on
which its splitting rules are shared by the faster ``tiktoken`` build of the same vocabulary (checked in the tests)
go through that one, with a bounded table of words already seen; texts with any other character go
through ``tokenizers``.

Defined results: a null or empty text is the closing id alone; a null id stays null; repeated rows are
packed as often as they come; an empty table gives no rows; other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernix.llm.common import cache, claim, trim

TIERS, GROUP = (1024, 512, 256, 128), 8192
#: Bytes of words kept per worker (a speed-up alone: words beyond are worked out each time), and tokens per packing step.
TABLE, STEP = 40 << 20, 1 << 20
#: What an entry takes beside its characters and ids.
_ENTRY = 200
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, sequence_length long, step_group long, ids binary"


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes."""

    #: Characters for which both builds of the splitting rule agree: ASCII, Latin letters and common punctuation.
    _plain = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞€]*")
    #: A space beside other white space: the parts around it are not split independently.
    _wide = re.compile(r" \s|\s ")

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.path, self._slow = path, None
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.seen: dict[str, bytes] = {}
        self.held = 0

    @property
    def slow(self):
        """The other build, loaded for the first text that needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow

    def _all(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self._plain.fullmatch(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self._wide.search(text) or len(text) < 64:
            return self._all(text)
        head, *rest = text.split(" ")
        parts = list(map(self.seen.get, rest))
        if None in parts:
            at = [i for i, x in enumerate(parts) if x is None]
            got = self._new({rest[i] for i in at})
            if got is None:
                return self._all(text)
            for i in at:
                parts[i] = got[rest[i]]
        return self._all(head) + b"".join(parts)

    def _new(self, words: set[str]) -> dict[str, bytes] | None:
        """Ids of words that each follow a space; None if they cannot be told apart."""
        new = [w for w in words if w]
        ids = np.array(self.fast.encode_ordinary("".join([" " + w for w in new])), "<u4")
        # A word opens with a space and holds no other, so tokens that begin with one part the words again.
        at = (np.flatnonzero(self.opens[ids]) * 4).tolist() + [len(ids) * 4]
        if len(at) != len(new) + 1:
            return None
        data = ids.tobytes()
        got = {w: data[a:b] for w, a, b in zip(new, at, at[1:])}
        if self.held < TABLE:
            self.seen.update(got)
            self.held += sum(map(len, got)) + len(data) + _ENTRY * len(got)
        if "" in words:
            got[""] = self._all(" ")
        return got


_ENCODERS: dict[str, Encoder] = cache({})


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Pieces are (document, start, ids); sequences are lists of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.pool: dict[int, list] = {t: [] for t in self.tiers}
        self.done: list[tuple[int, list]] = []
        self.waiting = 0

    def route(self, doc, start: int, ids: np.ndarray) -> None:
        tier = min(t for t in self.tiers if t >= len(ids))
        self.pool[tier].append((doc, start, ids))
        self.waiting += len(ids)

    def add(self, doc, ids: np.ndarray) -> None:
        top, n = self.tiers[0], len(ids)
        whole = n - n % top
        for a in range(0, whole, top):
            self.done.append((top, [(doc, a, ids[a : a + top])]))
        if whole < n:
            self.route(doc, whole, ids[whole:])

    def _take(self, tier: int):
        p = self.pool[tier].pop()
        self.waiting -= len(p[2])
        return p

    def pack(self, last: bool) -> None:
        """Packs all that waits; what cannot fill a window of the shortest tier stays, or at the end goes out short."""
        small = self.tiers[-1]
        for t in self.tiers:
            while self.pool[t] and (self.waiting >= t or last and self.waiting >= small):
                # Near the end the longest tier that the rest fills takes over.
                size = t if self.waiting >= t else max(x for x in self.tiers if x <= self.waiting)
                room, out = size, []
                for s in self.tiers[self.tiers.index(t) :]:
                    while room and self.pool[s] and len(self.pool[s][-1][2]) <= room:
                        out.append(self._take(s))
                        room -= len(out[-1][2])
                        if s == t:
                            break
                while room:
                    s = next(x for x in reversed(self.tiers) if self.pool[x])
                    doc, start, ids = self._take(s)
                    out.append((doc, start, ids[:room]))
                    if len(ids) > room:
                        self.route(doc, start + room, ids[room:])
                    room -= len(out[-1][2])
                self.done.append((size, out))
        if last and self.waiting:
            rest = [self._take(t) for t in self.tiers for _ in range(len(self.pool[t]))]
            n = sum(len(p[2]) for p in rest)
            # Padded to the longest tier, unless it is itself a power of two.
            self.done.append((n if n & (n - 1) == 0 else self.tiers[0], rest))

    def drain(self, group: int, last: bool) -> list[list[tuple[int, list]]]:
        """The windows done so far as full groups; the rest waits, or at the end makes a short group."""
        windows, self.done = sorted(self.done, key=lambda x: -x[0]), []
        groups: list[list[tuple[int, list]]] = [[] for _ in range(sum(w[0] for w in windows) // group)]
        # (room taken, group): the group with the most room comes first.
        heap = [(0, i) for i in range(len(groups))]
        for w in windows:
            if heap and heap[0][0] + w[0] <= group:
                taken, i = heap[0]
                groups[i].append(w)
                heapq.heapreplace(heap, (taken + w[0], i))
            else:
                self.done.append(w)
        if last and self.done:
            groups.append(self.done)
            self.done = []
        return groups


def pack_documents(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, group: int = GROUP, closing_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, sequence_length (with padding), step_group, ids."""
    close = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim(_ENCODERS)
        base = TaskContext.get().partitionId() << 33
        enc, packer, totals = encoder(path), Packer(tiers), {}
        seq, step = 0, 0

        def out(last: bool):
            nonlocal seq, step
            rows = []
            for windows in packer.drain(group, last):
                for size, pieces in windows:
                    at = 0
                    for doc, start, ids in pieces:
                        rows.append((doc[0], start, len(ids), doc[1], base + seq, at, size, base + step, ids.tobytes()))
                        at += len(ids)
                    seq += 1
                step += 1
            cols = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 8 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        size = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(enc(text.as_py() or "") + close, "<u4")
                packer.add((doc, len(ids)), ids)
                size += len(ids)
                if size >= STEP:
                    packer.pack(False)
                    yield out(False)
                    size = 0
        packer.pack(True)
        yield out(True)
        trim()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)
