"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for the rest.

Base spans come from three patterns (assign, access, hex). The method adds spans of kind novel. A candidate is
a run of CANDIDATE or more characters of tokens and paths that is more than a word or a number, in sensitive
context: a sensitive word within NEAR characters before it or after it, or a span reported that near before it
(so that a secret of several lines is followed). Its novelty is what it adds to the compressed text
around it, under a dictionary of identifiers, over what random strings of its alphabet and length add at the same place:
words and names are explained by the dictionary and the surroundings, a secret is not. Measuring inside the
text matters: by itself a short string is stored as it is, whatever it says. The least novelty to report is
fitted to a labelled table of made-up names and secrets. Lines of a PEM private key are reported without a measure.

The dictionary is made from the names in the standard library of the driver's Python and is sent with the tasks (some 200 kB).

Defined results: a null or empty text has no spans; offsets count code points; a null id stays null; words
(letters of one case or with one capital) under WORD characters and numbers (digits with separators) are no candidates;
repeated rows are scanned each; an empty table gives no rows; other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

import builtins
import importlib
import keyword
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernix.llm.common import claim, trim

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: How long a candidate is, how long a word may be, how near a sensitive word stands, and text used as surroundings on either side.
CANDIDATE, WORD, NEAR, AROUND = 12, 20, 64, 1024
_SENSITIVE = re.compile(r"(?ai:pass|pwd|secret|token|key|auth|bearer|cred|private|login|session|cookie|signature)")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=~-]{{{CANDIDATE},}}")
_WORD, _NUMBER = re.compile(r"[A-Za-z][a-z]*|[A-Z]+"), re.compile(r"[0-9+/_=~-]+")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----(.*?)(?:-----END|\Z)", re.S)
_PEM_LINE = re.compile(r"(?m)^[ \t]*([A-Za-z0-9+/]+={0,2})[ \t\r]*$")
_D, _U, _L = string.digits, string.ascii_uppercase, string.ascii_lowercase
_ALPHABETS = (_D + "abcdef", _D + "ABCDEF", _D + "abcdefABCDEF", _U + "234567", _L + "234567", _D + _L, _D + _U, _D + _L + _U, _D + _L + _U + "+/", _D + _L + _U + "-_", _D + _L + _U + "+/_=~-")
#: Modules whose names make the dictionary.
_MODULES = (
    "argparse ast asyncio base64 calendar collections configparser csv ctypes datetime decimal email.message functools ftplib getpass gzip hashlib heapq hmac html.parser http.client http.cookies http.server imaplib inspect io ipaddress itertools json logging logging.handlers "
    "mailbox math mimetypes multiprocessing os pathlib pickle platform poplib queue random re sched secrets select shutil signal smtplib socket socketserver sqlite3 ssl statistics string subprocess sysconfig tarfile tempfile textwrap threading time tokenize traceback types typing unittest urllib.parse urllib.request uuid warnings wave weakref xml.etree.ElementTree xmlrpc.client zipfile"
)
_LEVEL = 9
#: Stands before every measured text, so that a candidate without surroundings is not stored as it is.
_SETTING = "import sys\n\ndef read(path, size):\n    with open(path) as lines:\n        return [line.strip() for line in lines if line]\n\nIt was a long day for all of the people in that town, and there was more to come.\n"
#: How much worse a missed secret is than a name reported.
_MISSED = 5
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")


@lru_cache(1)
def identifiers() -> tuple[list[str], list[str]]:
    """Names of the standard library's modules, their members and arguments; and the words they are made of."""
    names = set(keyword.kwlist) | set(dir(builtins))
    for name in _MODULES.split():
        try:
            module = importlib.import_module(name)
        except ImportError:  # left out of this Python
            continue
        for member in dir(module):
            thing = getattr(module, member, None)
            code = getattr(thing, "__code__", None)
            names |= {member, *(dir(thing) if isinstance(thing, type) else ()), *getattr(code, "co_varnames", ())}
    names = sorted(n for n in names if len(n) > 2 and not n.startswith("__"))
    return names, sorted({w.lower() for n in names for w in _PART.findall(n) if len(w) > 2})


@lru_cache(1)
def dictionary() -> bytes:
    names, words = identifiers()
    return " ".join([*map(str.upper, words), *words, *map(str.capitalize, words), *names]).encode()


class Novelty:
    """Measures under one dictionary."""

    def __init__(self, names: bytes):
        import zstandard as z

        d = z.ZstdCompressionDict(names, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=_LEVEL)
        self._frame = z.ZstdCompressor(level=_LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress

    def added(self, strings: list[str], before: str, after: str) -> list[int]:
        """Bytes that each string adds between the two texts."""
        a, b = (_SETTING + before).encode(), after.encode()
        alone = len(self._frame(a + b))
        return [len(self._frame(a + s.encode() + b)) - alone for s in strings]

    def __call__(self, s: str, before: str = "", after: str = "") -> float:
        """What s adds, over what random strings of its alphabet and length add."""
        got, *rest = self.added([s, *_random_like(_alphabet(s), len(s))], before, after)
        return got * len(rest) / max(1, sum(rest))


def _alphabet(s: str) -> str:
    return next(a for a in _ALPHABETS if set(s.rstrip("=")) <= set(a))


@lru_cache(512)
def _random_like(alphabet: str, n: int) -> tuple[str, ...]:
    """A few random strings, longer ones fewer; the same for the same arguments."""
    r = random.Random(n)
    return tuple("".join(r.choices(alphabet, k=n)) for _ in range(4 if n <= 512 else 1))


def labelled(n: int = 240) -> list[tuple[str, bool]]:
    """Made-up names (False), a third of whose words are in no dictionary, and secrets (True)."""
    r = random.Random(11)
    words = [w for w in identifiers()[1] if len(w) > 3]
    made = lambda: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randrange(2, 4)))
    out = []
    for i in range(n):
        ws = [made() if r.random() < 1 / 3 else r.choice(words) for _ in range(r.randrange(3, 6))] + [str(r.randrange(100))]
        name = ("_".join(ws), "-".join(ws), ws[0] + "".join(map(str.capitalize, ws[1:])), "_".join(ws).upper())[i % 4]
        out += [(name, False), ("".join(r.choices(_ALPHABETS[i % len(_ALPHABETS)], k=r.choice((16, 20, 24, 32, 40, 64)))), True)]
    return out


@lru_cache(1)
def least_novelty() -> float:
    """The threshold with the least errors on the labelled table, in code, in prose and between lines of a key."""
    measure, r = Novelty(dictionary()), random.Random(12)
    lines = ["\n".join("".join(r.choices(_ALPHABETS[8], k=64)) for _ in range(3)) for _ in range(2)]
    settings = (
        ("def load(path):\n    # key of the session\n    headers = {'Authorization': 'Bearer ", "'}\n    return requests.get(path)\n"),
        ("The summer brought many people to the town, and the token of it was ", " as they said.\n"),
        ("token " + lines[0] + "\n", "\n" + lines[1]),
    )
    # Names do not stand between lines of a key.
    got = sorted((measure(s, *at), secret) for s, secret in labelled() for at in settings[: 3 if secret else 2])
    best, least, cost = float("inf"), 1.0, 0
    names = sum(not secret for _, secret in got)
    below = 0
    for (x, secret), (y, _) in zip(got, got[1:]):
        cost += _MISSED * secret
        below += not secret
        if x < y and cost + names - below < best:
            best, least = cost + names - below, (x + y) / 2
    return least


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class _Spans:
    """Spans added in order of their starts; asks whether one overlaps them or follows one closely."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []  # the furthest end so far
        for a, b in sorted(spans):
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        self.starts.append(a)
        self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def overlap(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def before(self, a: int, near: int) -> bool:
        i = bisect_right(self.ends, a)
        return i > 0 and a - self.ends[i - 1] <= near


def is_candidate(s: str) -> bool:
    """More than a number or a word."""
    return not (_NUMBER.fullmatch(s) or len(s) < WORD and _WORD.fullmatch(s))


def novel_spans(text: str, base: list[tuple[int, int, int]], measure: Novelty | None = None, least: float | None = None) -> list[tuple[int, int, int]]:
    if not _SENSITIVE.search(text):
        return []
    measure, least = measure or Novelty(dictionary()), least_novelty() if least is None else least
    known = _Spans([(a, b) for a, _, b in base])
    lines = [(m.start(1) + x.start(1), m.start(1) + x.end(1)) for m in _PEM.finditer(text) for x in _PEM_LINE.finditer(m[1])]
    lines = [(a, b) for a, b in lines if not known.overlap(a, b)]
    out, keys, found = [(a, 3, b) for a, b in lines], _Spans(lines), _Spans()
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if not is_candidate(m[0]) or known.overlap(a, b) or keys.overlap(a, b):
            continue
        sensitive = _SENSITIVE.search(text, max(0, a - NEAR), a) or _SENSITIVE.search(text, b, b + NEAR) or known.before(a, NEAR) or found.before(a, NEAR)
        if sensitive and measure(m[0], text[max(0, a - AROUND) : a], text[b : b + AROUND]) >= least:
            out.append((a, 3, b))
            found.add(a, b)
    return sorted(out)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], names: bytes, least: float) -> Iterator[pa.RecordBatch]:
    claim()
    measure = Novelty(names)
    for b in batches:
        rows = []
        for did, t in zip(b.column(0).to_pylist(), b.column(1)):
            text = t.as_py() or ""
            base = base_spans(text)
            n = [0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            novel = novel_spans(text, base, measure, least)
            rows.append((did, *n, len(novel), _join(base), _join(sorted(base + novel))))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base", "spans"])
    trim()


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, counts by kind, base spans and all spans as kind:start:end lists."""
    names, least = dictionary(), least_novelty()
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lambda it: _scan(it, names, least), "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string")
