"""HTML main-text extraction from flat text blocks.

A page is read once into flat text blocks (text between block-level tags). Each block has its word count
and link density, those of its neighbours, its tag, and which kinds of containers it stands in. A decision
tree, trained on the small labelled table of ``html_labels``, decides which blocks are main text. Many pages of
that table have no telling names, so that the tree also works by counts; the names of classes and ids are
read word by word and give way to the structure: names on an article, or around one, say nothing about its text.

A page is read in time linear in its length, however broken it is.

Defined results: a null or empty page gives an empty text; character references are decoded, also
without a semicolon where HTML allows it; white space inside a block becomes one space; broken markup never fails
(an unclosed tag or comment ends with the page and is no text); text of math, svg, canvas and object elements is
text like any other; repeated rows are read each; an empty table gives no rows; other columns are ignored. Page
ids are whole numbers.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernix.llm.common import claim, trim

_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements without readable content, without an end tag, and inside a line of text.
_RAW = frozenset("iframe noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym annotation b bdi bdo big canvas cite code data del desc dfn em font g i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext nobr object q s samp semantics small span strike strong sub sup svg text time tspan tt u var wbr br".split()
)
_CLOSES_ITSELF = frozenset("dd dt li option p td th tr".split())
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _RAW}
KINDS = ("nav", "header", "footer", "side", "notice", "ad", "form", "comment", "article")
_BY_TAG = {"article": "article", "aside": "side", "button": "form", "dialog": "notice", "fieldset": "form", "footer": "footer", "form": "form", "header": "header", "main": "article", "menu": "nav", "nav": "nav", "option": "form", "select": "form", "textarea": "form"}
_BY_ROLE = {"alert": "notice", "alertdialog": "notice", "article": "article", "banner": "header", "complementary": "side", "contentinfo": "footer", "dialog": "notice", "form": "form", "main": "article", "menu": "nav", "menubar": "nav", "navigation": "nav", "search": "form"}
#: Words of class names and ids, in the singular.
_BY_WORD = {
    "nav": "breadcrumb menu nav navbar navigation pager pagination skiplink toc",
    "header": "banner header masthead topbar",
    "footer": "colophon copyright foot footer",
    "side": "aside complementary popular recommendation recommended related share sharing sidebar social trending widget",
    "notice": "alert consent cookie disclaimer gdpr modal notice overlay paywall popup toast",
    "ad": "ad adsense advert advertisement advertising advertorial promo promotion sponsor sponsored",
    "form": "form login newsletter search signup subscribe",
    "comment": "comment disqus replie reply respond",
    "article": "article content entry main post story",
}
_WORDS = {w: k for k, ws in _BY_WORD.items() for w in ws.split()}
#: Kinds that hold although the same element, or one around or inside it, is an article.
_STRONG = frozenset(("ad", "comment"))
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "paragraph", "page_article", *KINDS)


def _token_kind(token: str) -> str | None:
    """The kind that one class name or id tells: of its words, the last one that is not an article's."""
    kinds = [_WORDS.get(w) or _WORDS.get(w.removesuffix("s")) for w in map(str.lower, _WORD.findall(token))]
    kinds = [k for k in kinds if k]
    return next((k for k in reversed(kinds) if k != "article"), kinds[0] if kinds else None)


def _own(tag: str, attrs: str) -> tuple[set[str], set[str]]:
    """Kinds that the element's tag or role tells, and those that its names tell."""
    sure, said = {_BY_TAG[tag]} if tag in _BY_TAG else set(), set()
    if tag in ("html", "body") or "=" not in attrs and "hidden" not in attrs:
        return sure, said
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role":
            sure |= {_BY_ROLE[value.lower()]} if value.lower() in _BY_ROLE else set()
        elif name in ("class", "id"):
            said |= {k for k in map(_token_kind, value.split()) if k}
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            sure.add("notice")
    return sure, said


def _inside(around: frozenset, tag: str, attrs: str) -> frozenset:
    """Kinds of the blocks inside an element, from those around it and its own."""
    sure, said = _own(tag, attrs)
    if "article" in sure or "article" in said:
        said = {k for k in said if k in _STRONG or k == "article"}
        if "article" not in around and "comment" not in around:
            # The page around an article (a layout named after its sidebar, one form about all) is not its kind.
            around = frozenset(k for k in around if k in ("side", "ad") and f"<{k}" in around)
    new = sure | said
    if "article" in around:
        new.discard("header")  # a header inside the article is the article's own
    marks = {f"<{k}" for k in sure}
    return around | new | marks if new else around


def blocks(page: str) -> list[tuple[str, int, int, str, frozenset]]:
    """(text, words, words in links, tag, kinds of its containers) of every text block, in order."""
    out: list = []
    #: Open elements: tag, kinds inside it, and the innermost block-level tag.
    stack: list[tuple[str, frozenset, str]] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked: list[str] = []
    none: frozenset = frozenset()

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            _, kinds, tag = stack[-1] if stack else ("", none, "")
            out.append((text, len(text.split()), len(" ".join(linked).split()), tag, kinds))
        parts.clear()
        linked.clear()

    def say(raw: str):
        text = _html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if opened["a"]:
            linked.append(text)

    def pop():
        opened[stack.pop()[0]] -= 1

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            say(page[lt + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            if page.startswith(("!", "?", "/"), lt + 1):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                say("<")
                at = lt + 1
            continue
        if lt > last:
            break
        # Quotes may hide an end mark; one that never closes hides nothing.
        rest = _REST.match(page, m.end())
        at = rest.end() if rest else page.find(">", m.end()) + 1
        attrs = page[m.end() : at - 1]
        tag, closing = m[1].lower(), page[lt + 1] == "/"
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _RAW:
            if not closing and not attrs.endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else n
            continue
        block = tag not in _INLINE
        if block:
            flush()
            # Inline containers end with the block around them.
            while stack and stack[-1][0] in _INLINE:
                pop()
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _CLOSES_ITSELF and stack and stack[-1][0] in ("p", tag):
            pop()
        if tag in _VOID or attrs.endswith("/") and block:
            continue
        _, around, outer = stack[-1] if stack else ("", none, "")
        stack.append((tag, _inside(around, tag, attrs), tag if block else outer))
        opened[tag] += 1
    flush()
    return out


def features(bs: list) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(bs)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words = np.array([b[1] for b in bs], float)
    density = np.array([min(1.0, b[2] / max(1, b[1])) for b in bs])
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = words[:-1], density[:-1], words[1:], density[1:]
    out[:, 9] = any("article" in b[4] for b in bs)
    for i, b in enumerate(bs):
        tag = b[3]
        out[i, 6], out[i, 7], out[i, 8] = tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag in ("dd", "dt", "li", "td", "th"), tag in ("blockquote", "figcaption", "p", "pre")
        for k in b[4]:
            if k in KINDS:
                out[i, 10 + KINDS.index(k)] = 1
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14) -> tuple | float:
    """A classification tree by Gini gain: (feature, threshold, left, right) or the share of main text; equal gains go to the first feature."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return float(y.mean())
    best, at = 1e-9, None
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
    for j in range(x.shape[1]):
        vals = np.unique(x[:, j])
        for t in (vals[1:] + vals[:-1]) / 2:
            on = x[:, j] <= t
            gain = gini(y) - gini(y[on]) - gini(y[~on])
            if gain > best + 1e-9:
                best, at = gain, (j, float(t), on)
    if at is None:
        return float(y.mean())
    j, t, on = at
    return j, t, grow(x[on], y[on], depth - 1), grow(x[~on], y[~on], depth - 1)


_TREE = None


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled table."""
    from quernix.llm.html_labels import pages

    xs, ys = [], []
    for page in pages():
        bs = blocks(page)
        ys += [b[0][0] == "+" for b in bs]
        # The mark is no word of the block.
        xs.append(features([(b[0][2:], b[1] - 1, max(0, b[2] - (b[2] == b[1])), *b[3:]) for b in bs]))
    return np.concatenate(xs), np.array(ys, float)


def tree():
    global _TREE
    if _TREE is None:
        _TREE = grow(*labelled())
    return _TREE


def main_text(page: str, model=None) -> str:
    """The main text of a page: its blocks in order, one line each."""
    model = tree() if model is None else model
    bs = blocks(page)
    out = []
    for b, x in zip(bs, features(bs).tolist()):
        t = model
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        if t >= 0.5:
            out.append(b[0])
    return "\n".join(out)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: page_id, url, text, n_chars."""
    model = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in batches:
            texts = [main_text(t.as_py() or "", model) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        trim()

    d = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")
