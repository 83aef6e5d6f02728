"""Line deduplication by a segment-partition edit join (DataFrame functions only).

Lines within TAU edits of each other are linked. A line is cut into TAU + 1 = 3 segments; by the
pigeonhole argument with edits counted from the left, a linked longer (or equal) line holds segment 1
at its start, segment 3 at its end, or segment 2 shifted by at most one. Segment lengths follow the
line's length class (a multiple of STEP), so neighbouring lengths share most probes. Index and probe
substrings meet as 64-bit keys in one equality join whose condition checks the lengths and a bound on
the counts of eight letters (one edit moves the counts by at most 2). What is left is verified on the texts
by a banded bit-parallel automaton: one bit per diagonal of the band, one number per count of errors. Shared
ends are cut off before, and lines whose automaton dies within LOOK characters are not read further.

The edits allowed follow the length: none in lines under min_chars, TAU from there. A line goes if an equal
or linked line starts earlier (smaller document id, or same id and smaller line number), judged on the
input: every line but the first of an equal group goes; the first goes too if a linked line starts earlier.

Scale: equal lines collapse by partial aggregation before any shuffle; the candidate join carries keys,
not texts; texts of candidates, and the lines of groups of equal or linked lines, are found again through a
bitmap of at most 2^16 words, whose size does not depend on the data; hot keys are split by the adaptive skew join.

Defined results: a null text stays null and has no lines; an empty text has one empty line; blank lines
always stay; a null id sorts before all others; rows that repeat an id compare by line number only; an
empty table gives no rows; all columns of the input come back, whatever their names. Ids are whole numbers
(or text that casts to them) above the least 64-bit number, which stands for null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernix.llm.common import NULL_ID, among, cut, fresh

TAU, STEP, MIN_CHARS = 2, 8, 30
#: Characters of the verification's first look at two lines, from where they begin to differ.
LOOK = 24
_LETTERS = "enthraoi"


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, rk, ln, line, h1, h2) of every line that is not blank; h1 and h2 are independent 64-bit hashes."""
    d = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text_col).alias("rk"), F.posexplode(F.split(text_col, "\n", -1)).alias("ln", "line")
    ).where(F.col("line").rlike(r"\S"))
    return d.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _counts(line: Column) -> Column:
    """Counts of eight letters, one byte each (capped at 255; the cap can only lower a difference)."""
    out = F.lit(0).cast("long")
    n = F.octet_length(line)
    for i, ch in enumerate(_LETTERS):
        c = F.least(F.lit(255), n - F.octet_length(F.replace(line, F.lit(ch), F.lit(""))))
        out = out.bitwiseOR(F.shiftleft(c.cast("long"), 8 * i))
    return out


def _distance(a: Column, b: Column) -> Column:
    """Sum of the differences of two packed counts."""
    at = lambda x, i: F.shiftrightunsigned(x, 8 * i).bitwiseAND(255)
    return sum((F.abs(at(a, i) - at(b, i)) for i in range(1, len(_LETTERS))), F.abs(at(a, 0) - at(b, 0)))


def _keys(line: Column, n: Column, q: Column) -> list[Column]:
    """Keys of the segments of length class q: first, last, middle, and the middle shifted by one either way."""
    g = F.floor(q / (TAU + 1)).cast("int")
    key = lambda i, start: F.xxhash64(q, F.lit(i), F.substring(line, start, g))
    return [key(1, F.lit(1)), key(3, n - g + 1), key(2, g + 1), key(2, g), key(2, g + 2)]


def _rows(keys: list[Column], own: bool) -> list[Column]:
    """Structs (key, role, p1, p2): role 1 index, 2 probe, 3 both; p1 and p2 are the keys of the segments tried before."""
    none = F.lit(None).cast("long")
    row = lambda key, r, p1, p2: F.struct(key.alias("key"), F.lit(r).alias("role"), p1.alias("p1"), p2.alias("p2"))
    first, last, mid, left, right = keys
    role = 3 if own else 2
    # A shifted piece that equals another is the same probe.
    return [
        row(first, role, none, none),
        row(last, role, first, none),
        row(mid, role, first, last),
        row(F.when(left != mid, left), 2, first, last),
        row(F.when((right != mid) & (right != left), right), 2, first, last),
    ]


def _bind(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def _states(a: Column, b: Column, upto: Column, tau: int) -> Column:
    """The automaton after the first ``upto`` characters of b: r0 .. r<tau>, for so many errors at most.

    Bit d of number e says: the prefix of a that ends at diagonal d of the band matches the current
    prefix of b with at most e edits.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    start = F.struct(*[F.lit(sum(1 << (tau + k) for k in range(e + 1))).alias(f"r{e}") for e in range(tau + 1)])

    def step(xs, ys, acc, j):
        ch = F.element_at(ys, j)
        n, hit = F.size(xs), F.lit(0)
        for d in range(width):
            i = j + d - tau
            hit = hit.bitwiseOR(F.when((i >= 1) & (i <= n) & (F.get(xs, i - 1) == ch), 1 << d).otherwise(0))
        # A struct per error count would repeat the columns before it; an array fold computes each once.
        first = F.array(acc["r0"].bitwiseAND(hit))
        out = F.aggregate(
            F.array(*[F.struct(acc[f"r{e - 1}"].alias("p"), acc[f"r{e}"].alias("c")) for e in range(1, tau + 1)]),
            first,
            lambda done, x: F.concat(
                done,
                F.array(x["c"].bitwiseAND(hit).bitwiseOR(x["p"]).bitwiseOR(F.shiftright(x["p"], 1)).bitwiseOR(F.shiftleft(F.element_at(done, -1), 1)).bitwiseAND(full)),
            ),
        )
        return _bind(out, lambda o: F.struct(*[F.get(o, F.lit(e)).alias(f"r{e}") for e in range(tau + 1)]))

    steps = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.expr("CAST(array() AS array<int>)"))
    # The characters are bound to a lambda variable, so that each text is split once, not once per step.
    chars = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return _bind(chars, lambda c: F.aggregate(steps, start, lambda acc, j: step(c["x"], c["y"], acc, j)))


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """The edit distance of two strings if it is at most tau, else null."""
    n, m = F.char_length(a), F.char_length(b)
    goal = F.call_function("shiftleft", F.lit(1), n - m + tau)
    none = F.lit(None).cast("int")
    dist = _bind(_states(a, b, m, tau), lambda r: F.coalesce(*[F.when(r[f"r{e}"].bitwiseAND(goal) != 0, e) for e in range(tau + 1)], none))
    return F.when(F.abs(n - m) <= tau, dist)


def _shared(a: Column, b: Column) -> Column:
    """How many characters two strings share at their start, by halving steps."""
    n = F.least(F.char_length(a), F.char_length(b))
    part = lambda x, p, i: F.substring(x, p + 1, F.call_function("shiftleft", F.lit(1), i))
    most = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    return F.aggregate(
        F.sequence(most, F.lit(0)), F.lit(0), lambda p, i: F.when(part(a, p, i) == part(b, p, i), F.least(n, p + F.call_function("shiftleft", F.lit(1), i))).otherwise(p)
    )


def verified(a: Column, b: Column, tau: int = TAU) -> Column:
    """``within`` of two strings, at little cost where they differ by more: what they share at either end is cut
    off, which leaves the distance as it is, and the automaton runs on only if it is alive after LOOK characters."""
    rest = lambda x, p: F.substring(x, p + 1, F.char_length(x))
    # Each cut also turns both strings round.
    trim = lambda s: _bind(F.struct(s["x"].alias("x"), s["y"].alias("y"), _shared(s["x"], s["y"]).alias("p")), lambda t: F.struct(F.reverse(rest(t["x"], t["p"])).alias("x"), F.reverse(rest(t["y"], t["p"])).alias("y")))
    alive = lambda s: _states(F.substring(s["x"], 1, LOOK + tau), F.substring(s["y"], 1, LOOK), F.least(F.char_length(s["y"]), F.lit(LOOK)), tau)[f"r{tau}"] != 0
    return _bind(F.struct(a.alias("x"), b.alias("y")), lambda s: _bind(trim(s), lambda t: _bind(trim(t), lambda u: F.when(alive(u), within(u["x"], u["y"], tau)))))


def _candidates(lines: DataFrame, min_chars: int) -> DataFrame:
    """Pairs (a, b) of line hashes, a < b, that meet in a segment and pass the bounds; each once, in the first segment they meet in."""
    n = F.char_length("line")
    line, q0 = F.col("line"), n - n % STEP
    own = {f"k{i}": c for i, c in enumerate(_keys(line, n, q0))}
    near = {f"j{i}": F.when(n % STEP < TAU, c) for i, c in enumerate(_keys(line, n, q0 - STEP))}
    more = {"n": n, "cs": _counts(line), **own, **near}
    # Equal lines give equal rows: one of each task, then of all, stands for them. Plain numbers keep the aggregation in hash tables.
    rows = lines.where(n >= min_chars).select("h1", "h2", *[c.alias(k) for k, c in more.items()]).groupBy("h1", "h2").agg(*[F.min(k).alias(k) for k in more])
    # The rows are built above the aggregation, so that each key is hashed once.
    ks = F.array(*_rows([F.col(k) for k in own], True), *_rows([F.col(k) for k in near], False))
    k = rows.select(F.explode(ks).alias("k"), F.col("h1").alias("h"), "n", "cs").where("k.key IS NOT NULL")
    k = k.select("k.key", (F.col("n") * 4 + F.col("k.role")).alias("nr"), "h", "cs", "k.p1", "k.p2")
    a, b = k.alias("a"), k.alias("b")
    na, nb = F.shiftright("a.nr", 2), F.shiftright("b.nr", 2)
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.h") != F.col("b.h"))
    for p in ("p1", "p2"):
        meets &= F.col(f"a.{p}").isNull() | (F.col(f"a.{p}") != F.col(f"b.{p}"))
    roles = (F.col("a.nr").bitwiseAND(1) == 1) & (F.col("b.nr").bitwiseAND(2) == 2)
    # Lines of one length meet both ways; one way is enough.
    sizes = (nb - na <= TAU) & ((nb > na) | ((nb == na) & (F.col("a.h") < F.col("b.h"))))
    # The planner does not see that the rows multiply; it must not broadcast them.
    j = a.hint("merge").join(b.hint("merge"), meets & roles & sizes & (_distance(F.col("a.cs"), F.col("b.cs")) <= 2 * TAU))
    return j.select(F.least("a.h", "b.h").alias("a"), F.greatest("a.h", "b.h").alias("b"))


def linked_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Links between different lines: (a, b, dist, and for each its h2, did, ln of its first occurrence); b starts later or ties."""
    lines = _lines(df, id_col, text_col)
    pairs = cut(_candidates(lines, min_chars))
    wanted = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h")))
    texts = among(lines.select("did", "ln", "line", "h1", "h2"), "h1", wanted).groupBy("h1", "h2", "line").agg(F.min(F.struct("did", "ln")).alias("at"))
    side = lambda s: texts.select(F.col("h1").alias(s), F.col("h2").alias(f"{s}2"), F.col("line").alias(f"{s}t"), F.col("at").alias(f"{s}at"))
    # Dealt by pair: verification costs more than its rows weigh, and a line of many pairs spreads over the tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").repartition(tasks, "a", "b")
    # A generator evaluates the distance once; a filter on it would do so again.
    found = F.explode(F.filter(F.array(verified(F.col("at"), F.col("bt"))), lambda d: d.isNotNull()))
    return j.select("a", "a2", "aat", "b", "b2", "bat", found.alias("dist"))


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, rk, ln, equal, near, n_links) of every line that goes or has links; equal: an equal line starts earlier; near: a linked one does."""
    # Of each link, the line that starts later; on a tie neither goes, but both keep the link.
    ends = cut(linked_lines(df, id_col, text_col, min_chars))
    one = ends.select(F.col("a").alias("h1"), F.col("a2").alias("h2"), (F.col("aat") > F.col("bat")).alias("later"))
    two = ends.select(F.col("b").alias("h1"), F.col("b2").alias("h2"), (F.col("bat") > F.col("aat")).alias("later"))
    near = one.unionByName(two).groupBy("h1", "h2").agg(F.bool_or("later").alias("near"), F.count("*").alias("n_links"))
    occ = _lines(df, id_col, text_col).select("did", "rk", "ln", "h1", "h2")
    groups = occ.groupBy("h1", "h2").agg(F.min(F.struct("did", "ln")).alias("at"), F.count("*").alias("n"))
    groups = groups.join(near, ["h1", "h2"], "left").where("n > 1 OR near IS NOT NULL").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Written, so that the join below has a plain exchange on either side: only then the adaptive skew join splits a hot line.
    groups = cut(groups)
    occ = among(occ, "h1", groups.select(F.col("h1").alias("h")))
    return occ.join(groups, ["h1", "h2"]).select("did", "rk", "ln", (F.struct("did", "ln") > F.col("at")).alias("equal"), "near", "n_links").where("equal OR near OR n_links > 0")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, counts: bool = False) -> DataFrame:
    """df with duplicate lines taken out of its text column; with counts also n_lines, n_removed, n_near and n_links."""
    did, rk, gone = fresh(df, "did", "rk", "gone")
    g = duplicate_lines(df, id_col, text_col, min_chars)
    g = g.groupBy(F.col("did").alias(did), F.col("rk").alias(rk)).agg(
        F.struct(
            F.collect_set(F.when(F.col("equal") | F.col("near"), F.col("ln"))).alias("ln"),
            F.count_if(F.col("near") & ~F.col("equal")).alias("near"),
            F.sum("n_links").alias("links"),
        ).alias(gone)
    )
    d = df.withColumn(did, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(rk, F.xxhash64(text_col)).join(g, [did, rk], "left")
    lines, out = F.split(text_col, "\n", -1), F.col(gone)["ln"]
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(out, i)), "\n")
    removed = F.coalesce(F.size(out), F.lit(0)).cast("long")
    more = {}
    if counts:
        more = {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "n_removed": F.when(F.col(gone).isNull(), F.lit(0).cast("long")).otherwise(removed),
            "n_near": F.coalesce(F.col(gone)["near"], F.lit(0).cast("long")),
            "n_links": F.coalesce(F.col(gone)["links"], F.lit(0).cast("long")),
        }
    text = F.when(F.col(gone).isNull() | (F.size(out) == 0), F.col(text_col)).otherwise(kept)
    return d.select(*[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in df.columns], *[v.alias(k) for k, v in more.items()])
