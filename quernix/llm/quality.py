"""Quality rules with host-level verdicts.

Each document is measured in one pass over its whole text and held against RULES. The failures of every rule are
aggregated by host (the source column), with partial aggregation, so a host with a third of all rows costs
no more than any other. For each rule a beta prior is fitted to the hosts by the method of moments and shrinks
every host's failure rate; a host passes if its shrunk rate is at most max_rate for every rule. Verdicts are
joined back to the documents; the side of the verdicts has one row per host, so a large host's documents can be
split over tasks by the adaptive skew join.

Defined results: null and empty texts have no words and fail; documents without a host are judged alone; a
null id stays null; repeated rows are measured each; an empty table gives no rows; other columns are ignored.
Ids are whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernix.llm.common import cut

SYMBOLS, SPACES, RUN = "#*$%&|<>", " \t\n\x0b\x0c\r", 5
MAX_RATE = 0.6
_NAMES = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Rules that a document can fail; the first two fail it by themselves, all count for its host.
RULES = {
    "short": "n_words < 10",
    "repetitive": "100 * n_repeat_words > 20 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "copied_lines": "10 * n_dup_lines > 3 * n_lines",
}


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word) of a whole text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    runs = list(zip(*(words[i:] for i in range(RUN))))
    repeat = 0
    if len(set(runs)) < len(runs):
        count, end = Counter(runs), 0
        for i, r in enumerate(runs):
            if count[r] > 1:
                repeat += i + RUN - max(i, end)
                end = i + RUN
    return n, chars, symbols, dup, repeat, len(seen) + dup


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = list(zip(*[measure(t.as_py()) for t in b.column(2)])) or [()] * 6
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.int64()) for x in got]], _NAMES)


def metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures of each row, whether it fails each rule (fails_<rule>), and base_failed."""
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    m = d.mapInArrow(_measure, ", ".join(f"{n} {'string' if n == 'host' else 'long'}" for n in _NAMES))
    m = m.withColumns({f"fails_{r}": F.expr(e) for r, e in RULES.items()})
    return m.withColumn("base_failed", F.col("fails_short") | F.col("fails_repetitive"))


def prior(n: float, f: float, k: float, rr: float) -> tuple[float, float]:
    """Mean and size of the beta prior from n documents, f failures and k hosts; rr sums n times the squared rate over hosts."""
    mean = min(max(f / n, 1e-6), 1 - 1e-6) if n else 0.5
    spread = max(rr / n - mean * mean, 0.0) if n else 0.0
    # Between-host variance: what sampling within hosts does not explain; none means the strongest prior allowed.
    between = spread - mean * (1 - mean) * (k / n if n else 0.0)
    return mean, min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0) if between > 0 else 1000.0


def host_verdicts(m: DataFrame, max_rate: float = MAX_RATE, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """(host, n_docs, n_failed, rate, rule, host_ok): failures of the rule with the highest shrunk rate, and whether that is low enough."""
    hosts = m.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(f"fails_{r}").alias(f"f_{r}") for r in rules])
    sums = [x for r in rules for x in (F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"rr_{r}"))]
    s = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), *sums).first()
    rated = []
    for r in rules:
        mean, size = prior(*(float(s[c] or 0) for c in ("n", f"f_{r}", "k", f"rr_{r}")))
        rated.append(F.struct(((F.col(f"f_{r}") + F.lit(mean * size)) / (F.col("n") + F.lit(size))).alias("rate"), F.col(f"f_{r}").alias("f"), F.lit(r).alias("rule")))
    worst = F.array_max(F.array(*rated))
    return hosts.select("host", F.col("n").alias("n_docs"), worst.alias("w")).select("host", "n_docs", F.col("w.f").alias("n_failed"), "w.rate", "w.rule", (F.col("w.rate") <= max_rate).alias("host_ok"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The measures of each row with base_failed, host_rate (the highest of the rules) and kept."""
    m = cut(metrics(df, id_col, text_col, host_col))
    j = m.join(host_verdicts(m, max_rate).select("host", F.col("rate").alias("host_rate"), "host_ok"), "host", "left")
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("host_ok", *[f"fails_{r}" for r in RULES])
