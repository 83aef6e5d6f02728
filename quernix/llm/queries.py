"""The thin queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernix.llm.common import real_id, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import chat

    planted = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.chat_digest(chat.chat_windows(rows))


#: Greedy spans turn by turn; what a span repeats are the system turn and up to two turns of 256 tokens in all. Of
#: roles and texts only the lengths are needed: every control string gets one character more. (Spans are
#: also cut at every 64 budgets, which no conversation of these tables reaches.)
_CONTROL = r"[<\[]\\*(?:\|[A-Za-z_]*\|?>|/?s>|/?INST\]|</?SYS>>)"
ORACLES["op1_chat_windows"] = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ix FROM c
), u AS (
  SELECT conv_id, ix, role, text, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\x20\x09-\x0D\p{{L}}\p{{N}}_]')) + 4 AS tk,
    17 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars,
    max(CASE WHEN role = 'system' THEN ix END) OVER (PARTITION BY conv_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS sx
  FROM t
), v AS (
  SELECT u.*, CASE WHEN u.role = 'system' THEN 0 ELSE u.tk END AS own, greatest(1, 768 - coalesce(s.tk, 0)) AS room, s.chars AS system_chars
  FROM u LEFT JOIN u s ON s.conv_id = u.conv_id AND s.ix = u.sx
), g AS (
  SELECT conv_id, ix, ix AS start, own AS used FROM v WHERE ix = 1
  UNION ALL
  SELECT v.conv_id, v.ix, CASE WHEN v.role = 'system' OR g.used + v.own > v.room THEN v.ix ELSE g.start END, CASE WHEN v.role = 'system' OR g.used + v.own > v.room THEN v.own ELSE g.used + v.own END
  FROM g JOIN v ON v.conv_id = g.conv_id AND v.ix = g.ix + 1
), w AS (
  SELECT a.conv_id,
    CASE WHEN a.sx IS NOT NULL AND a.role <> 'system' THEN a.system_chars ELSE 0 END
      + CASE WHEN b.role <> 'system' AND b.tk <= 256 THEN b.chars ELSE 0 END
      + CASE WHEN d.role <> 'system' AND d.tk + CASE WHEN b.role <> 'system' THEN b.tk ELSE 0 END <= 256 THEN d.chars ELSE 0 END AS chars
  FROM (SELECT DISTINCT conv_id, start FROM g) x JOIN v a ON a.conv_id = x.conv_id AND a.ix = x.start
    LEFT JOIN v b ON b.conv_id = x.conv_id AND b.ix = x.start - 1 LEFT JOIN v d ON d.conv_id = x.conv_id AND d.ix = x.start - 2
), h AS (
  SELECT conv_id, sum(chars) AS chars FROM w GROUP BY conv_id
), z AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY ix) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY ix), '') AS loss, sum(chars) AS chars
  FROM u GROUP BY conv_id
)
SELECT z.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(z.chars + h.chars AS BIGINT) AS formatted_chars
FROM z JOIN h ON z.conv_id = h.conv_id
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import simhash

    nd = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return nd.select(real_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import substring

    d = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(len(ws) - 19)) AS i, ws FROM w WHERE len(ws) >= 20
), k AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 20], ' ')) AS h FROM p
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM later
), g AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), r AS (
  SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i - 1)), ' ')) AS kept_sha256
FROM r
"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import lines

    d = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    kept = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "n_lines", "n_removed", "n_near", "n_links", F.char_length(kept).cast("long").alias("n_kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


#: Letters beyond ASCII in the texts; DuckDB's levenshtein counts bytes, so each is read as one control character.
_LETTERS = "éóèñüçêäößíÉÈÑÓÇÊÄÜÖÍ"
_BYTES = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)])

ORACLES["op3_line_dedup"] = rf"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM d WHERE text IS NOT NULL
), o AS (
  SELECT doc_id, ln, line, doc_id * 100000000 + ln AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), f AS (
  SELECT line, min(pos) AS pos FROM o GROUP BY line
), s AS (
  SELECT line, pos, length(line) AS n, translate(line, '{_LETTERS}', {_BYTES}) AS t FROM f WHERE length(line) >= 30
), c AS (
  SELECT *, {", ".join(f"length(line) - length(replace(line, '{x}', '')) AS c{i}" for i, x in enumerate("ensatr"))} FROM s
), p AS (
  SELECT a.line, count(*) AS links, bool_or(b.pos < a.pos) AS near
  FROM c a, (SELECT *, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM c) b
  WHERE a.n = b.m AND a.line <> b.line
    AND {" + ".join(f"abs(a.c{i} - b.c{i})" for i in range(6))} <= 4 -- an edit changes at most two counts by one
    AND levenshtein(a.t, b.t) <= 2
  GROUP BY a.line
), g AS (
  SELECT doc_id, o.ln, o.pos > f.pos AS equal, coalesce(p.near, false) AS near, coalesce(p.links, 0) AS links
  FROM o JOIN f ON o.line = f.line LEFT JOIN p ON o.line = p.line
), r AS (
  SELECT doc_id, list(ln) FILTER (equal OR near) AS gone, count(*) FILTER (near AND NOT equal) AS n_near, sum(links) AS n_links FROM g GROUP BY doc_id
), k AS (
  SELECT d.doc_id, ls, coalesce(gone, []) AS gone, n_near, n_links,
    coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10)), '') AS kept
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(length(kept) AS BIGINT) AS n_kept_chars, sha256(kept) AS kept_sha256
FROM k
"""


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import html

    return html.extract(table(spark, sf_dir, "pages"))


#: All of the tables' pages have one article element of headings, paragraphs, bold text and line breaks, which is the text wanted.
ORACLES["op5_html_text"] = r"""
WITH a AS (
  SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ') AS x FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'),
    lambda y: trim(regexp_replace(regexp_replace(replace(regexp_replace(y, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '[\x20\x09-\x0D\x{A0}]+', ' ', 'g'))) AS bs
  FROM a
), t AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(bs, lambda y: y <> ''), chr(10)), '') AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quernix.llm import packing

    p = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import secrets

    s = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def _starts(matches: str) -> str:
    """Where the matches of a pattern start (from 0), found one behind the other."""
    at = "a.e + instr(substr(t, a.e + 1), m) - 1"
    return f"list_reduce({matches}, lambda a, m: {{'e': {at} + length(m), 's': list_append(a.s, {at})}}, {{'e': 0::BIGINT, 's': []::BIGINT[]}}).s"


#: The base spans. The method's own are none in the tables' documents, so spans are the base spans there.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = {"assign": (_ASSIGN, 6, 1), "access": ("AKIA[A-Z0-9]+", 20, 0), "hex": ("[0-9a-f]+", 24, 0)}
ORACLES["op8_secret_scan"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, doc_id, t, {", ".join(f"regexp_extract_all(t, '{p}') AS m{i}, regexp_extract_all(t, '{p}', {g}) AS g{i}" for i, (p, _, g) in enumerate(_SECRETS.values()))} FROM d
), s AS (
  SELECT r, doc_id, {", ".join(f"list_filter(list_zip({_starts(f'm{i}')}, m{i}, g{i}), lambda x: length(x[3]) >= {n}) AS s{i}" for i, (_, n, _) in enumerate(_SECRETS.values()))} FROM m
), k AS (
  SELECT r, doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex,
    list_sort({" || ".join(f"list_transform(s{i}, lambda x: {{'start': x[1], 'kind': {i}, 'text': '{k}:' || x[1] || ':' || (x[1] + length(x[2]))}})" for i, k in enumerate(_SECRETS))}) AS spans
  FROM s
), j AS (
  SELECT doc_id, n_assign, n_access, n_hex, coalesce(array_to_string(list_transform(spans, lambda x: x.text), ','), '') AS spans FROM k
)
SELECT doc_id, CAST(n_assign AS BIGINT) AS n_assign, CAST(n_access AS BIGINT) AS n_access, CAST(n_hex AS BIGINT) AS n_hex, sha256(spans) AS base_sha256, spans FROM j
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import quality

    q = quality.judge(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op9_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), w AS (
  SELECT r, unnest(range(len(ws) - 4)) AS i, ws FROM d WHERE len(ws) >= 5
), k AS (
  SELECT r, i, md5(array_to_string(ws[i + 1 : i + 5], ' ')) AS h FROM w
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM k) WHERE n > 1
), c AS (
  SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY r
), m AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c ON d.r = c.r
), x AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), u AS (
  SELECT source, rule, CASE rule WHEN 0 THEN n_words < 10 WHEN 1 THEN 100 * n_repeat_words > 20 * n_words WHEN 2 THEN 2 * n_symbols > n_words ELSE 10 * n_dup_lines > 3 * n_lines END AS failed
  FROM x, (SELECT unnest(range(4)) AS rule) WHERE source IS NOT NULL
), h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, count_if(failed)::DOUBLE AS f FROM u GROUP BY ALL
), s AS (
  SELECT rule, sum(n) AS n, count(*)::DOUBLE AS k, sum(f * f / n) AS rr, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS mean FROM h GROUP BY rule
), b AS (
  SELECT *, greatest(rr / n - mean * mean, 0) - mean * (1 - mean) * k / n AS between_hosts FROM s
), p AS (
  SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 2), 1000) ELSE 1000 END AS size FROM b
), v AS (
  SELECT source, max((h.f + mean * size) / (h.n + size)) <= 0.6 AS ok FROM h JOIN p ON h.rule = p.rule GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM x LEFT JOIN v ON x.source = v.source
"""


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernix.llm import language

    d = table(spark, sf_dir, "documents")
    held = (language.remainder("doc_id") == 0).alias("held_out")
    return language.identify(d, language.fit(d), columns=[F.col("doc_id"), held], schema="doc_id long, held_out boolean")
