"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cellgrad.llm import license_scan, line_dedup, quality, url_filter

WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


LINE_DEDUP = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(x, {WS}), {LOWER}) AS k FROM line),
holder AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= {line_dedup.MIN_CHARS} GROUP BY k),
marked AS (
  SELECT keyed.doc_id, pos, x, coalesce(holder.first_doc < keyed.doc_id, false) AS gone
  FROM keyed LEFT JOIN holder ON holder.k = keyed.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUALITY = f"""
WITH base AS (
  SELECT doc_id, coalesce(source, chr(1) || 'none') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
  FROM documents),
win AS (
  SELECT doc_id, k, array_to_string(ws[k:k + {quality.WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {quality.WINDOW - 1})) AS k FROM base
        WHERE len(ws) >= {quality.WINDOW})),
again AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(generate_series(k, k + {quality.WINDOW - 1})) AS p FROM again) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS x FROM base),
worded AS (
  SELECT *, translate(trim(x, {WS}), {LOWER}) AS k, len(regexp_extract_all(x, '{WORD}')) AS lw
  FROM line WHERE trim(x, {WS}) <> ''),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM worded GROUP BY doc_id),
common AS (
  SELECT host, k FROM worded GROUP BY host, k HAVING count(DISTINCT doc_id) > {quality.MIN_DOCS}),
cut AS (
  SELECT doc_id, count(*) AS n, sum(lw) AS w FROM worded JOIN common USING (host, k) GROUP BY doc_id),
m AS (
  SELECT base.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(cut.n, 0) AS n_common_lines, coalesce(cut.w, 0) AS n_common_words
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id)),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PCT} AS base_failed
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_common_lines::BIGINT AS n_common_lines, n_common_words::BIGINT AS n_common_words, base_failed,
       NOT base_failed AND (n_words - n_common_words) * 100 >= n_words * {quality.MIN_LEFT_PCT} AS kept
FROM judged
"""

_CLEAN = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))"
_SHINGLES = f"""
  SELECT *, CASE WHEN len(w) >= {license_scan.SHINGLE}
    THEN list_transform(generate_series(1, len(w) - {license_scan.SHINGLE - 1}),
                        lambda k: array_to_string(w[k:k + {license_scan.SHINGLE - 1}], ' '))
    ELSE [array_to_string(w, ' ')] END AS sh"""

LICENSE_SCAN = f"""
WITH tpl AS (
  SELECT template_id, license, string_split(lower({_CLEAN}), ' ') AS w
  FROM (VALUES {", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in license_scan.TEMPLATES)})
    AS v(template_id, license, text) WHERE {_CLEAN} <> ''),
tsh AS (SELECT DISTINCT template_id, license, unnest(sh) AS s FROM ({_SHINGLES} FROM tpl)),
tn AS (SELECT template_id, license, count(*) AS n, ceil(count(*) * 1.25)::INT AS span FROM tsh GROUP BY ALL),
doc AS (SELECT doc_id, string_split(lower({_CLEAN}), ' ') AS w FROM documents WHERE {_CLEAN} <> ''),
dsh AS (
  SELECT doc_id, len(w) AS words, unnest(sh) AS s, generate_subscripts(sh, 1) - 1 AS p FROM ({_SHINGLES} FROM doc)),
hit AS (SELECT doc_id, words, template_id, p, s FROM dsh JOIN tsh USING (s)),
stretch AS (
  SELECT a.doc_id, a.words, a.template_id, tn.license, tn.n, a.p, count(DISTINCT b.s) AS found, max(b.p) AS last
  FROM hit a JOIN tn USING (template_id)
  JOIN hit b ON b.doc_id = a.doc_id AND b.template_id = a.template_id AND b.p >= a.p AND b.p < a.p + tn.span
  GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, template_id ORDER BY found DESC, p) AS r FROM stretch)
SELECT doc_id, template_id, license, n::BIGINT AS n_shingles, found::BIGINT AS n_found,
       round(found / n, 6)::DOUBLE AS containment, p::BIGINT AS first_word,
       least(last + {license_scan.SHINGLE}, words)::BIGINT AS last_word
FROM best WHERE r = 1 AND found >= ceil(n * {license_scan.MIN_CONTAINED})
"""


# Rounds after which what is still on its way is below 10^-9 of the seeds.
ROUNDS = 130


def _url_filter() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (len(r[0]), len(r[1]), r), reverse=True)
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    name = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (h, p, _) in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, rules))
    keep, move = 1 - url_filter.DAMPING, url_filter.DAMPING
    link = url_filter.LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE cutoff AS (
  SELECT *, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS tail
  FROM pages),
placed AS (
  SELECT page_id, html, translate(regexp_extract(tail, '^([^/?#]*)', 1), {LOWER}) AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cutoff),
ruled AS (SELECT *, CASE {name} END AS rule, CASE {verdict} END AS v FROM placed),
linked AS (
  SELECT DISTINCT host AS src, page_id, translate(regexp_replace(regexp_replace(l, '^.*@', ''), ':\d+$', ''), {LOWER}) AS dst
  FROM (SELECT host, page_id, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS l FROM ruled WHERE host <> '')),
links AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM linked WHERE dst <> '' AND dst <> src GROUP BY src, dst),
hosts AS (SELECT host FROM ruled WHERE host <> '' UNION SELECT dst FROM links),
labels AS (SELECT string_split(host, '.') AS w FROM hosts),
ties AS (
  SELECT DISTINCT array_to_string(w[k:], '.') AS a, array_to_string(w[k + 1:], '.') AS b
  FROM (SELECT w, unnest(generate_series(1, len(w) - 2)) AS k FROM labels WHERE len(w) > 2)),
edges AS (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT * FROM links UNION ALL SELECT a, b, 1.0 FROM ties UNION ALL SELECT b, a, 1.0 FROM ties) GROUP BY src, dst),
kinds AS (SELECT 0 AS kind, src, dst, weight FROM edges UNION ALL SELECT 1, dst, src, weight FROM edges),
step AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS p FROM kinds),
shares AS (
  SELECT host, avg((coalesce(v, '') = 'allow')::INT) AS t, avg((coalesce(v, '') = 'block')::INT) AS d
  FROM ruled WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (
  SELECT 0 AS kind, host, t AS seed FROM shares WHERE t > 0 UNION ALL SELECT 1, host, d FROM shares WHERE d > 0),
moved AS (
  SELECT 0 AS k, kind, host, seed * {keep!r} AS rank FROM seeds
  UNION ALL
  SELECT m.k + 1, m.kind, s.dst, sum(m.rank * s.p * {move!r}) FROM moved m
  JOIN step s ON s.kind = m.kind AND s.src = m.host WHERE m.k < {ROUNDS} GROUP BY m.k, m.kind, s.dst),
bad AS (
  SELECT host FROM moved GROUP BY host
  HAVING round(sum(CASE WHEN kind = 1 THEN rank ELSE -rank END) / {keep!r}, 9) > {url_filter.MARGIN})
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict
FROM ruled
"""


ORACLE = {
    "op2_license_scan": LICENSE_SCAN,
    "op3_line_dedup": LINE_DEDUP,
    "op9_quality": QUALITY,
    "op10_url_filter": _url_filter(),
}
