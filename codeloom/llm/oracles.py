"""SQL for the opN_ queries that SQL can express."""

from __future__ import annotations

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3 = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
cut AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(host, prefix, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (
  SELECT c.page_id, arg_max(r.host || r.prefix, length(r.host || r.prefix)) AS rule,
         arg_max(r.action, length(r.host || r.prefix)) AS action
  FROM cut c JOIN rules r ON (c.host = r.host OR suffix(c.host, '.' || r.host)) AND starts_with(c.path, r.prefix)
  GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, h.rule, coalesce(h.action, 'allow') AS verdict
FROM cut c LEFT JOIN hits h ON c.page_id = h.page_id
"""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS turn FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS most FROM sources),
steps AS (
  SELECT *, coalesce(sum(most) OVER w, 0) AS fixed, (SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER w, 0) AS free
  FROM weighted WINDOW w AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((3 * (SELECT sum(source_size) FROM sources) / 2 - fixed) / free, most / weight) AS level
  FROM steps WHERE (3 * (SELECT sum(source_size) FROM sources) / 2 - fixed) / free <= most / weight),
targets AS (
  SELECT source, source_size, CASE WHEN most < level * weight THEN most::DOUBLE ELSE level * weight END AS target
  FROM weighted, level),
run AS (
  SELECT doc_id, source, size, turn, sum(size) OVER (PARTITION BY source ORDER BY turn, size ROWS UNBOUNDED PRECEDING) AS offered,
         row_number() OVER (PARTITION BY source ORDER BY turn, size) AS nth FROM sized),
copies AS (
  SELECT r.*, t.source_size, t.target, rep, (r.offered + t.source_size * rep)::DOUBLE / t.target AS finish
  FROM run r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) AS reps(rep) WHERE r.size > 0),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, rep, turn, nth ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
taken AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM queued
  WHERE upto <= (SELECT 3 * sum(source_size) / 2 FROM sources) GROUP BY doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON s.doc_id = k.doc_id
"""

ORACLES = {"op2_line_dedup": OP2, "op3_url_filter": OP3, "op5_mix_sources": OP5}
