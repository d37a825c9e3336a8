"""SQL for DuckDB that gives the rows of those text queries that SQL can express."""

from __future__ import annotations

from quaybook.llm import secrets

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NGRAM_JACCARD = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM tokens a JOIN tokens b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY ALL)
  WHERE 100 * c >= 85 * (n + m - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.y, s.doc_id)) AS component_id
FROM sets s LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON r.x = s.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(place: int, kind: str, pattern: str, group: int, condition: str, may_hold: str) -> str:
    """Spans of one kind; ``may_hold`` is a quick test that every text with a span passes."""
    p = _quoted(pattern)
    return f"""
  SELECT doc_id, owner, {place} AS place, '{kind}' AS kind, starts AS start, starts + len(m) AS stop, value FROM (
    SELECT doc_id, owner, unnest(list_transform(range(1, len(ms) + 1), lambda i:
             list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))) AS starts, unnest(ms) AS m, unnest(vs) AS value
    FROM (SELECT doc_id, owner, string_split_regex(body, {p}) AS gaps, regexp_extract_all(body, {p}, 0) AS ms, regexp_extract_all(body, {p}, {group}) AS vs
          FROM (SELECT doc_id, coalesce(source, '{secrets.NO_OWNER}' || doc_id) AS owner, text AS body FROM documents WHERE regexp_matches(text, {_quoted(may_hold)}))) WHERE len(ms) > 0)
  WHERE {condition}"""


def _secrets() -> str:
    kinds = [_kind(k, kind, pattern, group, f"len(value) >= {least}", secrets.MAY_HOLD[kind]) for k, (kind, pattern, group, least) in enumerate(secrets.BASE)]
    kinds.append(_kind(3, secrets.RUN[0], "[A-Za-z0-9+/_=-]+", 0, "len(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')", "[A-Za-z0-9+/_=-]{20}"))
    text = "string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start, place, stop)"
    return f"""
WITH found AS MATERIALIZED ({" UNION ALL ".join(kinds)}),
verdicts AS (SELECT value, CASE WHEN count(DISTINCT owner) >= 3 OR count(DISTINCT doc_id) >= 10 THEN 'example' WHEN count(DISTINCT owner) = 1 AND any_value(len(list_distinct(string_split(value, '')))) >= 10 THEN 'live'
                           ELSE 'unsure' END AS verdict FROM found GROUP BY value),
judged AS MATERIALIZED (SELECT * FROM found JOIN verdicts USING (value)),
chosen AS MATERIALIZED (
  SELECT * FROM judged j WHERE place < 3 OR (verdict = 'live' AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.doc_id = j.doc_id AND b.place < 3 AND b.start < j.stop AND j.start < b.stop))),
counted AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, {text} FILTER (place < 3) AS base, {text} AS spans,
         count(*) FILTER (place = 3) AS n_added, count(*) FILTER (place < 3 AND verdict = 'live') AS n_live, count(*) FILTER (place < 3 AND verdict = 'example') AS n_example
  FROM chosen GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_added, 0) AS n_added, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN counted USING (doc_id)
"""


SECRET_SCAN = _secrets()
