"""DuckDB SQL for the queries that SQL can express."""

from .queries import LISTED_DOMAINS, URL_RULES

OP9 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), m AS (
  SELECT k, min(doc_id) AS first FROM s GROUP BY k
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN m USING (k) WHERE m.first < s.doc_id
), r AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(
    list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(coalesce(gone, []), x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


_LISTED = ", ".join(f"'{d}'" for d in LISTED_DOMAINS)

OP6 = rf"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule, verdict) AS (
  VALUES {", ".join(f"('{text}', '{kind}')" for kind, text in URL_RULES)}
), s AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM r
), m AS (
  SELECT page_id, max_by(s.rule, len(s.rule)) AS rule, max_by(s.verdict, len(s.rule)) AS verdict
  FROM u JOIN s ON (u.host = s.h OR ends_with(u.host, '.' || s.h)) AND starts_with(u.path, s.p)
  GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, m.rule,
  coalesce(m.verdict, CASE WHEN EXISTS (
    SELECT 1 FROM unnest([{_LISTED}]) AS l(d) WHERE u.host = d OR ends_with(u.host, '.' || d)) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id)
"""

OP10 = r"""
WITH p AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
    CASE WHEN contains(source, '://') THEN lower(regexp_extract(source, '(?s)^.*?://([^/?#]*)', 1)) ELSE source END AS source
  FROM documents
), t AS (
  SELECT source, count(*) AS n FROM p GROUP BY source
), l AS (
  SELECT source, line, count(*) AS k
  FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM p)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line
), b AS (
  SELECT l.source, list(l.line) AS gone FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  WHERE k >= 3 AND k > 0.08 * n GROUP BY l.source
), o AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept
  FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": OP6, "op9_substring_dedup": OP9, "op10_line_dedup": OP10}
