"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op2_exact_dedup"] = r"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM base)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
"""

ORACLE["op7_source_mixing"] = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM base GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS stop, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM sources),
levels AS (
  SELECT stop / weight AS ratio,
         (total - coalesce(sum(stop) OVER (ORDER BY stop / weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0))
         / sum(weight) OVER (ORDER BY stop / weight RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(stop, weight * (SELECT min_by(level, ratio) FROM levels WHERE level <= ratio)) AS target
  FROM weighed),
lined AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, floor(t.target) AS quota,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.place, b.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(line + size, quota) - line)
          + greatest(0, least(source_size + line + size, quota) - (source_size + line)) AS BIGINT) AS taken
FROM lined
"""

ORACLE["op8_url_cascade"] = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ranked AS (
  SELECT c.*, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM cut c LEFT JOIN rules r
    ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1
"""

ORACLE["op3_bit_sliced_topk"] = r"""
WITH usable AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM ranked
QUALIFY rank <= 20
"""

ORACLE["op12_source_divergence"] = r"""
WITH base AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM base) GROUP BY lang, term HAVING count(*) >= 3),
tokens AS (SELECT lang, source, unnest(words) AS term FROM base),
counts AS (
  SELECT t.lang, t.source, t.term, count(*) AS count FROM tokens t JOIN kept k ON t.lang = k.lang AND t.term = k.term
  GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(count) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total,
         (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS terms
  FROM (SELECT DISTINCT lang, source FROM base) g),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.count, 0) AS count,
         1 + (1000000000::HUGEINT * (coalesce(c.count, 0) + 1)) // (g.total + g.terms) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(count) + 1)::HUGEINT) // (any_value(n) + any_value(terms)) AS q
  FROM shares s JOIN (SELECT lang, sum(total)::HUGEINT AS n, any_value(terms) AS terms FROM groups GROUP BY lang) l USING (lang)
  GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
  ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((s.p - w.q) * (s.p - w.q)) // w.q AS value
  FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.count > 0 AND s.p > w.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""
