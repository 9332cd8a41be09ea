"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

MIX_SOURCES = """
WITH docs AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, ''))) AS _key FROM documents),
sizes AS (
  SELECT source, sum(coalesce(length(text), 0) + 1)::BIGINT AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, round(sqrt(size::DOUBLE) / (SELECT sum(sqrt(size::DOUBLE)) FROM sizes)
                       * (SELECT sum(size)::DOUBLE FROM sizes) / size, 9) AS rate FROM sizes),
means AS (
  SELECT source, greatest(ceil(rate / 32), 1)::INT AS shares, rate / greatest(ceil(rate / 32), 1) AS mean FROM rates),
steps AS (
  SELECT source, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 30)::BIGINT + 1)) AS k FROM means),
cdf AS (
  SELECT source, sum(exp(k * ln(greatest(mean, 1e-300)) - mean - lgamma(k + 1)))
                   OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
curves AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
draws AS (
  SELECT d.doc_id, d._key, m.source AS s, unnest(range(1, m.shares + 1)) AS share
  FROM (SELECT DISTINCT doc_id, _key, source FROM docs) d JOIN means m ON d.source IS NOT DISTINCT FROM m.source),
uniform AS (
  SELECT _key, s, ('0x' || substr(md5('1|' || _key || '|' || share), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM draws),
counts AS (
  SELECT _key, s, sum(len(list_filter(cs, lambda c: c <= u)))::INT AS n
  FROM uniform JOIN curves ON s IS NOT DISTINCT FROM curves.source GROUP BY _key, s),
copies AS (
  SELECT d.*, unnest(range(0, n))::INT AS copy
  FROM docs d JOIN counts c ON d._key = c._key AND d.source IS NOT DISTINCT FROM c.s)
SELECT * EXCLUDE (_key), md5('shuffle1|' || _key || '|' || copy) AS shuffle_key FROM copies
"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT rid, {rank} AS rank, '{kind}' AS kind, {least} AS least,
         list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gaps,
         list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS lens,
         list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS vals
  FROM docs WHERE regexp_matches(t, '{pattern}')"""


SECRET_SCAN = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({_kind(0, "assign", _ASSIGN, 2, 8)}
  UNION ALL {_kind(1, "access", "AKIA[A-Z0-9]+", 0, 16)}
  UNION ALL {_kind(2, "hex", "[0-9a-f]+", 0, 32)}),
matches AS (
  SELECT rid, rank, kind, least, unnest(range(1, len(lens) + 1)) AS i, unnest(gaps[:len(lens)]) AS gap,
         unnest(lens) AS len, unnest(vals) AS val FROM parts),
placed AS (
  SELECT *, sum(gap + len) OVER (PARTITION BY rid, kind ORDER BY i)::BIGINT AS stop FROM matches),
found AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
         count(*) FILTER (kind = 'hex') AS h,
         string_agg(kind || ':' || (stop - len) || ':' || stop, ',' ORDER BY stop - len, rank) AS spans
  FROM placed WHERE val >= least GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (rid)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM docs),
runs AS (
  SELECT rid, pos, size, string_agg(word, ' ') OVER (PARTITION BY rid, size ORDER BY pos
           RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS win
  FROM words, (SELECT DISTINCT size FROM windows)),
hits AS (SELECT rid, pos, r.size, item_id FROM runs r JOIN windows v ON r.win = v.win AND r.size = v.size),
hit_words AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY rid),
ids AS (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits),
hit_items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM ids GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words h USING (rid) LEFT JOIN hit_items i USING (rid)
"""
