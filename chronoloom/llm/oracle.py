"""DuckDB SQL of the operators that SQL can express, plain and quadratic where copies are many: for small tables only.

They take doc_id to be unique and not null, as in the tables they are run on.
"""

from __future__ import annotations

import string

from chronoloom.llm.quality import LINE_LIMIT, NGRAM_LIMITS, SYMBOL_LIMIT

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM t),
sizes AS (SELECT unnest([3, {", ".join(map(str, NGRAM_LIMITS))}]) AS n),
v AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS j FROM t, sizes WHERE len(w) >= n),
hit AS (
  SELECT doc_id, n, j FROM (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS g FROM v)
  QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
c AS (
  SELECT p.doc_id, sizes.n, length(p.word) AS chars, coalesce(max(hit.j) OVER (PARTITION BY p.doc_id, sizes.n ORDER BY p.j) > p.j - sizes.n, false) AS dup
  FROM p CROSS JOIN sizes LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.n = sizes.n AND hit.j = p.j),
share AS (
  SELECT doc_id, sum(chars) FILTER (n = 3) AS word_chars, count(*) FILTER (dup AND n = 3) AS n_repeat_words,
    {", ".join(f"coalesce(sum(chars) FILTER (dup AND n = {n}), 0) AS dup_{n}" for n in NGRAM_LIMITS)} FROM c GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
again AS (
  SELECT doc_id, count(*) - 1 AS more, count(*) * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM line WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line HAVING count(*) > 1),
lines AS (SELECT doc_id, sum(more) AS more, sum(chars) AS chars FROM again GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(more, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    {", ".join(f"coalesce(dup_{n}, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1)::DOUBLE AS dup_{n}gram_share" for n in NGRAM_LIMITS)},
    coalesce(chars, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1)::DOUBLE AS dup_line_share
  FROM t LEFT JOIN share ON t.doc_id = share.doc_id LEFT JOIN lines ON t.doc_id = lines.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND dup_line_share <= {LINE_LIMIT}::DOUBLE
  AND n_symbols <= {SYMBOL_LIMIT}::DOUBLE * n_words AND {" AND ".join(f"dup_{n}gram_share <= {x}::DOUBLE" for n, x in NGRAM_LIMITS.items())} AS kept
FROM m
"""

OP5 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (
  SELECT doc_id, doc_id AS other FROM s
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT s.doc_id, len(s.g) AS n_shingles, min(r.other) AS component_id
FROM s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.g
"""

OP8 = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (
  SELECT doc_id, octet_length(b) AS n, regexp_extract_all(hex(b), '..') AS x,
    list_transform(range(0, octet_length(b)), lambda i: md5(b[i + 1:i + 400])) AS m FROM b),
p AS (SELECT doc_id, n, unnest(range(0, n)) AS j, unnest(x) AS x, unnest(m) AS m FROM h),
hit AS (SELECT doc_id, j FROM p WHERE j <= n - 400 QUALIFY count(*) OVER (PARTITION BY m) > 1),
c AS (
  SELECT p.doc_id, p.j, p.x, count(hit.j) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) > 0 AS cut
  FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.j = hit.j),
r AS (SELECT *, cut AND NOT lag(cut, 1, false) OVER (PARTITION BY doc_id ORDER BY j) AS opens FROM c),
d AS (
  SELECT doc_id, count(*) FILTER (cut) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(x, '' ORDER BY j) FILTER (NOT cut), '') AS kept FROM r GROUP BY doc_id)
SELECT b.doc_id, octet_length(b.b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN d ON b.doc_id = d.doc_id
"""

OP9 = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM t),
v AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS j FROM t WHERE len(w) >= 50),
s AS (SELECT doc_id, j, array_to_string(w[j:j + 49], ' ') AS g FROM v),
hit AS (SELECT doc_id, j FROM s QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
c AS (
  SELECT p.doc_id, p.j, p.word, count(hit.j) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS cut
  FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.j = hit.j),
d AS (
  SELECT doc_id, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT cut), '') AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(d.n_removed, 0) AS n_removed, sha256(coalesce(d.kept, '')) AS kept_sha256
FROM t LEFT JOIN d ON t.doc_id = d.doc_id
"""
