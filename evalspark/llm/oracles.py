"""DuckDB SQL for the queries that SQL can express, written independently of
the Spark code."""

from __future__ import annotations

import corpus_pipeline

ORACLES: dict[str, str] = {}

ORACLES["op3_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM s),
total AS (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE AS want FROM w),
lvl(step, level) AS (
  SELECT 0, 0::DOUBLE
  UNION ALL
  SELECT step + 1,
    (SELECT (max(want) - coalesce(sum(CASE WHEN cap <= weight * level THEN cap END), 0))
            / sum(CASE WHEN cap > weight * level THEN weight END) FROM w, total)::DOUBLE
  FROM lvl WHERE step < 25),
fin AS (SELECT max(level) AS level FROM lvl),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM w, fin),
r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE
           / 281474976710656::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((floor(rate) + (u < rate - floor(rate))::INT) * size)::BIGINT AS taken
FROM r
"""

ORACLES["op4_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n,
         sha1(coalesce(html, '')) AS hex
  FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: (
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[(
           ((('0x' || substr(hex, ((k // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1)::INT]),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM o
"""

ORACLES["op5_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t)::BIGINT AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

ORACLES["op6_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k,
         unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
                lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS s
  FROM bw WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM dw, ks WHERE len(w) >= k),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM pos),
m AS (SELECT g.doc_id, g.k, g.i, win.item_id FROM g JOIN win ON g.k = win.k AND g.s = win.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

ORACLES["op2_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v
  WHERE 100 * shared >= 85 * (nu.n + nv.n - shared)),
r AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g,
    concat_ws('',
      coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id::VARCHAR, '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS head,
    n_chars::HUGEINT AS n, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM documents),
b AS (
  SELECT doc_id, g, n, head, tail, list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
        lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS c
  FROM raw),
lf AS (
  SELECT doc_id, g, sha256(head || coalesce(length(n::VARCHAR) || ':' || n, '-') || tail) AS leaf,
    CASE WHEN xor(c, 4294967295) % 7 = 0
      THEN sha256(head || coalesce(length((n + 1)::VARCHAR) || ':' || (n + 1), '-') || tail) END AS claim
  FROM b),
nl AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claim NULLS FIRST) - 1 AS i FROM lf),
t(g, lvl, i, h) AS (
  SELECT g, 0, i, leaf FROM nl
  UNION ALL
  SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, max(i) OVER (PARTITION BY g) AS m FROM t) WHERE m > 0 GROUP BY g, lvl, i // 2),
sub AS (SELECT g, max(lvl) AS top, max_by(h, lvl) AS subroot FROM t GROUP BY g),
ns AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS gi FROM sub),
u(lvl, i, h) AS (
  SELECT 0, gi, subroot FROM ns
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, max(i) OVER () AS m FROM u) WHERE m > 0 GROUP BY lvl, i // 2),
r AS (SELECT max(lvl) AS top, max_by(h, lvl) AS root FROM u),
d AS (SELECT nl.*, ns.top, ns.subroot, ns.gi, r.root, r.top AS rtop,
             row_number() OVER () AS k FROM nl JOIN ns USING (g) CROSS JOIN r),
steps AS (
  SELECT d.k, lv.l AS l, (d.i >> lv.l) & 1 AS odd, t.h FROM d, (SELECT unnest(range(64)) AS l) lv
    LEFT JOIN t ON t.g = d.g AND t.lvl = lv.l AND t.i = xor(d.i >> lv.l, 1) WHERE lv.l < d.top
  UNION ALL
  SELECT d.k, d.top + lv.l, (d.gi >> lv.l) & 1, u.h FROM d, (SELECT unnest(range(64)) AS l) lv
    LEFT JOIN u ON u.lvl = lv.l AND u.i = xor(d.gi >> lv.l, 1) WHERE lv.l < d.rtop),
p AS (SELECT k, string_agg(h, '' ORDER BY l) AS sib, list({'odd': odd, 'h': h} ORDER BY l) AS way FROM steps GROUP BY k),
f(k, l, h) AS (
  SELECT k, 0, coalesce(claim, leaf) FROM d
  UNION ALL
  SELECT f.k, f.l + 1, sha256(CASE WHEN way[f.l + 1].odd = 1 THEN coalesce(way[f.l + 1].h, '') || f.h
                                   ELSE f.h || coalesce(way[f.l + 1].h, '') END)
  FROM f JOIN p ON p.k = f.k WHERE f.l < len(way)),
z AS (SELECT k, max_by(h, l) AS folded_root FROM f GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(sib, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN z ON z.k = d.k LEFT JOIN p ON p.k = d.k
"""

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
