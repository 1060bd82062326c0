"""The numbered queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import decontam, jaccard, langid, neighbours, order, packing, periods, quality, reputation, secret_scan, substring, toxicity, variants

QUERIES = packing.QUERIES | quality.QUERIES | toxicity.QUERIES | decontam.QUERIES | langid.QUERIES | secret_scan.QUERIES | neighbours.QUERIES | jaccard.QUERIES | substring.QUERIES | order.QUERIES | periods.QUERIES | variants.QUERIES | reputation.QUERIES

ORACLE_SQL = variants.ORACLE_SQL | reputation.ORACLE_SQL | {
    "op4_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
b AS (SELECT doc_id, i FROM h JOIN (SELECT k, min(doc_id) AS m FROM h GROUP BY k) USING (k) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM b, range(0, 50) r(j)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
k AS (SELECT x.doc_id, count(c.pos) AS removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (c.pos IS NULL) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.pos = x.pos GROUP BY x.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op6_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY ALL""",
}
