"""DuckDB SQL of the audits, draws and searches that SQL can express over whole tables."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The byte table of the reversed polynomial of CRC-32."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ 0xEDB88320 if x & 1 else x >> 1
        out.append(x)
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p, 1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN size s USING (lang, source)
),
pairs AS (
  SELECT lang, source, item, coalesce(value, 0) AS value FROM (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source)
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
  USING (lang, source, item)
),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 10
""".format(upper=_UPPER, lower=_LOWER)

RESAMPLING = r"""
WITH crc AS (SELECT {crc}::BIGINT[] AS t),
d AS (SELECT row_number() OVER () AS i, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT i, doc_id, true AS own, text FROM d UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark),
w AS (SELECT i, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT i, own, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM w),
c AS (SELECT i, own, f, count(*) AS n FROM f GROUP BY ALL),
coded AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM c)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda k: ('0x' || h[k:k + 1])::BIGINT)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM coded, crc),
b AS (SELECT i, own, bucket, sum(n) AS n FROM c JOIN hashed USING (f) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t FROM b GROUP BY ALL),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM s),
gains AS (SELECT bucket, floor(1000 * ln((s.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS gain FROM s, total),
weights AS (SELECT i, sum(n) AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM b JOIN gains USING (bucket) WHERE own GROUP BY ALL),
scored AS (
  SELECT i, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (i) WHERE own
),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (WHERE able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed
""".format(upper=_UPPER, lower=_LOWER, crc=_crc_table())

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
)
SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id))::INTEGER AS rank
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
QUALIFY rank <= 20
"""
