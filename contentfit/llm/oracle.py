"""DuckDB SQL for the queries that SQL can express."""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

DECONTAMINATION = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
  lambda x: x <> '') AS ws FROM t),
sh AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM sh WHERE kind = 'i' GROUP BY id),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM sh d JOIN sh i ON d.s = i.s
  WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY d.id, i.id)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment
FROM shared JOIN n ON n.id = item_id WHERE 100 * c >= 80 * n
"""

QUALITY_RULES = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
raw_lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM base),
lines AS (
  SELECT doc_id, source, text, line, regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
  FROM raw_lines),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE len(lw) > 0 GROUP BY doc_id),
norm AS (SELECT doc_id, source, text, array_to_string(lw, ' ') AS line, sum(len(lw)) AS words FROM lines
  WHERE len(lw) > 0 GROUP BY doc_id, source, text, array_to_string(lw, ' ')),
common AS (SELECT source, line FROM norm GROUP BY source, line HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT doc_id, sum(words) AS n FROM norm JOIN common USING (source, line) GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM base WHERE len(ws) >= 5),
wins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM wins, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY doc_id),
c AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept FROM f
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, NULL::VARCHAR AS error FROM f
"""

SHARDING = """
WITH RECURSIVE steps AS (
  SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, list_transform(
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM d, crc),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS nth, sum(size) OVER () AS total FROM c),
p AS (SELECT *, (((2 * start + size) * 40) // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY nth) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""


def _vector_codes() -> str:
    """Four rounds of assigning and averaging, each a few common table expressions."""
    away = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds = []
    for i in range(5):
        rounds.append(f"""
a{i} AS MATERIALIZED (SELECT vec_id, part, x, (w).e AS entry, (w).d AS d FROM (
  SELECT p.vec_id, p.part, p.x, min({{'d': {away}, 'e': b.entry}}) AS w FROM parts p JOIN b{i} b USING (part)
  GROUP BY p.vec_id, p.part, p.x))""")
        if i < 4:
            rounds.append(f"""
m{i} AS (SELECT part, entry, pos, floor(sum(x[pos])::DOUBLE / count(*))::BIGINT AS v
  FROM a{i}, (SELECT unnest(range(1, 17)) AS pos) GROUP BY part, entry, pos),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (
  SELECT part, entry, list(v ORDER BY pos) AS x FROM m{i} GROUP BY part, entry) n USING (part, entry))""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[16 * part + 1:16 * part + 16] AS x FROM kept, range(4) t(part)),
b0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1) AS entry, x FROM parts
  QUALIFY entry < 256),{",".join(rounds)},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a4 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(x[pos]::VARCHAR, ',' ORDER BY part, entry, pos)) AS h
  FROM b4, (SELECT unnest(range(1, 17)) AS pos))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM codes JOIN kept USING (vec_id), book
"""


HARD_NEGATIVES = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a JOIN kept r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

ORACLE = {
    "op3_warc": WARC,
    "op5_near_dedup": NEAR_DEDUP,
    "op7_decontamination": DECONTAMINATION,
    "op8_quality_rules": QUALITY_RULES,
    "op11_sharding": SHARDING,
    "op12_vector_codes": _vector_codes(),
    "op13_hard_negatives": HARD_NEGATIVES,
}
