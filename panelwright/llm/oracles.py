"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others rest on trained models, XXH64 or a tokenizer, which it lacks; ``tests/llm`` holds them against
brute-force versions, and classifiers against held-out labels as well. CRC-32 is worked out byte by byte.
"""

WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def codes(rounds: int = 2) -> str:
    """Rounds of assigning 16 parts of 4 components to 64 entries and taking means, then the codes."""
    d = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5))
    steps = ""
    for k in range(rounds + 1):
        steps += f""",
a{k} AS (SELECT vec_id, label, p.part, any_value(x) AS x, min(({d}) * 64 + e) AS m FROM p JOIN c{k} ON p.part = c{k}.part GROUP BY vec_id, label, p.part)"""
        if k < rounds:
            means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
            steps += f""",
c{k + 1} AS (SELECT c{k}.part, c{k}.e, coalesce(s.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT part, m % 64 AS e, [{means}] AS c FROM a{k} GROUP BY ALL) s ON s.part = c{k}.part AND s.e = c{k}.e)"""
    return f"""
WITH v AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, label, part, v[part * 4 + 1:part * 4 + 4] AS x FROM v, range(16) t(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 64){steps},
r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', m % 64)), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256 FROM r"""


ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
n AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
ks AS (SELECT DISTINCT k FROM n),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hit AS (SELECT DISTINCT doc_id, item, dg.k AS k, i FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op8_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
f AS (SELECT *, rest / ws AS level, rest / ws * w < cap AS free FROM l),
g AS (SELECT *, least(cap, (SELECT arg_min(level, cap / w) FROM f WHERE free) * w) AS t FROM f),
goal AS (SELECT source, source_size, coalesce(t, cap) AS target,
  CAST(CAST('0x' || substr(md5(CASE WHEN source IS NULL THEN '-' ELSE '+' || source END || '|29'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS place FROM d),
c AS (SELECT p.doc_id, p.size, CAST(goal.source_size AS BIGINT) AS source_size, goal.target,
  CAST(CASE WHEN goal.source_size > 0 THEN floor(u + target / goal.source_size * (place + 1)) - floor(u + target / goal.source_size * place) ELSE 0 END AS BIGINT) AS copies
  FROM p JOIN goal ON p.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c""",
    "op9_shards": r"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(k AS UBIGINT) FOR k IN range(8)]),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT text, hex(encode(text)) AS h FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
b AS (SELECT text, [CAST('0x' || h[i:i + 1] AS UBIGINT) FOR i IN range(1, len(h), 2)] AS bytes FROM h),
crc AS (SELECT text, len(bytes) + 8 AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS crc FROM b, tab),
d AS (SELECT doc_id, crc.text, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS crc FROM documents JOIN crc ON coalesce(documents.text, '') = crc.text),
p AS (SELECT *, CAST(sum(size) OVER o AS BIGINT) - size AS before, row_number() OVER o AS place, CAST(sum(size) OVER () AS BIGINT) AS total FROM d WINDOW o AS (ORDER BY crc, text, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, greatest(min(before) OVER (PARTITION BY crc, text), before - CAST(floor(0.02::DOUBLE * total / 24) AS BIGINT)) * 24 // total AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op11_vector_codes": codes(),
    "op13_collocations": f"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cut AS (SELECT c.*, j, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') AND l.k = j
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ') AND r.k = c.k - j),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, p, max(a) AS f FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM c WHERE k = 3) GROUP BY ALL),
best AS (SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM low LEFT JOIN longer ON low.lang = longer.lang AND low.phrase = longer.p WHERE longer.f IS NULL OR 100 * longer.f < 50 * a)
SELECT best.lang, rank, phrase, a, l, r, n, score FROM best JOIN n ON best.lang = n.lang WHERE rank <= 2000""",
}
