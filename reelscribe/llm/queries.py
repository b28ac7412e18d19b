"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import bpe, brown, fingerprints, jaccard, language_id, packing, quality, sharding, substrings, token_counts, toxicity, variants, vector_codes

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_perplexity_rules": quality.op2_perplexity_rules,
    "op3_brown_scores": brown.op3_brown_scores,
    "op4_block_anchors": substrings.op4_block_anchors,
    "op5_packing": packing.op5_packing,
    "op6_shingle_jaccard": jaccard.op6_shingle_jaccard,
    "op7_bpe_rounds": bpe.op7_bpe_rounds,
    "op8_byte_shards": sharding.op8_byte_shards,
    "op9_language_id": language_id.op9_language_id,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_ftrl_toxicity": toxicity.op11_ftrl_toxicity,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_cover_tree_codes": vector_codes.op13_cover_tree_codes,
}

#: Each document's words and their places from 1.
WORDS = r"""
texts AS (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts)"""

REPEATS = f"""
WITH {WORDS.format(text="coalesce(text, '')")},
windows AS (
  SELECT doc_id, n, i, word, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM placed
),
least AS (SELECT h, min(doc_id) AS first_id FROM windows WHERE i + 49 <= n GROUP BY h),
marked AS (
  SELECT w.doc_id, w.i, w.word, CASE WHEN w.i + 49 <= w.n AND l.first_id < w.doc_id THEN w.i END AS bad FROM windows w LEFT JOIN least l USING (h)
),
covered AS (SELECT doc_id, i, word, coalesce(max(bad) OVER (PARTITION BY doc_id ORDER BY i) >= i - 49, false) AS gone FROM marked),
per_document AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per_document p USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
five AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM placed
),
sets AS (SELECT DISTINCT doc_id, md5(least(n, 5) || ' ' || shingle) AS h FROM five WHERE i = 1 OR i + 4 <= n),
sizes AS (SELECT doc_id, count(*) AS n_shingles FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id FROM low LEFT JOIN sizes USING (doc_id)
"""

#: CRC-32 of bytes, a table step for each.
CRC = """
WITH RECURSIVE bits AS (
  SELECT range AS n, range AS v, 0 AS step FROM range(256)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8
),
lookup AS (SELECT list(v ORDER BY n) AS tab FROM bits WHERE step = 8),
"""

VARIANTS = rf"""{CRC}
found AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
),
runs AS (SELECT doc_id, run, count(*) AS times FROM found GROUP BY ALL),
octets AS (
  SELECT *, [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS b FROM runs
),
hashed AS (SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM octets, lookup),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
vocab AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM vocab, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN vocab b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
firsts AS (SELECT word, min(other) AS form FROM near JOIN best USING (word) WHERE other_n = top GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM vocab LEFT JOIN best USING (word) LEFT JOIN firsts USING (word)
),
chain AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""

SHARDS = f"""{CRC}octets AS (
  SELECT doc_id, [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS b FROM documents
),
sums AS (SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM octets, lookup),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
),
axis AS (SELECT *, CAST(sum(size) OVER (ORDER BY h, doc_id) - size AS BIGINT) AS start, CAST(sum(size) OVER () AS BIGINT) AS total FROM sized),
grouped AS (SELECT *, min(start) OVER (PARTITION BY h) AS first, sum(size) OVER (PARTITION BY h) AS bytes FROM axis),
cut AS (
  SELECT *, least(7, CAST(floor(CASE WHEN bytes * 128 <= total THEN first ELSE start END * 8 / total) AS INT)) AS shard FROM grouped
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start, doc_id) - 1 AS slot,
  CAST(NULL AS INT) AS grown_shard
FROM cut JOIN sums USING (doc_id)
"""



def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Vector codes, a round after the other."""
    sql = [f"""
WITH sound AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, [CAST(floor(x * 4096) AS BIGINT) FOR x IN CAST(embedding AS DOUBLE[])] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pieces AS (SELECT row, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM sound, range({parts}) t(p)),
book0 AS (SELECT p, row - 1 AS e, v FROM pieces WHERE row <= {entries})"""]
    for i in range(rounds + 1):
        off = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        sql.append(f"""near{i} AS MATERIALIZED (
  SELECT row, p, min(struct_pack(d := CAST({off} AS BIGINT), e := e)) AS best FROM pieces x JOIN book{i} b USING (p) GROUP BY row, p
)""")
        if i < rounds:
            sql.append(f"""parts{i} AS (
  SELECT p, best.e AS e, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS c FROM pieces JOIN near{i} USING (row, p), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY ALL
),
moved{i} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY j) AS v FROM parts{i} GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN moved{i} m USING (p, e))""")
    return ",\n".join(sql) + f"""
, codes AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM sound JOIN codes USING (row), digest
"""


#: The others score with trained models, run merge rounds of a vocabulary file or sketch hashes, which SQL can't express.
SQL: dict[str, str] = {"op4_block_anchors": REPEATS, "op6_shingle_jaccard": NEAR, "op8_byte_shards": SHARDS, "op12_spelling_variants": VARIANTS, "op13_cover_tree_codes": codes_sql()}
