"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

PERIODIC_RUNS = r"""
WITH crc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda done, byte: list_reduce(
        [xor(done, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda bits, step: xor(bits >> 1, 3988292384 * (bits & 1))))) AS h
  FROM documents
), placed AS (
  SELECT doc_id, w, h // 10 AS g, len(w) AS n,
    CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a
  FROM crc
), words AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word
  FROM placed, unnest(range(n)) AS place(i)
), equals AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equals
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM islands GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS place(i)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
    min(struct_pack(l := -length, s := start, p := period)) AS longest
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, -longest.l AS length, longest.p AS period,
  (1000 * -longest.l) // longest.p AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

RANKED_SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), sizes AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), total AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, total GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total
  GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

MINHASH_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM edges
  UNION
  SELECT doc_id, b FROM reached JOIN edges ON other = a
), components AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN components USING (doc_id)
"""

TEXTS: dict[str, str] = {
    "op11_periodic_runs": PERIODIC_RUNS,
    "op12_ranked_search": RANKED_SEARCH,
    "op13_minhash_dedup": MINHASH_DEDUP,
}
