"""SQL for the queries that SQL can express, in the dialect of the engine that checks them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS words
  FROM item_words WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), places AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i
  FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, p.n, item
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM places) p
  JOIN windows USING (words)
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits))
  GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN doc_words USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
                                 lambda i: array_to_string(w[i:i + 2], ' '))) AS shingle
  FROM doc_words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
), roots AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN roots USING (doc_id)
"""

# The weights 3, 1, 2 repeat over the sources by code point, null last. Each step of `fill` fixes
# the sources whose target would be above twice their size and shares what is left by weight.
OP7 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS words,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight,
         1.5 * sum(sum(size)) OVER () AS whole
  FROM sized GROUP BY source
), fill AS (
  SELECT 0 AS step, source, words, weight, whole, CAST(NULL AS DOUBLE) AS fixed FROM sources
  UNION ALL
  SELECT step + 1, source, words, weight, whole,
         CASE WHEN fixed IS NOT NULL THEN fixed
              WHEN open_share * weight > 2 * words THEN 2 * words END
  FROM (
    SELECT *, (whole - sum(coalesce(fixed, 0)) OVER ()) / sum(CASE WHEN fixed IS NULL THEN weight END) OVER () AS open_share
    FROM fill
  ) WHERE step < (SELECT count(*) FROM sources)
), targets AS (
  SELECT source, words, coalesce(fixed, (whole - sum(coalesce(fixed, 0)) OVER ())
         / nullif(sum(CASE WHEN fixed IS NULL THEN weight ELSE 0 END) OVER (), 0) * weight) AS target
  FROM fill WHERE step = (SELECT count(*) FROM sources)
), ordered AS (
  SELECT s.doc_id, s.size, CAST(t.words AS BIGINT) AS source_size, t.target,
         CAST(round_even(t.target, 0) AS BIGINT) AS wanted,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (wanted // source_size) * size
            + greatest(0, least(size, wanted % source_size - earlier)) END AS BIGINT) AS taken
FROM ordered
"""

# A pair of similar sets shares one of the rarest words of each; the rarest here are by exact counts.
OP8 = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS said
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), sets AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(said, '[^\x20\x09-\x0D]+'))) AS w FROM lines
), classes AS (
  SELECT w, len(w) AS n, min((doc_id, line)) AS first, row_number() OVER () AS c FROM sets WHERE len(w) > 0 GROUP BY w
), words AS (
  SELECT c, n, unnest(w) AS word FROM classes
), counts AS (
  SELECT word, count(*) AS f FROM words GROUP BY word
), prefix AS (
  SELECT c, n, word FROM (
    SELECT c, n, word, row_number() OVER (PARTITION BY c ORDER BY f, word) AS r FROM words JOIN counts USING (word)
  ) WHERE r <= n - ceil(n * 80 / 100.0) + 1
), pairs AS (
  SELECT DISTINCT x.c AS a, y.c AS b FROM prefix x JOIN prefix y USING (word)
  WHERE x.c < y.c AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
), alike AS (
  SELECT CASE WHEN x.first < y.first THEN b ELSE a END AS c
  FROM pairs JOIN classes x ON x.c = a JOIN classes y ON y.c = b
  WHERE 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w)))
), stay AS (
  SELECT first[1] AS doc_id, count(*) AS n, string_agg(CAST(first[2] AS VARCHAR), ',' ORDER BY first[2]) AS kept
  FROM classes WHERE c NOT IN (SELECT c FROM alike) GROUP BY 1
), totals AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE len(w) > 0) AS n_said FROM sets GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_said, 0) - coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(kept, '') AS kept_lines
FROM documents LEFT JOIN totals USING (doc_id) LEFT JOIN stay USING (doc_id)
"""

OP11 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# A field is its length in bytes, a colon and its value. The checksum goes bit by bit.
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
OP13 = rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce(':' || lang, '-') AS tree, {_LEAF.format(n="n_chars")} AS leaf,
         {_LEAF.format(n="(n_chars + 1)")} AS forged,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda r, c: list_reduce(list_prepend(xor(r, c), [CAST(i AS BIGINT) for i in range(8)]),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) AS crc
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), lower AS (
  SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2
  FROM lower WHERE n > 1 GROUP BY tree, level, i // 2, n
), subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM lower WHERE n = 1
), upper AS (
  SELECT 0 AS level, place AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2
  FROM upper WHERE n > 1 GROUP BY level, i // 2, n
), steps AS (
  SELECT p.doc_id, p.tree, p.i, 0 AS part, l.level, (p.i >> l.level) & 1 AS side, s.h
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM lower WHERE n > 1) l USING (tree)
  LEFT JOIN lower s ON s.tree = p.tree AND s.level = l.level AND s.i = xor(p.i >> l.level, 1)
  UNION ALL
  SELECT p.doc_id, p.tree, p.i, 1, l.level, (r.place >> l.level) & 1, s.h
  FROM placed p JOIN subroots r USING (tree) CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) l
  LEFT JOIN upper s ON s.level = l.level AND s.i = xor(r.place >> l.level, 1)
), proofs AS (
  SELECT tree, i, list({{'side': side, 'h': h}} ORDER BY part, level) AS proof FROM steps GROUP BY tree, i
), folds AS (
  SELECT p.tree, p.i, 0 AS step, CASE WHEN crc % 7 = 0 AND forged IS NOT NULL THEN forged ELSE leaf END AS h,
         coalesce(proof, []) AS proof
  FROM placed p LEFT JOIN proofs f ON f.tree = p.tree AND f.i = p.i
  UNION ALL
  SELECT tree, i, step + 1, sha256(CASE WHEN proof[step + 1].side = 1 THEN coalesce(proof[step + 1].h, '') || h
                                        ELSE h || coalesce(proof[step + 1].h, '') END), proof
  FROM folds WHERE step < len(proof)
)
SELECT p.doc_id, p.leaf, r.subroot, u.h AS root,
       sha256(coalesce(array_to_string(list_transform(f.proof, lambda x: x.h), ''), '')) AS proof_sha256,
       f.h AS folded_root, f.h = u.h AS verified
FROM placed p JOIN subroots r USING (tree) JOIN (SELECT h FROM upper WHERE n = 1) u ON true
JOIN folds f ON f.tree = p.tree AND f.i = p.i AND f.step = len(f.proof)
"""

ORACLE = {
    "op1_decontaminate": OP1,
    "op2_near_duplicates": OP2,
    "op7_mix_sources": OP7,
    "op8_repeated_lines": OP8,
    "op11_search": OP11,
    "op13_manifest": OP13,
}
