"""SQL for DuckDB that states the results of the queries it can express."""

from __future__ import annotations

from wardmap.llm.mixing import MOST, SEED, SHARE, WEIGHTS, offset_of

DECONTAMINATE = r"""
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
  UNION ALL
  SELECT 'i', item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(words), 10) AS size,
         unnest(list_transform(range(1, len(words) - least(len(words), 10) + 2),
                               lambda s : array_to_string(words[s:s + least(len(words), 10) - 1], ' '))) AS grams
  FROM folded WHERE kind = 'i' AND len(words) > 0
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, size, unnest(range(1, len(words) - size + 2)) AS start,
         unnest(list_transform(range(1, len(words) - size + 2),
                               lambda s : array_to_string(words[s:s + size - 1], ' '))) AS grams
  FROM folded CROSS JOIN sizes WHERE kind = 'd' AND len(words) >= size
), hits AS (
  SELECT d.doc_id, d.start, d.size, i.item_id FROM doc_windows d JOIN item_windows i USING (size, grams)
), words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(start, start + size)) AS place FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT f.id AS doc_id, CAST(len(f.words) AS BIGINT) AS n_words, coalesce(w.n_hit, 0) AS n_hit,
       coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(w.n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN words_hit w ON w.doc_id = f.id LEFT JOIN items_hit i ON i.doc_id = f.id
WHERE f.kind = 'd'
"""

MIX = rf"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (number - 1) % {len(WEIGHTS)}
            {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(WEIGHTS))} END AS weight,
         {MOST} * source_size AS most
  FROM sources
), limits AS (
  SELECT *, CAST(most AS DOUBLE) / weight AS cap,
         sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, number ROWS UNBOUNDED PRECEDING) - most AS used,
         sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, number ROWS UNBOUNDED PRECEDING) AS weights,
         CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
  FROM weighted
), levels AS (
  SELECT *, (total - CAST(used AS DOUBLE)) / CAST(all_weights - weights + weight AS DOUBLE) AS level FROM limits
), targets AS (
  SELECT source, source_size,
         least(weight * (SELECT max(level) FROM levels WHERE level <= cap), CAST(most AS DOUBLE)) AS target
  FROM levels
), numbered AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS expected,
         row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS LAST) AS n
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(CAST({offset_of(SEED)!r} AS DOUBLE) + expected * n)
                    - floor(CAST({offset_of(SEED)!r} AS DOUBLE) + expected * (n - 1))) AS BIGINT) AS taken
FROM numbered
"""

WARC = r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages
), digests AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, hex,
         array_to_string(list_transform(range(0, 32), lambda i : substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((((strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 AS INTEGER) + 1, 1)) - 1) * 16
              + (strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 AS INTEGER) + 2, 1)) - 1))
             >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest
  FROM payloads
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id DESC NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id DESC NULLS LAST) AS largest
  FROM digests
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN largest END AS refers_to
FROM ranked
"""

COPIES = r"""
WITH squeezed AS (
  SELECT doc_id, length(coalesce(text, '')) AS characters,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents
), ranked AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         row_number() OVER (PARTITION BY body ORDER BY characters DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY characters DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM squeezed
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""


NEAR = r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT row, doc_id, list_sort(list_distinct(CASE
           WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i : array_to_string(w[i:i + 2], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingles
  FROM worded
), classes AS MATERIALIZED (
  SELECT row_number() OVER () AS class, shingles, len(shingles) AS n, min(doc_id) AS least
  FROM sets WHERE len(shingles) > 0 GROUP BY shingles
), members AS MATERIALIZED (SELECT class, n, unnest(shingles) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a.class AS a, b.class AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.class < b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached(a, b) AS (
  SELECT class, class FROM classes
  UNION
  SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reached r JOIN links l ON r.b IN (l.a, l.b)
), components AS (SELECT r.a AS class, min(least) AS component_id FROM reached r JOIN classes c ON c.class = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE m.component_id END AS component_id
FROM sets s LEFT JOIN classes c ON c.shingles = s.shingles LEFT JOIN components m ON m.class = c.class
"""

#: States: 0 at the start, 1 after system, 2 after user, 3 after assistant; costs of all that is left to do.
REPAIR = r"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, role, text, list_reduce(
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                          lambda c : CAST(ascii(c) AS BIGINT)),
           lambda crc, byte : list_reduce(range(8), lambda v, i : xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)),
           4294967295) AS crc
  FROM conversations
), lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(crc, 4294967295) % 20 AS lot FROM damaged
), left_over AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM lots WHERE lot <> 0
), ordered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM left_over
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, left(role, 1) AS kind,
         lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS earlier
  FROM ordered
), rows_ AS MATERIALIZED (
  SELECT *, blank OR seen AS must_go, CASE WHEN open THEN 1 ELSE 0 END AS cut FROM faults
), costs(c, i, c0, c1, c2, c3) AS (
  SELECT DISTINCT c, n + 1, 0, 4, 2, 0 FROM rows_
  UNION ALL
  SELECT c, i, least(e0, 2 + least(e2, 2 + e3)), least(e1, 2 + least(e2, 2 + e3)), least(e2, 2 + e3), least(e3, 2 + e2) FROM (
    SELECT r.c, r.i,
      least(3 + c0, CASE WHEN must_go THEN 999999999 ELSE least(2 + cut + c2, CASE kind WHEN 's' THEN cut + c1 WHEN 'u' THEN cut + c2 ELSE 999999999 END) END) AS e0,
      least(3 + c1, CASE WHEN must_go THEN 999999999 ELSE least(2 + cut + c2, CASE WHEN kind = 'u' THEN cut + c2 ELSE 999999999 END) END) AS e1,
      least(3 + c2, CASE WHEN must_go THEN 999999999 ELSE least(2 + cut + c3, CASE WHEN kind = 'a' THEN cut + c3 ELSE 999999999 END) END) AS e2,
      least(3 + c3, CASE WHEN must_go THEN 999999999 ELSE least(2 + cut + c2, CASE WHEN kind = 'u' THEN cut + c2 ELSE 999999999 END) END) AS e3
    FROM costs k JOIN rows_ r ON r.c = k.c AND r.i = k.i - 1)
), known AS MATERIALIZED (SELECT c, i, [c0, c1, c2, c3] AS v FROM costs),
places AS MATERIALIZED (
  SELECT k.c, k.i, k.v, a.v AS after, r.must_go, r.cut, r.kind, r.role, r.text
  FROM known k LEFT JOIN known a ON a.c = k.c AND a.i = k.i + 1 LEFT JOIN rows_ r ON r.c = k.c AND r.i = k.i
), trace(c, i, s, audit, lines) AS (
  SELECT c, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]) FROM rows_ WHERE i = 1
  UNION ALL
  SELECT c, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
         CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE kind WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE next END, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, wanted || ':')
                   WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, wanted || ':' || text) END
  FROM (
    SELECT t.*, p.kind, p.role, p.text, CASE WHEN t.s = 2 THEN 3 ELSE 2 END AS next,
           CASE WHEN t.s = 2 THEN 'assistant' ELSE 'user' END AS wanted,
           CASE WHEN p.after IS NOT NULL AND 3 + p.after[t.s + 1] = p.v[t.s + 1] THEN 'D'
                WHEN 2 + p.v[CASE WHEN t.s = 2 THEN 4 ELSE 3 END] = p.v[t.s + 1] THEN 'I'
                WHEN NOT p.must_go AND p.cut + CASE WHEN t.s = 0 AND p.kind = 's' THEN p.after[2]
                       WHEN t.s <> 2 AND p.kind = 'u' THEN p.after[3] WHEN t.s = 2 AND p.kind = 'a' THEN p.after[4] END = p.v[t.s + 1] THEN 'K'
                WHEN NOT p.must_go THEN 'R' END AS edit
    FROM trace t JOIN places p ON p.c = t.c AND p.i = t.i) WHERE edit IS NOT NULL
), results AS (
  SELECT c, arg_max(audit, len(audit)) AS audit, arg_max(lines, len(audit)) AS lines FROM trace GROUP BY c
), counts AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND seen) AS duplicate,
         count(*) FILTER (WHERE NOT blank AND NOT seen AND open) AS truncated,
         count(*) FILTER (WHERE earlier || kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY c
), found AS (
  SELECT n.*, k.v[1] AS cost, r.audit, sha256(array_to_string(r.lines, chr(10))) AS repaired_sha256
  FROM counts n JOIN results r USING (c) JOIN known k ON k.c = n.c AND k.i = 1
)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Plain k-means of each part: all distances in every round."""
    square = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i : (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""best{n} AS MATERIALIZED (
  SELECT x.row, x.p, x.v, min({square} * {entries} + b.e) AS best
  FROM pieces x JOIN book{n} b USING (p) GROUP BY x.row, x.p, x.v
)""")
        if n < rounds:
            steps.append(f"""book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN (
    SELECT p, e, list(mean ORDER BY i) AS v FROM (
      SELECT p, best % {entries} AS e, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
      FROM best{n}, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY ALL) GROUP BY p, e
  ) m USING (p, e)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label,
         list_transform(embedding, lambda x : CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT row, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v
  FROM kept, unnest(range(0, {parts})) AS u(p)
), firsts AS MATERIALIZED (
  SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept
  QUALIFY row_number() OVER (ORDER BY vec_id NULLS LAST, v) <= {entries}
), book0 AS MATERIALIZED (SELECT p, e, v FROM pieces JOIN firsts USING (row)),
{", ".join(steps)},
coded AS MATERIALIZED (
  SELECT row, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code,
         CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM best{rounds} GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM (
          SELECT p, e, i, v[i] AS x FROM book{rounds}, unnest(range(1, len(v) + 1)) AS u(i))) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


ORACLE = {
    "op1_decontaminate": DECONTAMINATE,
    "op6_jaccard_join": NEAR,
    "op7_mix_sources": MIX,
    "op8_warc": WARC,
    "op11_vector_codes": vector_codes_sql(),
    "op12_exact_copies": COPIES,
    "op13_conversation_repair": REPAIR,
}
