"""SQL of the queries of this subpackage, where SQL can state them on whole tables."""

from __future__ import annotations

_KEYED = r"""
WITH keyed AS (
  SELECT 'sampling_frame_1200' AS table_name, 'catalog' AS field_name, catalog AS k FROM sampling_frame_1200
  UNION ALL SELECT 'human_labels_201', 'llm_says', llm_says FROM human_labels_201
  UNION ALL SELECT 'human_labels_201', 'model', model FROM human_labels_201),
counts AS (SELECT table_name, field_name, lower(trim(k, E' \t\n\r')) AS k, count(*) AS n FROM keyed GROUP BY ALL),
report AS (
  SELECT target_set, category, coalesce(n, 0) AS available, greatest(CAST(round(target_share * sample_size) AS BIGINT), min_rows) AS needed
  FROM sample_targets t LEFT JOIN counts c ON c.table_name = t.table_name AND c.field_name = t.field_name AND c.k = lower(trim(t.category, E' \t\n\r')))
"""

_COPIES = r"""
WITH hidden AS (
  SELECT row_id FROM verdicts WHERE regexp_matches(title, '[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}\x{FB00}-\x{FB06}\x{0300}-\x{036F}]')
     OR regexp_matches(title, '\p{Latin}[\p{L}\p{N}]*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{L}\p{N}]*\p{Latin}')),
words AS (
  SELECT row_id, catalog, model, in_catalog, list_sort(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS w FROM verdicts WHERE row_id NOT IN (SELECT row_id FROM hidden)),
grouped AS (SELECT row_id, min(row_id) OVER (PARTITION BY catalog, model, in_catalog, w) AS keep_id FROM words WHERE len(w) > 0)
"""

_SPANS = """
WITH starts AS (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS p FROM documents WHERE length(text) >= 400),
windows AS (SELECT doc_id, p, md5(substr(text, p, 400)) AS h FROM starts),
owners AS (SELECT DISTINCT doc_id, h FROM windows),
common AS (SELECT h FROM owners GROUP BY h HAVING count(*) > 1),
held AS (SELECT doc_id, h FROM owners SEMI JOIN common USING (h))
"""

_SAMPLE = """
WITH keyed AS (
  SELECT 'sampling_frame_1200' AS table_name, 'catalog' AS field_name, row_id, catalog AS k FROM sampling_frame_1200
  UNION ALL SELECT 'human_labels_201', 'llm_says', row_id, llm_says FROM human_labels_201
  UNION ALL SELECT 'human_labels_201', 'model', row_id, model FROM human_labels_201),
bare AS (SELECT table_name, field_name, row_id, lower(trim(k, E' \\t\\n\\r')) AS k FROM keyed WHERE k IS NOT NULL),
mixed AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '17', table_name, field_name, k, row_id)), 1, 10))::BIGINT AS random FROM bare),
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, field_name, k ORDER BY random, row_id)::HUGEINT AS rank, count(*) OVER (PARTITION BY table_name, field_name, k)::HUGEINT AS available FROM mixed),
wanted AS (
  SELECT table_name, field_name, target_set, category, lower(trim(category, E' \\t\\n\\r')) AS k, CAST(round(target_share * sample_size) AS HUGEINT) AS by_share,
         greatest(CAST(round(target_share * sample_size) AS HUGEINT), min_rows) AS needed, ('0x' || substr(md5('17|' || target_set), 1, 5))::HUGEINT AS start FROM sample_targets),
first AS (
  SELECT target_set, category, row_id, rank, available, needed, start, least(by_share, available) AS n,
         CASE WHEN by_share >= available THEN rank ELSE (rank * by_share + start * available // 1048576) // available END AS upto,
         CASE WHEN by_share >= available THEN rank - 1 ELSE ((rank - 1) * by_share + start * available // 1048576) // available END AS until
  FROM ranked JOIN wanted USING (table_name, field_name, k) WHERE needed > 0),
rest AS (SELECT *, rank - upto AS remaining, available - n AS pool, least(needed, available) - n AS more FROM first),
again AS (
  SELECT *, upto = until AND CASE WHEN more >= pool THEN true ELSE (remaining * more + start * pool // 1048576) // pool > ((remaining - 1) * more + start * pool // 1048576) // pool END AS repaired FROM rest)
SELECT target_set, category, row_id, repaired FROM again WHERE upto > until OR repaired
"""

ORACLE: dict[str, str] = {
    "p1_sample": _SAMPLE,
    "p1_found": _KEYED + "SELECT target_set, category FROM report WHERE available < needed",
    "p1_report": _KEYED + "SELECT target_set, category, available, needed, least(available, needed) AS drawn, needed - least(available, needed) AS shortfall FROM report",
    "p6_found": _COPIES + "SELECT keep_id, row_id AS copy_id FROM grouped WHERE row_id <> keep_id",
    "p6_copies": _COPIES + "SELECT row_id, keep_id, count(*) OVER (PARTITION BY keep_id) AS n_copies FROM grouped",
    "p8_found": r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
grams AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM item_words)),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
doc_grams AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM doc_words))
SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN grams USING (g)""",
    "p9_found": _SPANS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM held a JOIN held b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_shared": _SPANS
    + """, places AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM windows SEMI JOIN common USING (h)),
parts AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS part FROM places),
stretches AS (SELECT doc_id, max(p) - min(p) + 400 AS n FROM parts GROUP BY doc_id, part),
sums AS (SELECT doc_id, sum(n)::BIGINT AS shared_chars, count(*) AS n_spans FROM stretches GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0.0 END AS shared_share, coalesce(n_spans, 0) AS n_spans FROM documents LEFT JOIN sums USING (doc_id)""",
}
ORACLE["p8_items"] = f"SELECT item_id, count(*) AS n_docs FROM ({ORACLE['p8_found']}) GROUP BY 1"
