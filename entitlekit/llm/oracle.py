"""DuckDB equivalents of the registered queries that SQL can express."""

from __future__ import annotations

from entitlekit.llm.licenses import TEMPLATES

ORACLE_SQL = {}

ORACLE_SQL["op4_recompression_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM docs WHERE len(words) >= 20
), windows AS (
  SELECT doc_id, p, array_to_string(list_slice(words, p, p + 19), ' ') AS w FROM starts
), later AS (
  SELECT doc_id, p FROM windows
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1
), removed AS (
  SELECT DISTINCT doc_id, p + k AS p FROM later, range(20) AS t(k)
), lists AS (
  SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM removed GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(
    CASE WHEN gone IS NULL THEN words ELSE
      list_filter(list_transform(words, lambda w, i: CASE WHEN list_contains(gone, i) THEN NULL ELSE w END), lambda w: w IS NOT NULL)
    END, ' '), '')) AS kept_sha256
FROM docs d LEFT JOIN lists l ON d.doc_id = l.doc_id
"""

ORACLE_SQL["op6_suffix_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM docs WHERE length(h) >= 100
), windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM starts
), later AS (
  SELECT doc_id, p FROM windows
  QUALIFY doc_id > min(doc_id) OVER (PARTITION BY w)
), edges AS (
  SELECT doc_id, p, CASE WHEN p <= 50 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) THEN 0 ELSE 1 END AS fresh
  FROM later
), numbered AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM edges
), spans AS (
  SELECT doc_id, span, min(p) AS lo, max(p) + 50 AS hi FROM numbered GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans
), cut AS (
  SELECT s.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head,
    max(hi) AS tail_from, sum(hi - lo) AS n_removed, count(*) AS n_spans
  FROM pieces s JOIN docs USING (doc_id) GROUP BY s.doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN head IS NULL THEN unhex(h) ELSE unhex(head || substr(h, 2 * tail_from + 1)) END) AS kept_sha256
FROM docs d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""

ORACLE_SQL["op10_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS width, array_to_string(list_slice(words, p, p + least(13, len(words)) - 1), ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS p FROM items WHERE len(words) > 0)
), widths AS (
  SELECT DISTINCT width FROM item_windows
), doc_windows AS (
  SELECT doc_id, width, p, array_to_string(list_slice(words, p, p + width - 1), ' ') AS w
  FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS p FROM docs, widths WHERE len(words) >= width)
), hits AS (
  SELECT d.doc_id, d.p, d.width, i.item_id FROM doc_windows d JOIN item_windows i ON d.width = i.width AND d.w = i.w
), covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT doc_id, p, width FROM hits), range(13) AS t(k)
  WHERE k < width GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id
"""

ORACLE_SQL["op7_minhash_near_dedup"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, p, p + 4), ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM docs WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  WHERE 10 * common >= 8 * (m.n + n.n - common)
), reach AS (
  SELECT doc_id, doc_id AS node FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.node = l.a
)
SELECT doc_id, min(node) AS class_id FROM reach GROUP BY doc_id
"""

_TEMPLATES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES.items())

ORACLE_SQL["op9_license_scan"] = r"""
WITH templates(license, text) AS (VALUES """ + _TEMPLATES + r"""
), template_words AS (
  SELECT license, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\n]+', ' ', 'g'), '[ \n]+'), lambda w: w <> '') AS words FROM templates
), template_grams AS (
  SELECT license, len(words) AS length, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS template FROM template_words
), normal AS (
  SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\n]+', ' ', 'g') AS normal FROM documents
), pieces AS (
  SELECT DISTINCT doc_id, unnest(string_split(normal, chr(10)) || regexp_split_to_array(normal, '\n(?: ?\n)+') || [normal]) AS segment FROM normal
), words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(segment, '[ \n]+'), lambda w: w <> '') AS words FROM pieces
), grams AS (
  SELECT doc_id, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS grams FROM words WHERE len(words) > 1
), scored AS (
  SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)) AS dice
  FROM grams, template_grams WHERE len(grams) * 3 >= len(template) * 2 AND len(grams) * 2 <= len(template) * 3
), lined AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''), '([.!?:;])[ \t]+', '\1' || chr(10), 'g')), '[^\p{L}\p{N}\n]+', ' ', 'g'), chr(10)),
    lambda u: list_filter(string_split(u, ' '), lambda w: w <> '')), lambda u: len(u) > 0) AS units FROM documents
), flat AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, units, flatten(units) AS words FROM lined
), met AS MATERIALIZED (
  SELECT r, doc_id, units, words, license, length, template
  FROM (SELECT *, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS grams FROM flat WHERE len(words) > 1), template_grams
  WHERE 3 * len(list_intersect(template, grams)) >= 2 * len(template)
), opened AS (
  SELECT r, license, k, len(u) AS n FROM (SELECT r, license, unnest(units) AS u, generate_subscripts(units, 1) AS k FROM met)
), placed AS MATERIALIZED (
  SELECT r, license, n, sum(n) OVER (PARTITION BY r, license ORDER BY k) AS upto FROM opened
), stretches AS (
  SELECT m.doc_id, m.license, m.template, list_slice(m.words, (a.upto - a.n + 1)::BIGINT, b.upto::BIGINT) AS words
  FROM met m JOIN placed a ON a.r = m.r AND a.license = m.license
  JOIN placed b ON b.r = a.r AND b.license = a.license AND b.upto - a.upto + a.n BETWEEN floor(m.length * 2 / 3) AND ceil(m.length * 3 / 2)
), stretch_grams AS (
  SELECT doc_id, license, template, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS grams FROM stretches WHERE len(words) > 1
), every AS (
  SELECT * FROM scored
  UNION ALL
  SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)) FROM stretch_grams
), found AS (
  SELECT doc_id, license, max(dice) AS dice FROM every WHERE dice >= 0.8 GROUP BY ALL
), best AS (
  SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses, first(license ORDER BY dice DESC, license) AS best_license, max(dice) AS best_dice
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM documents d LEFT JOIN best b ON d.doc_id IS NOT DISTINCT FROM b.doc_id
"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds one after another: every part against every entry of its position, then the floors of the means."""
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS v,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT n, k, list_slice(v, k * (len(v) // {parts}) + 1, (k + 1) * (len(v) // {parts})) AS part FROM kept, range({parts}) AS t(k)
), book0 AS MATERIALIZED (
  SELECT k, n - 1 AS e, part AS entry FROM parts WHERE n <= {entries}
)"""
    for r in range(rounds + 1):
        sql += f""", near{r} AS MATERIALIZED (
  SELECT n, k, any_value(part) AS part, min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + e) AS best
  FROM parts JOIN book{r} USING (k) GROUP BY n, k
)"""
        if r < rounds:
            sql += f""", sums{r} AS (
  SELECT k, best % {entries} AS e, p, sum(part[p])::HUGEINT AS s, count(*)::HUGEINT AS c
  FROM (SELECT k, best, part, unnest(range(1, len(part) + 1)) AS p FROM near{r}) GROUP BY ALL
), moved{r} AS (
  SELECT k, e, list((s - ((s % c) + c) % c) // c ORDER BY p) AS entry FROM sums{r} GROUP BY k, e
), book{r + 1} AS MATERIALIZED (
  SELECT b.k, b.e, coalesce(m.entry, b.entry) AS entry FROM book{r} b LEFT JOIN moved{r} m ON b.k = m.k AND b.e = m.e
)"""
    return sql + f""", coded AS (
  SELECT n, string_agg(lower(printf('%02x', (best % {entries})::BIGINT)), '' ORDER BY k) AS code, sum(best // {entries}) AS error FROM near{rounds} GROUP BY n
)
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY k, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (n)
"""


ORACLE_SQL["op11_vector_codes"] = _vector_codes()

ORACLE_SQL["op13_source_divergence"] = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), in_doc AS MATERIALIZED (
  SELECT n, lang, source, term, count(*) AS c FROM (SELECT n, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, sum(c)::HUGEINT AS lang_count FROM in_doc GROUP BY ALL HAVING count(*) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_count)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM docs
), held AS MATERIALIZED (
  SELECT i.lang, i.source, i.term, sum(c)::HUGEINT AS c FROM in_doc i JOIN kept k ON i.lang = k.lang AND i.term = k.term GROUP BY ALL
), sizes AS (
  SELECT lang, source, sum(c)::HUGEINT AS total FROM held GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
    (1 + (1000000000 * (coalesce(h.c, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v))::HUGEINT AS p,
    (1 + (1000000000 * (k.lang_count + 2)) // (l.total + 2 * l.v))::HUGEINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN sizes s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN held h ON g.lang = h.lang AND g.source = h.source AND k.term = h.term
), sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE c > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""
