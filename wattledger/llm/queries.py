"""One query per operator over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, forest, infill, language, merges, orchard, packing, setjoin, token_counts, token_output, toxicity, url_filters, winnow

QUERIES = {
    "op1_embedding_near_dedup": forest.query,
    "op2_token_counts": token_counts.query,
    "op3_chat_format": chat.query,
    "op4_ngram_jaccard_join": setjoin.query,
    "op5_toxicity": toxicity.query,
    "op6_url_filters": url_filters.query,
    "op7_token_output": token_output.query,
    "op8_language_id": language.query,
    "op9_best_fit_packing": packing.query,
    "op10_decontamination": winnow.query,
    "op11_fill_in_middle": infill.query,
    "op12_vector_codes": orchard.query,
    "op13_sentencepiece": merges.query,
}

# Windows of ten words, or all words of a shorter item, against every run of as many words.
_DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
), hits AS (
  SELECT doc_id, s, m, item_id FROM runs JOIN windows USING (m, g)
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Sets of three words, all pairs with a word run in common, and reachability.
_JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), b AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_in FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_in >= 90 * (x.n + y.n - both_in)
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
), c AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

_ESCAPED = "replace(replace(replace({0}, '\\\\', '\\\\\\\\'), '#', '\\\\#'), '</turn>', '<\\\\/turn>')".replace("\\\\", "\\")
# Every turn counts with its marks: '### ', ' ###' and a line break, '</turn>' and a line break.
_CHAT_FORMAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL
  SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), j AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(4 + length({_ESCAPED.format('role')}) + 5 + length({_ESCAPED.format('text')}) + 8) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM j
"""

# Keys by generating all folders and domains above; the active entry is found with a plain range join.
_URL_FILTERS = r"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', ['host', 'path']) AS u,
         DATE '2023-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 730 AS INTEGER) AS fetched
  FROM pages
), c AS (
  SELECT page_id, fetched, lower(u.host) AS host, CASE WHEN u.path = '' THEN '/' ELSE u.path END AS path FROM p WHERE u.host <> ''
), k AS (
  SELECT page_id, fetched, 'host' AS kind, host AS key FROM c
  UNION ALL SELECT page_id, fetched, 'url', host || path FROM c
  UNION ALL SELECT page_id, fetched, 'domain', array_to_string(string_split(host, '.')[i:], '.')
    FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM c)
  UNION ALL SELECT page_id, fetched, 'prefix', host || array_to_string(string_split(path, '/')[1:i], '/') || '/'
    FROM (SELECT *, unnest(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1)) AS i FROM c)
), named AS (
  SELECT 'host' AS kind, host AS key FROM c
  UNION SELECT 'url', host || path FROM c
  UNION SELECT 'domain', regexp_replace(host, '^(www|m|blog)\.', '') FROM c
  UNION SELECT 'prefix', host || '/' || string_split(path, '/')[2] || '/' FROM c
), h AS (
  SELECT kind, key, CAST('0x' || substr(md5(kind || ' ' || key), 1, 8) AS BIGINT) AS h FROM named
), log AS (
  SELECT kind, key, CASE WHEN h % 5 = 0 THEN 'allow' ELSE 'block' END AS action, h % 600 AS first, h % 600 + 40 + h % 97 AS second FROM h WHERE h % 3 = 0
), active AS (
  SELECT kind, key, action, DATE '2023-01-01' + CAST(first AS INTEGER) AS since, DATE '2023-01-01' + CAST(second AS INTEGER) AS until FROM log
  UNION ALL SELECT kind, key, action, DATE '2023-01-01' + CAST(second + 60 AS INTEGER), DATE '9999-12-31' FROM log
), m AS (
  SELECT page_id, kind, key, action,
         row_number() OVER (PARTITION BY page_id ORDER BY list_position(['domain', 'host', 'prefix', 'url'], kind) DESC, length(key) DESC, since DESC, action DESC, key DESC) AS r,
         count(*) OVER (PARTITION BY page_id) AS n
  FROM k JOIN active USING (kind, key) WHERE since <= fetched AND fetched < until
)
SELECT p.page_id, CAST(coalesce(n, 0) AS BIGINT) AS n_entries, kind, key, action, coalesce(action = 'block', false) AS blocked
FROM pages p LEFT JOIN m ON m.page_id = p.page_id AND r = 1
"""

# Units by a regular expression, segments by joining lists of them.
_FILL_IN_MIDDLE = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT doc_id, text, w, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90
              THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), s AS (
  SELECT *, array_to_string(w[1:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(w[greatest(x, y) + 1:n], '') AS q FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every distance of every part to every entry, the least one first; one pair of steps a round."""
    def nearest(round_: int) -> str:
        return f"""
n{round_} AS MATERIALIZED (
  SELECT id, label, part, p, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
    SELECT v.id, v.label, v.part, v.p, c.entry, list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM v JOIN c{round_} c USING (part)
  ) GROUP BY id, label, part, p
)"""

    def means(round_: int) -> str:
        return f"""
c{round_ + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.p, c.p) AS p FROM c{round_} c LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS p FROM (
      SELECT part, entry, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
      FROM (SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM n{round_}) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) m USING (part, entry)
)"""

    steps = ",".join(nearest(r) + "," + means(r) for r in range(rounds)) + "," + nearest(rounds)
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), v AS MATERIALIZED (
  SELECT id, label, part, e[part * (len(e) // {parts}) + 1:(part + 1) * (len(e) // {parts})] AS p FROM k, range({parts}) t(part)
), c0 AS (
  SELECT part, dense_rank() OVER (ORDER BY id) - 1 AS entry, p FROM v WHERE id IN (SELECT id FROM k ORDER BY id LIMIT {entries})
),{steps},
r AS (
  SELECT id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY id, label
)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM r
"""


ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": _FILL_IN_MIDDLE,
    "op12_vector_codes": _vector_codes(),
    "op6_url_filters": _URL_FILTERS,
    "op3_chat_format": _CHAT_FORMAT,
    "op4_ngram_jaccard_join": _JACCARD_JOIN,
    "op10_decontamination": _DECONTAMINATION,
}
