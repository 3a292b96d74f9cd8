"""DuckDB SQL that checks the queries which SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(len(words), 10) AS size FROM b WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[s:s + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS s FROM sized)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, s, array_to_string(words[s:s + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM d, sizes WHERE len(words) >= size)),
hits AS (SELECT p.doc_id, p.s, p.size, p.win FROM places p JOIN (SELECT DISTINCT win, size FROM windows) USING (win, size)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + size)) AS w FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list
          FROM (SELECT DISTINCT doc_id, win, size FROM hits) JOIN windows USING (win, size) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, length(regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) AS role_chars,
            length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) AS text_chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(8 + role_chars + 8 + text_chars + 7)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces WHERE len(words) > 0 GROUP BY lang),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS s FROM pieces),
grams AS (
  SELECT lang, size, words[s:s + size - 1] AS gram, count(*) AS f
  FROM places, (SELECT unnest(range(1, 5)) AS size) WHERE s + size - 1 <= len(words) GROUP BY ALL),
often AS (SELECT * FROM grams WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.gram, c.size AS size, c.f AS a, k, l.f AS l, r.f AS r,
         (2000000::HUGEINT * c.f // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1) c
  JOIN often l ON l.lang = c.lang AND l.gram = c.gram[1:k]
  JOIN often r ON r.lang = c.lang AND r.gram = c.gram[k + 1:c.size]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
held AS (
  SELECT DISTINCT b.lang, b.gram
  FROM (SELECT lang, f, size, gram, unnest(range(2, size)) AS part FROM often WHERE size > 2) o,
       (SELECT unnest(range(1, 4)) AS s) p, best b
  WHERE s + part - 1 <= o.size AND b.lang = o.lang AND b.gram = o.gram[s:s + part - 1] AND 100::HUGEINT * o.f >= 80::HUGEINT * b.a),
left_over AS (SELECT *, array_to_string(gram, ' ') AS phrase FROM best ANTI JOIN held USING (lang, gram)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _op13() -> str:
    rounds = "".join(
        f"""
a{k} AS (SELECT uid, vec_id, v, c, d FROM (SELECT vectors.uid, vectors.vec_id, vectors.v, c,
       list_sum(list_transform(list_zip(vectors.v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM vectors, c{k})
       QUALIFY row_number() OVER (PARTITION BY uid ORDER BY d, c) = 1),
s{k} AS (SELECT c, list(m ORDER BY i) AS w FROM (
       SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
       FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i) GROUP BY c),
c{k + 1} AS (SELECT c, coalesce(s{k}.w, c{k}.w) AS w FROM c{k} LEFT JOIN s{k} USING (c)),"""
        for k in range(5)
    )
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v AS w
       FROM vectors QUALIFY c < 40),{rounds}
final AS (SELECT uid, vec_id, c, d, w FROM (SELECT uid, vec_id, c, w,
       list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM vectors, c5)
       QUALIFY row_number() OVER (PARTITION BY uid ORDER BY d, c) = 1)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM final
"""


ORACLES = {"op11_collocations": OP11, "op13_centroids": _op13(), "op4_decontaminate": OP4, "op9_chat_format": OP9}
