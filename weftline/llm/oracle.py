"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT html, max(page_id) AS top FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha1(html), CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (html)
"""

CONTROLS = r"<\\*/s>|<\\*s>|<\\*\|(turn|says|image|audio|document|endoftext)\|>|\[\\*/?INST\]"
OP3 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(20 + length(role) + length(text) + len(regexp_extract_all(text, '{CONTROLS}'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def words(table: str, key: str, name: str) -> str:
    return f"{name} AS (SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"


def grams(source: str, key: str, name: str) -> str:
    """Each text's runs of five words with their places, as text."""
    return f"{name} AS (SELECT {key}, unnest(range(CAST(len(w) - 4 AS BIGINT))) AS pos, unnest(list_transform(range(CAST(len(w) - 4 AS BIGINT)), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) AS g FROM {source} WHERE len(w) >= 5)"


OP4 = f"""
WITH {words("documents", "doc_id", "d")}, {words("benchmark", "item_id", "b")}, {grams("d", "doc_id", "dg")}, {grams("b", "item_id", "bg")},
 bc AS (SELECT item_id, g, count(*) AS c FROM bg GROUP BY ALL), m AS (SELECT item_id, len(w) - 4 AS m FROM b WHERE len(w) >= 5), dm AS (SELECT doc_id, len(w) - 4 AS n FROM d WHERE len(w) >= 5),
 hits AS (SELECT doc_id, item_id, pos, g, c FROM dg JOIN bc USING (g)),
 near AS (SELECT doc_id, item_id FROM hits JOIN m USING (item_id) GROUP BY doc_id, item_id, m HAVING count(*) >= 0.8 * m),
 starts AS (SELECT DISTINCT doc_id, item_id, m, n, greatest(0, least(s, n - m)) AS s FROM (SELECT doc_id, item_id, m, n, unnest(range(pos - m + 1, pos + 1)) AS s FROM hits JOIN near USING (doc_id, item_id) JOIN m USING (item_id) JOIN dm USING (doc_id))),
 shared AS (SELECT doc_id, item_id, m, s, h.g, least(count(*), any_value(c)) AS k FROM starts JOIN hits h USING (doc_id, item_id) WHERE h.pos BETWEEN s AND s + m - 1 GROUP BY ALL),
 scored AS (SELECT doc_id, item_id, s, CAST(sum(k) AS DOUBLE) / m AS similarity FROM shared GROUP BY doc_id, item_id, s, m)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(s, (-similarity, s)) AS BIGINT) AS first_word FROM scored WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, item_id
"""

OP5 = f"""
WITH RECURSIVE {words("documents", "doc_id", "d")}, {grams("d", "doc_id", "long")},
 s AS (SELECT DISTINCT doc_id, g FROM long UNION ALL SELECT doc_id, 'whole ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON a = d.doc_id
"""

OP12 = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 good AS (SELECT vec_id, label, v FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.93),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN least_of ON least_of.a = vec_id
"""

SQL = {"op1_warc_shards": OP1, "op3_chat_parts": OP3, "op4_simhash_windows": OP4, "op5_parity_join": OP5, "op12_pca_tiles": OP12}
