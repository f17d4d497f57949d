"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_ESCAPED = "replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 11 AS size,
    row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS stop FROM sized
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(stop) FILTER (WHERE role = 'assistant' OR n = n_turns) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), usable AS (
  SELECT * FROM v
  WHERE len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]), lambda a, b: a + b, CAST(0 AS DOUBLE)) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.vec) = len(q.vec)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

WARC = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""

MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents
), sizes AS (SELECT key, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY key),
t AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM sizes),
shares AS (SELECT tokens / total AS p FROM sizes, t WHERE tokens > 0),
ends AS (SELECT min(p) AS low, max(p) AS high FROM shares),
search AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN pow(low, m - 1) / pow(high, m - 1) <= 2 THEN lo ELSE m END,
    CASE WHEN pow(low, m - 1) / pow(high, m - 1) <= 2 THEN m ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m FROM search WHERE i < 48), ends
), a AS (
  SELECT CASE WHEN high / low <= 2 THEN 0 ELSE hi END AS a FROM search, ends WHERE i = 48
), w AS (
  SELECT sum(pow(p, a)) AS z, max(pow(p, 1 - a)) AS least FROM shares, a
), plan AS (
  SELECT key, tokens, CAST(round(CASE WHEN tokens > 0 THEN pow(tokens / total, a) / z ELSE 0 END * (total * z * least)) AS BIGINT) AS budget
  FROM sizes, t, a, w
), split AS (
  SELECT key, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM plan
), last AS (
  SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY key ORDER BY md5('0:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN split USING (key)
), drawn AS (
  SELECT doc_id, source, n_tokens, unnest(range(0, CASE WHEN rest > 0 AND upto <= rest THEN whole + 1 ELSE whole END)) AS block FROM last
)
SELECT doc_id, source, block, n_tokens, md5('0:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key FROM drawn
"""

REPEATS = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), blocks AS (
  SELECT doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 99), 500)) AS base FROM b
), parts AS (
  SELECT doc_id, base, substr(x, CAST(2 * base + 1 AS BIGINT), 1198) AS y FROM blocks
), places AS (
  SELECT doc_id, base + i AS p, md5(substr(y, CAST(2 * i + 1 AS BIGINT), 200)) AS s
  FROM (SELECT doc_id, base, y, unnest(range(0, least(500, length(y) // 2 - 99))) AS i FROM parts)
), again AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM places
  ) WHERE n > 1
), marked AS (
  SELECT doc_id, p, CASE WHEN p > lag(p) OVER w + 100 THEN 1 ELSE 0 END AS fresh FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), runs AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), spans AS (
  SELECT doc_id, min(p) AS start, max(p) + 100 AS stop FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(stop) OVER w, 0) AS a, start AS z FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY start)
  UNION ALL SELECT doc_id, max(stop), NULL FROM spans GROUP BY doc_id
), total AS (
  SELECT doc_id, sum(stop - start) AS removed, count(*) AS n FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(CASE WHEN z IS NULL THEN substr(x, CAST(2 * a + 1 AS BIGINT)) ELSE substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)) END, '' ORDER BY a) AS x
  FROM gaps JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, CAST(length(b.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, b.x))) AS kept_sha256
FROM b LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op3_suffix_array_dedup": REPEATS, "op1_source_mixing": MIXING, "op4_warc": WARC, "op9_chat_formatting": CHAT, "op10_nearest_neighbours": NEAREST}
