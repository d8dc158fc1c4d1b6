"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size, list_slice(w, i, i + least(len(w), 13) - 1) AS gram
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS gram
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hits AS (
    SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, gram)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The contract's columns of op2; the shards that the tree draws are beyond SQL, so it is for tests alone.
OP2 = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
    FROM documents
), s AS (
    SELECT source, sum(size) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), step AS (
    SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0) AS left_n, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w
    FROM s WINDOW before AS (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
    SELECT source, n, w, 3 * n * left_w < left_n * w AS at_cap FROM step
), goal AS (
    SELECT source, n, CASE WHEN at_cap THEN CAST(3 * n AS DOUBLE)
        ELSE CAST((sum(n) OVER () - sum(CASE WHEN at_cap THEN 3 * n ELSE 0 END) OVER ()) * w AS DOUBLE)
             / CAST(sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
    FROM capped
), placed AS (
    SELECT d.doc_id, d.size, CAST(g.n AS BIGINT) AS source_size, g.target,
           CASE WHEN g.n > 0 THEN floor(g.target / g.n) ELSE 0 END AS passes,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN source_size > 0 AND begins + size / 2.0 <= target - passes * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

OP7 = r"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
    SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN last IS NOT NULL AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.n >= 1000
"""

CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP6 = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length({_escaped("role")}) + 1 + length({_escaped("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP12 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
    WHERE len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.93
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


def _kmeans(clusters: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment (a) and centroids (c) as one table expression after another."""
    steps = [f"""v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, e FROM v ORDER BY sha256('2:' || vec_id) LIMIT {clusters}
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT vec_id, any_value(v.e) AS e, min({{'d': d, 'c': c}}) AS best FROM (
        SELECT vec_id, v.e, c, list_sum(list_transform(list_zip(v.e, c{i}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}
    ) v GROUP BY vec_id
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
    SELECT c, list(floor(s / n)::BIGINT ORDER BY p) AS e
    FROM (SELECT best.c AS c, p, sum(x) AS s, count(*) AS n FROM (SELECT best, unnest(e) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY 1, 2) GROUP BY c
), c{i + 1} AS MATERIALIZED (
    SELECT c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (c)
)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c
"""


OP13 = _kmeans()

ORACLES = {
    "op6_chat_format": OP6, "op7_warc": OP7, "op3_decontaminate": OP3, "op12_metric_join": OP12, "op13_heap_kmeans": OP13,
}
