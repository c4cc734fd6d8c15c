"""Registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .ball_tree import op11_ball_tree
from .fingerprints import op5_fingerprints
from .html_text import op2_html_text
from .jaccard_join import op3_jaccard_join
from .lexical import op12_lexical
from .mixing import op4_mixing
from .orc_tokens import op6_orc_tokens
from .packing import op10_packing
from .quality import op8_quality
from .sharding import op9_sharding
from .suffix_dedup import op1_suffix_dedup
from .vectors import op7_nearest
from .whitening import op13_whitening

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_text": op2_html_text,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_fingerprints": op5_fingerprints,
    "op6_orc_tokens": op6_orc_tokens,
    "op7_nearest": op7_nearest,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_packing": op10_packing,
    "op11_ball_tree": op11_ball_tree,
    "op12_lexical": op12_lexical,
    "op13_whitening": op13_whitening,
}

# Repeated windows by their hashes, one row each: exact, but only for small tables.
_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, n, s, md5_number(substr(h, CAST(2 * s + 1 AS BIGINT), 400)) AS k
      FROM (SELECT doc_id, n, h, unnest(range(n - 199)) AS s FROM d WHERE n >= 200)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
runs AS (SELECT doc_id, min(s) AS lo, max(s) + 200 AS hi
         FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run
               FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM hit))
         GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS nxt,
                row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS i FROM runs),
kept AS (SELECT g.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed,
                string_agg(CASE WHEN i = 1 THEN substr(h, 1, CAST(2 * lo AS BIGINT)) ELSE '' END
                           || substr(h, CAST(2 * hi + 1 AS BIGINT), CAST(2 * (coalesce(nxt, n) - hi) AS BIGINT)), '' ORDER BY lo) AS rest
         FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

# All pairs that share a shingle, then everything reachable.
_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
                                GROUP BY a.doc_id, b.doc_id) p
          JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = documents.doc_id
"""

# Every query against every vector.
_OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

# Every document that shares a term with an item.
_OP12 = r"""
WITH dt AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                   lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
it AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
              lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark),
d AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM dt WHERE len(terms) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM d),
tf AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, c),
s AS (SELECT it.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * c.n_docs) // c.l)))) AS BIGINT) AS score
      FROM it JOIN tf ON it.term = tf.term JOIN w ON w.term = it.term, c GROUP BY it.item_id, tf.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": _OP1, "op3_jaccard_join": _OP3, "op11_ball_tree": _OP11,
                              "op12_lexical": _OP12}
