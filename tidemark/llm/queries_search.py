"""Registered queries of the search, prefix trie and quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import mask_search, prefix_trie, quality
from tidemark.llm.common import documents, table
from tidemark.llm.registry import query


@query("op11_mask_search", """
WITH d AS (SELECT doc_id, row_number() OVER () AS no, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT no, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT no, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY no, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
v AS (SELECT no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS value FROM p JOIN w USING (term), s),
r AS (SELECT item_id, any_value(doc_id) AS doc_id, sum(value)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY item_id, no)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def op11(spark, sf_dir):
    return mask_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


# DuckDB has no crc32, so it is folded bit by bit over the bytes of the decimal number; a subtree is found from its nodes' smallest members
@query("op12_prefix_trie", """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS k, said, size FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS said, strlen(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, c - c % 5 AS first, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h, FROM (SELECT DISTINCT c FROM t)),
f AS (SELECT h.c, first, h, count(t.c) AS n FROM h LEFT JOIN t ON t.c = first AND k <= h GROUP BY ALL),
p AS (SELECT f.c, t.k AS d, said, size FROM f JOIN t ON t.c = first AND k <= h UNION ALL SELECT f.c, n + t.k - h, said, size FROM f JOIN t ON t.c = f.c AND k > h),
x AS (SELECT c, d, size, sha256(string_agg(said, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key FROM p UNION ALL SELECT c, 0, 0, '' FROM f),
y AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent, lead(key) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM x),
v AS (SELECT key, any_value(d) AS depth, any_value(size) AS size, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM y GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n FROM v GROUP BY parent),
u AS (SELECT y.key, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * v.size)::BIGINT AS saved_tokens FROM v JOIN y ON y.c = v.conv_id AND y.d <= v.depth GROUP BY y.key)
SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN u USING (key) LEFT JOIN k USING (key) LEFT JOIN v a ON a.key = v.parent""")
def op12(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op13_quality_rules")
def op13(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("probability")
