"""SQL for the operators that it can express on whole tables."""

from __future__ import annotations

WORDS = r"""w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (
    SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents))"""

JACCARD = f"""WITH RECURSIVE {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
g AS (SELECT doc_id, pos, count(*) OVER v AS n, string_agg(word, ' ') OVER v AS gram, count(*) OVER (PARTITION BY doc_id) AS total FROM w
    WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE n = 5 OR (total < 5 AND pos = 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.doc_id)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN z USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)"""

SUBSTRINGS = f"""WITH {WORDS.format(text="coalesce(text, '')")},
g AS (SELECT doc_id, pos, count(*) OVER v AS n, string_agg(word, ' ') OVER v AS gram FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
o AS (SELECT gram, min(doc_id) AS owner FROM g WHERE n = 13 GROUP BY gram),
f AS (SELECT g.doc_id, pos, CAST(owner < g.doc_id AS INT) AS again FROM g JOIN o USING (gram) WHERE n = 13),
r AS (SELECT w.doc_id, word, pos, coalesce(max(again) OVER (PARTITION BY w.doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone FROM w LEFT JOIN f USING (doc_id, pos))
SELECT d.doc_id, count(word)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256 FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""

ORACLES = {"op3_jaccard_join": JACCARD, "op4_substring_dedup": SUBSTRINGS}
