"""SQL of the text queries that SQL can express on whole tables."""

# words: each character U+4E00-U+9FFF alone, else runs of letters and digits
_WORDS = r"regexp_extract_all(regexp_replace(lower({}), '([一-鿿])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


def _runs(table: str, key: str, text: str, width: int) -> str:
    return f"""
        SELECT DISTINCT {key}, array_to_string(w[i:i + {width - 1}], ' ') AS run
        FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {width - 1})) AS i FROM (SELECT {key}, {_WORDS.format(text)} AS w FROM {table}))"""


_PAIRS = f"""
    runs AS ({_runs('doc_cache', 'path', 'content', 5)}),
    size AS (SELECT path, count(*) AS n FROM runs GROUP BY path),
    common AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.path < b.path GROUP BY 1, 2),
    pair AS (SELECT path_a, path_b, c.n AS both_have, x.n + y.n - c.n AS either_has FROM common c JOIN size x ON x.path = path_a JOIN size y ON y.path = path_b)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_PAIRS} SELECT path_a, path_b FROM pair WHERE 10 * both_have >= 6 * either_has",
    "p1_groups": f"""
        WITH RECURSIVE {_PAIRS},
        near AS (SELECT path_a AS a, path_b AS b, both_have = either_has AS same FROM pair WHERE 10 * both_have >= 6 * either_has),
        edge AS (SELECT a, b, same FROM near UNION ALL SELECT b, a, same FROM near),
        reach AS (SELECT path AS a, path AS b FROM size UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
        class AS (SELECT s.path, least(s.path, coalesce(min(e.b), s.path)) AS class_path FROM size s LEFT JOIN edge e ON e.a = s.path AND e.same GROUP BY s.path)
        SELECT c.path, c.class_path, (SELECT min(b) FROM reach r WHERE r.a = c.path) AS group_path,
               (SELECT count(DISTINCT d.class_path) FROM edge e JOIN class d ON d.path = e.b WHERE e.a = c.path AND NOT e.same) AS links
        FROM class c""",
    "p6_found": f"""
        WITH doc AS ({_runs('documents', 'doc_id', 'text', 12)}), item AS ({_runs('eval_items', 'item_id', 'text', 12)})
        SELECT DISTINCT doc_id, item_id FROM doc JOIN item USING (run)""",
}
