"""DuckDB SQL of the queries that SQL can express on whole tables. The others are tested against brute force."""

from ..functions.urls import GUID_FILLERS, TRACKING_PARAM

_DECODED = "lower(CASE WHEN {0} LIKE '%\\%%' ESCAPE '\\' THEN url_decode(replace({0}, '+', '%2B')) ELSE {0} END)"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"

_SIMILAR = r"""WITH RECURSIVE w AS (SELECT article_id, list_distinct(regexp_extract_all(lower(title || ' ' || summary), '[\p{L}\p{N}]+')) AS ws FROM articles WHERE trim(title) <> '' AND trim(summary) <> ''),
t AS (SELECT article_id, len(ws) AS n, unnest(ws) AS word FROM w), f AS (SELECT word, COUNT(*) AS df FROM t GROUP BY 1),
r AS (SELECT article_id, n, word, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY df, word) AS r FROM t JOIN f USING (word)),
p AS (SELECT * FROM r WHERE r <= n - CEIL(0.7 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.article_id AS a, b.article_id AS b FROM p a JOIN p b ON a.word = b.word AND a.article_id < b.article_id AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9), alike AS (SELECT a, b FROM c JOIN w x ON x.article_id = a JOIN w y ON y.article_id = b WHERE 17 * len(list_intersect(x.ws, y.ws)) >= 7 * (len(x.ws) + len(y.ws)))
"""

ORACLE: dict[str, str] = {
    "p3_found": rf"""
WITH t AS (SELECT article_id, regexp_replace(regexp_replace(lower(canonical_url), '^\s+', ''), '\s*(#.*)?$', '') AS u FROM articles WHERE canonical_url IS NOT NULL),
v AS (SELECT article_id, regexp_replace(regexp_replace(regexp_replace(u, '^http://([^/?]*?):80([/?]|$)', 'http://\1\2'), '^https://([^/?]*?):443([/?]|$)', 'https://\1\2'), '^([a-z][a-z0-9+.-]*:)?//', '') AS u FROM t),
a AS (SELECT article_id, regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^(www|m)\.', '') AS host, regexp_extract(u, '^[^/?]*([^?]*)', 1) AS path,
 array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(regexp_replace(p, '=.*$', ''), '{TRACKING_PARAM}')), lambda p: {_DECODED.format("p")})), '&') AS params FROM v),
b AS (SELECT article_id, host, regexp_replace({_DECODED.format("path")}, '/$', '') AS path, params FROM a),
g AS (SELECT article_id, lower(source_host) AS host, trim(regexp_replace(lower(guid), '^[{{\s]*(urn:uuid:)?[{{\s]*|[}}\s]+$', '', 'g')) AS g FROM articles WHERE guid IS NOT NULL AND source_host IS NOT NULL),
k AS (SELECT article_id, 'u ' || host || path || '?' || params AS key FROM b WHERE host <> '' AND (path <> '' OR params <> '') UNION SELECT article_id, 'g ' || host || ' ' || g FROM g WHERE g <> '' AND g NOT IN ({", ".join(f"'{x}'" for x in GUID_FILLERS)})),
f AS (SELECT article_id, MIN(article_id) OVER (PARTITION BY key) AS first FROM k)
SELECT MIN(first) AS first_article_id, article_id FROM f WHERE first < article_id GROUP BY article_id""",
    "p3_near": r"""
WITH t AS (SELECT article_id, regexp_extract_all(lower(concat_ws(' ', title, summary, content)), '[\p{L}\p{N}]+') AS w FROM articles),
s AS (SELECT article_id, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 15)) AS h FROM t WHERE len(w) > 0),
f AS (SELECT article_id, list_distinct(list_transform(range(1, greatest(len(h) - 3, 1) + 1), lambda i: list_min(h[i:i + 3]))) AS fps FROM s),
x AS (SELECT article_id, len(fps) AS n, unnest(fps) AS fp FROM f)
SELECT MIN(a.article_id) AS first_article_id, b.article_id FROM (SELECT a.article_id, b.article_id AS later, any_value(a.n) AS n, any_value(b.n) AS m, COUNT(*) AS shared FROM x a JOIN x b ON a.fp = b.fp AND a.article_id < b.article_id GROUP BY 1, 2) a
JOIN f b ON b.article_id = later WHERE shared >= greatest(n, m) * 0.8 - 1e-9 GROUP BY b.article_id""",
    "p4_found": f"{_SIMILAR}SELECT a AS article_id_a, b AS article_id_b FROM alike",
    "p4_groups": f"""{_SIMILAR}, class AS (SELECT article_id, MIN(article_id) OVER (PARTITION BY list_sort(ws)) AS class_id FROM w),
e AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike), reach AS (SELECT a AS start, a AS v FROM e UNION SELECT r.start, e.b FROM reach r JOIN e ON e.a = r.v),
g AS (SELECT start, MIN(v) AS group_id FROM reach GROUP BY 1), n AS (SELECT a, COUNT(*) AS n_links FROM e GROUP BY 1)
SELECT group_id, class_id, article_id, n_links FROM g JOIN class ON class.article_id = start JOIN n ON n.a = start""",
    "p5_found": """
WITH RECURSIVE l AS (SELECT DISTINCT left_cluster_id AS a, right_cluster_id AS b FROM cross_category_cluster_adjudications WHERE decision = 'same_story' AND left_cluster_id <> right_cluster_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT a AS start, a AS v FROM e UNION SELECT r.start, e.b FROM reach r JOIN e ON e.a = r.v)
SELECT MIN(v) AS group_id, start AS cluster_id FROM reach GROUP BY start""",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dj AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS j FROM d), ij AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM i),
dg AS (SELECT doc_id, array_to_string(w[j:j + 11], ' ') AS g FROM dj), ig AS (SELECT item_id, array_to_string(w[j:j + 11], ' ') AS g FROM ij)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
