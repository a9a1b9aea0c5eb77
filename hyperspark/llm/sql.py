"""SQL for those pN_ queries that an independent engine can express."""

_PAIRS = """WITH i AS (SELECT DISTINCT sample_id, item FROM (SELECT sample_id, trim(regexp_replace(lower(x), '[\\s _-]+', ' ', 'g')) AS item FROM
 (SELECT sample_id, unnest(list_concat(coalesce(concepts, []::VARCHAR[]), coalesce(keywords, []::VARCHAR[]))) AS x FROM samples WHERE sample_id IS NOT NULL)) WHERE item <> ''),
n AS (SELECT item, count(*) AS n FROM i GROUP BY item), t AS (SELECT count(DISTINCT sample_id) AS total FROM i),
p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM i a JOIN i b ON a.sample_id = b.sample_id AND a.item < b.item GROUP BY a.item, b.item),
r AS (SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, total FROM p JOIN n x ON x.item = item_a JOIN n y ON y.item = item_b, t)"""

SQL = {
    "p4_found": _PAIRS + " SELECT item_a, item_b FROM r WHERE n_ab >= 6 AND n_ab * total >= 30 * n_a * n_b",
    "p4_pairs": _PAIRS + " SELECT item_a, item_b, n_ab, n_a, n_b, total AS n_baskets, round(n_a::DOUBLE * n_b / total, 6) AS expected, round(n_ab / (n_a::DOUBLE * n_b / total), 6) AS lift FROM r",
}
