"""SQL of the queries that SQL can express, by comparing all pairs; for small tables only."""

_PAIRS = r"""w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS w FROM r),
c AS (SELECT id, w, count(*) AS k FROM w GROUP BY 1, 2),
n AS (SELECT id, sum(k) AS n FROM c GROUP BY 1 HAVING sum(k) >= 15),
d AS (SELECT c.id, c.w, c.k, n.n FROM c JOIN n USING (id)),
p AS (SELECT a.id AS id_a, b.id AS id_b, sum(least(a.k, b.k)) AS o, any_value(a.n + b.n) AS s FROM d a JOIN d b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
close AS (SELECT id_a, id_b FROM p WHERE 10 * o >= 7 * (s - o))"""

P2_FOUND = f"""WITH r AS (SELECT DISTINCT id, text AS content FROM stage1), {_PAIRS}, t AS (SELECT DISTINCT id, split FROM stage1)
SELECT id_a, id_b FROM close JOIN t a ON a.id = id_a JOIN t b ON b.id = id_b WHERE (a.split = 'train') <> (b.split = 'train') AND a.split IN ('train', 'val', 'test') AND b.split IN ('train', 'val', 'test')"""

P2_REPORT = f"""WITH f AS ({P2_FOUND}), t AS (SELECT DISTINCT id, split FROM stage1),
e AS (SELECT CASE WHEN a.split = 'train' THEN id_b ELSE id_a END AS id FROM f JOIN t a ON a.id = id_a)
SELECT t.split, lower(trim(coalesce(r.source_name, ''))) AS source_name, count(*) AS n_pairs, count(DISTINCT e.id) AS n_records FROM e JOIN t ON t.id = e.id LEFT JOIN raw_content r ON r.id = e.id GROUP BY 1, 2"""

_BOTH = "r AS (SELECT id, content FROM raw_content UNION ALL SELECT id, content FROM findings)"

P3_FOUND = f"""WITH {_BOTH}, {_PAIRS}, o AS (SELECT id, row_number() OVER (ORDER BY batch_no, collected_at NULLS FIRST, id) AS n FROM findings),
x AS (SELECT id_a AS id, id_b AS other FROM close UNION ALL SELECT id_b, id_a FROM close)
SELECT DISTINCT x.id FROM x JOIN o ON o.id = x.id LEFT JOIN o q ON q.id = x.other WHERE coalesce(q.n, 0) < o.n"""

P5_FOUND = f"WITH {_BOTH}, {_PAIRS} SELECT id_a, id_b FROM close"


def _name(column: str) -> str:
    edge = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    return f"nullif(regexp_replace(regexp_replace(lower(regexp_replace({column}, '{edge}', '', 'g')), '^@', ''), '{edge}', '', 'g'), '')"


P4_FOUND = f"""WITH RECURSIVE ids AS (SELECT DISTINCT id FROM stage1),
k AS (SELECT id, 's:' || s AS k FROM (SELECT id, {_name("source_name")} AS s FROM raw_content) WHERE s IS NOT NULL
  UNION SELECT id, 'a:' || a FROM (SELECT id, {_name("author")} AS a FROM raw_content) WHERE a IS NOT NULL AND a NOT IN (SELECT {_name("handle")} FROM generic_handles)
  UNION SELECT properties['raw_content_id'], 'e:' || source_id FROM edges WHERE properties['raw_content_id'] IS NOT NULL AND source_id IS NOT NULL),
own AS (SELECT k.id, k.k FROM k JOIN ids USING (id)),
l AS (SELECT DISTINCT a.k AS u, b.k AS v FROM own a JOIN own b ON a.id = b.id),
reach AS (SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v)
SELECT own.id, min(substr(reach.v, 3)) AS group_key FROM own JOIN reach ON reach.u = own.k WHERE reach.v LIKE 's:%' GROUP BY own.id"""

ORACLE = {"p2_found": P2_FOUND, "p2_report": P2_REPORT, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND}
