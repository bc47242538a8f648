"""Names of the queries, what runs them, and SQL for those that SQL can express."""

from __future__ import annotations

from docketlake.functions.sqltext import tdoc_sql
from docketlake.operators import orphans, packed
from docketlake.plans import more_sql, queries, queries_sql

QUERIES = {
    **queries.QUERIES,
    "p1_found": orphans.p1_found,
    "p1_monthly": orphans.p1_monthly,
    "p1_cascade": orphans.p1_cascade,
    "p2_found": packed.p2_found,
    "p2_delimiters": packed.p2_delimiters,
}

_ORPHANS = f"""
refs AS (
  SELECT DISTINCT 'relationships' AS src_table, rel_id AS record_id, {tdoc_sql("to_tdoc")} AS k, seen_at AS at_time FROM relationships
  UNION ALL
  SELECT DISTINCT 'agenda', row_id, {tdoc_sql("tdoc")}, received_at FROM agenda
),
targets AS (
  SELECT 'relationships' AS src_table, {tdoc_sql("tdoc")} AS k, received_at AS b, deleted_at AS e FROM agenda
  UNION ALL
  SELECT 'agenda', {tdoc_sql("tdoc")}, listed_at, removed_at FROM manifest
),
orphans AS (
  SELECT r.src_table, record_id, any_value(at_time) AS at_time,
    CASE WHEN count(t.k) = 0 THEN 'missing' WHEN bool_or(b <= at_time) THEN 'deleted' ELSE 'later' END AS reason
  FROM refs r LEFT JOIN targets t ON r.src_table = t.src_table AND r.k = t.k
  WHERE r.k IS NOT NULL GROUP BY r.src_table, record_id
  HAVING NOT coalesce(bool_or(b <= at_time AND (e IS NULL OR at_time < e)), false)
)"""

_CASCADE = f"""{_ORPHANS},
links AS (SELECT DISTINCT rel_id, {tdoc_sql("from_tdoc")} AS child, {tdoc_sql("to_tdoc")} AS parent, seen_at FROM relationships),
seeds AS (
  SELECT l.child AS node FROM links l JOIN orphans o ON o.src_table = 'relationships' AND o.record_id = l.rel_id
  UNION SELECT {tdoc_sql("tdoc")} FROM agenda a JOIN orphans o ON o.src_table = 'agenda' AND o.record_id = a.row_id
),
-- a document is reached at many depths, of which the least counts
walks(node, depth) AS (
  SELECT node, 0 FROM seeds WHERE node IS NOT NULL
  UNION SELECT l.child, w.depth + 1 FROM walks w JOIN links l ON l.parent = w.node WHERE l.child IS NOT NULL AND l.child <> l.parent AND w.depth < 60
),
nodes AS (SELECT node, min(depth) AS depth FROM walks GROUP BY node),
cascade AS (
  SELECT src_table, record_id, at_time, 'direct' AS kind, 0 AS depth, reason FROM orphans
  UNION ALL
  SELECT 'relationships', rel_id, seen_at, 'inherited', n.depth + 1, NULL FROM links l JOIN nodes n ON l.parent = n.node
  WHERE NOT EXISTS (SELECT 1 FROM orphans o WHERE o.src_table = 'relationships' AND o.record_id = l.rel_id)
)"""

SQL = {
    **queries_sql.SQL,
    **more_sql.SQL,
    "p1_found": f"WITH {_ORPHANS} SELECT src_table, record_id, reason FROM orphans",
    "p1_cascade": f"WITH RECURSIVE {_CASCADE} SELECT src_table, record_id, kind, CAST(depth AS INT) AS depth, reason FROM cascade",
    "p1_monthly": f"""WITH RECURSIVE {_CASCADE}
SELECT src_table, strftime(at_time, '%Y-%m') AS month, kind, reason, count(*) AS orphans FROM cascade GROUP BY ALL""",
}
