"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from docketlake.functions.charforms import form_map, skeleton_map
from docketlake.functions.sqltext import mapped_sql, tdoc_sql
from docketlake.llm import components, confusables, mojibake, names, neardup, packing, spans, tokens

QUERIES = {
    "p3_found": spans.p3_found,
    "p4_found": names.p4_found,
    "p5_found": components.p5_found,
    "p6_found": confusables.p6_found,
    "p6_forms": confusables.p6_forms,
    "p6_classes": confusables.p6_classes,
    "p7_found": neardup.p7_found,
    "p8_ids": tokens.p8_ids,
    "p9_pack": packing.p9_pack,
    "p9_audit": packing.p9_audit,
    "p10_found": mojibake.p10_found,
    "p10_restored": mojibake.p10_restored,
}


def look_sql(col: str) -> str:
    """Texts are equal here exactly if their consistent forms are."""
    return f"trim(nfc_normalize({mapped_sql(f'nfc_normalize({mapped_sql(col, form_map())})', skeleton_map())}))"


_LOOKS = f"""
looks AS (
  SELECT DISTINCT 'agenda' AS src_table, row_id AS id, tdoc AS stored, {look_sql("tdoc")} AS form FROM agenda WHERE tdoc IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'evidence', evidence_id, text, {look_sql("text")} FROM evidence WHERE text IS NOT NULL
)"""

_WORDS = f"""
texts AS (
  SELECT DISTINCT 'agenda' AS src_table, row_id AS id, title AS stored FROM agenda
  UNION ALL
  SELECT DISTINCT 'evidence', evidence_id, text FROM evidence
),
sets AS (
  SELECT src_table, id, list_distinct(regexp_extract_all(lower({look_sql("stored")}), '[\\p{{L}}\\p{{N}}]+')) AS words FROM texts WHERE stored IS NOT NULL
)"""

SQL = {
    "p3_found": """
WITH r AS (SELECT DISTINCT evidence_id, text FROM evidence WHERE length(text) >= 120),
w AS (SELECT evidence_id, pos, substr(text, pos, 120) AS span FROM (SELECT evidence_id, text, unnest(range(1, length(text) - 118)) AS pos FROM r)),
s AS (SELECT span FROM w GROUP BY span HAVING min(evidence_id) < max(evidence_id)),
h AS (SELECT evidence_id, pos FROM w JOIN s USING (span)),
g AS (SELECT evidence_id, least(coalesce(lead(pos) OVER (PARTITION BY evidence_id ORDER BY pos) - pos, 120), 120) AS n FROM h)
SELECT evidence_id, CAST(sum(n) AS INT) AS shared_chars FROM g GROUP BY evidence_id""",
    "p5_found": f"""
WITH RECURSIVE e AS (
  SELECT {tdoc_sql("from_tdoc")} AS a, {tdoc_sql("to_tdoc")} AS b FROM relationships
  WHERE classification = 'candidate' AND relation_type IN ('revision_of', 'merged_into', 'approved_version_of')
),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a)
SELECT a AS tdoc, min(b) AS group_id FROM reach GROUP BY a""",
    "p6_found": f"""
WITH {_LOOKS}
SELECT a.src_table, a.id AS id_a, b.id AS id_b FROM looks a JOIN looks b ON a.src_table = b.src_table AND a.form = b.form AND a.id < b.id AND a.stored <> b.stored""",
    "p6_classes": f"""
WITH {_LOOKS}
SELECT src_table, id AS record_id, min(id) OVER w AS class_id, (SELECT count(DISTINCT stored) FROM looks b WHERE b.src_table = looks.src_table AND b.form = looks.form) AS spellings
FROM looks WINDOW w AS (PARTITION BY src_table, form)""",
    "p9_audit": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS split_without_need, CAST(0 AS BIGINT) AS overfull, true AS tight FROM documents HAVING count(*) > 0",
    "p7_found": f"""
WITH {_WORDS}
SELECT a.src_table, a.id AS id_a, b.id AS id_b FROM sets a JOIN sets b ON a.src_table = b.src_table AND a.id < b.id
WHERE len(a.words) > 0 AND 10 * least(len(a.words), len(b.words)) >= 7 * greatest(len(a.words), len(b.words))
  AND 17 * len(list_intersect(a.words, b.words)) >= 7 * (len(a.words) + len(b.words))""",
}
