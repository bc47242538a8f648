"""SQL for the queries over the test tables."""

from __future__ import annotations

from docketlake.operators import scope
from docketlake.plans.queries import COMPANY_QUERY, ID_QUERY, QUERY

_N = r"[A-Za-z][0-9][-–]?[0-9]{7}"
_SPACE = r"[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(x: str) -> str:
    c = f"upper(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"
    return f"CASE WHEN length({c}) >= 9 THEN {c}[1:2] || '-' || {c}[3:] ELSE replace(upper(trim({x})), '–', '-') END"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def _hash(x: str) -> str:
    return f"sha256(trim(regexp_replace({_fold(x)}, '{_SPACE}', ' ', 'g')))"


_ROLES = r"""list_filter([CASE WHEN contains(lower(concat_ws(' ', title, comments)), 'baseline') THEN 'baseline' END,
  CASE WHEN regexp_matches(coalesce(status, ''), '(?i)\bapproved\b') THEN 'approved' END], lambda x: x IS NOT NULL)"""
_PRIO = r"""CASE WHEN regexp_matches(lower(metadata_source), '/tdocsbyagenda\.html?$') THEN 0
  WHEN contains(lower(metadata_source), '/report/') AND NOT contains(lower(metadata_source), '/_older/') THEN 1
  WHEN contains(regexp_extract(lower(metadata_source), '([^/]*)$', 1), 'index') THEN 2 WHEN contains(lower(metadata_source), '/_older/') THEN 4 ELSE 3 END"""
_A = f"""
a AS (
  SELECT DISTINCT row_id, {_norm("tdoc")} AS tdoc, title, source AS source_company, status, agenda_item AS agenda, comments, discussion, metadata_source, metadata_locator, {_ROLES} AS role_hints
  FROM agenda
),
first_rows AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY tdoc ORDER BY {_PRIO}, metadata_source, row_id) = 1)"""
_E = rf"""
said AS (SELECT tdoc AS own, metadata_source AS source, metadata_locator AS locator, trim(concat_ws(' ', coalesce(comments, ''), coalesce(discussion, ''), coalesce(status, ''))) AS s FROM a WHERE tdoc IS NOT NULL),
bad AS (SELECT DISTINCT tdoc FROM a WHERE regexp_matches(coalesce(comments, '') || ' ' || coalesce(discussion, ''), '(?i)\b(?:incorrect|wrong)\b.{{0,80}}\b(?:merge|assignment|agenda)')),
found AS (
  SELECT own AS x, unnest(regexp_extract_all(regexp_extract(s, '(?i)\bmerged?\s+into\s+(.*?)(?:Not\s+Handled|$)', 1), '(?i)\b({_N})\b', 1)) AS y, 'merged_into' AS type, false AS back, source, locator FROM said
  UNION ALL SELECT own, unnest(regexp_extract_all(s, '(?i)\brevision\s+of\s+({_N})', 1)), 'revision_of', false, source, locator FROM said
  UNION ALL SELECT own, unnest(regexp_extract_all(s, '(?i)\brevised.{{0,40}}\bto\s+({_N})', 1)), 'revision_of', true, source, locator FROM said
  UNION ALL SELECT own, unnest(regexp_extract_all(regexp_extract(s, '(?i)\bbaseline\b.*?\bincl\.?\s+(.*?)(?:\brevised\b|$)', 1), '(?i)\b({_N})\b', 1)), 'input_to', true, source, locator FROM said
),
ends AS (SELECT CASE WHEN back THEN {_norm("y")} ELSE x END AS src, CASE WHEN back THEN x ELSE {_norm("y")} END AS dst, type, source, locator FROM found),
e AS (SELECT *, CASE WHEN type IN ('merged_into', 'input_to') AND src IN (SELECT tdoc FROM bad) THEN 'invalidated' ELSE 'candidate' END AS classification FROM ends WHERE src <> dst)"""
_R = f"r AS (SELECT DISTINCT rel_id, {_norm('from_tdoc')} AS src, {_norm('to_tdoc')} AS dst, relation_type AS type, classification, source, locator FROM relationships)"
_HAY = _fold("concat_ws(' ', " + ", ".join(f"coalesce({f}, '')" for f in scope.FIELDS) + ")")
_KINDS = {
    "key_issues": r"\bki\s*#?\s*([0-9]+(?:\.[0-9]+)*)\b",
    "solution_variants": r"\b(?:solution\s+variant|sv)\s*#?\s*([0-9]+(?:\.[0-9]+)*)\b",
}


def _score(q: scope.Query) -> str:
    fails, points = [], [f"{4 * len(q.companies) + 5 * sum(1 for v in q.required.values() if v)}"]
    for kind, wanted in q.required.items():
        if wanted:
            fails.append(f"NOT list_has_any(regexp_extract_all({_HAY}, '{_KINDS[kind]}', 1), {wanted})")
    if q.topic_terms:
        fails.append("NOT (" + " OR ".join(f"contains({_HAY}, '{t}')" for t in q.topic_terms) + ")")
        points += [f"CASE WHEN contains({_HAY}, '{t}') THEN 2 ELSE 0 END" for t in q.topic_terms]
    for c in q.companies:
        fails.append("NOT (" + " OR ".join(f"contains({_HAY}, '{v.casefold()}')" for v in (c, *q.aliases.get(c, ()))) + ")")
    return f"CASE WHEN {' OR '.join(fails)} THEN -1 ELSE {' + '.join(points)} END"


_SCOPE = f"""
hits AS (SELECT tdoc FROM first_rows WHERE {_score(QUERY)} > 0),
touched AS (SELECT src, dst FROM e WHERE classification = 'candidate' AND (src IN (SELECT tdoc FROM hits) OR dst IN (SELECT tdoc FROM hits))),
related AS (SELECT tdoc FROM hits UNION SELECT src FROM touched UNION SELECT dst FROM touched),
tasks AS (
  SELECT r.tdoc, CAST(CASE WHEN list_has_any(f.role_hints, ['approved', 'baseline']) THEN 0 WHEN h.tdoc IS NOT NULL THEN 1 WHEN f.tdoc IS NOT NULL THEN 2 ELSE 3 END AS BIGINT) AS priority
  FROM related r LEFT JOIN first_rows f USING (tdoc) LEFT JOIN hits h ON h.tdoc = r.tdoc
)"""
_BASE = f"{_A}, {_E}, {_SCOPE}"
_ATT = "att AS (SELECT *, event_type = 'error' AS failure, CASE WHEN event_type = 'view' THEN 'private_mirror' ELSE 'public' END AS kind FROM events)"

SQL = {
    "agenda_records": f"WITH {_A} SELECT tdoc, row_id, title, metadata_source, array_to_string(role_hints, ',') AS role_hints FROM first_rows",
    "agenda_edges": f"WITH {_A}, {_E} SELECT src, dst, type, any_value(classification) AS classification, source, locator FROM e GROUP BY src, dst, type, source, locator",
    "invalidated_edges": f"WITH {_A}, {_E} SELECT DISTINCT src, dst, type FROM e WHERE classification = 'invalidated'",
    "paragraph_hash": f"SELECT DISTINCT para_id, {_hash('text')} AS digest FROM document_index",
    "evidence_duplicates": f"""WITH x AS (SELECT DISTINCT evidence_id, tdoc, source, inner_file, ordinal, coalesce(nullif(paragraph_hash, ''), {_hash("coalesce(text, '')")}) AS paragraph_hash,
  concat_ws(':', tdoc, inner_file, locator) AS k FROM evidence),
w AS (SELECT *, first_value(k) OVER o AS f, row_number() OVER o AS n FROM x
  WINDOW o AS (PARTITION BY paragraph_hash ORDER BY tdoc NULLS FIRST, source NULLS FIRST, inner_file NULLS FIRST, ordinal NULLS FIRST, evidence_id, k))
SELECT evidence_id, paragraph_hash, CASE WHEN n > 1 THEN f END AS duplicate_of FROM w""",
    "document_lines": rf"""WITH x AS (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM x)
SELECT doc_id, pos, {_hash("line")} AS digest FROM y WHERE {_hash("line")} <> sha256('')""",
    "section_carry": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(0, len(p))) AS pos, unnest(p) AS line FROM l),
h AS (SELECT doc_id, pos, last_value(CASE WHEN length(line) < 160 AND regexp_matches(line, '^[0-9]+(?:\.[0-9]+)*[\s\x0b\x{a0}\x{3000}]+[^\s\x{a0}\x{3000}]') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS carried_section FROM x)
SELECT doc_id, carried_section, count(*) AS lines FROM h GROUP BY ALL""",
    "match_score": f"WITH {_A} SELECT row_id, CAST({_score(ID_QUERY)} AS BIGINT) AS score FROM a",
    "company_scope": f"WITH {_A} SELECT row_id FROM a WHERE {_score(COMPANY_QUERY)} > 0",
    "seed_scope": f"WITH {_A} SELECT row_id, tdoc FROM a WHERE tdoc IN ('S2-2300017', 'S2-2605845')",
    "scoped_records": f"""WITH {_BASE} SELECT r.tdoc, CASE WHEN h.tdoc IS NOT NULL THEN 'direct_query' ELSE 'explicit_relationship' END AS scope_basis, f.tdoc IS NULL AS metadata_missing
FROM related r LEFT JOIN hits h USING (tdoc) LEFT JOIN first_rows f ON f.tdoc = r.tdoc""",
    "task_priority": f"WITH {_BASE} SELECT tdoc, priority FROM tasks",
    "core_stage": f"WITH {_BASE} SELECT tdoc, priority FROM tasks WHERE priority = (SELECT min(priority) FROM tasks WHERE priority <= 1)",
    "task_batches": f"WITH {_BASE} SELECT tdoc, priority, (row_number() OVER (ORDER BY priority, tdoc) - 1) // 8 AS batch_no FROM tasks",
    "task_sources": f"""WITH {_BASE}, m AS (SELECT tdoc, min(source) AS source FROM manifest WHERE tdoc IS NOT NULL AND source IS NOT NULL GROUP BY tdoc)
SELECT t.tdoc, coalesce(m.source, 'meeting/Docs/' || t.tdoc || '.zip') AS source FROM tasks t LEFT JOIN m USING (tdoc)""",
    "distributions": f"""WITH {_A}, v AS (SELECT unnest(['agenda', 'company', 'status']) AS dimension, unnest([agenda, source_company, status]) AS x FROM a)
SELECT dimension, coalesce(nullif(trim(x), ''), '(blank)') AS value, count(*) AS n FROM v GROUP BY ALL""",
    "closure_depth": f"""WITH RECURSIVE {_A}, {_R}, files AS (SELECT DISTINCT tdoc FROM manifest),
u AS (SELECT DISTINCT src, dst FROM r WHERE classification = 'candidate' AND src <> dst AND dst IN (SELECT tdoc FROM files)),
walk(tdoc, depth) AS (SELECT tdoc, 0 FROM first_rows WHERE list_contains(role_hints, 'baseline') UNION SELECT u.dst, depth + 1 FROM walk JOIN u ON u.src = walk.tdoc WHERE depth < 40)
SELECT tdoc, CAST(min(depth) AS BIGINT) AS depth FROM walk WHERE tdoc IS NOT NULL GROUP BY tdoc""",
    "unique_relationships": f"WITH {_R} SELECT DISTINCT src, dst, type, source, locator FROM r",
    "circuit_breaker": f"WITH {_ATT} SELECT event_id, coalesce(bool_or(failure) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS circuit_open FROM att",
    "router_counters": f"""WITH {_ATT} SELECT user_id, count(*) FILTER (kind = 'public') AS public_attempts, count(*) FILTER (kind = 'public' AND NOT failure) AS public_hits,
count(*) FILTER (kind = 'private_mirror') AS mirror_attempts, count(*) FILTER (kind = 'private_mirror' AND NOT failure) AS mirror_hits,
count(*) FILTER (event_type = 'signup') AS stale_hits, bool_or(failure) AS circuit_opened FROM att GROUP BY user_id""",
    "adaptive_window": f"""WITH RECURSIVE {_ATT}, o AS (SELECT user_id, failure, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM att),
f(user_id, n, w, run) AS (SELECT DISTINCT user_id, 0::BIGINT, 4, 0 FROM o
  UNION ALL SELECT o.user_id, o.n, CASE WHEN failure THEN greatest(1, w // 2) WHEN run + 1 >= 8 AND w < 4 THEN w + 1 ELSE w END,
    CASE WHEN failure OR run + 1 >= 8 AND w < 4 THEN 0 ELSE least(run + 1, 7) END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT f.user_id, CAST(arg_max(w, n) AS BIGINT) AS final_window, max(n) AS attempts, any_value(p) AS pressure_events
FROM f JOIN (SELECT user_id, count(*) FILTER (failure) AS p FROM att GROUP BY user_id) USING (user_id) GROUP BY f.user_id""",
    "cache_decisions": """SELECT DISTINCT entry_id, CASE WHEN cache_state = 'hit' AND sha256 IS NOT NULL THEN 'not_modified' WHEN state <> 'fetch_error' THEN 'downloaded'
WHEN sha256 IS NOT NULL THEN 'stale' ELSE 'failed' END AS decision FROM manifest""",
    "resume_anti": """SELECT DISTINCT tdoc FROM manifest WHERE tdoc IS NOT NULL
AND tdoc NOT IN (SELECT tdoc FROM manifest WHERE state IN ('processed', 'cached_processed', 'local_processed') AND tdoc IS NOT NULL)""",
    "run_signatures": """SELECT meeting, sha256('{"meeting":"' || meeting || '","wg":"' || wg || '"}') AS signature FROM meetings""",
    "calendar_order": "SELECT meeting, wg, row_number() OVER (PARTITION BY wg ORDER BY CAST(meeting_no AS INT), coalesce(suffix, ''), start_date) AS order_no FROM meetings",
    "month_match": "SELECT wg || '/' || strftime(start_date, '%Y-%m') AS hint_id, count(*) AS meetings, count(*) FILTER (meeting_kind = 'subgroup') AS subgroup_meetings FROM meetings GROUP BY ALL",
    "meeting_ties": r"""WITH d AS (SELECT wg, 'TSG_' || replace(meeting, '#', '_') AS name FROM meetings), h AS (SELECT meeting AS hint_id, wg, meeting_no, lower(suffix) AS suffix FROM meetings),
m AS (SELECT hint_id, 5 + CASE WHEN suffix <> '' THEN 3 ELSE 0 END AS score FROM h JOIN d USING (wg)
  WHERE regexp_matches(name, '(^|[^0-9])' || meeting_no || '([^0-9]|$)') AND list_has_all(string_split_regex(lower(name), '[^a-z0-9]+'), list_filter(string_split_regex(coalesce(suffix, ''), '[^a-z0-9]+'), lambda x: x <> '')))
SELECT hint_id, max(score)::BIGINT AS best_score, count(*) AS tied FROM m GROUP BY hint_id""",
    "meeting_descriptors": """SELECT meeting, regexp_extract(meeting, '^([A-Z]+[0-9])', 1) AS wg, regexp_extract(meeting, '^([A-Z]+)', 1) AS tsg, meeting_no AS number, lower(suffix) AS suffix,
year(start_date) AS year, month(start_date) AS month, wg AS code FROM meetings""",
    "source_parts": """SELECT DISTINCT source, 'public' AS kind, sha256('https://docs.example.org/ftp/' || source) AS cache_key, '/ftp/' || source AS path,
regexp_extract(source, '([A-Z][0-9]-[0-9]{7})', 1) AS tdoc, replace(source, '/', '_') AS name, 3::BIGINT AS priority, false AS metadata, 'ftp/' || source || ',' || source AS mirror_paths FROM manifest""",
    "source_candidates": """WITH m AS (SELECT DISTINCT 'https://docs.example.org/ftp/' || source AS source, source AS rel, fallback_reason IS NOT NULL AS down FROM manifest)
SELECT source, down, 0::BIGINT AS rank, source AS effective, 'public' AS kind FROM m
UNION ALL SELECT source, down, 1, 'https://mirror.invalid/m/ftp/' || rel, 'private_mirror' FROM m WHERE down
UNION ALL SELECT source, down, 2, 'https://mirror.invalid/m/' || rel, 'private_mirror' FROM m WHERE down""",
    "page_links": """WITH m AS (SELECT DISTINCT source[1:8] AS grp, source FROM manifest WHERE source IS NOT NULL)
SELECT 'https://docs.example.org/ftp/' || grp || '/index.htm' AS url, row_number() OVER (PARTITION BY grp ORDER BY source) - 1 AS n, 'https://docs.example.org/ftp/' || grp || '/' || source AS link FROM m""",
    "run_coverage": """WITH m AS (SELECT DISTINCT * FROM manifest), c AS (SELECT source_kind, count(*) AS documents, count(*) FILTER (state IN ('processed', 'cached_processed', 'local_processed')) AS processed,
  count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'fetch_error') AS failed, CAST(coalesce(sum(body_bytes), 0) AS BIGINT) AS total_body_bytes, CAST(coalesce(sum(retry_count), 0) AS BIGINT) AS retry_count,
  count(*) FILTER (cache_state IN ('hit', 'parsed_hit')) AS cache_hits, count(*) FILTER (cache_state = 'parsed_hit') AS parsed_cache_hits, count(*) FILTER (fallback_reason IS NOT NULL) AS source_fallbacks FROM m GROUP BY source_kind)
SELECT *, cache_hits * 1000 // documents AS cache_hit_permille, CASE WHEN missing + failed > 0 THEN 'partial' ELSE 'no_known_gaps' END AS completeness,
concat_ws(' ', CASE WHEN missing > 0 THEN missing || ' documents have no file.' END, CASE WHEN failed > 0 THEN failed || ' documents could not be fetched.' END,
  CASE WHEN source_fallbacks > 0 THEN source_fallbacks || ' documents came from another source.' END, CASE WHEN documents > processed + missing + failed THEN 'Some documents were listed but not read.' END) AS warnings FROM c""",
    "manifest_order": """SELECT entry_id, row_number() OVER (ORDER BY priority NULLS FIRST, tdoc NULLS FIRST, source NULLS FIRST, entry_id) - 1 AS position
FROM (SELECT DISTINCT entry_id, priority, tdoc, source FROM manifest)""",
    "first_evidence": "SELECT tdoc, strftime(min(matched_at), '%Y-%m-%d %H:%M:%S') AS first_matched_at, count(DISTINCT evidence_id) AS items FROM evidence GROUP BY tdoc",
    "resumed_scope": f"""WITH {_A}, {_E}, {_R}, hits AS (SELECT tdoc FROM first_rows WHERE {_score(QUERY)} > 0),
every AS (SELECT src, dst FROM e WHERE classification = 'candidate' UNION SELECT src, dst FROM r WHERE classification = 'candidate'),
touched AS (SELECT src, dst FROM every WHERE src IN (SELECT tdoc FROM hits) OR dst IN (SELECT tdoc FROM hits))
SELECT tdoc FROM (SELECT tdoc FROM hits UNION SELECT src FROM touched UNION SELECT dst FROM touched) WHERE tdoc IS NOT NULL""",
    "company_mentions": f"""WITH {_A}, s AS (SELECT DISTINCT company_id, {_fold("trim(unnest(list_concat([name], coalesce(aliases, []))))")} AS s FROM companies)
SELECT DISTINCT row_id AS record_id, company_id FROM a JOIN s ON contains({_HAY}, s.s) WHERE s.s <> ''""",
    "excerpts": rf"""WITH p AS (SELECT DISTINCT para_id, text, regexp_extract(text, '(?i)\bTS [0-9.]+[0-9]') AS m FROM document_index),
q AS (SELECT para_id, text, m, strpos(text, m) AS at_pos FROM p WHERE m <> '')
SELECT para_id, trim(regexp_replace(substr(text, greatest(1, at_pos - 40), at_pos + length(m) + 40 - greatest(1, at_pos - 40)), '{_SPACE}', ' ', 'g')) AS excerpt FROM q""",
}
