"""More SQL for the queries over the test tables: identifiers, headers, addresses, meetings, and files that are read back."""

from __future__ import annotations

from docketlake.functions import ids, text
from docketlake.operators.passages import KEY_SECTIONS
from docketlake.plans.queries import QUERY
from docketlake.plans.queries_sql import _SPACE, _fold, _hash, _norm

_NUMBER = r"[A-Z]\p{Nd}[-–]?\p{Nd}{7}"
_TDOC = rf"(?i)\b({_NUMBER})\b"
_ALONE = rf"(?i)(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}_\x{{200c}}\x{{200d}}])({_NUMBER})(?:$|[^\p{{L}}\p{{M}}\p{{Nd}}_\x{{200c}}\x{{200d}}])"


def _re(pattern: str) -> str:
    """A pattern of functions.ids for the other engine, whose classes are ASCII only."""
    return "(?i)" + pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\x0b\x{85}\p{Z}]")


def _once(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def _listed(column: str) -> str:
    t = f"coalesce({column}, '')"
    tdocs = f"list_transform(regexp_extract_all({t}, '{_TDOC}', 1), lambda z: {_norm('z')})"
    every = [tdocs, *(f"regexp_extract_all({t}, '{_re(p)}', 1)" for p in (ids.KEY_ISSUE, ids.SOLUTION_VARIANT, ids.SOLUTION))]
    names = ("tdocs", "key_issues", "solution_variants", "solutions")
    return ", ".join(f"{_once(e)} AS {n}" for e, n in zip(every, names, strict=True))


_WORDS = r"[a-z0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]+"
_BASE = f"list_filter(regexp_extract_all({_fold('title')}, '{_WORDS}'), lambda w: length(w) > 1 OR regexp_matches(w, '^[0-9]$'))"
_MORE = " || ".join(f"CASE WHEN list_contains(b, '{k}') THEN {[w for v in vs for w in v.split()]} ELSE [] END" for k, vs in text.TOPIC_ALIASES.items())
_STATES = " OR ".join(f"regexp_matches(coalesce(text, ''), '{_re(p)}')" for _, p in ids.BODY_RELATIONS)
_RELEVANT = " OR ".join(
    [_STATES, *(f"contains({_fold('coalesce(text, chr(32))')}, '{t}')" for t in QUERY.topic_terms), *(f"contains({_fold('coalesce(section, chr(32))')}, '{w}')" for w in KEY_SECTIONS)]
)
_BODY = " UNION ALL ".join(
    f"SELECT {_norm('from_tdoc')} AS src, unnest(regexp_extract_all(excerpt, '{_re(p)}', 1)) AS hit, '{kind}' AS type, source, locator FROM r" for kind, p in ids.BODY_RELATIONS
)
_VERSIONS = """
p AS (SELECT DISTINCT tdoc, inner_file, ordinal, locator, paragraph_hash FROM document_index WHERE coalesce(change_state, '') <> 'deleted' AND tdoc IS NOT NULL),
v AS (SELECT tdoc, list(coalesce(paragraph_hash, '') ORDER BY inner_file NULLS FIRST, ordinal NULLS FIRST, locator NULLS FIRST) AS h, count(*) AS n, min(paragraph_hash) AS lo, max(paragraph_hash) AS hi FROM p GROUP BY tdoc)"""


def _priority(path: str) -> str:
    p = f"replace({_fold(path)}, chr(92), '/')"
    return rf"""CASE WHEN regexp_matches({p}, '/tdocsbyagenda\.html?$') THEN 0 WHEN contains({p}, '/report/') AND NOT contains({p}, '/_older/') THEN 1
  WHEN contains(regexp_extract({p}, '([^/]*)$', 1), 'index') THEN 2 WHEN contains({p}, '/_older/') THEN 4 ELSE 3 END"""


_LIKELY = f"regexp_matches(lower(path), '\\.({'|'.join(text.METADATA_SUFFIXES)})$') AND (" + " OR ".join(f"contains(lower(path), '{w}')" for w in text.METADATA_WORDS) + ")"
_HEADER_ROWS = ", ".join(f"('{k}', ' {v[:2].upper()}-{v[2:]} .:')" for k, vs in text.HEADERS.items() for v in vs)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


_CELLS = """
cells AS (
  SELECT row_id // 500 AS f, row_number() OVER (PARTITION BY row_id // 500 ORDER BY row_id) AS k, count(*) OVER (PARTITION BY row_id // 500) AS n, a, b, c
  FROM (SELECT DISTINCT row_id, coalesce(tdoc, '') AS a, coalesce(title, '') AS b, coalesce(comments, '') AS c FROM agenda)
)"""


def _read(kind: str, suffix: str, items: str, path: str = "'file' || f || '.{s}'", inner: str = "'file' || f || '.{s}'", more: str = "") -> str:
    """items: (f, part, place, kind, locator, text, change_state) of all rows, blank ones left out."""
    return f"""WITH {_CELLS}, items AS ({items}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY part, place) AS ordinal FROM items WHERE text <> '' AND NOT blank)
SELECT {path.format(s=suffix)} AS path, {inner.format(s=suffix)} AS inner_file, 'parsed' AS state, kind, ordinal, locator, text, change_state FROM numbered{more}"""


_JOINED = f"{_strip('a')} || ' | ' || {_strip('b')} || ' | ' || {_strip('c')}"
_NONE = f"{_strip('a')} = '' AND {_strip('b')} = '' AND {_strip('c')} = ''"
_CSV_ITEMS = f"SELECT f, 1 AS part, k AS place, 'csv-row' AS kind, 'row:' || k AS locator, {_JOINED} AS text, 'current' AS change_state, {_NONE} AS blank FROM cells"
_HTML_ITEMS = f"""SELECT f, 1 AS part, k AS place, 'html-row' AS kind, 'row:' || row_number() OVER (PARTITION BY f, none ORDER BY k) AS locator, text, 'current' AS change_state, none AS blank
FROM (SELECT *, {_squeeze('a')} || ' | ' || {_squeeze('b')} || ' | ' || {_squeeze('c')} AS text, {_NONE} AS none FROM cells)"""
_XLSX_ITEMS = f"""SELECT f, 1 AS part, k AS place, 'sheet-row' AS kind, 'sheet:1/row:' || k AS locator,
CASE WHEN c <> '' THEN {_JOINED} WHEN b <> '' THEN {_strip('a')} || ' | ' || {_strip('b')} ELSE {_strip('a')} END AS text, 'current' AS change_state, {_NONE} AS blank FROM cells"""
_PPTX_ITEMS = f"SELECT f, 1 AS part, k AS place, 'slide' AS kind, 'slide:' || k AS locator, {_squeeze("a || ' ' || b || ' ' || c")} AS text, 'current' AS change_state, false AS blank FROM cells"
_TXT_ITEMS = "SELECT f, 1 AS part, 1 AS place, 'text' AS kind, 'text:1' AS locator, string_agg(a || ' | ' || b || ' | ' || c, chr(10) ORDER BY k) AS text, 'current' AS change_state, false AS blank FROM cells GROUP BY f"
_DOCX_ITEMS = " UNION ALL ".join(
    [
        f"SELECT f, 1 AS part, 10 * k AS place, 'table-row' AS kind, 'table-row:' || k AS locator, {_squeeze('a')} || ' | ' || {_squeeze('b')} || ' | ' || {_squeeze('c')} AS text, 'current' AS change_state, {_NONE} AS blank FROM cells",
        f"SELECT f, 2, 10 * (2 * k - 1), 'paragraph', 'paragraph:' || (2 * k - 1), {_squeeze('a')}, 'current', false FROM cells",
        f"SELECT f, 2, 10 * (2 * k), 'paragraph', 'paragraph:' || (2 * k), {_squeeze('b')}, 'inserted', false FROM cells",
        f"SELECT f, 2, 10 * (2 * k) + 1, 'paragraph', 'paragraph:' || (2 * k) || '/deleted', {_squeeze('c')}, 'deleted', false FROM cells",
        *(f"SELECT f, 3, 3 * k + {j}, 'paragraph', 'paragraph:' || (2 * n + 3 * (k - 1) + {j}), {_squeeze(x)}, 'current', false FROM cells" for j, x in enumerate("abc", 1)),
    ]
)

SQL = {
    "header_fill": f"""SELECT DISTINCT {_norm(f"regexp_extract(trim(tdoc), '{_ALONE}', 1)")} AS tdoc, trim(coalesce(title, '')) AS title, trim(coalesce(source, '')) AS source_company,
trim(coalesce(status, '')) AS status, trim(coalesce(agenda_item, '')) AS agenda, metadata_source, row_id + 10 AS ordinal FROM agenda WHERE regexp_matches(trim(tdoc), '{_ALONE}')""",
    "identifiers_extract": f"""WITH p AS (SELECT DISTINCT para_id, text FROM document_index), i AS (SELECT para_id, {_listed("text")} FROM p)
SELECT para_id, array_to_string(tdocs, ',') AS tdocs, array_to_string(key_issues, ',') AS key_issues, array_to_string(solution_variants, ',') AS solution_variants, array_to_string(solutions, ',') AS solutions FROM i""",
    "stale_identifiers": f"""WITH p AS (SELECT DISTINCT para_id, text, identifiers, paragraph_hash FROM document_index), i AS (SELECT para_id, text, paragraph_hash, identifiers, {_listed("text")} FROM p),
s AS (SELECT para_id, (identifiers IS DISTINCT FROM struct_pack(tdocs := tdocs, key_issues := key_issues, solution_variants := solution_variants, solutions := solutions)) AS stale_identifiers,
  paragraph_hash IS DISTINCT FROM {_hash("text")} AS stale_hash FROM i)
SELECT para_id, stale_identifiers, stale_hash FROM s WHERE stale_identifiers OR stale_hash""",
    "query_terms": f"""WITH a AS (SELECT DISTINCT row_id, title FROM agenda), w AS (SELECT row_id, {_BASE} AS b FROM a), m AS (SELECT row_id, b || {_MORE} AS t FROM w)
SELECT row_id, array_to_string({_once("t")}, ' ') AS terms FROM m""",
    "body_edges": f"""WITH r AS (SELECT DISTINCT rel_id, from_tdoc, excerpt, source, locator FROM relationships), f AS ({_BODY}),
e AS (SELECT src, {_norm("hit")} AS dst, type, source, locator FROM f)
SELECT src, dst, type, source, locator, count(*) AS statements FROM e WHERE src <> dst GROUP BY ALL""",
    "context_window": f"""WITH p AS (SELECT DISTINCT para_id, tdoc, source, inner_file, ordinal, text, section FROM document_index), m AS (SELECT *, ({_RELEVANT}) AS r FROM p),
w AS (SELECT para_id, r OR coalesce(lag(r) OVER o, false) OR coalesce(lead(r) OVER o, false) AS near FROM m WINDOW o AS (PARTITION BY tdoc, source, inner_file ORDER BY ordinal NULLS FIRST, para_id))
SELECT para_id FROM w WHERE near""",
    "paragraph_patch": f"""WITH {_VERSIONS}, r AS (SELECT DISTINCT {_norm("from_tdoc")} AS src, {_norm("to_tdoc")} AS dst, relation_type AS type FROM relationships
  WHERE classification = 'candidate' AND relation_type IN ('revision_of', 'input_to', 'merged_into'))
SELECT src, dst, type, a.n AS paragraphs, a.n * (a.n - 1) // 2 AS places, a.lo AS least, a.hi AS greatest FROM r JOIN v a ON a.tdoc = src JOIN v b ON b.tdoc = dst WHERE src <> dst AND a.h <> b.h""",
    "resolved_meetings": r"""WITH c AS (SELECT DISTINCT meeting, wg, meeting_no, suffix, start_date, meeting_kind FROM meetings),
d AS (SELECT DISTINCT wg, 'TSG_' || replace(meeting, '#', '_') AS name, 'https://meetings.invalid/' || meeting || '/' AS url FROM c),
h AS (
  SELECT meeting AS hint_id, meeting AS hint, wg, meeting_no AS number, nullif(lower(suffix), '') AS suffix, NULL AS y, NULL AS m FROM c
  UNION ALL SELECT 'month of ' || meeting, regexp_extract(meeting, '^([A-Z]+[0-9])', 1) || ' ' || strftime(start_date, '%B %Y'), wg, NULL, NULL, year(start_date), month(start_date) FROM c
),
s AS (SELECT *, coalesce(regexp_matches(suffix, '(?i)ah|swg'), false) OR regexp_matches(hint, '(?i)\b(ahg?|swg|ad hoc)\b') AS sub FROM h),
near AS (SELECT DISTINCT s.hint_id, c.meeting_no, c.suffix, c.start_date FROM s JOIN c USING (wg) WHERE year(start_date) = y AND month(start_date) = m AND (meeting_kind = 'subgroup') = sub),
k AS (SELECT hint_id, count(*) AS n, min(meeting_no) AS no FROM near GROUP BY hint_id),
u AS (SELECT s.*, coalesce(k.n, 0) AS n, coalesce(number, CASE WHEN k.n = 1 THEN k.no END) AS use_number FROM s LEFT JOIN k USING (hint_id)),
f AS (SELECT hint_id, count(*) AS tied, arg_min(url, name) AS first_url FROM u JOIN d USING (wg)
  WHERE regexp_matches(name, '(^|[^0-9])' || use_number || '([^0-9]|$)') AND list_has_all(string_split_regex(lower(name), '[^a-z0-9]+'), list_filter(string_split_regex(coalesce(u.suffix, ''), '[^a-z0-9]+'), lambda x: x <> ''))
  GROUP BY hint_id),
r AS (SELECT hint_id, hint, wg, first_url, CASE WHEN number IS NULL AND m IS NULL THEN 'neither number nor month' WHEN m IS NOT NULL AND n = 0 THEN 'no meeting in that month'
  WHEN m IS NOT NULL AND n > 1 THEN 'several meetings in that month' WHEN tied IS NULL THEN 'no directory' WHEN tied > 1 THEN 'several directories' END AS reason FROM u LEFT JOIN f USING (hint_id))
SELECT hint_id, hint, wg, CASE WHEN reason IS NULL THEN 'resolved' WHEN starts_with(reason, 'several') THEN 'ambiguous' ELSE 'unresolved' END AS status,
CASE WHEN reason IS NULL THEN 'high' WHEN starts_with(reason, 'several') THEN 'candidate' ELSE 'unresolved' END AS confidence, CASE WHEN reason IS NULL THEN first_url END AS selected_url, reason FROM r""",
    "source_parts": rf"""WITH m AS (SELECT DISTINCT entry_id, source AS s, entry_id % 8 AS i FROM manifest WHERE source IS NOT NULL),
u AS (SELECT entry_id, s,
  CASE i WHEN 0 THEN 'https://docs.example.org/ftp/' || s || '?x=1' WHEN 1 THEN 'http://meetings.invalid/Report/' || s WHEN 2 THEN 'https://mirror.invalid/m/' || s WHEN 3 THEN 'https://elsewhere.test:8080/a%20b/TdocsByAgenda.htm'
    WHEN 4 THEN 'file:///srv/_older/agenda%20list/' || s || '.xlsx' WHEN 5 THEN 'Inbox%5Cindex%5C' || s WHEN 6 THEN 'https://docs.example.org/ftp/tdoc_index/' || s || '.CSV' ELSE 'https://u@elsewhere.test/x%2By/../' || s END AS k,
  CASE i WHEN 0 THEN '/ftp/' || s WHEN 1 THEN '/Report/' || s WHEN 2 THEN '/m/' || s WHEN 3 THEN '/a b/TdocsByAgenda.htm' WHEN 4 THEN '/srv/_older/agenda list/' || s || '.xlsx'
    WHEN 5 THEN 'Inbox\index\' || s WHEN 6 THEN '/ftp/tdoc_index/' || s || '.CSV' ELSE '/x+y/../' || s END AS path,
  CASE i WHEN 2 THEN 'private_mirror' WHEN 3 THEN 'remote' WHEN 4 THEN 'file_uri' WHEN 5 THEN 'local' WHEN 7 THEN 'remote' ELSE 'public' END AS kind,
  CASE i WHEN 0 THEN 'ftp/' || s || ',' || s WHEN 1 THEN 'Report/' || s WHEN 2 THEN 'm/' || s WHEN 3 THEN 'a b/TdocsByAgenda.htm' WHEN 6 THEN 'ftp/tdoc_index/' || s || '.CSV,tdoc_index/' || s || '.CSV' ELSE '' END AS mirror_paths FROM m)
SELECT entry_id, kind, sha256(k) AS cache_key, path, CASE WHEN regexp_matches(path, '{_TDOC}') THEN {_norm(f"regexp_extract(path, '{_TDOC}', 1)")} END AS tdoc,
regexp_replace(s, '[^A-Za-z0-9._-]+', '_', 'g') AS name, CAST({_priority("path")} AS BIGINT) AS priority, {_LIKELY} AS metadata, mirror_paths FROM u""",
    "safe_paths": r"""WITH m AS (SELECT DISTINCT source AS s FROM manifest WHERE source IS NOT NULL)
SELECT unnest([s, '/a%20b/' || s, 'a\\../' || s, 'a//' || s, './' || s, '%2e%2e/' || s, 'x+y/' || s]) AS path, unnest([s, 'a b/' || s, NULL, NULL, NULL, NULL, 'x+y/' || s]) AS safe FROM m""",
    "redacted_errors": r"""SELECT DISTINCT entry_id, CASE WHEN fallback_reason IS NOT NULL THEN '<private-mirror>: ' || regexp_extract(coalesce(error, 'OSError'), '^(\w*)', 1)
ELSE coalesce(error, 'OSError') || ' at <private-mirror>' || coalesce(source, '') END AS shown FROM manifest""",
    "host_failures": "SELECT event_id, event_type = 'error' OR event_id % 11 IN (2, 3, 5, 7, 8, 9, 10) AS against_host FROM events",
    "tdoc_validity": rf"""WITH a AS (SELECT DISTINCT row_id, {_norm("tdoc")} AS tdoc FROM agenda) SELECT row_id, tdoc, regexp_full_match(tdoc, '[A-Z][0-9]-[0-9]{{7}}') AS valid FROM a""",
    "month_hints": "SELECT meeting, year(start_date) AS year, month(start_date) AS month FROM meetings",
    "header_names": f"""WITH t AS (SELECT * FROM (VALUES {_HEADER_ROWS}, (NULL, 'no such column')) v(means, typed)) SELECT typed, means, (SELECT count(*) FROM meetings) AS meetings FROM t""",
    "cache_decisions": """SELECT DISTINCT entry_id, CASE WHEN cache_state = 'hit' AND sha256 IS NOT NULL AND NOT damaged THEN 'not_modified' WHEN state <> 'fetch_error' THEN 'downloaded'
WHEN sha256 IS NOT NULL AND NOT damaged AND entry_id % 5 <> 0 THEN 'stale' ELSE 'failed' END AS decision FROM (SELECT *, entry_id % 7 = 0 AND sha256 <> reverse(sha256) AS damaged FROM manifest)""",
    "read_csv": _read("csv-row", "csv", _CSV_ITEMS),
    "read_html": _read("html-row", "html", _HTML_ITEMS),
    "read_xlsx": _read("sheet-row", "xlsx", _XLSX_ITEMS),
    "read_pptx": _read("slide", "pptx", _PPTX_ITEMS),
    "read_docx": _read("paragraph", "docx", _DOCX_ITEMS),
    "read_text": _read("text", "txt", _TXT_ITEMS),
    "read_archive": _read("csv-row", "zip", _CSV_ITEMS, inner="v.inner", more=", LATERAL (SELECT unnest(['in/part' || f || '.csv', 'copy' || f || '.csv']) AS inner) v"),
}
