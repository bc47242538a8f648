"""Queries over the test tables, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions import ids, text
from docketlake.operators import agenda, coverage, diff, graph, passages, relations, resolve, scope
from docketlake.session import table
from docketlake.sources import cache, links, office, routing, writers
from docketlake.streaming import resume, window

QUERY = scope.Query("session anchor, AI intent")
ID_QUERY = scope.Query("KI#5 Solution Variant session anchor energy mobile time")
COMPANY_QUERY = scope.Query("", companies=("Drollurfa",), aliases={"Drollurfa": ("Communications Drollurfa",)})
SEEDS = scope.Query("S2-2300017 S2 2605845", tdocs=("S2-2300017", "s22605845"))
HOSTS = ("docs.example.org", "meetings.invalid")


def _agenda(spark: SparkSession, d: str) -> DataFrame:
    """Records as the operators know them, one per row_id."""
    a = table(spark, d, "agenda").dropDuplicates(["row_id"])
    return a.select(
        "row_id", ids.normalize_tdoc(F.col("tdoc")).alias("tdoc"), "title", F.col("source").alias("source_company"), "status",
        F.col("agenda_item").alias("agenda"), "comments", "discussion", "metadata_source", "metadata_locator", "meeting",
    ).withColumn("role_hints", text.role_hints(F.col("title"), F.col("comments"), F.col("status")))


def _first(spark, d) -> DataFrame:
    return agenda.first_per_document(_agenda(spark, d), ordinal="row_id")


def _edges(spark, d) -> DataFrame:
    a = _agenda(spark, d)
    return relations.classify(relations.agenda_edges(a), relations.invalid_sources(a))


def _stored_edges(spark, d) -> DataFrame:
    r = table(spark, d, "relationships").dropDuplicates(["rel_id"])
    return r.select(
        ids.normalize_tdoc(F.col("from_tdoc")).alias("src"), ids.normalize_tdoc(F.col("to_tdoc")).alias("dst"), F.col("relation_type").alias("type"),
        "classification", "source", "locator", F.col("excerpt"),
    )


def _index(spark, d) -> DataFrame:
    return table(spark, d, "document_index").dropDuplicates(["para_id"])


def agenda_records(spark, d):
    """First record of every document."""
    return _first(spark, d).select("tdoc", "row_id", "title", "metadata_source", F.array_join("role_hints", ",").alias("role_hints"))


def header_fill(spark, d):
    """Agenda tables as raw rows under a header per file, read back into records."""
    a = table(spark, d, "agenda").dropDuplicates(["row_id"])
    none = F.lit("")
    body = a.select(F.col("metadata_source").alias("file"), (F.col("row_id") + 10).alias("ordinal"), F.array(*(F.coalesce(F.col(c), none) for c in ("tdoc", "title", "source", "status", "agenda_item"))).alias("cells"))
    head = a.select(F.col("metadata_source").alias("file")).distinct().select("file", F.lit(1).cast("bigint").alias("ordinal"), F.array(*map(F.lit, ("TDoc", "Title", "Source", "Result", "Agenda Item"))).alias("cells"))
    return agenda.agenda_records(body.unionByName(head)).select("tdoc", "title", "source_company", "status", "agenda", "metadata_source", "ordinal")


def agenda_edges(spark, d):
    return relations.unique_edges(_edges(spark, d)).select("src", "dst", "type", "classification", "source", "locator")


def invalidated_edges(spark, d):
    return _edges(spark, d).where("classification = 'invalidated'").select("src", "dst", "type").distinct()


def body_edges(spark, d):
    """Relations stated in the excerpts that the relationships keep."""
    r = table(spark, d, "relationships").dropDuplicates(["rel_id"]).select(ids.normalize_tdoc(F.col("from_tdoc")).alias("tdoc"), F.col("excerpt").alias("text"), "locator", "source")
    return relations.body_edges(r).groupBy("src", "dst", "type", "source", "locator").agg(F.count("*").alias("statements"))


def identifiers_extract(spark, d):
    i = _index(spark, d).select("para_id", ids.identifiers(F.col("text")).alias("i"))
    return i.select("para_id", *(F.array_join(f"i.{k}", ",").alias(k) for k in ("tdocs", "key_issues", "solution_variants", "solutions")))


def stale_identifiers(spark, d):
    """Paragraphs whose stored identifiers or hash are not what their text holds."""
    i = _index(spark, d).select("para_id", (~F.col("identifiers").eqNullSafe(ids.identifiers(F.col("text")))).alias("ids"), (~F.col("paragraph_hash").eqNullSafe(text.text_hash(F.col("text")))).alias("stale_hash"))
    return i.select("para_id", F.col("ids").alias("stale_identifiers"), "stale_hash").where("stale_identifiers or stale_hash")


def paragraph_hash(spark, d):
    return _index(spark, d).select("para_id", text.text_hash(F.col("text")).alias("digest"))


def evidence_duplicates(spark, d):
    e = table(spark, d, "evidence").dropDuplicates(["evidence_id"])
    key = F.concat_ws(":", "tdoc", "inner_file", "locator")
    return passages.mark_duplicates(e, ["tdoc", "source", "inner_file", "ordinal", "evidence_id"], key).select("evidence_id", "paragraph_hash", "duplicate_of")


def document_lines(spark, d):
    """Non-blank lines of the documents with position and hash."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), text.text_hash(F.col("line")).alias("digest")).where(text.collapse(F.col("line")) != "")


def context_window(spark, d):
    return passages.select_passages(_index(spark, d), QUERY, keys=("tdoc", "source", "inner_file"), ties=("para_id",)).select("para_id")


def section_carry(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return agenda.carry_sections(lines, ["doc_id"], "pos", "line").groupBy("doc_id", "carried_section").agg(F.count("*").alias("lines"))


def match_score(spark, d):
    a = _agenda(spark, d)
    return a.select("row_id", scope.match_score(ID_QUERY).cast("bigint").alias("score"))


def company_scope(spark, d):
    return scope.direct_matches(_agenda(spark, d), COMPANY_QUERY).select("row_id")


def seed_scope(spark, d):
    return scope.direct_matches(_agenda(spark, d), SEEDS).select("row_id", "tdoc")


def scoped_records(spark, d):
    first = _first(spark, d)
    hits = scope.direct_matches(first, QUERY)
    related = relations.one_hop(_edges(spark, d), hits)
    return scope.scoped_records(related, first, hits).select("tdoc", "scope_basis", "metadata_missing")


def _tasks(spark, d) -> DataFrame:
    first = _first(spark, d)
    hits = scope.direct_matches(first, QUERY).select("tdoc", F.lit(True).alias("matched"))
    related = relations.one_hop(_edges(spark, d), hits)
    t = related.join(first.select("tdoc", "role_hints", F.lit(True).alias("known")), "tdoc", "left").join(hits, "tdoc", "left")
    return t.select("tdoc", scope.task_priority(F.col("role_hints"), F.col("matched"), F.col("known")).cast("bigint").alias("priority"))


def task_priority(spark, d):
    return _tasks(spark, d)


def core_stage(spark, d):
    return scope.stage(_tasks(spark, d), "core").select("tdoc", "priority")


def task_batches(spark, d):
    return scope.batches(_tasks(spark, d), 8).select("tdoc", "priority", "batch_no")


def task_sources(spark, d):
    m = table(spark, d, "manifest").select("tdoc", "source").where("tdoc is not null and source is not null")
    return scope.with_source(_tasks(spark, d).select("tdoc"), m, "meeting/")


def distributions(spark, d):
    return scope.distributions(_agenda(spark, d), {"agenda": "agenda", "company": "source_company", "status": "status"})


def run_coverage(spark, d):
    m = table(spark, d, "manifest").dropDuplicates(["entry_id"])
    return coverage.warnings(coverage.coverage(m, ["source_kind"])).withColumn("warnings", F.array_join("warnings", " "))


def closure_depth(spark, d):
    e = _stored_edges(spark, d)
    seeds = _first(spark, d).where("array_contains(role_hints, 'baseline')").select("tdoc")
    files = table(spark, d, "manifest").select("tdoc").distinct()
    return graph.closure(seeds, e, files).select("tdoc", F.col("depth").cast("bigint").alias("depth"))


def query_terms(spark, d):
    a = _agenda(spark, d)
    return a.select("row_id", F.array_join(text.query_terms(F.col("title")), " ").alias("terms"))


def paragraph_diff(spark, d):
    return diff.paragraph_diffs(_stored_edges(spark, d), _index(spark, d))


def paragraph_patch(spark, d):
    """Every pair of versions that differ, with the paragraphs of the old one after its blocks are put in: those of the new one."""
    index = _index(spark, d)
    blocks = diff.paragraph_diffs(_stored_edges(spark, d), index)
    return diff.patched(blocks, index).groupBy("src", "dst", "type").agg(F.count("*").alias("paragraphs"), F.sum("at").alias("places"), F.min("h").alias("least"), F.max("h").alias("greatest"))


def unique_relationships(spark, d):
    return relations.unique_edges(_stored_edges(spark, d)).select("src", "dst", "type", "source", "locator")


_SHAPES = (
    ("public", "HTTPS://Docs.Example.org/ftp/{}?x=1#top"), ("public", "http://meetings.invalid/Report/{}"), ("private_mirror", "https://mirror.invalid/m/{}"), ("remote", "https://elsewhere.test:8080/a%20b/TdocsByAgenda.htm#{}"),
    ("file_uri", "file:///srv/_older/agenda%20list/{}.xlsx"), ("local", "Inbox\\index\\{}"), ("public", "https://docs.example.org/ftp/tdoc_index/{}.CSV"), ("remote", "https://u@elsewhere.test/x+y/../{}"),
)


def _shaped(spark, d) -> DataFrame:
    """Every listed source as an address of one of several shapes, by its entry."""
    m = table(spark, d, "manifest").select("entry_id", "source").where("source is not null").dropDuplicates(["entry_id"])
    n, out = F.pmod("entry_id", F.lit(len(_SHAPES))), None
    for i, (_, form) in reversed(list(enumerate(_SHAPES))):
        before, after = form.split("{}")
        made = F.concat(F.lit(before), "source", F.lit(after))
        out = made if out is None else F.when(n == i, made).otherwise(out)
    return m.select("entry_id", "source", out.alias("url"))


def source_parts(spark, d):
    """Kind, key, priority, names and mirror places of every listed source, as an address of several shapes."""
    u = F.col("url")
    return _shaped(spark, d).select(
        "entry_id",
        routing.source_kind(u, HOSTS, "https://mirror.invalid/m/").alias("kind"),
        routing.cache_key(u).alias("cache_key"),
        text.source_path(u).alias("path"),
        text.tdoc_from_name(u).alias("tdoc"),
        text.safe_name(F.col("source")).alias("name"),
        text.metadata_priority(u).cast("bigint").alias("priority"),
        text.likely_metadata(u).alias("metadata"),
        F.array_join(routing.mirror_paths(u), ",").alias("mirror_paths"),
    )


def safe_paths(spark, d):
    """Paths of the manifest as they are, quoted, with a step up, with an empty and with a dotted part."""
    m = table(spark, d, "manifest").select("source").where("source is not null").distinct()
    made = F.array("source", F.concat(F.lit("/a%20b/"), "source"), F.concat(F.lit("a\\\\.."), F.lit("/"), "source"), F.concat(F.lit("a//"), "source"), F.concat(F.lit("./"), "source"), F.concat(F.lit("%2e%2e/"), "source"), F.concat(F.lit("x+y/"), "source"))
    p = m.select(F.explode(made).alias("path"))
    return p.select("path", routing.safe_relative(F.col("path")).alias("safe"))


def redacted_errors(spark, d):
    """Error texts of the manifest, of which those of a mirror never show its place."""
    m = table(spark, d, "manifest").dropDuplicates(["entry_id"]).select("entry_id", F.concat(F.coalesce("error", F.lit("OSError")), F.lit(" at https://mirror.invalid/m/"), F.coalesce("source", F.lit(""))).alias("message"), F.when(F.col("fallback_reason").isNotNull(), "private_mirror").otherwise("public").alias("kind"))
    return m.select("entry_id", routing.redact(F.col("message"), F.col("kind"), "https://mirror.invalid/m/").alias("shown"))


def host_failures(spark, d):
    """Which attempts speak against the host: the statuses of the events, as attempts of every status."""
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, (200, 304, 401, 403, 404, 407, 410, 429, 500, 503, 599))), (F.pmod("event_id", F.lit(11)) + 1).cast("int")).alias("http_status"), (F.col("event_type") == "error").alias("broken"))
    return e.select("event_id", routing.host_failure(F.col("http_status"), F.col("broken")).alias("against_host"))


def tdoc_validity(spark, d):
    """Typed document numbers in plain form and whether they are numbers."""
    a = table(spark, d, "agenda").dropDuplicates(["row_id"]).select("row_id", ids.normalize_tdoc(F.col("tdoc")).alias("tdoc"))
    return a.select("row_id", "tdoc", ids.valid_tdoc(F.col("tdoc")).alias("valid"))


def month_hints(spark, d):
    """The month named with a meeting, in one of four ways of writing."""
    m = table(spark, d, "meetings")
    way = F.pmod(F.dayofmonth("start_date"), F.lit(4))
    written = F.when(way == 0, F.date_format("start_date", "yyyy年M月")).when(way == 1, F.date_format("start_date", "yyyy-MM")).when(way == 2, F.date_format("start_date", "MMMM yyyy")).otherwise(F.date_format("start_date", "yyyy MMM"))
    h = m.select("meeting", text.month_hint(F.concat(F.col("meeting"), F.lit(", "), written)).alias("h"))
    return h.select("meeting", F.col("h.year").cast("bigint").alias("year"), F.col("h.month").cast("bigint").alias("month"))


def header_names(spark, d):
    """Column names as they are typed, in many spellings, and what they stand for."""
    every = [(k, v) for k, vs in text.HEADERS.items() for v in vs]
    m = table(spark, d, "meetings").select("meeting")
    typed = F.explode(F.array(*(F.struct(F.lit(k).alias("means"), F.lit(f" {v[:2].upper()}-{v[2:]} .:").alias("typed")) for k, v in every), F.struct(F.lit(None).cast("string").alias("means"), F.lit("no such column").alias("typed"))))
    t = m.select("meeting", typed.alias("t")).select("meeting", "t.typed")
    return t.groupBy("typed", text.canonical_header(F.col("typed")).alias("means")).agg(F.count("*").alias("meetings"))


def _read_back(spark, d, kind: str, zipped: bool = False) -> DataFrame:
    """Agenda rows written as files of a kind and read again."""
    a = table(spark, d, "agenda").dropDuplicates(["row_id"])
    files = writers.written_files(a, kind, "row_id", ["tdoc", "title", "comments"], zipped)
    return office.parse_files(files).select("path", "inner_file", "state", "kind", F.col("ordinal").cast("bigint").alias("ordinal"), "locator", "text", "change_state")


def read_docx(spark, d):
    return _read_back(spark, d, "docx")


def read_pptx(spark, d):
    return _read_back(spark, d, "pptx")


def read_xlsx(spark, d):
    return _read_back(spark, d, "xlsx")


def read_csv(spark, d):
    return _read_back(spark, d, "csv")


def read_html(spark, d):
    return _read_back(spark, d, "html")


def read_text(spark, d):
    return _read_back(spark, d, "txt")


def read_archive(spark, d):
    return _read_back(spark, d, "csv", True)


def source_candidates(spark, d):
    m = table(spark, d, "manifest").select(F.concat(F.lit("https://docs.example.org/ftp/"), "source").alias("source"), (F.col("fallback_reason").isNotNull()).alias("down")).distinct()
    return routing.candidates(m, "source", HOSTS, "https://mirror.invalid/m/", F.col("down")).select("source", "down", F.col("rank").cast("bigint").alias("rank"), "effective", "kind")


def _attempts(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failure"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "view", "private_mirror").otherwise("public").alias("kind"), (F.col("event_type") == "signup").alias("stale"))


def circuit_breaker(spark, d):
    return routing.circuit(_attempts(spark, d), ["user_id"], ["ts", "event_id"], F.col("failure")).select("event_id", "circuit_open")


def router_counters(spark, d):
    return routing.counters(_attempts(spark, d), ["user_id"])


def adaptive_window(spark, d):
    return window.adaptive_window(_attempts(spark, d), "user_id", "ts", ["ts", "event_id"], F.col("failure")).withColumnRenamed("key", "user_id")


def cache_decisions(spark, d):
    m = table(spark, d, "manifest").dropDuplicates(["entry_id"])
    # every seventh payload has been damaged since, every fifth is asked for afresh
    log = m.select("entry_id", F.when(F.col("cache_state") == "hit", 304).otherwise(200).alias("http_status"), (F.col("state") != "fetch_error").alias("ok"), F.col("sha256").alias("cached_sha256"), F.when(F.pmod("entry_id", F.lit(7)) == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("payload_sha256"), (F.pmod("entry_id", F.lit(5)) == 0).alias("refresh"))
    return cache.fresh_or_stale(log).select("entry_id", "decision")


def resume_anti(spark, d):
    m = table(spark, d, "manifest")
    return resume.remaining(m.select("tdoc").where("tdoc is not null").distinct(), m.where(F.col("state").isin(*coverage.PROCESSED)))


def run_signatures(spark, d):
    m = table(spark, d, "meetings")
    return m.select("meeting", resume.signature_column("meeting", "wg").alias("signature"))


def _calendar(spark, d) -> DataFrame:
    return table(spark, d, "meetings").select("meeting", "wg", "meeting_no", "suffix", "start_date", "end_date", "meeting_kind", "source")


def calendar_order(spark, d):
    return resolve.calendar_order(_calendar(spark, d)).select("meeting", "wg", "order_no")


def month_match(spark, d):
    c = _calendar(spark, d)
    hints = c.select(F.concat_ws("/", "wg", F.date_format("start_date", "yyyy-MM")).alias("hint_id"), "wg", F.year("start_date").alias("year"), F.month("start_date").alias("month")).distinct()
    return resolve.month_matches(hints, c).groupBy("hint_id").agg(F.count("*").alias("meetings"), F.count_if(F.col("meeting_kind") == "subgroup").alias("subgroup_meetings"))


def _directories(spark, d) -> DataFrame:
    return _calendar(spark, d).select("wg", F.concat(F.lit("TSG_"), F.regexp_replace("meeting", "#", "_")).alias("name"), F.concat(F.lit("https://meetings.invalid/"), "meeting", F.lit("/")).alias("url"))


def meeting_ties(spark, d):
    c = _calendar(spark, d)
    hints = c.select(F.col("meeting").alias("hint_id"), "wg", F.col("meeting_no").alias("number"), F.lower("suffix").alias("suffix"))
    return resolve.best_or_tied(resolve.directory_matches(hints, _directories(spark, d))).select("hint_id", F.col("best_score").cast("bigint").alias("best_score"), "tied")


def resolved_meetings(spark, d):
    c = _calendar(spark, d)
    named = c.select(F.col("meeting").alias("hint_id"), F.col("meeting").alias("hint"))
    dated = c.select(F.concat(F.lit("month of "), "meeting").alias("hint_id"), F.concat(F.regexp_extract("meeting", "^([A-Z]+[0-9])", 1), F.lit(" "), F.date_format("start_date", "MMMM yyyy")).alias("hint"))
    return resolve.resolve_meetings(named.union(dated), c, _directories(spark, d)).select("hint_id", "hint", "wg", "status", "confidence", "selected_url", "reason")


def meeting_descriptors(spark, d):
    m = table(spark, d, "meetings").select("meeting", text.meeting_descriptor(F.concat(F.col("meeting"), F.date_format("start_date", " MMMM yyyy"))).alias("d"))
    return m.select("meeting", "d.wg", "d.tsg", "d.number", "d.suffix", F.col("d.year").cast("bigint").alias("year"), F.col("d.month").cast("bigint").alias("month"), text.group_code(F.col("d.wg")).alias("code"))


def page_links(spark, d):
    """A listing page per group of sources, read back into links."""
    m = table(spark, d, "manifest").where("source is not null").select(F.substring("source", 1, 8).alias("grp"), "source").distinct()
    row = F.concat(F.lit('<li><A class=x HREF="'), "source", F.lit('#top">x</a> <a href="mailto:a@b">m</a>'))
    pages = m.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("html")).withColumn("url", F.concat(F.lit("https://docs.example.org/ftp/"), "grp", F.lit("/index.htm")))
    return links.page_links(pages).select("url", F.col("n").cast("bigint").alias("n"), "link")


def excerpts(spark, d):
    """The surroundings of the first identifier of a paragraph."""
    return _index(spark, d).select("para_id", text.excerpt(F.col("text"), r"(?i)\bTS [0-9.]+[0-9]", 40).alias("excerpt")).where("excerpt is not null")


def manifest_order(spark, d):
    """Place of every manifest entry in the order (priority, tdoc, source, entry_id)."""
    m = table(spark, d, "manifest").dropDuplicates(["entry_id"]).select("entry_id", "priority", "tdoc", "source")
    return scope.positions(m, ["priority", "tdoc", "source", "entry_id"]).select("entry_id", "position")


def first_evidence(spark, d):
    """When the first evidence of a document was matched, and how much there is."""
    return table(spark, d, "evidence").groupBy("tdoc").agg(F.min("matched_at").alias("first_matched_at"), F.count_distinct("evidence_id").alias("items")).select("tdoc", F.date_format("first_matched_at", "yyyy-MM-dd HH:mm:ss").alias("first_matched_at"), "items")


def resumed_scope(spark, d):
    """The scope when the stored relationships of an earlier run are known too."""
    hits = scope.direct_matches(_first(spark, d), QUERY)
    edges = relations.with_previous(_edges(spark, d), _stored_edges(spark, d))
    return relations.one_hop(edges, hits)


def company_mentions(spark, d):
    hay = F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in scope.FIELDS))
    return scope.company_mentions(_agenda(spark, d), "row_id", hay, table(spark, d, "companies"))


QUERIES = {
    f.__name__: f
    for f in (
        agenda_records, header_fill, agenda_edges, invalidated_edges, body_edges, identifiers_extract, stale_identifiers, paragraph_hash, evidence_duplicates,
        document_lines, context_window, section_carry, match_score, company_scope, seed_scope, scoped_records, task_priority, core_stage, task_batches, task_sources,
        distributions, run_coverage, closure_depth, query_terms, paragraph_diff, paragraph_patch, safe_paths, redacted_errors, host_failures, tdoc_validity, month_hints,
        header_names, read_docx, read_pptx, read_xlsx, read_csv, read_html, read_text, read_archive, unique_relationships, source_parts, source_candidates, circuit_breaker,
        router_counters, adaptive_window, cache_decisions, resume_anti, run_signatures, calendar_order, month_match, meeting_ties, resolved_meetings,
        meeting_descriptors, page_links, excerpts, manifest_order, first_evidence, resumed_scope, company_mentions,
    )
}
