"""Commands over meetings: resolve, preview, collect, cache_info, cache_clear.

A meeting is a folder, or the address of a directory page. preview reads metadata only.
collect adds bodies: those of the core stage, or everything that valid edges reach. Only
files that are asked for are opened, each by the task that parses it. Both return tables and
can write them; nothing is concluded from an edge or a status.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.text import group_code, likely_metadata, tdoc_from_name
from docketlake.operators import agenda, coverage, diff, passages, relations, scope
from docketlake.operators.resolve import calendar_rows, resolve_meetings
from docketlake.operators.scope import Query, QueryError
from docketlake.schemas import EXPORTS, conform
from docketlake.session import checkpoint
from docketlake.sources import cache, fetch, links, office, sinks
from docketlake.streaming.resume import read_or_none, remaining, run_signature


@dataclass(frozen=True)
class Options:
    """How files are got and read. work_dir holds payloads and must be a folder that all executors share."""

    work_dir: str | None = None
    route: fetch.Route = fetch.Route()
    max_concurrency: int = 4
    parse_workers: int | None = None
    batch_size: int = 1000
    download: str | None = None
    max_depth: int = 2
    max_directories: int = 251

    def payloads(self) -> str:
        return self.work_dir or os.path.join(tempfile.gettempdir(), "docketlake-payloads")


@dataclass
class Result:
    """Tables of a run, and its counters as one row."""

    tables: dict[str, DataFrame]
    signature: str
    stage: str = "preview"
    blocked: bool = False
    exit_code: int = field(init=False, default=0)

    def __post_init__(self):
        self.exit_code = 2 if self.blocked else 0

    def write(self, folder: str, form: str = "json") -> None:
        """A directory per table, written in parallel, and the run's counters as one file."""
        for name, t in self.tables.items():
            sinks.write_rows(conform(t, name) if name in EXPORTS else t, os.path.join(folder, name), form)
        sinks.write_json({"run_signature": self.signature, "stage": self.stage}, os.path.join(folder, "run.json"))


def _remote(meeting: str) -> bool:
    return meeting.lower().startswith(("http://", "https://"))


def _files(spark: SparkSession, meetings: list[str], options: Options) -> DataFrame:
    """(path, length, meeting, kind) of what is below the meetings; kind: file, or not_visited for a directory left out."""
    out = None
    for m in meetings:
        if _remote(m):
            root = spark.createDataFrame([(m if m.endswith("/") else m + "/",)], "url string")
            pages = fetch.page_reader(os.path.join(options.payloads(), "pages"), options.route, options.max_concurrency)
            f = links.crawl(pages, root, options.max_depth, most=options.max_directories).select(F.col("link").alias("path"), F.lit(None).cast("bigint").alias("length"), "kind")
        else:
            f = office.list_files(spark, m).select("path", "length", F.lit("file").alias("kind"))
        f = f.withColumn("meeting", F.lit(m))
        out = f if out is None else out.unionByName(f)
    return checkpoint(out)


def _located(files: DataFrame, options: Options) -> DataFrame:
    """files (path, ...) with place, transfer_state, body_bytes, retry_count and fallback_reason; addresses are fetched, files stay where they are."""
    remote = F.col("path").rlike("(?i)^https?://")
    here = files.where(~remote).select(
        "*", F.col("path").alias("place"), F.lit("local").alias("transfer_state"), F.lit(0).cast("bigint").alias("fetched_bytes"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("fallback_reason"), F.lit(False).alias("stale")
    )
    away = files.where(remote)
    if away.isEmpty():
        return here
    log = fetch.fetch_adaptive(away.select(F.col("path").alias("source")), os.path.join(options.payloads(), "files"), options.route, options.max_concurrency)
    log = log.select(
        F.col("source").alias("path"), F.col("path").alias("place"), F.col("state").alias("transfer_state"), F.col("body_bytes").alias("fetched_bytes"), "retry_count", "fallback_reason",
        ((F.col("state") == "cached") & F.col("error").isNotNull()).alias("stale"),
    )
    return here.unionByName(away.join(log, "path"))


STATS = ("transfer_state", "fetched_bytes", "retry_count", "fallback_reason", "stale", "cache_state", "size")


def _parsed(sources: DataFrame, options: Options, cache_dir: str | None) -> DataFrame:
    """Rows of sources (path, tdoc, length) with their document and what it took to read them; a file that cannot be got is one row with its state."""
    got = checkpoint(_located(sources.select("path", "tdoc", "length"), options))
    lost = got.where("place is null").withColumn("cache_state", F.lit("not_requested")).withColumn("size", F.lit(None).cast("bigint"))
    got = got.where("place is not null")
    if options.parse_workers:
        got = got.repartition(options.parse_workers)
    if cache_dir:
        rows, files = cache.cached_parse(got, cache_dir, "place")
        rows = rows.drop(*cache.KEYS).join(files.select("path", "tdoc", *STATS[:5], "cache_state", F.col("body_bytes").alias("size")), "path")
    else:
        rows = office.parse_paths(got.withColumn("cache_state", F.lit("not_requested")).withColumn("size", F.col("length")).drop("length"), "place")
    columns = [c for c in rows.columns if c not in ("place", "length", "body_bytes")]
    unread = lost.select("path", "tdoc", *STATS, F.lit("fetch_error").alias("state"))
    return rows.select(*columns).unionByName(unread, allowMissingColumns=True)


def read_metadata(spark: SparkSession, files: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(agenda records, the first of each document; files that may list documents with priority, chosen and whether one was read)."""
    plain = files.where("kind = 'file'")
    listing = plain.where(likely_metadata(F.col("path")) & tdoc_from_name(F.col("path")).isNull())
    if listing.isEmpty():
        listing = plain.where(F.lower("path").rlike(r"\.(xlsx|csv)$") & tdoc_from_name(F.col("path")).isNull())
    ranked = checkpoint(agenda.best_sources(listing.select("path", "meeting"), "meeting", "path"))
    got = checkpoint(_located(ranked.where("chosen").select("path"), options))
    rows = checkpoint(office.parse_paths(got.where("place is not null").select("path", "place"), "place"))
    bad = rows.where("state <> 'parsed' and state <> 'unsupported'").select("path").union(got.where("place is null").select("path")).distinct()
    ranked = ranked.join(bad.withColumn("failed", F.lit(True)), "path", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    with_cells = rows.where("cells is not null").select(F.concat_ws("#", "path", "inner_file").alias("file"), "ordinal", "cells")
    return agenda.first_per_document(agenda.agenda_records(with_cells)), ranked


def preview(spark: SparkSession, meetings: list[str], query: Query, previous: DataFrame | None = None, options: Options = Options()) -> Result:
    """Scope of a query: candidates, edges, distributions, counts; bodies are not read.

    Valid edges of a previous run (relationships) enlarge the scope.
    """
    signature = run_signature(meetings, query.text, list(query.companies), list(query.tdocs))
    if missing := [m for m in meetings if "://" not in m and not os.path.isdir(m)]:
        empty = spark.createDataFrame([(m, "unresolved") for m in missing], "input string, status string")
        return Result({"meetings": empty}, signature, blocked=True)
    files = _files(spark, meetings, options)
    records, ranked = read_metadata(spark, files, options)
    records = checkpoint(records)
    edges = checkpoint(relations.unique_edges(relations.classify(relations.agenda_edges(records), relations.invalid_sources(records))))
    if previous is not None:
        edges = checkpoint(relations.with_previous(edges, previous))
    hits = checkpoint(scope.direct_matches(records, query))
    asked = spark.createDataFrame([(t,) for t in query.tdocs], "tdoc string")
    related = relations.one_hop(edges, hits.select("tdoc").union(asked))
    listed = files.where("kind = 'file'").select(tdoc_from_name(F.col("path")).alias("tdoc"), F.col("path").alias("source"), "meeting", "length").where("tdoc is not null")
    scoped = checkpoint(scope.scoped_records(related, records, hits, query.tdocs))
    failures = ranked.where("failed").count() + files.where("kind = 'not_visited'").count()
    tables = {
        "meetings": spark.createDataFrame([(m, "resolved") for m in meetings], "input string, status string"),
        "agenda_records": records,
        "candidates": scoped,
        "relationships": relations.edges_touching(edges, related),
        "distributions": scope.distributions(scoped, {"agenda": "agenda", "company": "source_company", "status": "status"}),
        "files": listed,
        "sources": ranked,
        "not_visited": files.where("kind = 'not_visited'").select("path", "meeting"),
        "counts": coverage.preview_counts(scoped, records, hits, query.text, query.tdocs, failures=failures),
    }
    return Result(tables, signature)


def _earlier(spark: SparkSession, state_dir: str, signature: str) -> DataFrame | None:
    """Parsed rows of an earlier run that asked for the same; those of another run are removed."""
    note = os.path.join(state_dir, "state.json")
    try:
        same = json.loads(Path(note).read_text(encoding="utf-8")).get("run_signature") == signature
    except (OSError, ValueError):
        same = False
    if same:
        return read_or_none(spark, os.path.join(state_dir, "parsed"))
    shutil.rmtree(os.path.join(state_dir, "parsed"), ignore_errors=True)
    sinks.write_json({"run_signature": signature}, note)
    return None


def _read_bodies(spark: SparkSession, sources: DataFrame, options: Options, cache_dir: str | None, state_dir: str | None, signature: str, read_: list[int]) -> DataFrame:
    """Parsed rows of sources (tdoc, path, length, priority), batch by batch in order of priority; with a state_dir each batch is kept as soon as it is read, and what is kept is not read again."""
    if state_dir is None:
        return checkpoint(_parsed(sources, options, cache_dir))
    earlier = _earlier(spark, state_dir, signature)
    done = None if earlier is None else checkpoint(earlier.where("state <> 'fetch_error'").select("tdoc").distinct())
    todo = checkpoint(scope.batches(sources if done is None else remaining(sources, done), options.batch_size))
    last = todo.agg(F.max("batch_no")).first()[0]
    place = os.path.join(state_dir, "parsed")
    for n in range(0 if last is None else int(last) + 1):
        part = todo.where(F.col("batch_no") == n)
        read_[0] += part.count()
        _parsed(part, options, cache_dir).write.mode("append").parquet(place)
    kept = read_or_none(spark, place)
    if kept is None:
        return checkpoint(_parsed(sources.where("false"), options, None))
    kept = kept.join(sources.select("path").distinct(), "path", "left_semi")
    # a document that failed before and was read now counts as read
    read_now = kept.where("state <> 'fetch_error'").select("path").distinct().withColumn("_read", F.lit(True))
    return checkpoint(kept.join(read_now, "path", "left").where("state <> 'fetch_error' or _read is null").drop("_read"))


def collect(
    spark: SparkSession, meetings: list[str], query: Query, stage: str = "core", cache_dir: str | None = None, mode: str = "topic", previous: DataFrame | None = None,
    state_dir: str | None = None, options: Options = Options(),
) -> Result:
    """The preview with the bodies of its documents: index, evidence, edges, diffs, documents, coverage.

    In stage complete the bodies' own edges are followed to documents that have a file,
    until none is left. Every document is parsed once, whatever reaches it. With a state_dir
    an interrupted run goes on where it stopped, and a complete run takes over what a core
    run of the same question has read.
    """
    if stage not in ("core", "complete"):
        raise QueryError(f"no such stage: {stage}")
    run = preview(spark, meetings, query, previous, options)
    if run.blocked:
        return run
    t = run.tables
    scoped = t["candidates"]
    matched = scoped.where("scope_basis <> 'explicit_relationship'").select("tdoc", F.lit(True).alias("_m"))
    asked = F.col("tdoc").isin(*query.tdocs) if query.tdocs else F.lit(False)
    tasks = scoped.join(matched, "tdoc", "left").select("tdoc", scope.task_priority(F.col("role_hints"), F.col("_m"), ~F.col("metadata_missing"), asked).alias("priority"))
    chosen = checkpoint(scope.stage(tasks, stage))
    first = t["files"].groupBy("tdoc").agg(F.min(F.struct("source", "length")).alias("f")).select("tdoc", F.col("f.source").alias("path"), "f.length")
    index = parsed_all = None
    read_ = [0]
    frontier = seen = chosen.select("tdoc", "priority")
    while True:
        sources = checkpoint(frontier.join(first, "tdoc"))
        parsed = _read_bodies(spark, sources, options, cache_dir, state_dir, run.signature, read_)
        parsed_all = parsed if parsed_all is None else parsed_all.unionByName(parsed)
        part = checkpoint(office.document_index(parsed, F.col("tdoc"), F.col("path")))
        index = part if index is None else index.unionByName(part)
        if stage == "core":
            break
        body = relations.body_edges(part).where("dst is not null").select(F.col("dst").alias("tdoc")).distinct()
        fresh = body.join(first.select("tdoc"), "tdoc", "left_semi").join(seen.select("tdoc"), "tdoc", "left_anti")
        frontier = checkpoint(fresh.withColumn("priority", F.lit(3)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    body_edges = relations.body_edges(index).withColumn("classification", F.lit("candidate")).withColumn("confidence", F.lit("high")).withColumn("warning", F.lit(None).cast("string"))
    edges = checkpoint(relations.unique_edges(t["relationships"].unionByName(body_edges)))
    picked = passages.select_passages(index, query, mode)
    order = seen.groupBy("tdoc").agg(F.min("priority").alias("priority"))
    evidence = passages.mark_duplicates(
        picked.join(order, "tdoc"), ["priority", "tdoc", "source", "inner_file", "ordinal"], F.concat_ws(":", "tdoc", "inner_file", "locator")
    )
    blocks = checkpoint(diff.paragraph_diffs(edges, index))
    read = parsed_all.groupBy("tdoc").agg(
        F.min("path").alias("source"),
        F.count_distinct(F.when(F.col("state") == "parsed", F.col("inner_file"))).alias("parsed_files"),
        F.count_distinct(F.when(F.col("state").isin("unsupported", "too_large", "too_deep") | F.col("state").startswith("parse_error"), F.col("inner_file"))).alias("unsupported_files"),
        F.collect_set(F.struct("inner_file", "state")).alias("files"),
        F.bool_or(F.col("state").startswith("read_error") | (F.col("state") == "fetch_error")).alias("lost"),
        *(F.first(c).alias(c) for c in STATS),
    )
    state = (
        F.when(F.col("source").isNull(), "missing").when(F.col("lost"), "fetch_error").when(F.col("cache_state") == "parsed_hit", "cached_processed")
        .when(F.col("transfer_state") == "local", "local_processed").otherwise("processed")
    )
    documents = checkpoint(
        order.join(read, "tdoc", "left").withColumn("state", state).withColumn("body_bytes", F.coalesce("size", "fetched_bytes", F.lit(0)))
        .withColumn("cache_state", F.when((F.col("cache_state") != "parsed_hit") & (F.col("transfer_state") == "cached"), "hit").otherwise(F.coalesce("cache_state", F.lit("not_requested"))))
        .drop("lost", "size")
    )
    more = documents.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unsupported_files", "parsed_files", "fetched_bytes")), F.count_if(F.coalesce("stale", F.lit(False))).alias("stale_hits")
    ).withColumn("_one", F.lit(1))
    totals = coverage.warnings(coverage.coverage(documents)).withColumn("_one", F.lit(1)).join(more, "_one").drop("_one")  # one row each
    totals = totals.withColumn("relationship_expansion_stable", F.lit(stage == "complete")).withColumn("documents_read", F.lit(read_[0])).withColumn(
        "completeness", F.when((F.col("completeness") == "partial") | (F.col("unsupported_files") > 0) | (F.col("stale_hits") > 0) | (F.size("warnings") > 0), "partial").otherwise("no_known_gaps")
    )
    tables = {**t, "relationships": edges, "document_index": index, "evidence": evidence, "diffs": diff.nested_diffs(blocks, index), "documents": documents, "coverage": totals, "tasks": tasks}
    if options.download:
        zips = documents.where("source is not null").select(F.col("source").alias("path"), "tdoc").where(F.lower("path").endswith(".zip"))
        tables["saved"] = office.save_members(_located(zips, options).where("place is not null"), options.download)
    return Result(tables, run.signature, stage)


cache_info = cache.cache_info
cache_clear = cache.cache_clear


def resolve(spark: SparkSession, hints: list[str], calendar: DataFrame, directories: DataFrame) -> DataFrame:
    """One row per hint, see operators.resolve.resolve_meetings."""
    return resolve_meetings(spark.createDataFrame(list(enumerate(hints)), "hint_id int, hint string"), calendar, directories)


def read_calendar(spark: SparkSession, pages: dict[str, str], options: Options = Options()) -> DataFrame:
    """Calendar of groups from their pages: group -> address or file of an HTML page with one row per meeting."""
    listed = spark.createDataFrame(list(pages.items()), "grp string, path string").withColumn("wg", group_code(F.upper("grp")))
    got = _located(listed.select("path", "wg"), options).where("place is not null").select("path", "place", "wg")
    rows = office.parse_paths(got.withColumn("path", F.concat("path", F.lit("#calendar.html"))), "place")
    return calendar_rows(rows.where("cells is not null").select("wg", F.regexp_replace("path", "#calendar.html$", "").alias("source"), "cells"))


def read_directories(spark: SparkSession, roots: dict[str, str], options: Options = Options()) -> DataFrame:
    """(wg, name, url) of the directories listed on a group's page: group -> address."""
    listed = spark.createDataFrame(list(roots.items()), "grp string, url string").withColumn("wg", group_code(F.upper("grp")))
    pages = fetch.page_reader(os.path.join(options.payloads(), "pages"), options.route, options.max_concurrency)(listed.select("url"))
    found = links.page_links(pages).where(F.col("link").endswith("/") & F.col("link").startswith(F.col("url"))).join(listed.select("url", "wg"), "url")
    return found.select("wg", F.regexp_extract("link", "([^/]+)/$", 1).alias("name"), F.col("link").alias("url")).distinct()


def cache_report(spark: SparkSession, folder: str) -> dict[str, int]:
    """Entries, files and bytes of a cache; zeros where there is none."""
    parsed = read_or_none(spark, folder)
    if parsed is None:
        return {"entries": 0, "files": 0, "bytes": 0}
    files = office.list_files(spark, folder).where(F.col("path").endswith(".parquet")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
    return {"entries": parsed.select("cache_key").distinct().count(), "files": files.files, "bytes": files.bytes}
