"""Folders of test tables that are empty, or hold nulls, empty and very long texts, repeated rows and extra columns."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "agenda": "row_id bigint, meeting string, tdoc string, title string, source string, status string, agenda_item string, comments string, discussion string, received_at timestamp, deleted_at timestamp, metadata_source string, metadata_locator string",
    "manifest": "entry_id bigint, tdoc string, state string, source string, source_kind string, fallback_reason string, priority int, cache_state string, etag string, sha256 string, content_length bigint, body_bytes bigint, retry_count int, download_seconds double, listed_at timestamp, removed_at timestamp, error string",
    "relationships": "rel_id bigint, from_tdoc string, to_tdoc string, relation_type string, classification string, confidence string, source string, locator string, excerpt string, warning string, seen_at timestamp",
    "document_index": "para_id bigint, tdoc string, source string, inner_file string, ordinal int, kind string, locator string, text string, paragraph_hash string, change_state string, section string, identifiers struct<tdocs:array<string>,key_issues:array<string>,solution_variants:array<string>,solutions:array<string>>, parsed_at timestamp",
    "evidence": "evidence_id bigint, tdoc string, source string, inner_file string, ordinal int, locator string, text string, paragraph_hash string, change_state string, section string, duplicate_of string, matched_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, tdoc string, doc_kind string, created_at timestamp",
    "companies": "company_id bigint, name string, kind string, country string, aliases array<string>",
    "meetings": "meeting string, wg string, meeting_no string, suffix string, start_date date, end_date date, meeting_kind string, source string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}
CLASHING = ("id", "class", "block", "node", "root", "word", "value", "k", "th", "text_", "n", "record_id", "pos")


def write(spark, folder: str, odd: bool) -> str:
    """Empty tables, or with ``odd`` 8 rows each: all null, empty, blank, very long, twice the same."""
    texts = [None, "", " \t​", "x" * 20_000, "word " * 3_000, "S2-2605845", "S2-2605845", "Ａ, \"b"]
    for name, ddl in TABLES.items():
        schema = StructType.fromDDL(ddl)
        if not odd:
            df = spark.createDataFrame([], schema)
        else:
            rows = []
            for i, t in enumerate(texts):
                i = min(i, 6) if t == "S2-2605845" else i
                i = 5 if t == "S2-2605845" else i
                rows.append(tuple(i if f.dataType.typeName() in ("long", "integer") else t if f.dataType.typeName() == "string" else None for f in schema.fields))
            df = spark.createDataFrame(rows, schema)
            first = schema.fields[0]
            if first.dataType.typeName() == "string":
                df = df.where(F.col(first.name).isNotNull())
        for c in CLASHING:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder
