"""Exported tables as DDL, and the words their columns may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_IDENTIFIERS = "struct<tdocs:array<string>,key_issues:array<string>,solution_variants:array<string>,solutions:array<string>>"
_SIDE = "array<struct<locator:string,text:string>>"
AGENDA_RECORD = (
    "tdoc string, title string, source_company string, status string, agenda string, comments string, discussion string, "
    "role_hints array<string>, metadata_source string, metadata_locator string"
)
DOCUMENT_INDEX = (
    "tdoc string, source string, inner_file string, ordinal int, kind string, locator string, text string, paragraph_hash string, "
    f"change_state string, section string, identifiers {_IDENTIFIERS}"
)
EXPORTS = {
    "agenda_records": AGENDA_RECORD,
    "candidates": f"{AGENDA_RECORD}, scope_basis string, metadata_missing boolean",
    "document_index": DOCUMENT_INDEX,
    "evidence": f"{DOCUMENT_INDEX}, duplicate_of string",
    "relationships": "`from` string, `to` string, type string, classification string, confidence string, source string, locator string, evidence string, warning string",
    "diffs": f"`from` string, `to` string, relation_type string, status string, changes array<struct<operation:string,baseline:{_SIDE},candidate:{_SIDE}>>",
    "documents": "tdoc string, state string, source string, priority int, parsed_files bigint, unsupported_files bigint, files array<struct<inner_file:string,state:string>>",
    "attempts": "attempt_no bigint, requested string, effective string, kind string, ok boolean, http_status int, error string",
}
RENAMED = {
    "relationships": {"from": "src", "to": "dst", "evidence": "excerpt"},
    "diffs": {"from": "src", "to": "dst", "relation_type": "type"},
}

DOCUMENT_STATES = ("metadata_only", "missing", "fetch_error", "processed", "cached_processed", "local_processed")
TRANSFER_STATES = ("local", "downloaded", "cached", "resumed_complete", "fetch_error")
CACHE_STATES = ("not_requested", "miss", "hit", "parsed_hit")
CHANGE_STATES = ("current", "inserted", "deleted")
RELATION_TYPES = ("revision_of", "merged_into", "approved_version_of", "input_to", "responds_to")
CLASSIFICATIONS = ("candidate", "invalidated")
SCOPE_BASES = ("explicit_tdoc", "direct_query", "explicit_relationship")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of an export in their order and types; those that are absent are null, others are left out."""
    names = RENAMED.get(name, {})
    out = []
    for f in StructType.fromDDL(EXPORTS[name]).fields:
        own = names.get(f.name, f.name)
        value = F.col(own) if own in df.columns else F.lit("available") if (name, f.name) == ("diffs", "status") else F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)
