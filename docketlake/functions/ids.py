"""Patterns of identifiers and relations, and identifier functions over columns.

The patterns are the matching language of the data (fixed values), in Java syntax; FLAGS
makes them Unicode-aware and caseless. They run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iU)"
# The matching language of identifiers.
NUMBER = r"[A-Z]\d[-–]?\d{7}"
TDOC = rf"\b({NUMBER})\b"
KEY_ISSUE = r"\bKI\s*#?\s*(\d+(?:\.\d+)*)\b"
SOLUTION_VARIANT = r"\b(?:Solution\s+Variant|SV)\s*#?\s*(\d+(?:\.\d+)*)\b"
SOLUTION = r"\bSolution\s*#?\s*(\d+(?:\.\d+)*)\b"
# Relations stated in the text of a document, (type, pattern).
BODY_RELATIONS = (
    ("merged_into", rf"\b(?:merge(?:d)?|merging)\s+(?:this\s+)?(?:proposal\s+)?into\s+({NUMBER})"),
    ("revision_of", rf"\b(?:revision|revised\s+version)\s+of\s+({NUMBER})"),
    ("revision_of", rf"\b({NUMBER})\s+(?:was\s+)?revised\s+(?:as|to)\b"),
    ("input_to", rf"\b(?:input|contribution)\s+to\s+({NUMBER})"),
    ("responds_to", rf"\b(?:response|reply|comment(?:s|ing)?)\s+(?:to|on)\s+({NUMBER})"),
)
# Relations stated in an agenda row.
AGENDA_MERGE_CLAUSE = r"\bmerge(?:d)?\s+into\s+(.*?)(?:Not\s+Handled|$)"
AGENDA_REVISION_OF = rf"\brevision\s+of\s+({NUMBER})"
AGENDA_REVISED_TO = rf"\brevised.{{0,40}}\bto\s+({NUMBER})"
AGENDA_BASELINE_INPUTS = r"\bbaseline\b.*?\bincl\.?\s+(.*?)(?:\brevised\b|$)"
INVALID_ASSIGNMENT = r"\b(?:incorrect|wrong)\b.{0,80}\b(?:merge|assignment|agenda)"


def found_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(group))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, FLAGS + pattern, group)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def normalize_tdoc(value: Column) -> Column:
    """Letters and digits raised, dash after the second; a value with fewer than nine of them is only trimmed and raised."""
    compact = F.upper(F.regexp_replace(value, r"[^A-Za-z0-9]", ""))
    return F.when(F.length(compact) >= 9, F.concat(F.substring(compact, 1, 2), F.lit("-"), F.substr(compact, F.lit(3)))).otherwise(
        F.replace(F.upper(F.trim(value)), F.lit("–"), F.lit("-"))
    )


def valid_tdoc(value: Column) -> Column:
    return value.rlike(r"^[A-Z]\d-\d{7}$")


def identifiers(text: Column) -> Column:
    """struct of four lists, each with its different values in order of first occurrence; null text gives empty lists."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(
        F.array_distinct(F.transform(found_all(t, TDOC), normalize_tdoc)).alias("tdocs"),
        F.array_distinct(found_all(t, KEY_ISSUE)).alias("key_issues"),
        F.array_distinct(found_all(t, SOLUTION_VARIANT)).alias("solution_variants"),
        F.array_distinct(found_all(t, SOLUTION)).alias("solutions"),
    )
