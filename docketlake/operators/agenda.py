"""Agenda tables: rows of cells to records, first record per document, sections carried on.

Row order is data: every input has a file and an ordinal, nothing depends on the order of
a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.ids import TDOC, found, matches, normalize_tdoc
from docketlake.functions.text import HEADERS, canonical_header, metadata_priority, role_hints
from docketlake.operators.ordered import carry_last


def agenda_records(rows: DataFrame, file: str = "file", ordinal: str = "ordinal", cells: str = "cells") -> DataFrame:
    """Records of table rows (file, ordinal, cells array<string>).

    A row with a document column and at least one more known column is a header; it holds
    for all later rows of its file until the next header. Of two columns of one name the
    later counts. A row is kept if its document cell holds a number. Rows before any
    header, null cells and short rows give no record or null fields.
    """
    names = F.transform(F.coalesce(cells, F.array().cast("array<string>")), canonical_header)
    known = F.filter(names, lambda n: n.isNotNull())
    # position of the last column of each name
    where = F.struct(*((F.size(names) - F.array_position(F.reverse(names), k) + 1).cast("int").alias(k) for k in HEADERS))
    has = F.struct(*(F.array_contains(known, k).alias(k) for k in HEADERS))
    header = F.array_contains(known, "tdoc") & (F.size(F.array_distinct(known)) >= 2)
    r = rows.select(F.col(file).alias("file"), F.col(ordinal).alias("ordinal"), F.col(cells).alias("cells"), header.alias("is_header"), where.alias("w"), has.alias("h"))
    r = carry_last(r.select("file", "ordinal", "cells", "is_header", F.struct("w", "h").alias("own")), ["file"], "ordinal", F.when(F.col("is_header"), F.col("own")), "held")
    r = r.select("file", "ordinal", "cells", "is_header", F.col("held.w").alias("w"), F.col("held.h").alias("h"))
    fields = {k: F.when(F.col(f"h.{k}"), F.trim(F.try_element_at("cells", F.col(f"w.{k}")))) for k in HEADERS}
    tdoc = found(F.coalesce(fields["tdoc"], F.lit("")), TDOC)
    return (
        r.where(~F.col("is_header") & F.col("w").isNotNull())
        .select(
            F.when(tdoc != "", normalize_tdoc(tdoc)).alias("tdoc"),
            fields["title"].alias("title"),
            fields["source"].alias("source_company"),
            fields["status"].alias("status"),
            fields["agenda"].alias("agenda"),
            fields["comments"].alias("comments"),
            fields["discussion"].alias("discussion"),
            F.col("file").alias("metadata_source"),
            F.concat(F.lit("row:"), "ordinal").alias("metadata_locator"),
            F.array_join("cells", " | ", "").alias("text"),
            "ordinal",
        )
        .where("tdoc is not null")
        .withColumn("role_hints", role_hints(F.col("title"), F.col("comments"), F.col("status")))
    )


def first_per_document(records: DataFrame, key: str = "tdoc", source: str = "metadata_source", ordinal: str = "ordinal") -> DataFrame:
    """The record of the best source (priority, name, ordinal) of every document; ties go to the least hash of the row.

    The pick is a map-side minimum, not a sort of a key's rows: a hot key costs a row per task.
    """
    rank = F.struct(metadata_priority(F.col(source)).alias("p"), F.col(source).alias("s"), F.col(ordinal).alias("o"), F.xxhash64(*records.columns).alias("j"))
    best = records.groupBy(key).agg(F.min_by(F.struct(*records.columns), rank).alias("r"))
    return best.select("r.*")


def best_sources(sources: DataFrame, group: str, source: str, most: int = 30) -> DataFrame:
    """Adds priority and chosen: per meeting the agenda page alone if there is one, else the first ``most`` by priority and name.

    What is not chosen stays as a row, so that a cut shows.
    """
    s = sources.withColumn("priority", metadata_priority(F.col(source)))
    w = Window.partitionBy(group)
    s = s.withColumn("least", F.min("priority").over(w)).withColumn("n", F.row_number().over(w.orderBy("priority", source)))
    return s.withColumn("chosen", F.when(F.col("least") == 0, F.col("priority") == 0).otherwise(F.col("n") <= most)).drop("least", "n")


def is_heading(text, style=None):
    """A heading style, or fewer than 160 characters that begin with a dotted number."""
    numbered = (F.length(text) < 160) & matches(text, r"^\d+(?:\.\d+)*\s+\S")
    return F.coalesce(numbered if style is None else numbered | F.lower(style).startswith("heading"), F.lit(False))


def carry_sections(rows: DataFrame, keys: list[str], ordinal: str, text: str, style: str | None = None) -> DataFrame:
    """Adds carried_section: the last heading at or before a row of the same file; null before the first."""
    head = is_heading(F.col(text), F.col(style) if style else None)
    return carry_last(rows, keys, ordinal, F.when(head, F.col(text)), "carried_section")
