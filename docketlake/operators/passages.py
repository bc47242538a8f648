"""Passages of documents: which matter to a query, with their neighbours, each text once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.ids import BODY_RELATIONS, matches
from docketlake.functions.text import fold, text_hash
from docketlake.operators.ordered import near_marked
from docketlake.operators.scope import Query

# Words in a section's name that make it matter.
KEY_SECTIONS = ("proposal", "discussion", "conclusion", "observation", "summary")


def relevant(query: Query, text: str = "text", section: str = "section", mode: str = "topic") -> Column:
    """A term of the query, a stated relation, or a section that matters.

    mode ``topic`` leaves out words of identifier kinds and numbers, ``all_terms`` takes every term.
    """
    t, s = fold(F.coalesce(F.col(text), F.lit(""))), fold(F.coalesce(F.col(section), F.lit("")))
    out = matches(F.coalesce(F.col(text), F.lit("")), "|".join(p for _, p in BODY_RELATIONS))
    for term in query.topic_terms if mode == "topic" else query.terms:
        out = out | t.contains(term)
    for word in KEY_SECTIONS:
        out = out | s.contains(word)
    return out


def select_passages(index: DataFrame, query: Query, mode: str = "topic", keys: tuple[str, ...] = ("tdoc", "source", "inner_file"), ordinal: str = "ordinal", ties: tuple[str, ...] = ()) -> DataFrame:
    """Relevant rows of a paragraph index and the one before and after each in its file."""
    return near_marked(index, list(keys), ordinal, relevant(query, mode=mode), "_chosen", ties).where("_chosen").drop("_chosen")


def mark_duplicates(rows: DataFrame, order: list[str], key: Column, text: str = "text", digest: str = "paragraph_hash") -> DataFrame:
    """Fills empty hashes and adds duplicate_of: the key of the first row, by ``order``, with the same hash; null for it.

    The first row of a hash is a map-side minimum joined back, so a text that a third of
    all rows share is no sort of one task. Null texts hash as empty text.
    """
    filled = rows.drop("duplicate_of").withColumn(digest, F.coalesce(F.nullif(F.col(digest), F.lit("")), text_hash(F.coalesce(F.col(text), F.lit("")))))
    filled = filled.withColumn("_key", key).withColumn("_order", F.struct(*order, "_key"))
    first = filled.groupBy(F.col(digest).alias("_h")).agg(F.min_by("_key", "_order").alias("_first"), F.min("_order").alias("_least"))
    joined = filled.join(first, F.col(digest) == F.col("_h"))
    return joined.withColumn("duplicate_of", F.when(F.col("_order") > F.col("_least"), F.col("_first"))).drop("_h", "_first", "_least", "_order", "_key")
