"""Typed edges between documents: from agenda rows, from bodies, invalidated ones kept apart.

An edge is a candidate only; nothing here concludes that a document was adopted.
Null texts state nothing; edges of a document to itself are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.ids import (
    AGENDA_BASELINE_INPUTS,
    AGENDA_MERGE_CLAUSE,
    AGENDA_REVISED_TO,
    AGENDA_REVISION_OF,
    BODY_RELATIONS,
    INVALID_ASSIGNMENT,
    TDOC,
    found,
    found_all,
    matches,
    normalize_tdoc,
)
from docketlake.functions.text import collapse

INVALID_WARNING = "An incorrect agenda or merge assignment is noted in the meeting's discussion."
INVALIDATED_TYPES = ("merged_into", "input_to")


def _said(*parts: str):
    return F.trim(F.concat_ws(" ", *(F.coalesce(F.col(p), F.lit("")) for p in parts)))


def agenda_edges(records: DataFrame) -> DataFrame:
    """(src, dst, type, source, locator, excerpt) of agenda records (tdoc, comments, discussion, status, metadata_*)."""
    said = _said("comments", "discussion", "status")
    r = records.select(normalize_tdoc(F.col("tdoc")).alias("own"), "metadata_source", "metadata_locator", said.alias("said")).where("own is not null")

    def out(targets, kind: str, reverse: bool = False):
        ends = ("other", "own") if reverse else ("own", "other")
        return F.transform(
            targets,
            lambda t: F.struct(
                (normalize_tdoc(t) if ends[0] == "other" else F.col("own")).alias("src"),
                (normalize_tdoc(t) if ends[1] == "other" else F.col("own")).alias("dst"),
                F.lit(kind).alias("type"),
            ),
        )

    s = F.col("said")
    edges = F.concat(
        out(found_all(found(s, AGENDA_MERGE_CLAUSE), TDOC), "merged_into"),
        out(found_all(s, AGENDA_REVISION_OF), "revision_of"),
        out(found_all(s, AGENDA_REVISED_TO), "revision_of", reverse=True),
        out(found_all(found(s, AGENDA_BASELINE_INPUTS), TDOC), "input_to", reverse=True),
    )
    return (
        r.select(F.explode(edges).alias("e"), F.col("metadata_source").alias("source"), F.col("metadata_locator").alias("locator"), F.col("said").alias("excerpt"))
        .select("e.*", "source", "locator", "excerpt")
        .where("src <> dst")
    )


def invalid_sources(records: DataFrame) -> DataFrame:
    """(tdoc) of records whose comments or discussion call an assignment wrong."""
    said = F.concat_ws(" ", F.coalesce("comments", F.lit("")), F.coalesce("discussion", F.lit("")))
    return records.where(matches(said, INVALID_ASSIGNMENT)).select(normalize_tdoc(F.col("tdoc")).alias("tdoc")).where("tdoc is not null").distinct()


def classify(edges: DataFrame, invalid: DataFrame) -> DataFrame:
    """Adds classification, confidence and warning: merges and inputs of invalid sources are invalidated, revisions never."""
    bad = invalid.select(F.col("tdoc").alias("src"), F.lit(True).alias("bad"))
    hit = F.coalesce("bad", F.lit(False)) & F.col("type").isin(*INVALIDATED_TYPES)
    return (
        edges.join(bad, "src", "left")
        .withColumn("classification", F.when(hit, "invalidated").otherwise("candidate"))
        .withColumn("confidence", F.lit("high"))
        .withColumn("warning", F.when(hit, F.lit(INVALID_WARNING)))
        .drop("bad")
    )


def body_edges(paragraphs: DataFrame, own: str = "tdoc", text: str = "text", locator: str = "locator", source: str = "source") -> DataFrame:
    """(src, dst, type, source, locator, excerpt): every relation a paragraph states about its own document."""
    p = paragraphs.select(F.col(own).alias("src"), F.col(text).alias("text"), F.col(locator).alias("locator"), F.col(source).alias("source"))
    p = p.where(matches(F.col("text"), "|".join(x for _, x in BODY_RELATIONS)))
    parts = [
        p.select(
            "src",
            "source",
            "locator",
            "text",
            F.lit(kind).alias("type"),
            F.arrays_zip(found_all(F.col("text"), pattern, 1).alias("hit"), found_all(F.col("text"), pattern, 0).alias("whole")).alias("all"),
        )
        for kind, pattern in BODY_RELATIONS
    ]
    # the matches of a pattern come in order, each begins behind the one before it
    places = F.expr(
        "aggregate(all, cast(array() as array<int>), (was, m) -> concat(was, array("
        "locate(m.whole, text, if(size(was) = 0, 1, element_at(was, -1) + length(all[size(was) - 1].whole))))))"
    )
    e = reduce(DataFrame.unionByName, parts).where("size(all) > 0").withColumn("places", places)
    e = e.select("src", "source", "locator", "text", "type", F.explode(F.arrays_zip("all", "places")).alias("m"))
    e = e.select("src", "source", "locator", "text", "type", "m.all.hit", "m.all.whole", F.col("m.places").alias("start"))
    start = F.col("start")
    cut = F.greatest(F.lit(1), start - 100)
    return (
        e.select(
            "src",
            normalize_tdoc(F.col("hit")).alias("dst"),
            "type",
            "source",
            "locator",
            collapse(F.substr("text", cut, start + F.length("whole") + 100 - cut)).alias("excerpt"),
        )
        .where("src <> dst")
    )


def unique_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type, source, locator): the one with the greatest excerpt, a defined winner."""
    keys = ["src", "dst", "type", "source", "locator"]
    rest = [c for c in edges.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rest))))
    return edges.groupBy(*keys).agg(pick.alias("r")).select(*keys, "r.*")


def edges_touching(edges: DataFrame, documents: DataFrame, key: str = "tdoc") -> DataFrame:
    """Edges with an end among the documents: two semi-joins, no OR join."""
    d = documents.select(F.col(key).alias("d")).distinct()
    return edges.join(d, edges["src"] == d["d"], "left_semi").union(edges.join(d, edges["dst"] == d["d"], "left_semi")).distinct()


def one_hop(edges: DataFrame, documents: DataFrame, key: str = "tdoc") -> DataFrame:
    """(tdoc): the documents and both ends of the valid edges that touch them."""
    valid = edges_touching(edges.where("classification = 'candidate'"), documents, key)
    ends = valid.select(F.explode(F.array("src", "dst")).alias("tdoc"))
    return documents.select(F.col(key).alias("tdoc")).union(ends).where("tdoc is not null").distinct()


def with_previous(edges: DataFrame, previous: DataFrame) -> DataFrame:
    """Edges together with the valid ones of an earlier run, each once; what only one side has is null on the other."""
    return unique_edges(edges.unionByName(previous.where("classification = 'candidate'"), allowMissingColumns=True))
