"""Paragraph differences between versions of a document.

Only 64-bit hashes of paragraphs go to the matcher, in document order; locators and texts
are joined to the changed blocks afterwards. Pairs come from edges only.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIFFED = ("revision_of", "input_to", "merged_into")
KEY = ("inner_file", "ordinal", "locator")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            old, new = list(r.old), list(r.new)
            ops = difflib.SequenceMatcher(a=old, b=new, autojunk=False).get_opcodes()
            out += [(r.src, r.dst, r.type, n, op, i1, i2, j1, j2) for n, (op, i1, i2, j1, j2) in enumerate(o for o in ops if o[0] != "equal")]
        yield pd.DataFrame(out, columns=["src", "dst", "type", "block", "operation", "old_from", "old_to", "new_from", "new_to"])


def version_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, type) to compare: valid edges of the types that relate versions, each once."""
    return edges.where("classification = 'candidate'").where(F.col("type").isin(*DIFFED)).select("src", "dst", "type").where("src <> dst").distinct()


def _versions(index: DataFrame) -> DataFrame:
    """(tdoc, h): the paragraph hashes of every document in order; deleted rows do not take part, repeated rows count once."""
    rows = index.where("coalesce(change_state, '') <> 'deleted'").select("tdoc", *KEY, "paragraph_hash").where("tdoc is not null").distinct()
    return rows.groupBy("tdoc").agg(F.array_sort(F.collect_list(F.struct(*KEY, F.xxhash64("paragraph_hash").alias("h")))).alias("p")).select("tdoc", F.transform("p", lambda x: x["h"]).alias("h"))


def paragraph_diffs(edges: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst, type, block, operation, old_from, old_to, new_from, new_to): changed blocks, half-open positions from 0.

    Deleted rows do not take part, repeated rows count once. A pair with a side that has no
    paragraphs gives nothing; equal versions give no block.
    """
    texts = _versions(index)
    pairs = (
        version_pairs(edges)
        .join(texts.select(F.col("tdoc").alias("src"), F.col("h").alias("new")), "src")
        .join(texts.select(F.col("tdoc").alias("dst"), F.col("h").alias("old")), "dst")
        .where("old <> new")
    )
    schema = "src string, dst string, type string, block int, operation string, old_from int, old_to int, new_from int, new_to int"
    return pairs.select("src", "dst", "type", "old", "new").mapInPandas(_blocks, schema)


def patched(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst, type, at, h): the old version of every pair after its blocks are put in, paragraph by paragraph; h is the stored paragraph hash."""
    rows = index.where("coalesce(change_state, '') <> 'deleted'").select("tdoc", *KEY, "paragraph_hash").where("tdoc is not null").distinct()
    order = Window.partitionBy("tdoc").orderBy(*KEY, F.xxhash64("paragraph_hash"))
    numbered = rows.select("tdoc", (F.row_number().over(order) - 1).alias("at"), F.col("paragraph_hash").alias("h"))
    pairs = ["src", "dst", "type"]
    spans = blocks.groupBy(*pairs).agg(F.array_sort(F.collect_list(F.struct("block", "old_from", "old_to", "new_from", "new_to"))).alias("b"))
    old = spans.join(numbered.withColumnRenamed("tdoc", "dst"), "dst").where(~F.exists("b", lambda x: (F.col("at") >= x["old_from"]) & (F.col("at") < x["old_to"])))
    # a kept paragraph moves by what the blocks before it add
    shift = F.aggregate(F.filter("b", lambda x: x["old_to"] <= F.col("at")), F.lit(0), lambda s, x: s + (x["new_to"] - x["new_from"]) - (x["old_to"] - x["old_from"]))
    kept = old.select(*pairs, (F.col("at") + shift).alias("at"), "h")
    added = spans.select(*pairs, F.explode("b").alias("x")).where("x.new_to > x.new_from").select(*pairs, F.explode(F.sequence(F.col("x.new_from"), F.col("x.new_to") - 1)).alias("at"))
    return kept.unionByName(added.join(numbered.withColumnRenamed("tdoc", "src"), ["src", "at"]).select(*pairs, "at", "h"))


def nested_diffs(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst, type, changes array<struct<operation, baseline, candidate>>) with locators and texts."""
    rows = index.where("coalesce(change_state, '') <> 'deleted'").where("tdoc is not null").select("tdoc", *KEY, "paragraph_hash", "text").dropDuplicates(["tdoc", *KEY, "paragraph_hash"])
    order = Window.partitionBy("tdoc").orderBy(*KEY, F.xxhash64("paragraph_hash"))
    numbered = rows.withColumn("at", F.row_number().over(order) - 1).select("tdoc", "at", "locator", "text")
    ids = ["src", "dst", "type", "block"]

    def side(doc: str, lo: str, hi: str, name: str) -> DataFrame:
        wide = blocks.where(F.col(hi) > F.col(lo)).select(*ids, F.explode(F.sequence(F.col(lo), F.col(hi) - 1)).alias("at"))
        met = wide.join(numbered, (wide[doc] == numbered["tdoc"]) & (wide["at"] == numbered["at"])).select(*ids, numbered["at"], "locator", "text")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "locator", "text"))), lambda x: F.struct(x["locator"].alias("locator"), x["text"].alias("text")))
        return met.groupBy(*ids).agg(listed.alias(name))

    none = F.array().cast("array<struct<locator:string,text:string>>")
    full = (
        blocks.join(side("dst", "old_from", "old_to", "baseline"), ids, "left")
        .join(side("src", "new_from", "new_to", "candidate"), ids, "left")
        .withColumn("change", F.struct("block", "operation", F.coalesce("baseline", none).alias("baseline"), F.coalesce("candidate", none).alias("candidate")))
    )
    return full.groupBy("src", "dst", "type").agg(F.transform(F.array_sort(F.collect_list("change")), lambda c: c.dropFields("block")).alias("changes"))
