"""Filling fixed-capacity containers with items of varying length.

Best-two-fit: a container is filled greedily with the largest item that still fits; then
its smallest item is exchanged for the two unpacked items that fill the widened gap best,
as long as that leaves less unused space, and filling goes on. Only items longer than a
container are split. Items are hashed into shards of about ``SHARD_ITEMS``, packed side
by side; a shard leaves at most its last containers unfilled, whatever the input size,
and only (id, piece, size) is shuffled.

Defined results: an item of size 0 (null, empty text) lies in the shard's first
container; repeated rows are one item each; an empty table gives no container.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.tokens import VOCABULARY, count_tokens
from docketlake.session import table

CAPACITY = 2048
SHARD_ITEMS = 10_000


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each size; every size must be at most the capacity."""
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, s in enumerate(sizes):
        by_size[s].append(i)
    here = there = 0  # bit s / bit capacity - s: an item of size s is left
    for s in range(1, capacity + 1):
        if by_size[s]:
            here |= 1 << s
            there |= 1 << (capacity - s)
    out = [0] * len(sizes)

    def take(s: int) -> int:
        nonlocal here, there
        item = by_size[s].pop()
        if not by_size[s]:
            here &= ~(1 << s)
            there &= ~(1 << (capacity - s))
        return item

    def give(s: int, item: int) -> None:
        nonlocal here, there
        by_size[s].append(item)
        here |= 1 << s
        there |= 1 << (capacity - s)

    def best_pair(gap: int, above: int) -> tuple[int, int] | None:
        """Two sizes left with the largest sum in (above, gap]."""
        for total in range(gap, max(above, 1), -1):
            both = here & (there >> (capacity - total)) & ((1 << total) - 1)
            while both:
                a = both.bit_length() - 1
                b = total - a
                if a != b or len(by_size[a]) > 1:
                    return a, b
                both &= ~(1 << a)
        return None

    number = 0
    while here:
        bin_, gap = [], capacity
        while True:
            while fits := here & ((1 << (gap + 1)) - 1):
                s = fits.bit_length() - 1
                bin_.append((s, take(s)))
                gap -= s
            if not gap or not here:
                break
            small = min(bin_)
            pair = best_pair(gap + small[0], small[0])
            if pair is None:
                break
            bin_.remove(small)
            give(*small)
            bin_ += [(s, take(s)) for s in pair]
            gap += small[0] - sum(pair)
        for _, item in bin_:
            out[item] = number
        number += 1
    return out


def pack(items: DataFrame, item_id: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, rows: int | None = None) -> DataFrame:
    """(item_id, piece, start, size, container) for items with a size; a null size counts as 0."""
    n = items.count() if rows is None else rows
    shards = max(1, -(-n // shard_items))
    s = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0))
    pieces = items.select(F.col(item_id).alias("item_id"), s.alias("total")).select(
        "item_id", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity).cast("int") - 1, F.lit(0)))).alias("piece")
    )
    pieces = pieces.select(
        "item_id",
        "piece",
        (F.col("piece").cast("bigint") * capacity).alias("start"),
        F.least(F.col("total") - F.col("piece").cast("bigint") * capacity, F.lit(capacity)).cast("int").alias("size"),
        F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)).cast("int").alias("shard"),
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "piece"], ignore_index=True)  # the same result in a repeated task
        at = best_two_fit(pdf["size"].tolist(), capacity)
        return pdf.assign(container=pd.Series(at, dtype="int64") + pdf["shard"].astype("int64") * 2**32)[["item_id", "piece", "start", "size", "container"]]

    kind = pieces.schema["item_id"].dataType.simpleString()
    return pieces.groupBy("shard").applyInPandas(fill, f"item_id {kind}, piece int, start bigint, size int, container bigint")


def p9_pack(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = count_tokens(docs, "doc_id", "text", VOCABULARY)
    return pack(sizes, "doc_id", "tokens", rows=docs.count()).withColumnRenamed("item_id", "doc_id")


def p9_audit(spark, sf_dir: str) -> DataFrame:
    """One row (none without documents): documents packed, and what must not be: containers beyond the capacity, pieces out of place, texts split without need, more than one per cent of containers beyond the least number."""
    packed = p9_pack(spark, sf_dir)
    docs = packed.groupBy("doc_id").agg(
        F.count("*").alias("pieces"), F.sum("size").alias("total"), F.max("piece").alias("last"),
        F.sum((F.col("start") != F.col("piece").cast("bigint") * CAPACITY).cast("int")).alias("moved"), F.sum(((F.col("size") < CAPACITY) & (F.col("piece") == 0)).cast("int")).alias("short_first"),
    )
    of_docs = docs.agg(
        F.count("*").alias("documents"), F.count_if((F.col("moved") > 0) | (F.col("pieces") != F.col("last") + 1)).alias("misplaced"),
        F.count_if((F.col("pieces") > 1) & ((F.col("total") <= CAPACITY) | (F.col("short_first") > 0))).alias("split_without_need"), F.sum("total").alias("tokens"),
    )
    bins = packed.groupBy("container").agg(F.sum("size").alias("used")).agg(F.count("*").alias("containers"), F.count_if(F.col("used") > CAPACITY).alias("overfull"))
    both = of_docs.withColumn("_one", F.lit(1)).join(bins.withColumn("_one", F.lit(1)), "_one")  # one row each
    least = F.ceil(F.col("tokens") / CAPACITY)
    return both.where("documents > 0").select("documents", "misplaced", "split_without_need", "overfull", (F.col("containers") <= F.ceil(least * 1.01) + 1).alias("tight"))
