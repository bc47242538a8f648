"""Computations along the order of a file, for files that may hold a third of all rows.

A file's rows are cut into buckets of ``BUCKET`` ordinals. What a bucket hands to its
neighbours is aggregated map-side to a row per bucket, passed along that short list, and
joined back, so no task sorts a whole hot file. Ties in the ordinal are broken by the columns
named, else by a hash of the row, so that no text is part of a sort key. Null keys form a
file of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def _bucketed(rows: DataFrame, ordinal: str, ties: tuple[str, ...] = ()) -> DataFrame:
    order = F.struct(F.col(ordinal), *(ties or (F.xxhash64(*rows.columns).alias("h"),)))
    return rows.withColumn("_bucket", F.floor(F.coalesce(F.col(ordinal), F.lit(0)) / BUCKET)).withColumn("_order", order)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in [*keys, "_bucket"]:
        cond = cond & left[k].eqNullSafe(right[f"_r{k}"])
    return cond


def carry_last(rows: DataFrame, keys: list[str], ordinal: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last non-null value at or before each row of its file."""
    columns = rows.columns
    r = _bucketed(rows.withColumn("_value", value), ordinal)
    last = r.groupBy(*keys, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_order"))).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    came = last.select(*(F.col(k).alias(f"_r{k}") for k in [*keys, "_bucket"]), F.last("_last", ignorenulls=True).over(along).alias("_came"))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_own", F.last("_value", ignorenulls=True).over(w))
    return r.join(came, _same(r, came, keys), "left").select(*columns, F.coalesce("_own", "_came").alias(name))


def near_marked(rows: DataFrame, keys: list[str], ordinal: str, marked: Column, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``: the row, or the one just before or after it in its file, is marked."""
    columns = rows.columns
    r = _bucketed(rows.withColumn("_m", F.coalesce(marked, F.lit(False))), ordinal, ties)
    ends = r.groupBy(*keys, "_bucket").agg(F.min_by("_m", "_order").alias("_first"), F.max_by("_m", "_order").alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    came = ends.select(
        *(F.col(k).alias(f"_r{k}") for k in [*keys, "_bucket"]), F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after")
    )
    w = Window.partitionBy(*keys, "_bucket").orderBy("_order")
    r = (
        r.withColumn("_near", F.max("_m").over(w.rowsBetween(-1, 1)))
        .withColumn("_is_first", F.lag("_m").over(w).isNull())
        .withColumn("_is_last", F.lead("_m").over(w).isNull())
    )
    r = r.join(came, _same(r, came, keys), "left")
    off = F.lit(False)
    near = F.col("_near") | (F.col("_is_first") & F.coalesce("_before", off)) | (F.col("_is_last") & F.coalesce("_after", off))
    return r.select(*columns, near.alias(name))
