"""The cache of parsed documents: a table by (cache_key, sha256, parser_version), and its care."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.session import checkpoint
from docketlake.sources import office
from docketlake.sources.routing import cache_key
from docketlake.streaming.resume import read_or_none

PARSER_VERSION = "1"
KEYS = ["cache_key", "sha256", "parser_version"]


def keyed(files: DataFrame, path: str = "path", content: str = "content", version: str = PARSER_VERSION) -> DataFrame:
    return files.withColumn("cache_key", cache_key(F.col(path))).withColumn("sha256", F.sha2(F.col(content), 256)).withColumn("parser_version", F.lit(version))


def unparsed(files: DataFrame, parsed: DataFrame | None) -> DataFrame:
    """Keyed files without a parsed entry; the query plays no part, so any later query may use an entry."""
    return files if parsed is None else files.join(parsed.select(*KEYS).distinct(), KEYS, "left_anti")


def cached_parse(paths: DataFrame, root: str, place: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows of all files, files with sha256, body_bytes and cache_state); only unknown contents are parsed, and added to the cache at root."""
    spark = paths.sparkSession
    files = office.hashed(paths, place).withColumn("cache_key", cache_key(F.col("path"))).withColumn("parser_version", F.lit(PARSER_VERSION))
    files = checkpoint(files)
    known = read_or_none(spark, root)
    new = checkpoint(unparsed(files, known).withColumn("new", F.lit(True)))
    office.parse_paths(new.select("path", place, *KEYS) if place != "path" else new.select("path", *KEYS), place).drop(*({place} - {"path"})).write.mode("append").partitionBy("parser_version").parquet(root)
    rows = spark.read.parquet(root).join(files.select(*KEYS).distinct(), KEYS, "left_semi")
    state = F.when(F.col("sha256").isNull(), "not_requested").when(F.col("new"), "miss").otherwise("parsed_hit")
    return rows, files.join(new.select(*KEYS, "new").distinct(), KEYS, "left").withColumn("cache_state", state).drop("new")


def cache_info(files: DataFrame) -> DataFrame:
    """One row: entries, files, bytes of cache files (cache_key, length)."""
    return files.agg(F.count_distinct("cache_key").alias("entries"), F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def cache_clear(root: str, confirm: bool = False) -> bool:
    """Deletes a local cache folder; refuses without confirmation."""
    if not confirm:
        raise ValueError("clearing the cache needs confirm=True")
    existed = Path(root).is_dir()
    if existed:
        shutil.rmtree(root)
    return existed


def fresh_or_stale(log: DataFrame) -> DataFrame:
    """Adds decision to conditional fetches (http_status, ok, cached_sha256, payload_sha256, refresh).

    not_modified (304), downloaded, stale (failed, and the kept payload still has its hash, no refresh asked), failed.
    """
    intact = F.col("cached_sha256").isNotNull() & (F.col("cached_sha256") == F.col("payload_sha256"))
    return log.withColumn(
        "decision",
        F.when((F.col("http_status") == 304) & intact, "not_modified")
        .when(F.col("ok"), "downloaded")
        .when(intact & ~F.coalesce("refresh", F.lit(False)), "stale")
        .otherwise("failed"),
    )
