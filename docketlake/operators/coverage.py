"""What was checked, failed or is missing: roll-ups of a run's documents, and the warnings they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROCESSED = ("processed", "cached_processed", "local_processed")


def coverage(documents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters over documents (state, body_bytes, retry_count, cache_state, download_seconds, fallback_reason); nulls count as 0."""
    n = F.count("*")
    hits = F.count_if(F.col("cache_state").isin("hit", "parsed_hit"))
    return documents.groupBy(*(by or [])).agg(
        n.alias("documents"),
        F.count_if(F.col("state").isin(*PROCESSED)).alias("processed"),
        F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state") == "fetch_error").alias("failed"),
        F.coalesce(F.sum("body_bytes"), F.lit(0)).alias("total_body_bytes"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retry_count"),
        hits.alias("cache_hits"),
        F.count_if(F.col("cache_state") == "parsed_hit").alias("parsed_cache_hits"),
        F.coalesce(F.try_divide(hits * 1000, n).cast("bigint"), F.lit(0)).alias("cache_hit_permille"),
        F.count_if(F.col("fallback_reason").isNotNull()).alias("source_fallbacks"),
        F.when(F.count_if(F.col("state").isin("missing", "fetch_error") | F.coalesce(F.col("stale") if "stale" in documents.columns else F.lit(False), F.lit(False))) > 0, "partial").otherwise("no_known_gaps").alias("completeness"),
    )


def preview_counts(scoped: DataFrame, records: DataFrame, hits: DataFrame, query: str, explicit: tuple[str, ...] = (), blocked: bool = False, failures: int = 0) -> DataFrame:
    """One row: agenda records, direct candidates, candidates, those of the meeting and those known by a relation only, and warnings about the scope."""
    one = F.lit(1).alias("_one")
    s = scoped.agg(F.count("*").alias("candidates"), F.count_if(~F.col("metadata_missing")).alias("current_candidates"), F.count_if("metadata_missing").alias("historical_candidates")).withColumn("_one", one)
    known = F.count_if(F.col("tdoc").isin(*explicit)) if explicit else F.lit(0).cast("bigint")
    r = records.select("tdoc").distinct().agg(F.count("*").alias("agenda_records"), known.alias("_known")).withColumn("_one", one)
    h = hits.select("tdoc").distinct().agg(F.count("*").alias("direct_candidates")).withColumn("_one", one)
    c = F.col
    said = F.array_compact(
        F.array(
            F.when(F.lit(blocked), "A meeting is ambiguous or unresolved; no bodies are collected."),
            F.when((c("agenda_records") > 0) & (c("direct_candidates") == c("agenda_records")) & F.lit(bool(query)), "The query selects every agenda record; look at its words and identifiers."),
            F.when(c("agenda_records") == 0, "No agenda record was read; the scope may have gaps."),
            F.when(c("_known") < len(set(explicit)), "Some documents asked for are in no agenda that was read."),
            F.when(F.lit(failures > 0), "Some sources could not be read; coverage has gaps."),
        )
    )
    return s.join(r, "_one").join(h, "_one").withColumn("warnings", said).drop("_one", "_known")  # one row each


def warnings(counts: DataFrame) -> DataFrame:
    """Adds warnings: a message per gap that the counters show."""
    c = F.col
    return counts.withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(c("documents") == 0, "No document is in scope."),
                F.when(c("missing") > 0, F.concat(c("missing").cast("string"), F.lit(" documents have no file."))),
                F.when(c("failed") > 0, F.concat(c("failed").cast("string"), F.lit(" documents could not be fetched."))),
                F.when(c("source_fallbacks") > 0, F.concat(c("source_fallbacks").cast("string"), F.lit(" documents came from another source."))),
                F.when(c("documents") > c("processed") + c("missing") + c("failed"), "Some documents were listed but not read."),
            )
        ),
    )
