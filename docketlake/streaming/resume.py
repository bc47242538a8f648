"""Resuming a run: its signature, what is left to do, and idempotent writes per micro-batch."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


def run_signature(meetings: list[str], query: str, companies: list[str], tdocs: list[str]) -> str:
    """SHA-256 of what a run asks for; the stage is not part of it, so core work serves the complete run."""
    asked = {"companies": sorted(companies), "included_tdocs": sorted(tdocs), "meetings": sorted(meetings), "query": query}
    return hashlib.sha256(json.dumps(asked, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def signature_column(*parts: str):
    return F.sha2(F.to_json(F.struct(*sorted(parts))), 256)


def remaining(tasks: DataFrame, done: DataFrame, key: str = "tdoc") -> DataFrame:
    """Tasks whose key is not done yet; null keys stay."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def read_or_none(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def resumable(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "tdoc") -> StreamingQuery:
    """Processes what is new in a file stream and appends it under out/batch=N.

    A batch overwrites its own folder only, so a repeated batch after a lost driver leaves
    the same rows; keys done in earlier batches are taken out by an anti-join. Data is
    committed before the stream's offsets.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = read_or_none(batch.sparkSession, out)
        todo = batch.dropDuplicates([key])
        if done is not None:
            todo = remaining(todo, done.where(F.col("batch") != number), key)
        process(todo).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
