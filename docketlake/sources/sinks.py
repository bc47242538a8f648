"""Results as files: partitioned tables, and single small reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

MOST_REPORT_ROWS = 1_000_000


def write_rows(rows: DataFrame, path: str, form: str = "json") -> None:
    """One file per partition, written in parallel (JSON lines or parquet)."""
    rows.write.mode("overwrite").format(form).save(path)


def write_json(value, path: str) -> None:
    """A JSON file, replaced as a whole."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, default=str)
    os.replace(f.name, path)


def write_report(rows: DataFrame, path: str) -> int:
    """A small table as one JSON array; refuses more than MOST_REPORT_ROWS rows instead of cutting."""
    got = rows.limit(MOST_REPORT_ROWS + 1).toJSON().collect()
    if len(got) > MOST_REPORT_ROWS:
        raise ValueError("too large for one file; use write_rows")
    write_json([json.loads(x) for x in got], path)
    return len(got)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are not JSON are left out, a missing path is an empty table."""
    if not os.path.exists(path) and "://" not in path:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")
