"""The adaptive window as a batch fold and as a stream, and resuming a file stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docketlake.streaming import resume, window


def plain_fold(flags, most):
    w, run = most, 0
    for bad in flags:
        if bad:
            w, run = max(1, w // 2), 0
        else:
            run += 1
            if run >= window.STREAK and w < most:
                w, run = w + 1, 0
            run = min(run, window.STREAK - 1)
    return w, run


def log(rng, keys, n):
    start = dt.datetime(2026, 1, 1)
    return [(rng.choice(keys), i, start + dt.timedelta(hours=i), rng.random() < 0.06) for i in range(n)]


def test_window_fold_over_days(spark):
    data = log(random.Random(1), ["a", "b", None], 900)
    df = spark.createDataFrame(data, "k string, n int, ts timestamp, bad boolean")
    got = {r.key: (r.final_window, r.attempts, r.pressure_events) for r in window.adaptive_window(df, "k", "ts", ["ts", "n"], F.col("bad"), most=6).collect()}
    for k in ("a", "b"):
        flags = [b for key, _, _, b in data if key == k]
        assert got[k] == (plain_fold(flags, 6)[0], len(flags), sum(flags))
    assert set(got) == {"a", "b"}
    assert window.adaptive_window(df.where("false"), "k", "ts", ["n"], F.col("bad")).count() == 0


def test_window_stream_over_batches(spark, tmp_path):
    data = log(random.Random(2), ["a"], 300)
    schema = "k string, n string, bad boolean"
    last = {}
    for i in range(3):
        part = [(k, f"{n:05}", b) for k, n, _, b in data[i * 100 : i * 100 + 100]]
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        q = window.stream_window(stream, "k", "n", "bad").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: last.update({r.key: r for r in df.collect()})).trigger(availableNow=True).start()
        q.awaitTermination()
        got = last["a"]
        assert (got.window, got.successes) == plain_fold([b for _, _, _, b in data[: i * 100 + 100]], 4)


def test_resume_is_idempotent(spark, tmp_path):
    out, cp, schema = str(tmp_path / "out"), str(tmp_path / "cp"), "tdoc string, v int"
    seen = []

    def process(df):
        seen.append(df.count())
        return df

    for i, part in enumerate(([("a", 1), ("b", 1), ("a", 1)], [("b", 2), ("c", 2)], [])):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        resume.resumable(stream, process, out, cp).awaitTermination()
    assert sorted((r.tdoc, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 2)]
    assert seen == [2, 1]


def test_signature_ignores_order_and_stage():
    a = resume.run_signature(["m1", "m2"], "q", ["x"], ["S2-2600001"])
    assert a == resume.run_signature(["m2", "m1"], "q", ["x"], ["S2-2600001"]) != resume.run_signature(["m1"], "q", ["x"], [])
