"""Long exact spans shared between records, by seed and extend.

Seeds: every text is winnowed (least hash of ``GRAM``-grams in each window of ``WINDOW``),
so that two texts with a common span of ``GRAM + WINDOW - 1`` characters hold the same
anchor at the same place of it. Texts are joined on the anchors that more than one of them
holds. Extension: an anchor's context is the text on both sides of it, as far as a span of
the least length around it can reach. Equal contexts of an anchor meet map-side and stand
for one another; different ones are extended both ways, character by character, against
each other, and a match of ``least`` characters or more is kept. Kept matches that overlap
or touch in a text are its maximal repeats. Records of one stored text share everything.

No group is unbounded: an anchor with more than ``CONTEXTS`` different contexts (a line of
boilerplate before different texts) is not compared pair by pair; there the spans of
exactly the least length around it are counted by their text, a row per span, which gives
the same maximal matches. Texts are told apart by the least id that holds them.

Defined results: null texts and texts shorter than ``least`` share nothing; repeated rows
of one id are one record; very long texts are handled whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.session import checkpoint, table

LEAST = 120
GRAM = 60
WINDOW = 61
CONTEXTS = 64
FILTER_BITS = 1 << 24
_BASE = 0x9E3779B97F4A7C15
_NO_HASH = np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(size, _BASE, np.uint64)).astype(np.uint64)
    down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)).astype(np.uint64)
    return up, down


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(text: str, k: int = GRAM) -> np.ndarray:
    """A hash for every stretch of k characters."""
    code = _codes(text).astype(np.uint64)
    n = len(code) - k + 1
    if n <= 0:
        return _NO_HASH
    up, down = _powers(1 << max(12, len(code).bit_length()))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_mix(code + np.uint64(77)) * up[: len(code)], out=sums[1:])
    return _mix((sums[k:] - sums[:n]) * down[:n])


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed grams: the first of the least in every window."""
    grams = gram_hashes(text)
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64), _NO_HASH
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    return at, grams[at]


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, tid) to (anchor, tid), the different anchors of each text."""
    for batch in batches:
        found, owner = [_NO_HASH], [np.zeros(0, np.int64)]
        for t, tid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a = np.unique(anchors(t)[1])
            found.append(a)
            owner.append(np.full(len(a), tid, np.int64))
        yield pa.RecordBatch.from_arrays([_ints(np.concatenate(found)), pa.array(np.concatenate(owner))], ["anchor", "tid"])


def anchor_filter(anchors_: DataFrame) -> np.ndarray:
    """A bit for each value of an anchor's last bits, FILTER_BITS bits whatever the input: what it lets pass still meets an exact join."""
    bits = np.zeros(FILTER_BITS, np.bool_)
    bits[anchors_.select(F.col("anchor").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def _contexts(reach: int, passes):
    """(text, tid) to (anchor, tid, at, off, around): the place of each anchor that the filter lets pass, and its text with ``reach`` characters on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passes.value
        for batch in batches:
            found, owner, places, offs, around = [_NO_HASH], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for t, tid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, hashes = anchors(t)
                low = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                good = (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(np.bool_)
                at = at[good]
                found.append(hashes[good])
                owner.append(np.full(len(at), tid, np.int64))
                places.append(at)
                offs.append(np.minimum(at, reach))
                around += [t[max(0, p - reach) : p + GRAM + reach] for p in at.tolist()]
            columns = [_ints(np.concatenate(found)), *(pa.array(np.concatenate(c)) for c in (owner, places, offs)), pa.array(around, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "tid", "at", "off", "around"])

    return run


def extend(around: list[str], off: list[int], lo: list[int], hi: list[int], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context of one anchor, how far it is matched to the left and to the right by contexts of other texts; -1 where by none.

    lo and hi are the least and the greatest text that hold a context.
    """
    n, width = len(around), 2 * reach + GRAM
    codes = np.empty((n, width), np.int64)
    codes[:] = -1 - np.arange(n)[:, None]  # beyond the text nothing is equal
    for i, (a, o) in enumerate(zip(around, off, strict=True)):
        codes[i, reach - o : reach - o + len(a)] = _codes(a)
    left, right = np.full(n, -1), np.full(n, -1)
    low, high = np.asarray(lo), np.asarray(hi)
    for i in range(n):
        same = codes == codes[i]
        l = np.logical_and.accumulate(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
        r = np.logical_and.accumulate(same[:, reach + GRAM :], axis=1).sum(axis=1)
        others = (low != low[i]) | (high != high[i]) | (low < high)  # held by a text that is not the only one of context i
        ok = others & same[:, reach : reach + GRAM].all(axis=1) & (l + r >= reach)
        if low[i] == high[i]:
            ok[i] = False
        else:
            l[i], r[i], ok[i] = off[i], len(around[i]) - off[i] - GRAM, len(around[i]) - GRAM >= reach
        if ok.any():
            left[i], right[i] = l[ok].max(), r[ok].max()
    return left, right


def _extended(reach: int):
    """(anchor, contexts) to (anchor, h, left, right) of the contexts that are matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for anchor, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, right = extend(*([c[k] for c in group] for k in ("around", "off", "lo", "hi")), reach)
                for k in np.flatnonzero(left >= 0).tolist():
                    for column, v in zip(out, (anchor, group[k]["h"], int(left[k]), int(right[k])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["anchor", "h", "left", "right"])

    return run


def _counted(contexts: DataFrame, least: int) -> DataFrame:
    """The same as _extended() by counting: every span of ``least`` characters that holds the anchor, by its text."""
    starts = F.sequence(F.greatest(F.col("off") - (least - GRAM), F.lit(0)), F.least(F.col("off"), F.length("around") - least))
    spans = contexts.where((F.length("around") >= least) & (F.length("around") - least >= F.greatest(F.col("off") - (least - GRAM), F.lit(0))))
    spans = spans.select("anchor", "h", "off", "lo", "hi", "around", F.explode(starts).alias("s"))
    spans = spans.select("anchor", "h", "lo", "hi", (F.col("off") - F.col("s")).alias("d"), F.md5(F.substring("around", F.col("s") + 1, F.lit(least))).alias("span"))
    shared = spans.groupBy("anchor", "d", "span").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("anchor", "d", "span")
    met = spans.join(shared, ["anchor", "d", "span"]).groupBy("anchor", "h")
    return met.agg(F.max("d").cast("int").alias("left"), (F.lit(least - GRAM) - F.min("d")).cast("int").alias("right"))


def shared_spans(records: DataFrame, rid: str, text: str, least: int = LEAST, contexts: int = CONTEXTS) -> DataFrame:
    """(record_id, shared_chars) of the records that share a span of ``least`` characters or more."""
    reach = least - GRAM
    if least < GRAM + WINDOW - 1:
        raise ValueError(f"least must be {GRAM + WINDOW - 1} or more")
    rows = records.select(F.col(rid).alias("id"), F.col(text).alias("text"), F.md5(F.col(text)).alias("key")).where(F.length("text") >= least)
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.min("id").alias("tid"), F.max("id").alias("top")).persist(StorageLevel.MEMORY_AND_DISK)
    seeds = texts.select("text", "tid").mapInArrow(_seeds, "anchor bigint, tid bigint")
    shared = seeds.groupBy("anchor").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo < hi").select("anchor").persist(StorageLevel.MEMORY_AND_DISK)
    # texts stay where they are: the filter tells them which anchors are worth a context, the join which of these are shared
    passes = records.sparkSession.sparkContext.broadcast(anchor_filter(shared))
    places = texts.select("text", "tid").mapInArrow(_contexts(reach, passes), "anchor bigint, tid bigint, at bigint, off bigint, around string")
    places = places.join(shared, "anchor", "left_semi")
    places = places.withColumn("h", F.xxhash64("around", "off")).persist(StorageLevel.MEMORY_AND_DISK)
    different = places.groupBy("anchor", "off", "around", "h").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"))
    groups = different.groupBy("anchor").agg(F.count("*").alias("n"))
    different = different.join(groups, "anchor").persist(StorageLevel.MEMORY_AND_DISK)
    few = different.where(F.col("n") <= contexts).groupBy("anchor").agg(F.collect_list(F.struct("h", "around", "off", "lo", "hi")).alias("group"))  # at most ``contexts``
    matched = few.mapInArrow(_extended(reach), "anchor bigint, h bigint, left int, right int").unionByName(_counted(different.where(F.col("n") > contexts), least))
    met = places.select("tid", "at", "anchor", "h").join(matched, ["anchor", "h"])
    matches = met.groupBy("tid").agg(F.sort_array(F.collect_set(F.struct((F.col("at") - F.col("left")).alias("s"), (F.col("at") + GRAM + F.col("right")).alias("e")))).alias("m"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    repeats = F.aggregate(
        "m", none, lambda was, m: F.struct((was["n"] + F.greatest(F.lit(0).cast("bigint"), m["e"] - F.greatest(m["s"], was["to"]))).alias("n"), F.greatest(was["to"], m["e"]).alias("to"))
    )
    covered = matches.select("tid", repeats["n"].alias("chars"))
    chars = texts.join(covered, "tid", "left").select("key", F.when(F.col("tid") < F.col("top"), F.length("text")).otherwise(F.col("chars")).cast("int").alias("shared_chars"))
    out = checkpoint(rows.select("id", "key").distinct().join(chars.where("shared_chars is not null"), "key").select(F.col("id").alias("record_id"), "shared_chars"))
    for kept in (texts, shared, places, different):
        kept.unpersist()
    return out


def p3_found(spark, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "evidence"), "evidence_id", "text").withColumnRenamed("record_id", "evidence_id")
