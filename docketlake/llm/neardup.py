"""Near-duplicate records with small edits, by pigeonhole blocks over fingerprints.

A record's fingerprint is a row of BLOCKS x PER_BLOCK symbols, each the least hash of its
words under one function, split into ``BLOCKS`` blocks: two fingerprints that differ in
fewer symbols than there are blocks share one, whichever symbols they are. All words of a
record take part alike, so that no kind of edit (new ids, typos, names, however rare) can
take the blocks from the words that are left: whatever the edits are, two records of word
similarity J share a block but with probability (1 - J^PER_BLOCK)^BLOCKS, 2.7e-7 at J = 0.7,
6e-12 at J = 0.8. Records that share a block are verified by the Hamming distance of their
sketches: a bit is the parity of the number of words hashed to it, so that the distance is
never more than the number of words in which the records differ, and the bound that follows
from both sizes and the similarity asked for rejects no true pair. An exact check of the
word sets follows, so no false pair remains. All parameters are the same at every size, and
nothing is capped; a block of more than ``HEAVY`` records is spread over salted parts.

Texts are split into words once; the sets (32-bit hashes, so two different words of a pair
are taken for one with a probability below 1e-6) are kept by class: records with the same
words form a class and meet once, copies are paired only in the result.

Defined results: null and empty texts and texts without a letter or digit match nothing;
repeated rows of one id are one record; an empty table gives no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.confusables import consistent_form
from docketlake.session import checkpoint, spread, table

BLOCKS = 36
PER_BLOCK = 3
BITS = 112  # of the sketch; 16 more hold the size
HEAVY = 10_000
ROWS_AT_ONCE = 2000
ROWS_A_PART = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TIMES = np.array([i * 0x9E3779B97F4A7C15 % 2**64 for i in range(64)], np.uint64)
_SEEDS = np.random.default_rng(7).integers(1, 2**63, BLOCKS * PER_BLOCK, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    return x ^ (x >> np.uint64(29))


def words(text: str | None) -> set[str]:
    """The different words of a text."""
    return set(_WORD.findall(consistent_form(text).lower())) if text else set()


class WordHashes(dict):
    """Word -> 32-bit hash; per worker, bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        x = (crc32(raw) | crc32(raw[::-1]) << 32) * 0xBF58476D1CE4E5B9 % 2**64
        h = self[word] = ((x ^ x >> 32) * 0x94D049BB133111EB >> 32) % 2**32
        return h


_hashes = WordHashes()


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, class, words)."""
    for batch in batches:
        ids, flat, ends = [], [], [0]
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ws := words(t):
                ids.append(i)
                flat += map(_hashes.__getitem__, ws)
                ends.append(len(flat))
        values, at = np.array(flat, np.uint32), np.array(ends, np.int32)
        # the sum of the words' mixed hashes does not depend on their order
        classes = np.add.reduceat(_mix(_mix(values.astype(np.uint64) + _TIMES[1])), at[:-1]) if ids else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes.view(np.int64)), lists], ["id", "class", "words"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the length of each."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64), np.diff(lists.offsets.to_numpy())


def fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block keys, sketches) of word sets laid end to end, a row per record; no set is empty.

    A sketch is two words: 64 bits of parity; 48 more above the size of the set (at most 65,535).
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    known, back = np.unique(hashes, return_inverse=True)
    keys = np.repeat(_TIMES[1 : BLOCKS + 1][None, :], len(sizes), axis=0)
    for j, seed in enumerate(_SEEDS):
        values = (_mix((known + _TIMES[1]) * seed ^ seed) >> np.uint64(32)).astype(np.uint32)
        low = np.minimum.reduceat(values[back], starts)
        at = j // PER_BLOCK
        keys[:, at] = _mix(keys[:, at] * _C1 ^ low.astype(np.uint64))
    place = (_mix(_mix(known + _TIMES[2])) >> np.uint64(40)) % np.uint64(BITS)
    one = np.uint64(1)
    first = np.where(place < 64, one << (place % np.uint64(64)), np.uint64(0))
    second = np.where(place >= 64, one << (np.uint64(16) + place % np.uint64(64)), np.uint64(0))
    sketches = np.stack([np.bitwise_xor.reduceat(bits[back], starts) for bits in (first, second)], axis=1)
    sketches[:, 1] |= np.minimum(sizes, 65_535).astype(np.uint64)
    return keys, sketches


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, words) to (block, class, s0, s1), a row per block."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            keys, sketches = fingerprints(*_flat(batch.column(1)))
            own = np.repeat(np.arange(len(keys)), BLOCKS)
            columns = [keys.ravel(), batch.column(0).to_numpy(zero_copy_only=False)[own], *sketches[own].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], ["block", "class", "s0", "s1"])


def _met(blocks: DataFrame, others: DataFrame, keys: list[str], tenths: int) -> DataFrame:
    """(class_a, class_b) that share a block and whose sketches are near enough for the similarity."""
    a, b = (d.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("class", "s0", "s1"))) for d, s in ((blocks, "a"), (others, "b")))
    differ = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.shiftrightunsigned(F.col("s1_a").bitwiseXOR(F.col("s1_b")), 16))
    m, n = (F.col(c).bitwiseAND(F.lit(65_535)) for c in ("s1_a", "s1_b"))
    # of m and n words at least tenths / (10 + tenths) x (m + n) are common, so at most this many differ
    near = differ * (10 + tenths) <= (m + n) * (10 - tenths)
    capped = (m == 65_535) | (n == 65_535)
    alike = (F.least(m, n) * 10 >= F.greatest(m, n) * tenths) & (near | capped)
    return a.join(b, keys).where((F.col("class_a") < F.col("class_b")) & alike).select("class_a", "class_b")


def near_duplicates(records: DataFrame, rid: str, text: str, tenths: int = 7, heavy: int = HEAVY) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of records with word similarity of at least tenths / 10."""
    rows = spread(records.select(F.col(rid).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null"))
    # kept for all that follows; a lost part is computed again from its rows. Copies meet map-side, so a hot class is a row per task
    members = rows.mapInArrow(_word_sets, "id bigint, class bigint, words array<int>").persist(StorageLevel.MEMORY_AND_DISK)
    classes = members.groupBy("class").agg(F.first("words").alias("words")).persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(records.sparkSession.sparkContext.defaultParallelism, -(-classes.count() * BLOCKS // ROWS_A_PART))
    # shuffled once by block: a given number of parts is kept by the cache, and the join takes both sides from it as they lie
    blocks = classes.mapInArrow(_block_rows, "block bigint, class bigint, s0 bigint, s1 bigint").repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)
    large = checkpoint(blocks.groupBy("block").count().where(F.col("count") > heavy).select("block", F.ceil(F.col("count") / heavy).cast("int").alias("salts")))
    if large.isEmpty():
        near = _met(blocks, blocks, ["block"], tenths)
    else:
        light = blocks.join(large, "block", "left_anti")
        hot = checkpoint(blocks.join(large, "block"))
        salted = hot.withColumn("salt", F.pmod(F.xxhash64("class"), "salts").cast("int"))
        every = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        near = _met(light, light, ["block"], tenths).unionByName(_met(salted, every, ["block", "salt"], tenths))
    near = near.distinct()
    sets = [classes.select(F.col("class").alias(f"class_{s}"), F.col("words").alias(f"words_{s}")) for s in "ab"]
    near = near.join(sets[0], "class_a").join(sets[1], "class_b").withColumn("both", F.size(F.array_intersect("words_a", "words_b")))
    near = checkpoint(near.where(F.col("both") * 10 >= (F.size("words_a") + F.size("words_b") - F.col("both")) * tenths).select("class_a", "class_b"))
    ids = checkpoint(members.select("id", "class").distinct())
    for kept in (blocks, classes, members):
        kept.unpersist()
    m = [ids.select(F.col("id").alias(f"id_{s}"), F.col("class").alias(f"class_{s}")) for s in "ab"]
    across = near.join(m[0], "class_a").join(m[1], "class_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    copies = m[0].join(m[1], F.col("class_a") == F.col("class_b")).where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(copies)


FIELDS = {"agenda": ("row_id", "title"), "evidence": ("evidence_id", "text")}


def p7_found(spark, sf_dir: str) -> DataFrame:
    out = [near_duplicates(table(spark, sf_dir, t), rid, col).select(F.lit(t).alias("src_table"), "id_a", "id_b") for t, (rid, col) in FIELDS.items()]
    return out[0].unionByName(out[1])
