"""Garbled text from wrong character encodings: found, and restored where possible.

Noisy-channel decoding over the words (runs between spaces and line ends) that hold a
character beyond ASCII. A word is read back as bytes of the encoding that may have been
assumed; the bytes form a lattice whose edges are the characters they may have been (UTF-8
sequences or GB 2312 pairs, never both in one run, or the character itself). Lost bytes are
wildcards of the lattice: a byte sequence may lack C1 controls, U+FFFD may stand for a byte
or for characters. Through the closed part of the lattice a Viterbi search takes the path
that is likeliest under the corpus' character frequencies; with wildcards the lattice is
searched together with the corpus' words, which it meets by keys that lost bytes leave
alone, and each word's best path is scored by its wildcards. All readings of a word are
weighed by the corpus' word frequencies: one wins if it is clearly likelier than the word as
it stands, the most frequent word with the fewest wildcards first. Decoding is repeated
until nothing is gained, for text garbled more than once. Where nothing is likelier, the
word stays as it is, and is counted as not restored.

Counts cover all documents. A text counts once, so that copies of it carry no extra
weight; the rows that hold a word only decide about wildcards and letters of another encoding where the distinct texts do not contradict.
Texts meet by hash map-side first; candidate readings meet the word counts in joins, so only the character counts (at most one row per Unicode character)
come to the driver.

Defined results: null and empty texts are sound; U+FFFD and C1 controls (but for a lone
next-line) are always damage, restorable or not; repeated rows come out once.
"""

from __future__ import annotations

import codecs
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.session import checkpoint, even, spread, table

# Encodings that may have been assumed for UTF-8 or other bytes.
ASSUMED = ("latin-1", "cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "koi8_r", "cp866")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
ASSUMED_WIDE = ("gb18030", "shift_jis", "euc_kr", "big5")
CLEARLY = 3.0  # nats
WILDCARD, LOST = 1.0, 0.5  # nats a U+FFFD and a lost control cost a reading
CERTAIN = 3.0  # nats a reading without wildcards is ahead
FILTER_BITS = 1 << 22
_DAMAGE = re.compile("[\x80-\x84\x86-\x9f�]")
USUAL = re.compile("[\u00a0-\u024f\u0370-\u045f\u2010-\u2044\u20ac\u2100-\u25ff]")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
_BEYOND = re.compile("[^\x00-\x7f]+")
_LEAD = re.compile("[\xc2-\xf4]")  # what the first byte of a sequence looks like in Latin-1
_PAIR = re.compile("[\xa1-\xff]{2}")


@lru_cache(None)
def byte_chars(codec: str) -> dict[str, int]:
    """Character -> byte above 127; undefined bytes pass as C1 controls."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def _expected(byte: int) -> int:
    """Length of the UTF-8 sequence a byte leads; 0 if it leads none."""
    return 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0


@lru_cache(None)
def _sequences(codec: str) -> re.Pattern:
    """What a word must hold if UTF-8 was read as this encoding: a leading and a following byte."""
    chars = byte_chars(codec)
    lead, follow = ("".join(map(re.escape, (c for c, b in chars.items() if at <= b < to))) for at, to in ((0xC2, 0xF5), (0x80, 0xC0)))
    return re.compile(f"[{lead}][{follow}]")


class Channel:
    """Readings of words under the character frequencies of a corpus of ``docs`` words."""

    def __init__(self, char_counts: dict[str, float]):
        self.total = sum(char_counts.values()) + 1
        self.floor = math.log(0.5 / self.total)
        self.logp = {c: math.log(n / self.total) for c, n in char_counts.items()}
        self.readings = lru_cache(100_000)(self._readings)

    def p(self, ch: str) -> float:
        """Log frequency; a character that no word holds is the less likely the further its block is from those in use."""
        if (known := self.logp.get(ch)) is not None:
            return known
        return self.floor - (0.0 if USUAL.match(ch) else 2.0 if WIDE.match(ch) else 12.0)

    def _path(self, run: str, codec: str, pairs: bool = False) -> tuple[float, str]:
        """Viterbi over one run of characters beyond ASCII: (gain over the run as it stands, reading), by UTF-8 sequences or by pairs."""
        table_ = byte_chars(codec)
        codes = [table_.get(c, -1) for c in run]
        n = len(run)
        best: list[tuple[float, str]] = [(0.0, "")] + [(-math.inf, "")] * n
        for i in range(n):
            gain, text = best[i]
            if gain == -math.inf:
                continue
            edges = [(1, run[i], 0.0)]
            if pairs:
                size = 2 if i + 2 <= n and codes[i] >= 0xA1 and codes[i + 1] >= 0xA1 else 0
            else:
                size = _expected(codes[i]) if codes[i] >= 0 else 0
                if size and not (i + size <= n and all(0x80 <= c < 0xC0 for c in codes[i + 1 : i + size])):
                    size = 0
            if size:
                try:
                    ch = bytes(codes[i : i + size]).decode("gb2312" if pairs else "utf-8")
                    # a pair alone proves little, runs of them do
                    edges.append((size, ch, self.p(ch) - sum(map(self.p, run[i : i + size])) - (2.5 if pairs and n < 4 else 0.0)))
                except UnicodeDecodeError:
                    pass
            for size, ch, g in edges:
                if gain + g > best[i + size][0]:
                    best[i + size] = (gain + g, text + ch)
        return best[n]

    def _wide(self, run: str, codec: str) -> tuple[float, str]:
        """A run whose UTF-8 bytes were read as a two-byte encoding; a sequence cut off at its end is lost."""
        try:
            raw = run.encode(codec)
        except UnicodeEncodeError:
            return 0.0, run
        text, used = codecs.utf_8_decode(raw, "ignore", False)
        if not text or raw[:used].decode("utf-8", "ignore").encode("utf-8") != raw[:used]:
            return 0.0, run
        gain = sum(map(self.p, text)) - sum(map(self.p, run))
        return (gain, text) if gain > 0 else (0.0, run)

    def _once(self, word: str, pairs: bool) -> tuple[float, str]:
        """The likeliest single step back."""
        options = [(0.0, word)]
        if pairs:
            tried = [(c, self._path) for c in ("latin-1", "cp1252")] if _PAIR.search(word) else []
        else:
            tried = [(c, self._path) for c in ASSUMED if _sequences(c).search(word)]
            tried += [(c, self._wide) for c in ASSUMED_WIDE] if WIDE.search(word) else []
        for codec, back in tried:
            gain, out, end = 0.0, [], 0
            for m in _BEYOND.finditer(word):
                g, reading = back(m[0], codec, True) if pairs else back(m[0], codec)
                gain += g
                out += [word[end : m.start()], reading]
                end = m.end()
            options.append((gain, "".join(out) + word[end:]))
        return max(options, key=lambda o: o[0])

    def decode(self, word: str, pairs: bool = False) -> tuple[float, str]:
        """(gain, reading) of the likeliest way back; each step leaves fewer bytes, so the steps end."""
        total = 0.0
        while True:
            gain, reading = self._once(word, pairs)
            if gain <= 1.0 or reading == word:
                return total, word
            total, word = total + gain, reading

    def _readings(self, word: str) -> list[tuple[str, str, float]]:
        """(kind, key, gain): 'read' a reading, 'alike' one that only word counts can prove, 'mask' a key of a lattice with wildcards."""
        out: list[tuple[str, str, float]] = []
        gain, reading = self.decode(word)
        if gain > 0 and reading != word:
            out.append(("read", reading, gain))
        by_pairs, pairs = self.decode(word, True)
        if by_pairs > 0 and pairs not in (word, reading):
            out.append(("read", pairs, by_pairs))
        left = reading if gain > CLEARLY else word
        if _DAMAGE.search(left) or (left != word and _LEAD.search(left)) or _DAMAGE.search(word):
            if len(left) > 1 or left == "â":
                out += [("mask", key, max(gain, 0.0)) for key in traces(word, left)]
        elif len(left) > 1 and _LEAD.search(left):
            # nothing shows but that bytes may be missing: only words of the very same bytes are asked
            out.append(("mask", "=" + _kept(left, 0x100), 0.0))
        elif left == "â":
            out += [("mask", key, 0.0) for key in traces(word, left)]
        if sum(1 for c in word if ord(c) > 127 and c.isalpha()) >= 3:
            seen = {word}
            for wrong in (*ASSUMED, "iso8859_5", "mac_cyrillic"):
                chars = byte_chars(wrong)
                if not all(ord(c) < 128 or c in chars for c in word):
                    continue
                raw = bytes(ord(c) if ord(c) < 128 else chars[c] for c in word)
                for true in CYRILLIC:
                    if true != wrong:
                        back = raw.decode(true, "replace")
                        if back not in seen and all(ord(c) < 128 or "Ѐ" < c <= "ё" for c in back):
                            seen.add(back)
                            out.append(("alike", back, 0.0))
        return out


def mask(word: str) -> str:
    """Runs beyond ASCII as one wildcard."""
    return _BEYOND.sub("�", word)


def _kept(word: str, least: int) -> str:
    """The UTF-8 bytes of the characters from ``least`` on as Latin-1, without C1 controls."""
    raw = "".join(c if ord(c) < least else c.encode("utf-8", "surrogatepass").decode("latin-1") for c in word)
    return "".join(c for c in raw if not "\x80" <= c < "\xa0")


def traces(word: str, left: str) -> list[str]:
    """Keys under which a damaged word, as it is and as far as it can be read (``left``), meets the words that may fill it.

    Lost C1 controls leave the same bytes of the damaged and of the whole word, whatever the length. Beside U+FFFD
    the longest plain part beyond Latin-1 is in both, of which up to three characters are the key, with the mask.
    """
    out = {mask(left), "=" + _kept(word, 0x100), "=" + _kept(left, 0x100), "=" + _kept(left, 0x80)}
    if "�" in left and (part := max(re.split("[\x00-\xff�]+", left), key=len)):
        out.add(f"~{part[:3]}{zlib.crc32(mask(left).encode('utf-8', 'surrogatepass'))}")
    return sorted(out)


def whole_traces(word: str) -> list[str]:
    """The keys of traces() for a sound word; by its mask only where it has an ASCII part or is one character."""
    shape = zlib.crc32(mask(word).encode("utf-8", "surrogatepass"))
    out = {"=" + _kept(word, 0x80)} | {f"~{run[i : i + k]}{shape}" for run in _BEYOND.findall(word) for k in (1, 2, 3) for i in range(len(run) - k + 1)}
    if len(mask(word)) > 1 or len(word) == 1:
        out.add(mask(word))
    return sorted(out)


def wildcards(damaged: str, whole: str) -> float | None:
    """Least cost of a path for ``whole`` through the lattice of a damaged word; None if there is none."""
    a, b = _BEYOND.findall(damaged), _BEYOND.findall(whole)
    if len(a) != len(b):
        return None
    total = 0.0
    for x, y in zip(a, b, strict=True):
        if (cost := _run_cost(x, y)) is None:
            return None
        total += cost
    return total


def _run_cost(damaged: str, whole: str) -> float | None:
    """Viterbi over one run: every character of the whole word is there, or as bytes of which C1 controls may be lost, or under U+FFFD.

    U+FFFD stands for one byte or for any number of characters in a row.
    """
    n = len(damaged)
    codes = [{byte_chars("latin-1").get(c, -1), byte_chars("cp1252").get(c, -1)} for c in damaged]
    at = {0: 0.0}  # place in the damaged run -> least cost
    for ch in whole:
        new: dict[int, float] = {}

        def reach(i: int, cost: float, new=new) -> None:
            if cost < new.get(i, math.inf):
                new[i] = cost

        raw = ch.encode("utf-8", "surrogatepass")
        for i, cost in at.items():
            if i == n:
                continue
            if damaged[i] == ch:
                reach(i + 1, cost)
            if damaged[i] == "\ufffd":
                reach(i + 1, cost + WILDCARD)
                reach(i, cost + WILDCARD)
            if raw[0] in codes[i] or (damaged[i] == "\ufffd" and len(raw) > 1):
                states = {(i + 1, cost + (0.0 if raw[0] in codes[i] else WILDCARD))}
                for byte in raw[1:]:
                    after = set()
                    for k, c in states:
                        if k < n and byte in codes[k]:
                            after.add((k + 1, c))
                        elif k < n and damaged[k] == "\ufffd":
                            after.add((k + 1, c + WILDCARD))
                        if byte < 0xA0:
                            after.add((k, c + LOST))
                    states = after
                for k, c in states:
                    reach(k, c)
        at = new
    return at.get(n)


_BREAKS = "\t\n\r\x0b\x0c"


def odd_words(text: str) -> list[str]:
    """Words with a character beyond ASCII; a no-break space breaks no word."""
    if text.isascii():
        return []
    for c in _BREAKS:  # several times faster than translate()
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if not w.isascii()]


def _text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, words, counts, copies); texts without such words are left out."""
    for batch in batches:
        found: dict[int, list] = {}
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k in found:
                found[k][1] += 1
            elif odd := odd_words(t):
                found[k] = [Counter(odd), 1]
        columns = [pa.array(list(found), pa.int64()), pa.array([list(w) for w, _ in found.values()], pa.list_(pa.string())), pa.array([list(w.values()) for w, _ in found.values()], pa.list_(pa.int64())), pa.array([n for _, n in found.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "words", "counts", "copies"])


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n, rows) of all words with a character beyond ASCII: how often it is in distinct texts, and how many rows hold it."""
    some = spread(docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).where("text is not null"))
    texts = some.mapInArrow(_text_words, "key bigint, words array<string>, counts array<bigint>, copies bigint")
    texts = texts.groupBy("key").agg(F.first(F.arrays_zip("words", "counts")).alias("found"), F.sum("copies").alias("copies"))
    return texts.select("copies", F.inline("found")).groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n"), F.sum("copies").alias("rows"))


def char_counts(words: DataFrame) -> dict[str, float]:
    """Character -> how many words (with their counts) hold it; at most a row per Unicode character.

    Rows break ties between equal counts: all rows together add less than one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = Counter(), Counter()
        for batch in batches:
            for w, n, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for c in set(w):
                    if ord(c) > 127:
                        found[ord(c)] += n
                        held[ord(c)] += rows
        columns = [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64()), pa.array([held[c] for c in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["c", "n", "rows"])

    counts = words.select("word", "n", "rows").mapInArrow(run, "c int, n bigint, rows bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    total = sum(r.rows for r in counts) + 1
    return {chr(r.c): r.n + r.rows / total for r in counts}


def garbled_words(words: DataFrame) -> DataFrame:
    """(word, fixed) of the garbled ones among (word, n, rows); fixed is null where nothing fits."""
    counts = (uuid4().hex, words.sparkSession.sparkContext.broadcast(char_counts(words)))

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = _channel(counts)
        for pdf in batches:
            rows = [(w, n, m, *r) for w, n, m in zip(pdf["word"], pdf["n"], pdf["rows"], strict=True) for r in channel.readings(w)]
            yield pd.DataFrame(rows, columns=["word", "n", "rows", "kind", "key", "gain"])

    offers = checkpoint(even(words).mapInPandas(propose, "word string, n long, rows long, kind string, key string, gain double"))
    known = words.select(F.col("word").alias("key"), F.col("n").alias("seen"), F.col("rows").alias("seen_rows"))
    # by distinct texts; by rows only where these hold the reading as often
    often = ((F.col("seen") >= 2) & (F.col("seen") >= 3 * F.col("n"))) | ((F.col("seen") >= F.col("n")) & (F.col("seen_rows") >= 2) & (F.col("seen_rows") >= 3 * F.col("rows")))
    read = (
        offers.where("kind <> 'mask'")
        .join(known, "key", "left")
        .withColumn("seen", F.coalesce("seen", F.lit(0)))
        .where(F.when(F.col("kind") == "read", F.col("gain") + F.log((F.col("seen") + 1) / (F.col("n") + 1)) > CLEARLY).otherwise(often))
        .select("word", F.col("key").alias("fixed"), F.when(F.col("seen") > 0, F.log("seen") + CERTAIN).otherwise(F.col("gain")).alias("score"), "seen")
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, w, n, m) for w, n, m in zip(pdf["word"], pdf["n"], pdf["rows"], strict=True) for k in whole_traces(w)]
            yield pd.DataFrame(rows, columns=["key", "fixed", "seen", "seen_rows"])

    # only sound words can fill wildcards
    fillers = even(words.where(~F.col("word").rlike("[\\x{80}-\\x{9f}\\x{fffd}]"))).mapInPandas(fill, "key string, fixed string, seen long, seen_rows long")

    @F.pandas_udf("double")
    def cost(damaged: pd.Series, whole: pd.Series) -> pd.Series:
        out = []
        for d, w in zip(damaged, whole, strict=True):
            found = [wildcards(x, w) for x in {_left(counts, d), d} if mask(x) == mask(w)] if d != w else []
            out.append(min((c for c in found if c is not None), default=None))
        return pd.Series(out, dtype=object)

    filled = (
        offers.where("kind = 'mask'")
        .join(fillers, "key")
        .where(often)
        .withColumn("cost", cost("word", "fixed"))
        .where("cost is not null")
        .select("word", "fixed", (F.log("seen") - F.col("cost")).alias("score"), "seen")
    )
    sure = words.where(F.col("word").rlike("[\\x{80}-\\x{84}\\x{86}-\\x{9f}\\x{fffd}]")).select("word", F.lit(None).cast("string").alias("fixed"), F.lit(-1.0).alias("score"), F.lit(0).cast("bigint").alias("seen"))
    best = F.max_by("fixed", F.struct(F.col("seen") > 0, "score", "seen", "fixed"))
    return read.unionByName(filled).unionByName(sure).groupBy("word").agg(best.alias("fixed"))


_channels: dict[str, Channel] = {}


def _channel(counts) -> Channel:
    """The channel of a worker, kept between its tasks."""
    key, shared = counts
    if key not in _channels:
        _channels.clear()
        _channels[key] = Channel(shared.value)
    return _channels[key]


@lru_cache(20_000)
def _decoded(channel: Channel, word: str) -> str:
    gain, reading = channel.decode(word)
    return reading if gain > CLEARLY else word


def _left(counts, word: str) -> str:
    return _decoded(_channel(counts), word)


def _filter_bits(words: pd.Series | list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % FILTER_BITS for w in words), np.int64, len(words))


def word_filter(words: DataFrame) -> np.ndarray:
    """A bit per crc32 of a word, FILTER_BITS bits whatever the input: what it lets pass still meets an exact join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"bit": np.unique(_filter_bits(pdf["word"]))})

    bits = np.zeros(FILTER_BITS, np.bool_)
    bits[words.select("word").mapInPandas(run, "bit int").distinct().toArrow()["bit"].to_numpy()] = True
    return np.packbits(bits)


def garbled_places(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, word, fixed) of every garbled word of every document."""
    words = checkpoint(word_counts(docs, text))
    garbled = checkpoint(garbled_words(words))
    passes = docs.sparkSession.sparkContext.broadcast(word_filter(garbled))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(passes.value).astype(np.bool_)
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if odd := list(set(odd_words(t))):
                    hit = [odd[k] for k in np.flatnonzero(bits[_filter_bits(odd)])]
                    ids += [i] * len(hit)
                    out += hit
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "word"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return spread(rows).mapInArrow(suspects, "doc_id bigint, word string").join(garbled, "word")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return garbled_places(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_restored(spark, sf_dir: str) -> DataFrame:
    """(doc_id, restored, unrestored): the text with every garbled word restored that can be, and how many words cannot."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fixes = (
        garbled_places(docs, "doc_id", "text")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("word", "fixed")).alias("fixes"))
    )

    @F.pandas_udf("string")
    def mend(texts: pd.Series, fixes: pd.Series) -> pd.Series:
        out = []
        for t, fs in zip(texts, fixes, strict=True):
            known = {f["word"]: f["fixed"] for f in fs if f["fixed"] is not None}
            out.append(re.sub("[^ \t\n\r\x0b\x0c]+", lambda m: known.get(m[0], m[0]), t))  # noqa: B023
        return pd.Series(out)

    left = F.size(F.filter("fixes", lambda f: f["fixed"].isNull() | f["fixed"].rlike("[\\x{80}-\\x{84}\\x{86}-\\x{9f}\\x{fffd}]")))
    return docs.join(fixes, "doc_id").select("doc_id", mend("text", "fixes").alias("restored"), left.cast("bigint").alias("unrestored"))
