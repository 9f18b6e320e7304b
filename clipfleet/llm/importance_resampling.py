"""Resampling of documents toward a target distribution by hashed features.

Features are runs of 1 to `most` consecutive words; a feature's bucket is the CRC-32 of its bytes. A bucket's gain is the
logarithm of its smoothed share in the target over that in the corpus; a document's weight is the sum over its features,
and Gumbel noise of its id on top makes the highest scores a sample without replacement.

The checksums of a batch are computed at once: CRC-32 is linear, so a table holds what each byte value at each distance
from the end of its feature contributes, one XOR-reduction over the spans adds them up, and a constant for each length
stands for the register's start and end. Features longer than the table fold blockwise: the sum so far is moved on by a
block's length with four tables and the next block's is added.

Two passes over the texts: counts of buckets (a row a task and bucket, summed by Spark), then weights from the gains,
which are `buckets` numbers whatever the corpus. Ranks come from a sort by range: each partition's rows are counted, and
only these counts meet in the driver.

Null texts have no words. A null doc_id hashes as the empty string and loses ties. Repeated rows count and rank each.
Very long texts are taken whole, in slices that end between words. An empty table gives an empty result; without target texts all gains
follow from the smoothing alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfleet.llm.common import stored

BUCKETS, SEED, MIN_WORDS, SHARE = 10_000, 2024, 20, 10
REACH = 64

# --- CRC-32 of many spans ------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


class SpanCrc:
    """CRC-32 of spans of a byte buffer: `reach` distances from the end are tabled, longer spans fold by blocks of it."""

    def __init__(self, reach: int = REACH):
        self.reach, one = reach, _byte_table()
        rows = [one]
        for _ in range(reach - 1):  # one byte further from the end: a zero byte more runs through the register
            rows.append(one[rows[-1] & 0xFF] ^ (rows[-1] >> np.uint32(8)))
        self.table = np.concatenate(rows)
        # a register moved on by a whole block of zero bytes, byte by byte of the register
        shift = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for _ in range(reach):
            shift = one[shift & 0xFF] ^ (shift >> np.uint32(8))
        self.shift, self.one = shift, one
        self.consts = self._constants(reach)

    def _constants(self, longest: int) -> np.ndarray:
        """What the register's start, all ones, becomes after each number of zero bytes, inverted at the end."""
        out = [0xFFFFFFFF]
        one = self.one.tolist()
        for _ in range(longest):
            out.append(one[out[-1] & 0xFF] ^ (out[-1] >> 8))
        return np.array(out, dtype=np.uint32) ^ np.uint32(0xFFFFFFFF)

    def _moved(self, reg: np.ndarray) -> np.ndarray:
        s = self.shift
        return s[0][reg & 0xFF] ^ s[1][(reg >> np.uint32(8)) & 0xFF] ^ s[2][(reg >> np.uint32(16)) & 0xFF] ^ s[3][reg >> np.uint32(24)]

    def _sums(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """XOR of the contributions of spans of 1 to `reach` bytes."""
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(firsts, sizes)
        far = np.repeat(sizes, sizes) - 1 - within
        byte = data[np.repeat(starts, sizes) + within]
        return np.bitwise_xor.reduceat(self.table[far * 256 + byte], firsts)

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Checksums (unsigned 32-bit) of data[start : start + size] for sizes of 1 and more."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint32)
        longest = int(sizes.max())
        if longest >= len(self.consts):
            self.consts = self._constants(longest)
        head = (sizes - 1) % self.reach + 1  # the first block takes the odd bytes, so the others are whole
        reg = self._sums(data, starts, head)
        done = head.copy()
        while len(todo := np.flatnonzero(done < sizes)):
            block = self._sums(data, starts[todo] + done[todo], np.full(len(todo), self.reach))
            reg[todo] = self._moved(reg[todo]) ^ block
            done[todo] += self.reach
        return reg ^ self.consts[sizes]


# --- features ------------------------------------------------------------------------------------

#: Bytes of words, after A-Z became a-z: digits, small letters, and all of other scripts.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


#: Bytes of text whose features are computed at once; their arrays take some 60 times as much.
SLICE = 1 << 20


def _cut(at: int, live: np.ndarray, ends: np.ndarray, whole: bool) -> int:
    """The first place from `at` on where the buffer may be cut: a text's end or, unless texts stay whole, between words."""
    end = int(ends[np.searchsorted(ends, at)])
    width = 256
    while not whole and at < end:
        gap = np.flatnonzero(~live[at : min(at + width, end)])
        if len(gap):
            return at + int(gap[0])
        at, width = min(at + width, end), 2 * width
    return end


def features(texts: pa.Array, crc: SpanCrc, most: int = 1, buckets: int = BUCKETS, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, row of each word) of the features of a batch of texts, slice by slice of about `size` bytes.

    Slices end between words, and for runs of several words at texts' ends. Words keep their places in one buffer, parted
    by a space, so a run of several words is one span of it.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    lowered = _LOWER[raw]
    live = _WORD[lowered]
    lo, n = 0, len(raw)
    while lo < n:
        hi = _cut(lo + size, live, ends, most > 1) if lo + size < n else n
        yield _slice_features(lowered[lo:hi], live[lo:hi], ends - lo, crc, most, buckets)
        lo = hi


def _slice_features(data: np.ndarray, live: np.ndarray, ends: np.ndarray, crc: SpanCrc, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # a word starts where one byte of a word follows another kind, or a text begins
    within = ends[(ends > 0) & (ends < len(live))]
    fresh = np.ones(len(live), dtype=bool)
    fresh[1:] = ~live[:-1]
    fresh[within] = True
    starts = np.flatnonzero(live & fresh)
    stops = np.append(~live[1:], True)
    stops[within - 1] = True
    after = np.flatnonzero(stops & live) + 1
    row = np.searchsorted(ends, starts, side="right")
    width = after - starts
    rows, found = [row], [crc(data, starts, width) % buckets]
    if most > 1 and len(starts):
        at = np.cumsum(width + 1) - (width + 1)
        inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        joined = np.full(int(at[-1] + width[-1]), 32, dtype=np.uint8)
        joined[np.repeat(at, width) + inner] = data[np.repeat(starts, width) + inner]
        for n in range(2, most + 1):
            k = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
            rows.append(row[k])
            found.append(crc(joined, at[k], at[k + n - 1] + width[k + n - 1] - at[k]) % buckets)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), row


def bucket_counts(texts: DataFrame, text_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; tasks count first, Spark adds, and `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = SpanCrc(), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, bucket, _ in features(b.column(0), crc, most, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    rows = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + b) / ((float(x) + 1) * (t + b)))) for x, y in zip(corpus, target, strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = SpanCrc()
        for b in batches:
            n, words, weight = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for row, bucket, word in features(b.column(1), crc, most, buckets):
                n += np.bincount(row, minlength=b.num_rows)
                words += np.bincount(word, minlength=b.num_rows)
                np.add.at(weight, row, gain[bucket])
            yield pa.record_batch({"doc_id": b.column(0), "n_words": pa.array(words, pa.int64()), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, share: int) -> DataFrame:
    """rows with `rank`, by falling score, then doc_id, of the first share in a hundred; null below it.

    Rows are sorted by range; a partition's rank begins after the rows of those before it.
    """
    rows = rows.withColumn("__deal", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "__deal"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__deal").withColumn("__at", F.monotonically_increasing_id())
    laid = stored(laid, "ranked").withColumn("__part", F.shiftright("__at", 33)).withColumn("__k", F.expr("__at & 8589934591") + 1)
    sizes = sorted((r["__part"], r["n"]) for r in laid.groupBy("__part").agg(F.count("*").alias("n")).collect())  # one a task
    before = [0, *accumulate(n for _, n in sizes)]
    spark, drawn = rows.sparkSession, before[-1] * share // 100
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "__part long, __before long")
    rank = F.col("__k") + F.col("__before")
    return laid.join(starts, "__part").withColumn("rank", F.when(rank <= drawn, rank)).drop("__part", "__k", "__before", "__at")


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, share: int = SHARE) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs; rank counts the drawn ones from 1.

    Of the documents with min_words words at least, `share` in a hundred are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, "text", most, buckets), bucket_counts(target, "text", most, buckets))
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = weigh(docs, gain, most).withColumn("score", F.col("weight") + noise)
    rows = stored(rows, "weights")
    drawn = ranked(rows.filter(F.col("n_words") >= min_words), share)
    return drawn.unionByName(rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
