"""Token-id output: concatenated ids with Elias-Fano document boundaries.

File format: a Parquet table of blocks. A block holds the documents that follow each other in one shard:

shard, block        place in the order of documents
start_in_shard      ids before the block in its shard
n_docs, n_tokens    sizes of the block
id_width            2 or 4 bytes an id, little-endian, unsigned
ids                 all ids of the block, one after the other
doc_ids             the documents, in order
low_bits, low, high, samples   Elias-Fano code of the n_docs + 1 boundaries

The code splits each boundary into `low_bits` low bits (packed) and a high part, which is written in unary: boundary i
sets bit `(b_i >> low_bits) + i` of `high`. select1(i) finds the i-th set bit from `samples` (the place of each 64th one,
32 bits) and a popcount scan of a few bytes, and gives b_i back: 2 to 3.5 + low_bits bits a document instead of 64.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 64
_POP = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)
BLOCKS = "shard int, block int, start_in_shard long, n_docs long, n_tokens long, id_width int, ids binary, doc_ids array<long>, low_bits int, low binary, high binary, samples binary"


# --- Elias-Fano ------------------------------------------------------------------------------


def ef_encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Code of a non-decreasing, non-empty array of integers: (low_bits, low, high, samples)."""
    v = np.asarray(values, dtype=np.uint64)
    n, top = len(v), int(v[-1])
    bits = max(0, (top // n).bit_length() - 1)
    low = np.zeros(0, dtype=np.uint8)
    if bits:
        flat = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        low = np.packbits(flat, bitorder="little")
    at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
    high[at] = 1
    return bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes()


class Boundaries:
    """Random access to an Elias-Fano code."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.bits = low_bits
        self._low = low
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    def select1(self, i: int) -> int:
        """Place of the i-th set bit of the high part, i from 0."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, used = at >> 3, at & 7
        now = int(self.high[byte]) >> used
        base = at
        while True:
            ones = int(_POP[now])
            if left < ones:
                while True:
                    step = (now & -now).bit_length() - 1
                    if not left:
                        return base + step
                    now &= now - 1
                    left -= 1
            left -= ones
            byte += 1
            base = byte << 3
            now = int(self.high[byte])

    def select(self, i: int) -> int:
        """Boundary i."""
        top = self.select1(i) - i
        if not self.bits:
            return top
        first = i * self.bits
        chunk = int.from_bytes(self._low[first >> 3 : (first + self.bits + 7) >> 3], "little")
        return top << self.bits | chunk >> (first & 7) & ((1 << self.bits) - 1)


# --- encoding --------------------------------------------------------------------------------


class BlankSplitEncoder:
    """Ids of whole texts by a `tokenizers` file whose pre-tokens never hold blanks.

    Strings of special tokens in a text become those tokens, as in the library. Texts are cut at blanks, and the ids of each distinct piece come from the library once and are kept in a bounded
    table, so the cost follows the distinct pieces. It holds for tokenizers that drop blanks and treat the pieces apart
    (tests compare it with the library on whole texts).
    """

    def __init__(self, path: str, dtype: str, keep: int = 1_500_000, longest: int = 200, word_end: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.keep, self.longest = dtype, keep, longest
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(word_end)]] = True

    @staticmethod
    def _letters(x: str) -> bool:
        """Whether x is letters only, and stays so in lower case (a capital I with a dot gives a mark there)."""
        return x.isalpha() and (x.isascii() or unicodedata.normalize("NFC", x).lower().isalpha())

    def _learn(self, new: list[str]) -> None:
        """Words of letters are encoded together, each with the one token that ends it; `word,` and `word.` follow from
        their parts, as the pre-tokenizer parts letters from the rest; all other pieces go to the library one by one."""
        known, letters = self.known, self._letters
        plain, marked, rest = set(), [], []
        for x in new:
            if letters(x):
                plain.add(x)
            elif x[-1] in ",." and letters(x[:-1]):
                marked.append(x)
                if x[:-1] not in known:
                    plain.add(x[:-1])
                if x[-1] not in known:
                    rest.append(x[-1])
            else:
                rest.append(x)
        words = list(plain)
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) == len(part):
                width, data, at = ids.itemsize, ids.tobytes(), 0
                for x, e in zip(part, ((ends + 1) * width).tolist(), strict=True):
                    known[x] = data[at:e]
                    at = e
            else:
                rest += part
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            known.update(zip(part, (np.array(e.ids, dtype=self.dtype).tobytes() for e in encode(part, add_special_tokens=False)), strict=True))
        for x in marked:
            known[x] = known[x[:-1]] + known[x[-1]]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        pieces = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > self.keep:
            self.known = {"": b""}
        new = list(set().union(*pieces).difference(self.known))
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, p)) for p in pieces]
        for x in new:
            if len(x) > self.longest:
                del self.known[x]
        return out


def _block(shard: int, block: int, start: int, doc_ids: list, parts: list[bytes], width: int) -> dict:
    ends = np.concatenate([[0], np.cumsum([len(p) // width for p in parts])])
    bits, low, high, samples = ef_encode(ends)
    return {"shard": shard, "block": block, "start_in_shard": start, "n_docs": len(parts), "n_tokens": int(ends[-1]), "id_width": width, "ids": b"".join(parts), "doc_ids": doc_ids, "low_bits": bits, "low": low, "high": high, "samples": samples}


@lru_cache(maxsize=2)
def encoder_of(path: str, dtype: str) -> BlankSplitEncoder:
    """One encoder for all tasks of a Python worker, so that its table stays warm."""
    return BlankSplitEncoder(path, dtype)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write blocks to `path`, documents in ascending order of their id.

    Documents are dealt by ranges of (id, hash of the text), so shards follow each other and repeated ids part; within a
    shard they are sorted and streamed. Null ids come first, null texts are empty, repeated rows are all written (ties
    by text). Other columns are ignored. An empty table gives an empty file set.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    dtype, end = f"<u{width}", np.array([end_id], dtype=f"<u{width}").tobytes()
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start_in_shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id_width", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, held, ids, parts, encoder = TaskContext.get().partitionId(), 0, 0, 0, [], [], None
        for b in batches:
            encoder = encoder or encoder_of(tokenizer, dtype)
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                for i, p in zip(some.column(0).to_pylist(), encoder(some.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    parts.append(p + end)
                    held += len(p) // width + 1
                    if held >= block_tokens:
                        yield pa.RecordBatch.from_pylist([_block(shard, block, start, ids, parts, width)], schema=schema)
                        block, start, held, ids, parts = block + 1, start + held, 0, [], []
        if parts:
            yield pa.RecordBatch.from_pylist([_block(shard, block, start, ids, parts, width)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(path)


# --- reading ---------------------------------------------------------------------------------


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with `base`, the ids before their shard. Shards are as many as the writer's tasks, which bounds the join."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    return blocks.join(F.broadcast(base), "shard")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files.

    start counts the ids of all documents before it; ids_crc32 is over unsigned 32-bit little-endian ids.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ef = Boundaries(r["low_bits"], r["low"], r["high"], r["samples"])
                ids = np.frombuffer(r["ids"], dtype=f"<u{r['id_width']}").astype("<u4")
                n = r["n_docs"]
                at = np.fromiter(map(ef.select, range(n + 1)), dtype=np.int64, count=n + 1)
                cuts = [ids[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)]
                first = r["base"] + r["start_in_shard"]
                out = {"doc_id": pa.array(r["doc_ids"], pa.int64()), "start": pa.array(first + at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(cuts, pa.binary())
                yield pa.record_batch(out)

    cols = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return read_blocks(spark, path).mapInArrow(decode, cols)
