"""Byte-level BPE by a rank file: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token's bytes form a linked list of parts. For each mergeable pair its rank's bucket holds the place of the left
part; a bitmap of two levels (words of 256 bits) has a bit for every bucket that is not empty, so the lowest rank is found by
two find-first-set steps. A merge takes the leftmost place of the lowest rank, joins two parts and queues the
pairs to its left and right. Places whose pair has changed meanwhile are stale and skipped. The cost is O(n log n) at
most in the length of the pre-token, which suits very long ones. From 4,096 bytes on a bucket is a heap of places.

Null texts are empty and give no ids. Repeated rows are encoded each; extra columns are left out. Very long texts are
encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


WORD = 8  # a bitmap word has 2^8 bits


def pair_ranks(ranks: dict[bytes, int]) -> list[int]:
    """Rank of each pair of bytes a, b at a << 8 | b, or -1."""
    return [ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of one pre-token. Places of a bucket are the set bits of an integer, so the leftmost is a find-first-set too;
    beyond 4,096 bytes, where such integers get slow, a bucket is a heap of places."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    wide = n > 4096
    rank_at = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # noqa: B905  of the pair whose left part begins here
    rank_at.append(-1)
    end = list(range(1, n + 1))  # where the part that begins here ends
    left = list(range(-1, n - 1))  # where the part before the one that begins here begins
    buckets: dict = {}
    words: dict[int, int] = {}  # lower level of the bitmap
    top = 0  # upper level: words that aren't zero
    for i, r in enumerate(rank_at):
        if r >= 0:
            if r not in buckets:
                buckets[r] = [i] if wide else 1 << i
                w = r >> WORD
                words[w] = words.get(w, 0) | 1 << (r & 255)
                top |= 1 << w
            elif wide:
                buckets[r].append(i)
            else:
                buckets[r] |= 1 << i
    while top:
        w = (top & -top).bit_length() - 1
        bits = words[w]
        rank = w << WORD | (bits & -bits).bit_length() - 1
        held = buckets[rank]
        if wide:
            i = heappop(held)
        else:
            i = (held & -held).bit_length() - 1
            held &= held - 1
            buckets[rank] = held
        if not held:
            del buckets[rank]
            bits &= bits - 1
            words[w] = bits
            if not bits:
                top &= top - 1
        if rank_at[i] != rank:
            continue  # stale
        j = end[i]
        k = end[j]
        end[i] = k
        rank_at[j] = -1
        if k < n:
            left[k] = i
            r = get(piece[i : end[k]], -1)
        else:
            r = -1
        h, place = left[i], i
        while True:  # the pair that begins at i, then the one that ends with it
            rank_at[place] = r
            if r >= 0:
                if r not in buckets:
                    buckets[r] = [place] if wide else 1 << place
                    w = r >> WORD
                    words[w] = words.get(w, 0) | 1 << (r & 255)
                    top |= 1 << w
                elif wide:
                    heappush(buckets[r], place)
                else:
                    buckets[r] |= 1 << place
            if place == h or h < 0:
                break
            place = h
            r = get(piece[h:k], -1)
    out, i = [], 0
    while i < n:
        j = end[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Codec:
    """Encoder and decoder of one rank file and pattern, with a bounded table of pre-tokens met before."""

    def __init__(self, ranks_path: str, pattern: str, keep: int = 700_000, longest: int = 64):
        import regex

        self.ranks = load_ranks(ranks_path)
        self.pairs = pair_ranks(self.ranks)
        self.find = regex.compile(pattern).findall
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.keep, self.longest = keep, longest
        self.known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        return array("I", merge(text.encode("utf-8", "replace"), self.ranks, self.pairs)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit little-endian integers."""
        pieces = self.find(text or "")
        known = self.known
        if len(known) > self.keep:
            known.clear()
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        long: dict[str, bytes] = {}
        for p in set(pieces).difference(known):
            (known if len(p) <= self.longest else long)[p] = self.piece(p)
        if long:
            return b"".join(long[p] if p in long else known[p] for p in pieces)
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec_of(ranks_path: str, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker, so that its table stays warm."""
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) with ids as little-endian unsigned 32-bit integers, one row for every row of docs.

    Null texts are empty and give no ids; repeated rows are all encoded; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or codec_of(ranks_path, pattern)
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                ids = [codec.encode(t) for t in some.column(1).to_pylist()]
                yield pa.record_batch({"doc_id": some.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The columns of `encoded` and `decoded`, the bytes that the ids stand for (null ids: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or codec_of(ranks_path, pattern)
            out = [None if x is None else codec.decode(x) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary")
