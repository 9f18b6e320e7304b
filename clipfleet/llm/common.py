"""What the operators of this subpackage share: a bit filter, joins on hot keys and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfleet.sources.scratch import rounds, scratch_path, stored

__all__ = ["BLANKS", "connected_components", "id_filter", "join_counted", "join_hot", "n_words_of", "passes", "rounds", "salted", "scratch_path", "stored", "words_of"]

#: The blanks that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"\x20\x09-\x0D"


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


# --- a bit filter over ids -------------------------------------------------------------------

FILTER_BITS_MIN, FILTER_BITS_MAX, FILTER_CHUNK = 20, 27, 16


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def id_filter(ids: DataFrame, column: str) -> tuple[tuple[int, np.ndarray], bool]:
    """Bits set for every id: a prefilter without misses, of 16 MB at most whatever the number of ids.

    The second value says whether it is dense, so that many others pass; an exact join should follow then.
    """
    n = ids.count()
    bits = int(min(FILTER_BITS_MAX, max(FILTER_BITS_MIN, int(n).bit_length() + 6)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            s = np.unique(_slot(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits))
            for c in np.unique(s >> np.uint64(FILTER_CHUNK)):
                part = own.setdefault(int(c), np.zeros(1 << FILTER_CHUNK, dtype=bool))
                part[(s[s >> np.uint64(FILTER_CHUNK) == c] & np.uint64((1 << FILTER_CHUNK) - 1)).astype(np.int64)] = True
        if own:
            yield pa.record_batch({"chunk": pa.array(list(own), pa.int32()), "bits": pa.array([np.packbits(v).tobytes() for v in own.values()], pa.binary())})

    def merge(key, parts):
        import pandas as pd

        out = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in parts["bits"]])
        return pd.DataFrame({"chunk": [key[0]], "bits": [out.tobytes()]})

    found = ids.select(F.col(column).cast("long")).mapInArrow(mark, "chunk int, bits binary").groupBy("chunk").applyInPandas(merge, "chunk int, bits binary")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    step = 1 << (FILTER_CHUNK - 3)
    for r in found.collect():  # at most 2^27 bits
        out[r.chunk * step : (r.chunk + 1) * step] = np.frombuffer(r.bits, dtype=np.uint8)
    return (bits, out), n > 1 << (bits - 3)


def passes(ids: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    s = _slot(ids, bits).astype(np.int64)
    return (table[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1


# --- joins on keys that many rows share --------------------------------------------------------

HOT_SHARE, SALT_ROWS = 2000, 256


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, total: int, how: str = "left", keep: bool = False) -> DataFrame:
    """rows joined with table, which has each key once and in `count` its number of rows; how is left or inner. The count
    is dropped unless kept.

    Keys of more than a HOT_SHARE-th of all rows are fewer than HOT_SHARE, whatever the input, and are broadcast; the
    others are shuffled.
    """
    least, key = total // HOT_SHARE + 1, [key] if isinstance(key, str) else key
    parts = (table.filter(F.col(count) > least), table.filter(F.col(count) <= least))
    hot, cold = (p if keep else p.drop(count) for p in parts)
    hot = F.broadcast(hot)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, how))


def join_counted(rows: DataFrame, table: DataFrame, key: str, label: str, how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key once; the rows of each key are counted first, so that those of a key
    with very many are not sent to one task. rows and table are read more than once."""
    counted = stored(table.join(rows.groupBy(key).agg(F.count("*").alias("__n")), key), label)
    total = counted.agg(F.sum("__n")).first()[0] or 0
    return join_hot(rows, counted, key, "__n", int(total), how)


def salted(rows: DataFrame, table: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """rows and table with `salt`, to be joined on [key, "salt"]; table has each key once. A key with many rows is dealt
    to several tasks by a hash of `by`, and its row of table copied to each. The keys so treated hold more than a
    HOT_SHARE-th of all rows each, so they are few and broadcast."""
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > max(SALT_ROWS, rows.count() // HOT_SHARE))
    hot = F.broadcast(hot.select(key, F.ceil(F.col("__n") / SALT_ROWS).alias("__salts")))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1)))).drop("__salts")
    copied = table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt, copied


# --- connected components ----------------------------------------------------------------------


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that has an edge (a, b); component is the smallest id reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges stand still. Each step is
    one grouped minimum and one join on the same key; hubs are pre-aggregated by the minimum.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        n = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = n.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        linked = n.join(low, "a")
        if large:
            return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        hooked = linked.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hooked.union(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()

    with rounds(edges.sparkSession):
        now = stored(edges.filter("a != b").select("a", "b").distinct(), "edges")
        seen = state(now)
        for _ in range(most_rounds):
            if not seen.n:
                break
            now = stored(star(star(now, True), False), "edges")
            got = state(now)
            if got == seen:
                break
            seen = got
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        roots = now.select(F.col("b").alias("id")).distinct()
        found = now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
        return stored(found, "components", outlives=True)
