"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: the sources, by code point and null last, weigh `weights` in turn and share `share` times all words; none gets
more than `most` times its own size, and what is over goes to the others by weight. This is a water level: with the
sources sorted by cap / weight, those below the level are capped.

Schedule: slot k has the point frac(k * golden ratio); cumulative shares of the sources map it to one of them. The slots
of a source are ranked, and rank r takes the r-th block of `block` words from the source's stream: its documents in a
hashed order, a second time in another order if the target exceeds the size. The stream is cut at the target, so a
source's words differ from it by less than one word, and no document is taken more than `most` times (1 or 2).

The slots order the result: `mixed_documents` puts documents in slot order, `mixed_blocks` returns the blocks themselves.

Ranks and positions are prefix sums in two levels (buckets first), so no window holds a whole source.

Sizes are words `[^\\x20\\x09-\\x0D]+`; null texts have none. Null sources are one source, last in order. Repeated rows
are taken each on its own. Ties in the hashed order are broken by id. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipfleet.llm.common import BLANKS, n_words_of, stored

GOLDEN = (math.sqrt(5) - 1) / 2
BLOCK, BUCKETS, CELLS, CHUNK = 1024, 4096, 1024, 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source_key, source_size, target, quota): a row for each source of `sizes` (source, source_key, size)."""
    per = sizes.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # over sources, not documents
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("capped", F.col("cap") / F.col("weight") <= level).withColumn("total", total)
    free = lambda c, x: F.sum(F.when(F.col("capped") == F.lit(x), F.col(c)).otherwise(0.0)).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - free("cap", True)) * F.col("weight") / free("weight", False))
    return per.withColumn("target", target).select("source_key", "source_size", "target", F.least(F.rint("target").cast("long"), F.col("source_size") * most).alias("quota"))


def _running(rows: DataFrame, group: list[str], bucket: str, order: list[Column | str], size: Column, name: str) -> DataFrame:
    """rows with `name`, the sum of size over the rows of the group before each: bucket sums first, then within buckets."""
    rows = rows.withColumn("__size", size)
    sums = rows.groupBy(*group, bucket).agg(F.sum("__size").alias("__n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__in", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    return inside.join(sums, [*group, bucket]).withColumn(name, F.col("__base") + F.col("__in")).drop("__size", "__base", "__in")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_key, rank): which source each slot takes its next block from. A source has ceil(quota / block)."""
    spark = targets.sparkSession
    need = targets.withColumn("need", F.ceil(F.col("quota") / block).cast("long")).filter("need > 0")
    n = int(need.agg(F.sum("need")).first()[0] or 0)
    order = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    spans = need.withColumn("lo", F.coalesce(F.sum("need").over(order), F.lit(0)) / F.lit(float(max(n, 1)))).withColumn("hi", F.col("lo") + F.col("need") / F.lit(float(max(n, 1))))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    k = F.col("id")
    high, low = F.floor(k / (1 << 20)), k % (1 << 20)
    point = F.pmod(high * F.lit(math.fmod((1 << 20) * GOLDEN, 1.0)) + low * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(n + 64).select(k.alias("slot"), point.alias("p")).withColumn("cell", F.floor(F.col("p") * CELLS))
    met = slots.join(cells.select("cell", "lo", "hi", "need", "source_key"), "cell").filter("p >= lo AND p < hi").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    ranked = _running(met.select("slot", "source_key", "need", "chunk"), ["source_key"], "chunk", ["slot"], F.lit(1), "rank").filter("rank < need")
    have = ranked.groupBy("source_key").agg(F.count("*").alias("have"))
    short = need.join(have, "source_key", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")
    rest = short.withColumn("rank", F.explode(F.sequence(F.col("have"), F.col("need") - 1)))
    return ranked.select("slot", "source_key", "rank").union(rest.select((F.lit(n + 64) + F.col("rank")).alias("slot"), "source_key", "rank"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: row, doc_id, text_hash, source, size, source_size, target. pieces: row, slot, pass, first
    and words: the words first .. first + words - 1 of a document that a slot takes."""
    if most not in (1, 2):
        raise ValueError("most is 1 or 2")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("source_key"), n_words_of(F.col("text").cast("string")).alias("size"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "sizes")
    targets = stored(source_targets(rows, weights, share, most), "targets")
    slots = schedule(targets, block)
    full = rows.filter("size > 0").join(targets, "source_key")
    passes = full.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).filter("pass * source_size < quota")
    passes = passes.select("row", "doc_id", "source_key", "size", "source_size", "quota", "pass", "text_hash", F.xxhash64("doc_id", "text_hash", F.col("pass") + seed).alias("h")).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)))
    placed = _running(passes, ["source_key", "pass"], "bucket", ["h", "doc_id", "text_hash", "row"], F.col("size"), "at").withColumn("at", F.col("at") + F.col("pass") * F.col("source_size")).filter("at < quota")
    end = F.least(F.col("at") + F.col("size"), F.col("quota"))
    cut = placed.withColumn("end", end).withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    lo, hi = F.greatest(F.col("at"), F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    pieces = cut.select("row", "source_key", "rank", "pass", (lo - F.col("at")).alias("first"), (hi - lo).alias("words")).join(slots, ["source_key", "rank"])
    return rows.join(targets, "source_key"), pieces.select("row", "slot", "pass", "first", "words")


def taken(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target and taken of every row (the words that the mix takes, repeats
    counted), with the first slot that takes it and the number of blocks it goes to."""
    rows, pieces = mix(docs, **parameters)
    per = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_blocks"))
    return rows.join(per, "row", "left").select("doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def _with_texts(docs: DataFrame, rows: DataFrame, per: DataFrame) -> DataFrame:
    """docs joined with the rows of `per` that take them, and `__worded`: the text's words with the blanks before each."""
    per = rows.join(per, "row").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__key"), F.col("size").alias("__size"), *[F.col(c) for c in per.columns if c.startswith("__")])
    key = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))
    once = docs.withColumn("__h", F.xxhash64("text")).withColumn("__k", key).dropDuplicates(["doc_id", "__h", "__k"])
    both = once.join(per, once["doc_id"].eqNullSafe(per["__id"]) & (once["__h"] == per["__hash"]) & (once["__k"] == per["__key"]))
    return both.withColumn("__worded", F.regexp_extract_all("text", F.lit(f"[{BLANKS}]*[^{BLANKS}]+"), F.lit(0)))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as rows of docs: a row for each pass over a document; where the target cuts one, the text's words up to
    the cut, with the blanks between them. Rows without words are not taken.

    Partitions are hashed samples of the mix, each in the order of the schedule's slots, so that a reader who stops after
    any part of a file has seen the sources near their target shares.
    """
    rows, pieces = mix(docs, **parameters)
    per = pieces.groupBy("row", "pass").agg(F.sum("words").alias("__words"), F.min("slot").alias("__slot"))
    both = _with_texts(docs, rows, per.drop("pass"))
    short = F.array_join(F.slice("__worded", 1, F.col("__words").cast("int")), "")
    out = both.withColumn("text", F.when(F.col("__words") < F.col("__size"), short).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.sortWithinPartitions("__slot", "__h").select(*docs.columns)


def mixed_blocks(docs: DataFrame, **parameters) -> DataFrame:
    """(slot, source, doc_id, text): the mix as blocks of equal size. The rows of a slot together hold `block` words of
    its source (fewer in a source's last block); slots in ascending order are the mix."""
    rows, pieces = mix(docs, **parameters)
    per = pieces.select("row", F.col("slot").alias("__slot"), F.col("first").alias("__first"), F.col("words").alias("__words"))
    part = F.array_join(F.slice("__worded", (F.col("__first") + 1).cast("int"), F.col("__words").cast("int")), "")
    return _with_texts(docs, rows, per).select(F.col("__slot").alias("slot"), "source", "doc_id", part.alias("text"))
