"""Quality rules of documents, and the cross-document frequency of their lines.

All of it is DataFrame functions. Lines are normalised (lower case, blanks joined) and hashed; a line's
frequency on a host is the number of distinct documents there that hold it. Documents with the same set of lines are
copies and count as one: a document is known by a hash of its whole set of line hashes. Lines on more than `max_docs`
documents of a host are removed; a document is depleted when fewer than `min_left` words, or less than `min_share` of
its words, are left.

Null texts have no words and fail. A null host is a host of its own. Rows that repeat get the same verdict each. Extra
columns are kept by `apply_rules` and don't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfleet.llm.common import BLANKS, join_hot, stored, words_of

MAX_DOCS, MIN_LEFT, MIN_SHARE = 20, 15, 0.2
KEY = ["doc_id", "host", "text_hash"]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array (64-bit hashes stand for windows)."""

    def covered(places: Column) -> Column:
        """Length of the union of [p, p + 2] over sorted places."""
        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(p - s["last"], F.lit(3))).alias("n")))["n"]

    def of(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        by_list = lambda d: F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(d, h), i)), lambda p: p.isNotNull())
        pairs = lambda: let(  # noqa: E731  for many repeats: sort (hash, place) and look at neighbours
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda t: F.sort_array(F.transform(F.filter(t, lambda x, i: F.coalesce(x["h"] == F.get(t, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(t, i + 1)["h"], F.lit(False))), lambda x: x["i"])),
        )
        return let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 48, covered(by_list(d))).otherwise(covered(pairs())))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, of))


def line_hash(line: Column) -> Column:
    """The first 60 bits of the MD5 digest, which other engines compute alike."""
    digest = F.md5(F.regexp_replace(F.lower(line), f"[{BLANKS}]+", " ").cast("binary"))
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each row: doc_id, host, text_hash, the counts, base_failed, and `lines` with hash and words of each."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.transform(x, lambda y: F.struct(line_hash(F.btrim(y, F.lit(" \t\n\x0b\x0c\r"))).alias("h"), F.size(words_of(y)).alias("w"))).alias("lines")))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), F.xxhash64(text).alias("text_hash"), counts.alias("c"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lined.alias("l"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(*KEY, "c.*", "n_symbols", "l.*").withColumn("base_failed", failed)


def frequent_lines(base: DataFrame, max_docs: int) -> DataFrame:
    """(doc_id, host, text_hash, h, w): the occurrences of lines above the limit on their host."""
    once = base.dropDuplicates(KEY)
    whole = F.xxhash64(F.array_sort(F.array_distinct(F.transform("lines", lambda y: y["h"]))))
    line = once.filter(F.size("lines") > 0).select(*KEY, whole.alias("whole"), F.explode("lines").alias("y")).select(*KEY, "whole", "y.h", "y.w")
    often = line.groupBy("host", "h", "whole").agg(F.count("*").alias("n")).groupBy("host", "h").agg(F.count("*").alias("on_docs"), F.sum("n").alias("n")).filter(F.col("on_docs") > max_docs)
    often = stored(often.select("host", "h", "n"), "frequent")
    # a banner of very many pages of a host is joined by broadcast
    return join_hot(line.select(*KEY, "h", "w"), often, ["host", "h"], "n", int(often.agg(F.sum("n")).first()[0] or 0), "inner")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT, min_share: float = MIN_SHARE, **columns: str) -> DataFrame:
    """base_rules with n_removed_words, `removed` (hashes of the removed lines) and kept."""
    base = stored(base_rules(docs, **columns), "rules")
    hits = frequent_lines(base, max_docs).groupBy(*KEY).agg(F.sum("w").cast("long").alias("n_removed_words"), F.collect_set("h").alias("removed"))
    on = [base[k].eqNullSafe(hits[k]) for k in KEY]
    both = base.join(hits, on, "left").select(base["*"], F.coalesce("n_removed_words", F.lit(0)).alias("n_removed_words"), "removed")
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_left) | (left < min_share * F.col("n_words")))
    return both.drop("lines").withColumn("kept", ~F.col("base_failed") & ~depleted)


def apply_rules(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT, min_share: float = MIN_SHARE) -> DataFrame:
    """The kept documents in their own columns, without the removed lines; n_chars follows the text where it exists."""
    verdict = judge(docs, max_docs, min_left, min_share).filter("kept").select(*KEY, "removed").dropDuplicates(KEY)
    verdict = verdict.select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("removed").alias("__removed"))
    host = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = docs["doc_id"].eqNullSafe(verdict["__doc_id"]) & (host == verdict["__host"]) & (F.xxhash64(text) == verdict["__text_hash"])
    both = docs.join(verdict, on)
    stay = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("__removed"), line_hash(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))))), "\n")
    new = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(stay)
    out = both.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
