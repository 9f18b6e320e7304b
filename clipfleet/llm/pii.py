"""Personal data in texts: base patterns, and bootstrapped contextual extraction.

Base patterns find e-mail and IP addresses, card and phone numbers. Bootstrapping: the words to the left of an entity
are a lexical pattern. Base entities are seed instances; other identifier-like tokens (with several digits) are unknown
ones. Spark holds the graph of patterns and distinct instances and scores it in rounds: a pattern's score is the share
of its instances' confidence, an instance's confidence is the noisy-or of its patterns' scores, seeds staying at 1. A
pattern needs `min_seeds` distinct seeds; after the first round, instances with a confidence of `min_score` or more are
seeds too, so patterns that never stand before a base entity can qualify. Where a single word stands before an instance
on its line, the line's start is part of the pattern. Patterns at `min_score` or more, after the last round, turn the unknown
instances behind them into spans of kind `id`. Copies of a document add nothing to the graph, as edges are distinct.

What an unknown identifier is, is a definition of its kind, with parameters: `shortest` to `longest` code points and
`digits` digits or more. The words of a pattern are looked for in `context` code points to the left, to which the rest of
a word that reaches over that edge is added.

The texts are read once; the graph holds hashes only. Null texts are empty; repeated rows get their own result; offsets
count code points. Very long texts are scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfleet.llm.common import join_counted, stored

# fixed values: kinds and patterns of the base
KINDS = ("email", "ip", "card", "phone", "id")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\W\d_]+")
SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("pattern", pa.int64())])
CONTEXT = 64
SHORTEST, LONGEST, DIGITS = 6, 32, 4


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the run of local characters before it, then the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            # a failed attempt leaves no match before this @, so a later one may not reach back over it
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = [(0, *s) for s in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


@lru_cache(maxsize=8)
def _token(longest: int) -> re.Pattern:
    """Runs of letters and digits, parted by single - . _ / and with a digit among the first `longest` code points."""
    return re.compile(rf"(?<![A-Za-z0-9])(?<![A-Za-z0-9][-._/])(?=[A-Za-z._/-]{{0,{longest}}}[0-9])[A-Za-z0-9]+(?:[-._/][A-Za-z0-9]+)*")


def unknown_tokens(text: str, base: list[tuple[int, int, int]], shortest: int = SHORTEST, longest: int = LONGEST, digits: int = DIGITS) -> list[tuple[int, int]]:
    """Identifier-like tokens outside the base spans; single - . _ / may part them."""
    out = []
    for m in _token(longest).finditer(text):
        a, z = m.span()
        if shortest <= z - a <= longest and sum("0" <= c <= "9" for c in m[0]) >= digits and not any(s < z and a < e for _, s, e in base):
            out.append((a, z))
    return out


def pattern_before(text: str, start: int, words: int = 2, context: int = CONTEXT) -> str | None:
    """The last words to the left of start, in lower case, after ^ for the line's start if there are fewer; None without a word."""
    lo = max(0, start - context)
    while 0 < lo < start and text[lo - 1].isalpha() and text[lo].isalpha():
        lo -= 1
    line = text[lo:start]
    whole, line = lo == 0 or "\n" in line, line.rpartition("\n")[2]
    found = _WORD.findall(line.lower())
    if len(found) >= words:
        return " ".join(found[-words:])
    return " ".join(["^", *found]) if found and whole else None


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def scan(docs: DataFrame, id_col: str, text_col: str, context: int = CONTEXT, shortest: int = SHORTEST, longest: int = LONGEST, digits: int = DIGITS) -> DataFrame:
    """(row, doc_id, spans): base spans and unknown tokens, with hashes of their values and patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                t = x.as_py() or ""
                base = base_spans(t)
                spans = []
                for k, a, z in base + [(4, *s) for s in unknown_tokens(t, base, shortest, longest, digits)]:
                    p = pattern_before(t, a, context=context)
                    spans.append({"kind": k, "start": a, "end": z, "instance": _hash(t[a:z].lower()), "pattern": None if p is None else _hash(p)})
                out.append(spans)
            yield pa.record_batch({"doc_id": b.column(0), "spans": pa.array(out, pa.list_(SPAN))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind int, start int, end int, instance long, pattern long>>").select(F.monotonically_increasing_id().alias("row"), "*")


def score_patterns(edges: DataFrame, rounds: int = 3, min_seeds: int = 3, min_score: float = 0.6) -> DataFrame:
    """(pattern, score) of patterns with enough seeds. edges: distinct (pattern, instance, seed)."""
    edges = stored(edges, "graph")
    known = edges.filter("seed = 1").select("instance").distinct().withColumn("confidence", F.lit(1.0))
    known = confidence = stored(known, "known")
    for k in range(rounds):
        held = join_counted(edges, confidence, "instance", f"held{k}", "left").withColumn("c", F.coalesce("confidence", F.lit(0.0)))
        scores = held.groupBy("pattern").agg((F.sum("c") / F.count("*")).alias("score"), F.sum((F.col("c") >= min_score).cast("int")).alias("seeds")).filter(F.col("seeds") >= min_seeds)
        scores = stored(scores.select("pattern", "score"), f"scores{k}")
        if k + 1 < rounds:
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
            found = join_counted(edges, scores, "pattern", f"found{k}").groupBy("instance").agg((1 - doubt).alias("confidence"))
            confidence = found.union(known).groupBy("instance").agg(F.max("confidence").alias("confidence"))
    return scores


def find_personal_data(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, min_score: float = 0.6, context: int = CONTEXT, shortest: int = SHORTEST, longest: int = LONGEST, digits: int = DIGITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of (kind, start, end); spans adds the discovered ones to base."""
    rows = stored(scan(docs, id_col, text_col, context, shortest, longest, digits), "personal")
    each = rows.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    edges = each.filter("pattern IS NOT NULL").groupBy("pattern", "instance").agg(F.max((F.col("kind") < 4).cast("int")).alias("seed"))
    good = score_patterns(edges, rounds, min_seeds, min_score).filter(F.col("score") >= min_score).select("pattern")
    added = join_counted(each.filter("kind = 4"), good, "pattern", "good").groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    base = F.transform(F.filter("spans", lambda s: s["kind"] < 4), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = rows.withColumn("base", base).join(added, "row", "left")
    return both.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
