"""Captions: words to cues, glossary fixes, emphasis, and caption documents.

Spans end at sentence ends and pauses; within a span cues are the cheapest partition by a small dynamic programme, or of
equal numbers of words. Both are formed over the stream of words that the words' own window leaves sorted, by arrays over
all spans of a batch. The rest is windows, joins and array
functions, but for the glossary's rewriting, which is such a stream too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipfleet.functions.dims import BREAK_WORDS
from clipfleet.functions.exprs import ends_sentence, normalize_token, srt_time, term_key, to_frames


def _by_clip():
    return Window.partitionBy("clip_id").orderBy("idx")


def _in_order(words: DataFrame) -> DataFrame:
    """words with each clip in one partition, by idx: a window asks for that, and shuffles only where it isn't so yet."""
    return words.withColumn("__place", F.row_number().over(_by_clip())).sortWithinPartitions("clip_id", "idx")


def caption_spans(words: DataFrame, gap_ms: int = 600) -> DataFrame:
    """words with `span`: a new one after a sentence end, or after a pause of gap_ms or more."""
    ends = ends_sentence(F.col("word")) | F.coalesce(F.lead("start_ms").over(_by_clip()) - F.col("end_ms") >= gap_ms, F.lit(False))
    rows = words.withColumn("ends", ends.cast("long"))
    return rows.withColumn("span", F.coalesce(F.sum("ends").over(_by_clip().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("ends")


def partition_span(lengths: list[int], breaks: list[bool], commas: list[bool], max_words: int, min_words: int, max_chars: int, target: int) -> list[int]:
    """Cue number of each word of one span: the partition of least cost.

    A cue costs 2, the squared distance of its length from the target, and 3 for each word below min_words (if that is
    over 1). Where a cue starts inside the span: a break word first saves 1.5, one just before costs 2, a comma just
    before saves 1. Of equal costs the shorter last cue wins.
    """
    n = len(lengths)
    before = [0]
    for x in lengths:
        before.append(before[-1] + x)
    edge = [0.0] * n
    for j in range(1, n):
        edge[j] = (-1.5 if breaks[j] else 0.0) + (2.0 if breaks[j - 1] else 0.0)
        if commas[j - 1]:
            edge[j] -= 1.0
    best, cut = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for size_end in range(1, n + 1):
        for size in range(1, min(max_words, size_end) + 1):
            start = size_end - size
            if size > 1 and before[size_end] - before[start] + size - 1 > max_chars:
                continue
            cost = best[start] + 2.0 + (size - target) ** 2 + edge[start]
            if min_words > 1 and size < min_words:
                cost += 3.0 * (min_words - size)
            if cost < best[size_end]:
                best[size_end], cut[size_end] = cost, start
    starts, at = [], n
    while at:
        at = cut[at]
        starts.append(at)
    starts.reverse()
    out = []
    for k, s in enumerate(starts):
        out += [k] * ((starts[k + 1] if k + 1 < len(starts) else n) - s)
    return out


#: Spans that the partition runs over side by side; fewer are left to the plain form.
SIDE_BY_SIDE = 16


def partition_spans(first: np.ndarray, n: np.ndarray, chars: np.ndarray, breaks: np.ndarray, commas: np.ndarray, max_words: int, min_words: int, max_chars: int, target: int) -> np.ndarray:
    """Whether a cue starts at each word: `partition_span` of spans (their first word and length) that follow each other,
    run place by place over all spans that are as long."""
    total = len(chars)
    starts, cut, best = np.zeros(total, bool), np.zeros(total + 1, np.int64), np.zeros(total + 1)
    before = np.concatenate([[0], np.cumsum(chars)])
    edge = np.zeros(total)
    edge[1:] = np.where(breaks[1:], -1.5, 0.0) + np.where(breaks[:-1], 2.0, 0.0) - np.where(commas[:-1], 1.0, 0.0)
    edge[first] = 0.0
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    # the cost of words up to the k-th of a span stands at its k-th word, that of none is 0
    for at in range(1, int(n[0]) + 1 if len(n) else 0):
        f = first[: np.searchsorted(-n, -at, "right")]
        if len(f) < SIDE_BY_SIDE:
            break
        low, where = np.full(len(f), np.inf), np.zeros(len(f), np.int64)
        for size in range(1, min(max_words, at) + 1):
            start = at - size
            cost = (best[f + start - 1] if start else 0.0) + 2.0 + (size - target) ** 2 + edge[f + start]
            if min_words > 1 and size < min_words:
                cost = cost + 3.0 * (min_words - size)
            better = cost < low
            if size > 1:
                better &= before[f + at] - before[f + start] + size - 1 <= max_chars
            low, where = np.where(better, cost, low), np.where(better, start, where)
        best[f + at - 1], cut[f + at - 1] = low, where
    else:
        at = int(n[0]) + 1 if len(n) else 1
    long = n >= at  # beyond the places that were run
    f, left = first[~long], n[~long]
    while len(f):
        c = cut[f + left - 1]
        starts[f + c] = True
        f, left = f[c > 0], c[c > 0]
    for f, m in zip(first[long].tolist(), n[long].tolist(), strict=True):
        numbers = np.array(partition_span(chars[f : f + m].tolist(), breaks[f : f + m].tolist(), commas[f : f + m].tolist(), max_words, min_words, max_chars, target))
        starts[f : f + m] = np.diff(numbers, prepend=-1) > 0
    return starts


def _flat(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if not column.null_count else np.array(column.to_pylist(), object)


def _by_whole_spans(batches: Iterator[pa.RecordBatch], gap_ms: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The stream of words (clip_id, start_ms, end_ms, __ends, ...) in parts that end where a span ends, with the clip of
    each word and whether a span starts there, as `caption_spans` has it."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    before = None

    def part() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows, clips, opens = zip(*held, strict=True)
        return pa.Table.from_batches(rows), np.concatenate(clips), np.concatenate(opens)

    for b in batches:
        if not b.num_rows:
            continue
        clip, ends = _flat(b.column("clip_id")), b.column("__ends").to_numpy(zero_copy_only=False)
        start, end = (b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("start_ms", "end_ms"))  # null: not a number
        opens = np.empty(len(clip), bool)
        opens[0] = before is None or before[0] != clip[0] or before[1] or start[0] - before[2] >= gap_ms
        opens[1:] = (clip[1:] != clip[:-1]) | ends[:-1] | (start[1:] - end[:-1] >= gap_ms)
        before = clip[-1], ends[-1], end[-1]
        at = np.flatnonzero(opens)
        at = int(at[-1]) if len(at) else -1
        if at > 0:
            held.append((b.slice(0, at), clip[:at], opens[:at]))
        if at >= 0 and held:
            yield part()
            held = []
        at = max(at, 0)
        held.append((b.slice(at), clip[at:], opens[at:]))
    if held:
        yield part()


def _numbered(starts: np.ndarray, clip: np.ndarray, last: tuple) -> tuple[np.ndarray, tuple]:
    """The number in its clip of the cue of each word; last: the clip and the number before."""
    count = np.cumsum(starts)
    opens = np.concatenate([[clip[0] != last[0]], clip[1:] != clip[:-1]])
    begun = np.maximum.accumulate(np.where(opens, np.arange(len(clip)), -1))  # the first word of the clip, if it is here
    cue = np.where(begun >= 0, count - count[np.maximum(begun, 0)], last[1] + count)
    return cue, (clip[-1], cue[-1])


def chunk_words(words: DataFrame, max_words: int = 4, min_words: int = 2, max_chars: int = 24, gap_ms: int = 600, target: int = 0, breaks: tuple[str, ...] = BREAK_WORDS) -> DataFrame:
    """words with `cue`, the 0-based number of each word's cue in its clip, and `starts`, whether the cue starts there."""
    aim = target if target > 0 else max(1, round((min_words + max_words) / 2))
    if min_words == max_words == 1:  # every word a cue
        return words.withColumn("cue", (F.row_number().over(_by_clip()) - 1).cast("long")).withColumn("starts", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False))
    marked = words.withColumn("__ends", no(ends_sentence(F.col("word")))).withColumn("__chars", F.coalesce(F.length("word"), F.lit(0))).withColumn("__break", no(F.col("norm").isin(*breaks))).withColumn("__comma", no(F.rtrim("word").rlike("[,;:]$")))
    names = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, -1)
        for part, clip, opens in _by_whole_spans(batches, gap_ms):
            first = np.flatnonzero(opens)
            starts = partition_spans(first, np.diff(first, append=len(clip)), *(part.column(c).to_numpy() for c in ("__chars", "__break", "__comma")), max_words, min_words, max_chars, aim)
            cue, last = _numbered(starts, clip, last)
            yield from part.select(names).append_column("cue", pa.array(cue, pa.int64())).append_column("starts", pa.array(starts)).combine_chunks().to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return _in_order(marked).mapInArrow(run, kinds + ", cue long, starts boolean")


def even_cues(words: DataFrame, size: int = 3, gap_ms: int = 600) -> DataFrame:
    """Cues, as of `words_to_cues`, of `size` words of a span each, the last of a span of what is left; formed in the
    stream of words, which is neither grouped nor numbered by windows."""
    columns = ["clip_id", "word", "start_ms", "end_ms"]
    marked = words.select(*columns, "idx", F.coalesce(ends_sentence(F.col("word")), F.lit(False)).alias("__ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, -1)
        for part, clip, opens in _by_whole_spans(batches, gap_ms):
            place = np.arange(len(clip))
            starts = (place - np.maximum.accumulate(np.where(opens, place, 0))) % size == 0
            cue, last = _numbered(starts, clip, last)
            at = np.flatnonzero(starts)
            ids, word, start, end = (part.column(c).combine_chunks() for c in columns)
            edges = pa.array(np.append(at, len(clip)), pa.int32())
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1), pa.int32()), pa.array([], pa.int64()))
            times = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([start, end], ["s", "e"]))
            ends = np.append(at[1:], len(clip)) - 1
            rows = [ids.take(pa.array(at)), pa.array(cue[at], pa.int64()), start.take(pa.array(at)), end.take(pa.array(ends)), pa.ListArray.from_arrays(edges, word), none, pa.array(np.ones(len(at), bool)), times]
            yield pa.RecordBatch.from_arrays(rows, ["clip_id", "i", "start_ms", "end_ms", "words", "emphasis", "keep", "word_times"])

    kind = words.schema["clip_id"].dataType.simpleString()
    return _in_order(marked).drop("idx").mapInArrow(run, f"clip_id {kind}, i long, start_ms long, end_ms long, words array<string>, emphasis array<bigint>, keep boolean, word_times array<struct<s:bigint,e:bigint>>")


def even_cues_in_place(words: DataFrame, size: int = 3, gap_ms: int = 600) -> DataFrame:
    """`even_cues` by three windows over words, for what groups or joins cues by clip: cues lie where their words lie, as
    those of the stream don't, so they needn't be shuffled."""
    w, no = _by_clip(), lambda c: F.coalesce(c, F.lit(False))
    word = F.struct("word", "start_ms", "end_ms")
    rows = words.select("clip_id", "idx", "start_ms", word.alias("x"), no(ends_sentence(F.col("word"))).alias("ends"))
    apart = no(F.col("start_ms") - F.lag("x").over(w)["end_ms"] >= gap_ms)
    rows = rows.select("clip_id", "idx", "x", F.row_number().over(w).alias("place"), (no(F.lag("ends").over(w)) | apart | F.lag("ends").over(w).isNull()).alias("opens"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("starts", (F.col("place") - F.max(F.when(F.col("opens"), F.col("place"))).over(so_far)) % size == 0)
    ahead = [F.lead(F.struct("starts", "x"), k).over(w).alias(f"x{k}") for k in range(1, size)]
    rows = rows.select("clip_id", "x", "starts", (F.sum(F.col("starts").cast("long")).over(so_far) - 1).alias("i"), *ahead).filter("starts")
    inside, all_ = F.lit(True), [F.col("x")]
    for k in range(1, size):
        inside = inside & no(~F.col(f"x{k}.starts"))
        all_.append(F.when(inside, F.col(f"x{k}.x")))
    rows = rows.select("clip_id", "i", F.array_compact(F.array(*all_)).alias("w"))
    times = F.transform("w", lambda x: F.struct(x["start_ms"].alias("s"), x["end_ms"].alias("e")))
    none = F.array().cast("array<bigint>")
    return rows.select("clip_id", "i", F.get("w", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("w", -1)["end_ms"].alias("end_ms"), F.transform("w", lambda x: x["word"]).alias("words"), none.alias("emphasis"), F.lit(True).alias("keep"), times.alias("word_times"))


def emphasise(cues: DataFrame, terms: DataFrame) -> DataFrame:
    """cues with `emphasis`, the places of the words whose keys are among their clip's terms (clip_id, terms)."""
    hit = F.filter(F.transform("words", lambda x, k: F.when(F.array_contains("terms", term_key(x)), k.cast("long"))), lambda k: k.isNotNull())
    marked = F.coalesce(F.when(F.col("terms").isNotNull(), hit), F.array().cast("array<bigint>"))
    return cues.join(terms, "clip_id", "left").withColumn("emphasis", marked).select(*cues.columns)


def words_to_cues(chunked: DataFrame, terms: DataFrame | None = None, karaoke: bool = True, most: int | None = None) -> DataFrame:
    """(clip_id, i, start_ms, end_ms, words, emphasis, keep, word_times) from words with `cue`.

    terms (clip_id, terms): keys of emphasised words; without it nothing is emphasised. most: how many words a cue has at
    most, if that is known and the words of a cue follow each other by idx; cues then look ahead from their first word in
    the order that words have anyway, rather than being grouped. A longer cue is an error.
    """
    word = F.struct("idx", "word", "start_ms", "end_ms")
    if most is None:
        cues = chunked.groupBy("clip_id", F.col("cue").alias("i")).agg(F.array_sort(F.collect_list(word)).alias("w"))
    else:
        w, cue = _by_clip(), F.col("cue")
        rows = chunked.select("clip_id", "idx", "cue", word.alias("x"))
        ahead = [F.when(F.lead("cue", k).over(w) == cue, F.lead("x", k).over(w)).alias(f"x{k}") for k in range(1, most)]
        rows = rows.select("clip_id", cue.alias("i"), "x", *ahead, (F.lag("cue").over(w) == cue).alias("inside"), (F.lead("cue", most).over(w) == cue).alias("longer")).filter("inside IS NULL OR NOT inside")
        longer = F.raise_error(F.lit(f"a cue has more than {most} words")).cast("array<struct<idx:bigint,word:string,start_ms:bigint,end_ms:bigint>>")
        cues = rows.select("clip_id", "i", F.when(F.col("longer"), longer).otherwise(F.array_compact(F.array("x", *[f"x{k}" for k in range(1, most)]))).alias("w"))
    times = F.transform("w", lambda x: F.struct(x["start_ms"].alias("s"), x["end_ms"].alias("e")))
    none = F.array().cast("array<bigint>")
    cues = cues.select("clip_id", "i", F.get("w", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("w", -1)["end_ms"].alias("end_ms"), F.transform("w", lambda x: x["word"]).alias("words"), none.alias("emphasis"), F.lit(True).alias("keep"), (times if karaoke else F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("word_times"))
    return emphasise(cues, terms) if terms is not None else cues


# --- glossary ------------------------------------------------------------------------------------


def merge_terms(layers: DataFrame) -> DataFrame:
    """(identity, ord, term): terms without repeats, first place wins, lower priorities first. layers: identity,
    priority, ord, term."""
    first = layers.groupBy("identity", "term").agg(F.min(F.struct("priority", "ord")).alias("at"))
    n = F.row_number().over(Window.partitionBy("identity").orderBy("at", "term")) - 1
    return first.select("identity", n.cast("long").alias("ord"), "term")


def merge_fixes(layers: DataFrame) -> DataFrame:
    """(identity, ord, wrong, right): the highest priority's right side; a key keeps its first place. layers: identity,
    priority, ord, wrong, right."""
    per = layers.groupBy("identity", "wrong").agg(F.max_by("right", F.struct("priority", "ord")).alias("right"), F.min(F.struct("priority", "ord")).alias("at"))
    n = F.row_number().over(Window.partitionBy("identity").orderBy("at", "wrong")) - 1
    return per.select("identity", n.cast("long").alias("ord"), "wrong", "right")


def fix_text(text: Column, fixes: list[tuple[str, str]]) -> Column:
    """Whole-word, case-blind replacements with flexible blanks; longest key first, later ones see earlier results.

    fixes is one identity's small dimension; it becomes a chain of expressions.
    """
    for wrong, right in sorted(fixes, key=lambda f: -len(f[0])):
        key = r"\s+".join(re.escape(p) for p in wrong.split())
        text = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{Nd}}_]){key}(?![\p{{L}}\p{{Nd}}_])", right.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def apply_glossary(words: DataFrame, fixes: list[tuple[str, str]]) -> DataFrame:
    """words with glossary fixes: keys of most tokens, then of most characters, first; each pass takes its matches from
    left to right on the normalised words of the stream as it then is. A match becomes one word over its time.

    Words go through Python as a stream, in the order that a window by clip leaves, a clip at a time; those of clips that
    hold no first token of a key pass as they are, since a rewrite can add no token to them.
    """
    order = sorted(((w.lower().split(), r, w) for w, r in fixes if w.split()), key=lambda f: (-len(f[0]), -len(f[2])))
    starts = sorted({k[0] for k, _, _ in order})
    plain = lambda x: re.sub(r"[^a-z0-9']+", "", x.lower())
    keys = [(key, right, plain(right)) for key, right, _ in order]

    def rewrite(word: list, start: list, end: list, norm: list) -> tuple[list, list, list, list]:
        for key, right, token in keys:
            m = len(key)
            if m == 1:
                for at in [i for i, x in enumerate(norm) if x == key[0]]:
                    word[at], norm[at] = right, token
                continue
            found, free = [], 0
            for at in [i for i, x in enumerate(norm) if x == key[0]]:
                if at >= free and norm[at : at + m] == key:
                    found.append(at)
                    free = at + m
            if found:
                for at in found:
                    word[at], norm[at], end[at] = right, token, end[at + m - 1]
                gone = {at + k for at in found for k in range(1, m)}
                stay = [i for i in range(len(norm)) if i not in gone]
                word, start, end, norm = ([x[i] for i in stay] for x in (word, start, end, norm))
        return word, start, end, norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [*cols], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        clip, held, out = None, ([], [], [], []), tuple([] for _ in cols)

        def close(touched: bool) -> None:
            nonlocal held
            if held[0]:
                now = rewrite(*held) if touched else held
                for column, values in zip(out, ([clip] * len(now[0]), range(len(now[0])), *now), strict=True):
                    column.extend(values)
            held = ([], [], [], [])

        was = False
        for b in batches:
            ids = b.column("clip_id").to_pylist()
            rows = [b.column(c).to_pylist() for c in ("word", "start_ms", "end_ms", "norm")]
            marks, edges = b.column("touched"), [k for k in range(1, len(ids)) if ids[k] != ids[k - 1]]
            for a, z in zip([0, *edges], [*edges, len(ids)], strict=True):
                if a < z:
                    if ids[a] != clip:
                        close(was)
                        clip, was = ids[a], marks[a].as_py()
                    for column, values in zip(held, rows, strict=True):
                        column.extend(values[a:z])
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)
                out = tuple([] for _ in cols)
        close(was)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    cols = ["clip_id", "idx", "word", "start_ms", "end_ms", "norm"]
    whole = _by_clip().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = words.select(*cols).withColumn("touched", F.coalesce(F.max(F.col("norm").isin(starts)).over(whole), F.lit(False)))
    return marked.sortWithinPartitions("clip_id", "idx").drop("idx").mapInArrow(run, "clip_id long, idx long, word string, start_ms long, end_ms long, norm string")


# --- documents -----------------------------------------------------------------------------------


def srt(cues: DataFrame, upper: bool = False) -> DataFrame:
    """(clip_id, text): the kept cues of each clip as one SubRip text, numbered from 1."""
    n = F.row_number().over(Window.partitionBy("clip_id").orderBy("start_ms", "end_ms", "i"))
    line = F.array_join("words", " ")
    rows = cues.filter("keep").withColumn("n", n).withColumn("block", F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), F.upper(line) if upper else line, F.lit("\n")))
    return rows.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("text"))


def word_windows(fps: int) -> Column:
    """(from, dur) in frames of each word of a cue, relative to the cue: captured times if they fit, else an even split."""
    n = F.size("words")
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / n)).alias("s"), (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * (k + 1) / n)).alias("e")))
    times = F.when(n == 0, F.array().cast("array<struct<s:bigint,e:bigint>>")).when(F.size("word_times") == n, F.col("word_times")).otherwise(even)
    cue = to_frames(F.col("start_ms"), fps)

    def rel(w: Column) -> Column:
        begin = F.greatest(F.lit(0), to_frames(w["s"], fps) - cue)
        return F.struct(begin.cast("long").alias("from"), F.greatest(F.lit(1), to_frames(w["e"], fps) - cue - begin).cast("long").alias("dur"))

    return F.transform(times, rel)


def caption_props(cues: DataFrame, fps: int, upper: bool = True) -> DataFrame:
    """(clip_id, i, from_f, dur_f, text, words, emphasis, windows, start_ms, end_ms): what a renderer needs for each kept
    cue."""
    line = F.array_join("words", " ")
    start = to_frames(F.col("start_ms"), fps)
    words = F.transform("words", F.upper) if upper else F.col("words")
    return cues.filter("keep").select("clip_id", "i", start.alias("from_f"), F.greatest(F.lit(1), to_frames(F.col("end_ms"), fps) - start).cast("long").alias("dur_f"), (F.upper(line) if upper else line).alias("text"), words.alias("words"), "emphasis", word_windows(fps).alias("windows"), "start_ms", "end_ms")


def props_documents(props: DataFrame, safe_boxes: DataFrame | None = None, cue_boxes: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(clip_id, doc): one JSON document of each clip's props, cues in order, with words, emphasis and word timings.

    safe_boxes (clip_id, x, y, w, h) is the default box of a clip; cue_boxes (clip_id, i, x, y, w, h) holds for single
    cues that dodge something. parts: the number of partitions that cues lie in by clip, if that is known: their boxes are
    dealt to as many and make one table with them, so cues stay where they lie rather than being shuffled for a join.
    """
    box = F.struct(F.col("x"), F.col("y"), F.col("w").alias("width"), F.col("h").alias("height"))
    none = F.lit(None).cast("struct<x:bigint,y:bigint,width:bigint,height:bigint>")
    rows = props.withColumn("box", none)
    if cue_boxes is not None:
        own = cue_boxes.filter("clip_id IS NOT NULL AND i IS NOT NULL").groupBy("clip_id", "i").agg(F.collect_list(box).alias("boxes"))
        own = own.repartition(parts, "clip_id") if parts else own
        both = own.unionByName(props.withColumn("cue", F.lit(True)), allowMissingColumns=True)
        met = both.withColumn("boxes", F.first("boxes", True).over(Window.partitionBy("clip_id", "i"))).filter("cue")
        rows = met.select(*props.columns, F.explode_outer("boxes").alias("box"))
    timings = F.transform("windows", lambda w: F.struct(w["from"].alias("from"), w["dur"].alias("durationInFrames")))
    cue = F.struct("i", F.col("from_f").alias("from"), F.col("dur_f").alias("durationInFrames"), (F.col("start_ms") / 1000).alias("startSeconds"), (F.col("end_ms") / 1000).alias("endSeconds"), "text", "words", "emphasis", timings.alias("wordTimings"), "box")
    docs = rows.groupBy("clip_id").agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    docs = docs.join(safe_boxes.select("clip_id", box.alias("safeBox")), "clip_id", "left") if safe_boxes is not None else docs.withColumn("safeBox", none)
    return docs.select("clip_id", F.to_json(F.struct("safeBox", "cues")).alias("doc"))


def preview_samples(cues: DataFrame, n: int) -> DataFrame:
    """(clip_id, i, t_ms): midpoints of up to n evenly spaced cues; one sample is the middle cue."""
    w = Window.partitionBy("clip_id")
    rows = cues.withColumn("k", F.row_number().over(w.orderBy("i")) - 1).withColumn("c", F.count("*").over(w))
    take = F.least(F.lit(n), F.col("c"))
    wanted = F.when(take == 1, F.array(F.floor(F.col("c") / 2))).otherwise(F.transform(F.sequence(F.lit(0), take - 1), lambda i: F.rint(i * (F.col("c") - 1) / (take - 1)).cast("long")))
    return rows.filter(F.array_contains(wanted, F.col("k").cast("long"))).select("clip_id", "i", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("t_ms"))
