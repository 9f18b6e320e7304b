"""Rough cut: words and silences to keep and drop segments.

words: clip_id, idx, word, norm, start_ms, end_ms. durations: clip_id, duration_ms. All windows are by clip. Range joins
carry the clip and a time bucket, so one long clip spreads over tasks; the whole rough cut is a stream of clips.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipfleet.functions.dims import FILLERS, STOP_WORDS
from clipfleet.functions.exprs import normalize_token
from clipfleet.operators.intervals import BUCKET_MS, join_points, over_buckets


def _by_clip():
    return Window.partitionBy("clip_id").orderBy("idx")


def label_words(words: DataFrame, extra: Iterable[str] = (), false_starts: bool = True, max_gap_ms: int = 500) -> DataFrame:
    """words with `label`: filler, false-start (the same token follows within the gap) or null."""
    w = _by_clip()
    again = (F.col("norm") != "") & (F.col("norm") == F.lead("norm").over(w)) & (F.lead("start_ms").over(w) - F.col("end_ms") <= max_gap_ms)
    label = F.when(F.col("norm").isin(*FILLERS, *extra), "filler")
    return words.withColumn("label", label.when(again, "false-start") if false_starts else label)


def keep_runs(labelled: DataFrame, gap_ms: int = 600) -> DataFrame:
    """(clip_id, n, start_ms, end_ms): runs of kept words; a labelled word or a longer gap closes one."""
    block = F.sum(F.col("label").isNotNull().cast("long")).over(_by_clip())
    kept = labelled.withColumn("block", block).filter("label IS NULL")
    inside = Window.partitionBy("clip_id", "block").orderBy("idx")
    before = F.max("end_ms").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start_ms") - before > gap_ms).cast("long"), F.lit(0))
    runs = kept.withColumn("opens", opens).withColumn("run", F.sum("opens").over(inside))
    runs = runs.groupBy("clip_id", "block", "run").agg(F.min_by("start_ms", "idx").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("idx").alias("first"))
    n = F.row_number().over(Window.partitionBy("clip_id").orderBy("first")).cast("long")
    return runs.select("clip_id", n.alias("n"), "start_ms", "end_ms")


def pad_runs(runs: DataFrame, durations: DataFrame, lead_ms: int = 60, tail_ms: int = 150, strict: bool = False) -> DataFrame:
    """(clip_id, n, a_ms, b_ms): runs widened, but not over the bare edges of their neighbours. Where two pads meet in
    the gap between runs they overlap, unless strict, which parts such a gap in the middle."""
    w = Window.partitionBy("clip_id").orderBy("n")
    last = F.max("end_ms").over(Window.partitionBy("clip_id"))
    rows = runs.join(durations, "clip_id").withColumn("duration_ms", F.greatest("duration_ms", last))
    a = F.greatest(F.col("start_ms") - lead_ms, F.coalesce(F.lag("end_ms").over(w), F.lit(0)), F.lit(0))
    b = F.least(F.col("end_ms") + tail_ms, F.coalesce(F.lead("start_ms").over(w), F.col("duration_ms")), F.col("duration_ms"))
    rows = rows.withColumn("a_ms", a).withColumn("b_ms", F.greatest("a_ms", b))
    if strict:
        middle = lambda end, start: F.floor((end + start) / 2).cast("long")
        left = F.when(F.lag("b_ms").over(w) > F.col("a_ms"), middle(F.lag("end_ms").over(w), F.col("start_ms")))
        right = F.when(F.lead("a_ms").over(w) < F.col("b_ms"), middle(F.col("end_ms"), F.lead("start_ms").over(w)))
        rows = rows.withColumn("l", left).withColumn("r", right).withColumn("a_ms", F.coalesce("l", "a_ms")).withColumn("b_ms", F.coalesce("r", "b_ms"))
    return rows.select("clip_id", "n", "a_ms", "b_ms", "duration_ms")


def cut_pieces(pads: DataFrame, durations: DataFrame) -> DataFrame:
    """(clip_id, i, start_ms, end_ms, keep): keeps and the drops between them; a clip without runs is one keep."""
    w = Window.partitionBy("clip_id").orderBy("n")
    cursor, last = F.lag("b_ms", 1, 0).over(w), F.lead("n").over(w).isNull()
    piece = lambda s, e, k: F.struct(s.cast("long").alias("start_ms"), e.cast("long").alias("end_ms"), F.lit(k).alias("keep"))
    rows = durations.select("clip_id", F.col("duration_ms").alias("whole_ms")).join(pads, "clip_id", "left")
    parts = F.filter(F.array(piece(cursor, F.col("a_ms"), False), piece(F.col("a_ms"), F.col("b_ms"), True), F.when(last, piece(F.col("b_ms"), F.col("duration_ms"), False))), lambda x: x.isNotNull() & (x["end_ms"] > x["start_ms"]))
    rows = rows.select("clip_id", "n", F.when(F.col("n").isNull(), F.array(piece(F.lit(0), F.col("whole_ms"), True))).otherwise(parts).alias("p"))
    rows = rows.select("clip_id", "n", F.posexplode("p").alias("k", "x")).select("clip_id", "n", "k", "x.*")
    i = F.row_number().over(Window.partitionBy("clip_id").orderBy("n", "k")) - 1
    return rows.select("clip_id", i.cast("long").alias("i"), "start_ms", "end_ms", "keep")


def _over_words(segments: DataFrame, marks: DataFrame, meets: dict, parts: dict, whole: dict) -> DataFrame:
    """segments with what they find among marks (clip_id, bucket, ...) of their time buckets.

    Segments, a row for each of their buckets, and marks are one table by clip and bucket rather than the two sides of a
    join, so they are shuffled once and segments are computed once. Within a bucket parts are functions of the marks that a segment meets (meets, by name); whole puts those of its buckets together.
    """
    each = F.sequence(F.floor(F.col("start_ms") / BUCKET_MS), F.floor(F.greatest("start_ms", "end_ms") / BUCKET_MS))
    both = segments.select("clip_id", F.explode(each).alias("bucket"), F.struct(*[c for c in segments.columns if c != "clip_id"]).alias("s"))
    both = both.unionByName(marks.select("clip_id", "bucket", F.struct(*[c for c in marks.columns if c not in ("clip_id", "bucket")]).alias("m")), allowMissingColumns=True)
    # one shuffle by clip serves both groupings and what follows by clip
    rows = both.repartition("clip_id").groupBy("clip_id", "bucket").agg(F.collect_list("s").alias("s"), F.collect_list("m").alias("m"))
    found = F.transform("s", lambda s: F.struct(s.alias("s"), *[f(F.filter("m", partial(meets[n], s))).alias(n) for n, f in parts.items()]))
    rows = rows.select("clip_id", F.explode(found).alias("x")).select("clip_id", "x.s.*", *[f"x.{n}" for n in parts])
    own = [c for c in segments.columns if c not in ("clip_id", "i")]
    return rows.groupBy("clip_id", "i").agg(*[F.first(c).alias(c) for c in own], *[c.alias(n) for n, c in whole.items()])


def _centred(s, m):
    """Whether the centre of word m lies in segment s."""
    return (2 * s["start_ms"] <= m["twice"]) & (m["twice"] < 2 * s["end_ms"])


def _reached(s, m):
    """Whether labelled word m shares a positive time with the dropped segment s."""
    return ~s["keep"] & m["mark"].isNotNull() & (m["mark"]["ms"] < s["end_ms"]) & (m["mark"]["me"] > s["start_ms"])


def _read(found):
    return F.transform(found, lambda m: F.struct(m["idx"].alias("idx"), m["word"].alias("word")))


def _highest(found):
    return F.array_max(F.transform(found, lambda m: m["mark"]["rank"]))


def _text():
    return F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("words"))), lambda x: x["word"]), " ")


def _with_reason(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", F.when(F.col("keep"), "").when(F.col("rank") == 2, "filler").when(F.col("rank") == 1, "false-start").otherwise("silence")).drop("rank")


def _twice():
    return F.col("start_ms") + F.col("end_ms")


def _centre():
    """Time bucket of a word's centre."""
    return F.floor(_twice() / 2 / BUCKET_MS)


def _mark():
    """Time and rank of a labelled word."""
    return F.struct(F.col("start_ms").alias("ms"), F.col("end_ms").alias("me"), F.when(F.col("label") == "filler", 2).otherwise(1).alias("rank")).alias("mark")


def segment_text(segments: DataFrame, words: DataFrame) -> DataFrame:
    """segments with `text`: the words whose centre lies in [start, end), in order."""
    marks = words.select("clip_id", _centre().alias("bucket"), "idx", "word", _twice().alias("twice"))
    return _over_words(segments, marks, {"words": _centred}, {"words": _read}, {"text": _text()})


def drop_reasons(segments: DataFrame, labelled: DataFrame) -> DataFrame:
    """segments with `reason`: for drops filler before false-start before silence, by overlapping labelled words."""
    marks = over_buckets(labelled.filter("label IS NOT NULL").select("clip_id", "start_ms", "end_ms", "label"))
    marks = marks.select("clip_id", "bucket", _mark())
    return _with_reason(_over_words(segments, marks, {"rank": _reached}, {"rank": _highest}, {"rank": F.max("rank")}))


def _told(segments: DataFrame, labelled: DataFrame) -> DataFrame:
    """segments with `reason` and `text`, as of drop_reasons and segment_text, in one pass over the words: a labelled word
    stands in each bucket that it touches, any other in that of its centre."""
    touched = F.sequence(F.floor(F.col("start_ms") / BUCKET_MS), F.floor(F.col("end_ms") / BUCKET_MS))
    marked = F.col("label").isNotNull() & (F.col("end_ms") >= F.col("start_ms"))
    marks = labelled.select("clip_id", "idx", "word", _twice().alias("twice"), _centre().alias("home"), F.when(marked, _mark()).alias("mark"), F.explode(F.when(marked, touched).otherwise(F.array(_centre()))).alias("bucket"))
    # null in buckets other than that of its centre, so that the word is read once
    marks = marks.withColumn("twice", F.when(F.col("bucket") == F.col("home"), F.col("twice"))).drop("home")
    return _with_reason(_over_words(segments, marks, {"rank": _reached, "words": _centred}, {"rank": _highest, "words": _read}, {"rank": F.max("rank"), "text": _text()}))


def decisions(words: DataFrame, durations: DataFrame, trim: bool = True, gap_ms: int = 600, lead_ms: int = 60, tail_ms: int = 150, strict: bool = False) -> DataFrame:
    """(clip_id, i, start_ms, end_ms, keep, reason) of every clip; without trimming each clip is one keep."""
    if not trim:
        return _whole(durations).withColumn("reason", F.lit(""))
    labelled = label_words(words)
    return drop_reasons(cut_pieces(pad_runs(keep_runs(labelled, gap_ms), durations, lead_ms, tail_ms, strict), durations), labelled)


def _whole(durations: DataFrame) -> DataFrame:
    """Each clip as one keep."""
    zero = F.lit(0).cast("long")
    return durations.select("clip_id", zero.alias("i"), zero.alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit(True).alias("keep"))


def _within(values: np.ndarray, of: np.ndarray, at: np.ndarray, clip: np.ndarray, side: str) -> np.ndarray:
    """How many values (sorted by the number of their clip, of, then by size) lie in earlier clips, or in the given clip
    before the place `at`; on side right those at it count too."""
    if not len(values):
        return np.zeros(len(at), np.int64)
    low, high = values.min(), values.max()
    width = int(high - low) + 3
    key = (values - low).astype(np.int64) + 1 + of * width
    return np.searchsorted(key, np.clip(at - low + 1, 0, width - 1).astype(np.int64) + clip * width, side)


def _runs_of(clip: np.ndarray, idx: np.ndarray, start: np.ndarray, end: np.ndarray, label: np.ndarray, gap_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clip, start, end) of the runs, as of `keep_runs`, of words in order; words of one place share what precedes them, and the last of them says where a run starts."""

    def last_of(c: np.ndarray) -> np.ndarray:
        """The last row of each row's place."""
        ends = np.append((c[1:] != c[:-1]) | (idx[1:] != idx[:-1]), True)
        return np.flatnonzero(ends)[np.cumsum(ends) - ends]

    if not len(clip):
        return clip, start, end
    block = np.cumsum(label > 0)[last_of(clip)]
    at = label == 0
    clip, idx, start, end, block = clip[at], idx[at], start[at], end[at], block[at]
    if not len(clip):
        return clip, start, end
    new = np.concatenate([[True], (clip[1:] != clip[:-1]) | (block[1:] != block[:-1])])
    group = np.cumsum(new)
    low = np.nanmin(end) if not np.isnan(end).all() else 0.0
    size = np.where(np.isnan(end), 0, end - low + 1).astype(np.int64)  # 0: none
    width = int(size.max()) + 1
    before = np.concatenate([[0], np.maximum.accumulate(size + group * width)[:-1]]) - group * width
    opens = ~new & (before > 0) & (start - (before - 1 + low) > gap_ms)
    last = last_of(group)
    run = np.cumsum(opens)[last]
    first = np.flatnonzero(np.concatenate([[True], ~(group[1:] == group[:-1]) | (run[1:] != run[:-1])]))
    return clip[first], start[last[first]], np.fmax.reduceat(end, first)


def _beside(values: np.ndarray, clip: np.ndarray, k: int) -> np.ndarray:
    """The value of the row before (k = 1) or after (k = -1) in the same clip; not a number where there is none."""
    out = np.full(len(values), np.nan)
    same = clip[1:] == clip[:-1]
    if k > 0:
        out[1:] = np.where(same, values[:-1], np.nan)
    else:
        out[:-1] = np.where(same, values[1:], np.nan)
    return out


def _pieces_of(clip: np.ndarray, start: np.ndarray, end: np.ndarray, length: np.ndarray, given: np.ndarray, lead_ms: int, tail_ms: int, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(clip, start, end, keep) of the pieces, as of `pad_runs` and `cut_pieces`, that runs leave of clips with a length
    (given); a clip without runs is one keep."""
    or_else = lambda x, y: np.where(np.isnan(x), y, x)
    d = length.copy()
    if len(clip):
        first = np.flatnonzero(np.concatenate([[True], clip[1:] != clip[:-1]]))
        d[clip[first]] = np.fmax(d[clip[first]], np.fmax.reduceat(end, first))
    d = d[clip]
    a = np.fmax(np.fmax(start - lead_ms, or_else(_beside(end, clip, 1), 0)), 0)
    b = np.fmax(a, np.fmin(np.fmin(end + tail_ms, or_else(_beside(start, clip, -1), d)), d))
    if strict:
        left = np.where(_beside(b, clip, 1) > a, np.floor((_beside(end, clip, 1) + start) / 2), np.nan)
        right = np.where(_beside(a, clip, -1) < b, np.floor((end + _beside(start, clip, -1)) / 2), np.nan)
        a, b = or_else(left, a), or_else(right, b)
    cursor = or_else(_beside(b, clip, 1), 0)
    last = np.concatenate([clip[1:] != clip[:-1], [True]]) if len(clip) else np.zeros(0, bool)
    bare = np.setdiff1d(np.flatnonzero(given), clip)
    n, zero = np.arange(len(clip)), np.zeros(len(bare))
    of = np.concatenate([clip, clip, clip[last], bare])
    s, e = np.concatenate([cursor, a, b[last], zero]), np.concatenate([a, b, d[last], length[bare]])
    keep = np.concatenate([np.zeros(len(clip), bool), np.ones(len(clip), bool), np.zeros(int(last.sum()), bool), np.ones(len(bare), bool)])
    order = np.lexsort((np.concatenate([0 * n, 0 * n + 1, 0 * n[last] + 2, 0 * bare]), np.concatenate([n, n, n[last], 0 * bare]), of))
    order = order[(e > s)[order] | (order >= len(of) - len(bare))]
    return of[order], s[order], e[order], keep[order]


def _cut_of(rows: pa.Table, gap_ms: int, lead_ms: int, tail_ms: int, strict: bool) -> pa.RecordBatch:
    """The rough cut of whole clips, each a row of its length, if it has one, and its words in order."""
    plain = lambda c: rows.column(c).cast(pa.float64()).to_numpy()  # noqa: E731  null: not a number
    first, code = rows.column("__first").to_numpy(), plain("__code")
    ids = rows.column("clip_id").combine_chunks().take(pa.array(np.flatnonzero(first)))
    of = np.cumsum(first) - 1
    own = np.isnan(code)
    length, given = np.full(len(ids), np.nan), np.zeros(len(ids), bool)
    length[of[own]], given[of[own]] = plain("duration_ms")[own], True
    at = np.flatnonzero(~own)
    clip, start, end, code = of[at], plain("start_ms")[at], plain("end_ms")[at], code[at]
    word = rows.column("word").combine_chunks().take(pa.array(at))
    runs = _runs_of(clip, plain("idx")[at], start, end, code, gap_ms)
    told = given[runs[0]] & ids.is_valid().to_numpy(zero_copy_only=False)[runs[0]]  # no clip has no length
    pc_, s, e, keep = _pieces_of(*(x[told] for x in runs), length, given, lead_ms, tail_ms, strict)
    # words by their centre
    twice = start + end
    read = np.flatnonzero(~np.isnan(twice) & word.is_valid().to_numpy(zero_copy_only=False))
    read = read[np.lexsort((twice[read], clip[read]))]
    lo, hi = (_within(twice[read], clip[read], 2 * x, pc_, "left") for x in (s, e))
    n = np.maximum(hi - lo, 0)
    edges = np.concatenate([[0], np.cumsum(n)])
    place = read[np.arange(edges[-1]) - np.repeat(edges[:-1], n) + np.repeat(lo, n)]
    if np.any(read[1:] < read[:-1]):
        place = place[np.lexsort((place, np.repeat(np.arange(len(n)), n)))]
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), word.take(pa.array(place))), " ")
    # labelled words that begin before a drop's end, but those that end by its start
    rank = np.zeros(len(s), np.int64)
    for k in (1, 2):
        m = (code >= k) & (end >= start)
        ms, me = (np.lexsort((x[m], clip[m])) for x in (start, end))
        met = _within(start[m][ms], clip[m][ms], e, pc_, "left") > _within(end[m][me], clip[m][me], s, pc_, "right")
        rank[met & ~keep] = k
    reason = pa.array(["silence", "false-start", "filler", ""]).take(pa.array(np.where(keep, 3, rank)))
    number = np.arange(len(pc_)) - np.searchsorted(pc_, pc_, "left")
    long = lambda x: pa.array(x.astype(np.int64))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(pc_)), long(number), long(s), long(e), pa.array(keep), reason, text], ["clip_id", "i", "start_ms", "end_ms", "keep", "reason", "text"])


def _cut_stream(labelled: DataFrame, durations: DataFrame, gap_ms: int, lead_ms: int, tail_ms: int, strict: bool, parts: int | None) -> DataFrame:
    """Runs, pads, pieces, reasons and texts of whole clips in the stream of labelled words, by arrays over all clips of a
    batch: words are read once, and neither grouped nor shuffled. A length stands before the words of its clip."""
    code = F.when(F.col("label") == "filler", 2).when(F.col("label").isNotNull(), 1).otherwise(0)
    lengths = durations.select("clip_id", F.col("duration_ms").cast("long").alias("duration_ms"))
    lengths = lengths.repartition(parts, "clip_id") if parts else lengths
    rows = lengths.unionByName(labelled.select("clip_id", "idx", "word", "start_ms", "end_ms", code.alias("__code")), allowMissingColumns=True)
    order = [F.col("__code").isNotNull(), F.col("idx"), F.col("word")]
    first = F.row_number().over(Window.partitionBy("clip_id").orderBy(*order)) == 1
    rows = rows.withColumn("__first", first).sortWithinPartitions("clip_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            at = np.flatnonzero(b.column("__first").to_numpy(zero_copy_only=False))
            at = int(at[-1]) if len(at) else 0
            if at or (held and b.num_rows and b.column("__first")[0].as_py()):
                yield _cut_of(pa.Table.from_batches([*held, b.slice(0, at)]), gap_ms, lead_ms, tail_ms, strict)
                held = []
            held.append(b.slice(at))
        if sum(b.num_rows for b in held):
            yield _cut_of(pa.Table.from_batches(held), gap_ms, lead_ms, tail_ms, strict)

    kind = labelled.schema["clip_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"clip_id {kind}, i long, start_ms long, end_ms long, keep boolean, reason string, text string")


def rough_cut(words: DataFrame, durations: DataFrame, trim: bool = True, gap_ms: int = 600, lead_ms: int = 60, tail_ms: int = 150, strict: bool = False, parts: int | None = None) -> DataFrame:
    """(clip_id, i, start_ms, end_ms, keep, reason, text): decisions with the words that they hold. durations has a clip
    once. parts: the number of partitions that words lie in by clip, if that is known, so that they aren't shuffled."""
    if not trim:
        # one segment a clip: its words needn't meet it by time, so they stay where the clip lies
        texts = words.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("idx", "word", _twice().alias("twice")))).alias("w"))
        inside = F.filter("w", lambda x: (x["twice"] >= 0) & (x["twice"] < 2 * F.col("end_ms")))
        text = F.array_join(F.transform(inside, lambda x: x["word"]), " ")
        rows = decisions(words, durations, False).join(texts, "clip_id", "left").withColumn("text", F.coalesce(text, F.lit("")))
        return rows.select("clip_id", "i", "start_ms", "end_ms", "keep", "reason", "text")
    return _cut_stream(label_words(words), durations, gap_ms, lead_ms, tail_ms, strict, parts)


def overlap_flags(segments: DataFrame) -> DataFrame:
    """Keeps with `overlaps_prev`: whether one starts before the keep before it ends (wide pads allow that)."""
    w = Window.partitionBy("clip_id").orderBy("i")
    return segments.filter("keep").withColumn("overlaps_prev", F.coalesce(F.col("start_ms") < F.lag("end_ms").over(w), F.lit(False)))


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter("keep")


def cut_stats(segments: DataFrame) -> DataFrame:
    """Kept and source duration, counts, and dropped time by reason of each clip."""
    length = F.col("end_ms") - F.col("start_ms")
    of = lambda r: F.coalesce(F.sum(F.when(F.col("reason") == r, length)), F.lit(0))
    return segments.groupBy("clip_id").agg(F.coalesce(F.sum(F.when(F.col("keep"), length)), F.lit(0)).alias("kept_ms"), F.max("end_ms").alias("source_ms"), F.count("*").alias("n_segments"), F.sum(F.col("keep").cast("long")).alias("n_keep"), of("filler").alias("filler_ms"), of("false-start").alias("false_start_ms"), of("silence").alias("silence_ms"))


def read_silence_log(lines: DataFrame) -> DataFrame:
    """(clip_id, n, start_ms, end_ms) from (clip_id, line_no, line): an end closes only a pending start; an open last
    start has a null end."""
    value = F.rint(F.regexp_extract("line", r"silence_(?:start|end):\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).cast("double") * 1000).cast("long")
    events = lines.filter(F.col("line").rlike(r"silence_(?:start|end):\s*-?[0-9]")).withColumn("opens", F.col("line").contains("silence_start:")).withColumn("ms", value)
    w = Window.partitionBy("clip_id").orderBy("line_no")
    events = events.withColumn("was", F.lag("opens").over(w)).withColumn("from", F.lag("ms").over(w)).withColumn("last", F.lead("opens").over(w).isNull())
    closed = F.when(~F.col("opens") & F.col("was"), F.struct(F.col("from").alias("start_ms"), F.col("ms").alias("end_ms")))
    still = F.when(F.col("opens") & F.col("last"), F.struct(F.col("ms").alias("start_ms"), F.lit(None).cast("long").alias("end_ms")))
    found = events.select("clip_id", "line_no", F.coalesce(closed, still).alias("s")).filter("s IS NOT NULL")
    return found.select("clip_id", F.row_number().over(w).cast("long").alias("n"), "s.start_ms", "s.end_ms")


def speech_regions(silences: DataFrame, durations: DataFrame, min_ms: int = 1) -> DataFrame:
    """(clip_id, n, start_ms, end_ms): what silences leave of each clip, regions shorter than min_ms dropped."""
    s = silences.join(durations, "clip_id")
    hold = lambda c: F.least(F.greatest(c, F.lit(0)), F.col("duration_ms"))
    s = s.select("clip_id", "duration_ms", hold(F.col("start_ms")).alias("s"), hold(F.coalesce("end_ms", "duration_ms")).alias("e"))
    before = Window.partitionBy("clip_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = s.select("clip_id", F.coalesce(F.max("e").over(before), F.lit(0)).alias("start_ms"), F.col("s").alias("end_ms"))
    tail = durations.join(s.groupBy("clip_id").agg(F.max("e").alias("e")), "clip_id", "left").select("clip_id", F.coalesce("e", F.lit(0)).alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    found = gaps.unionByName(tail).filter((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") >= min_ms))
    n = F.row_number().over(Window.partitionBy("clip_id").orderBy("start_ms")).cast("long")
    return found.select("clip_id", n.alias("n"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


def silence_transcript(regions: DataFrame) -> DataFrame:
    """Marker words `[speech n]`, one for each region, that the rough cut takes like a transcript; their language is
    `und`."""
    word = F.concat(F.lit("[speech "), F.col("n").cast("string"), F.lit("]"))
    return regions.select("clip_id", (F.col("n") - 1).alias("idx"), word.alias("word"), "start_ms", "end_ms", normalize_token(word).alias("norm"), F.lit("und").alias("language"))


def active_at(overlays: DataFrame, probes: DataFrame) -> DataFrame:
    """Overlays with start <= t < end for each probe (clip_id, t_ms)."""
    return join_points(probes, overlays, "t_ms", "start_ms", "end_ms").filter("t_ms < end_ms")


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, pos, norm, m, keyword): tokens of each phrase; all are keywords if none is left without stop words."""
    tokens = F.filter(F.transform(F.split("phrase", r"\s+"), normalize_token), lambda x: x != "")
    each = queries.select("query_id", tokens.alias("q")).select("query_id", F.size("q").alias("m"), (F.size(F.filter("q", lambda x: ~x.isin(*STOP_WORDS))) == 0).alias("all"), F.posexplode("q").alias("pos", "norm"))
    return each.select("query_id", "pos", "norm", "m", (F.col("all") | ~F.col("norm").isin(*STOP_WORDS)).alias("keyword"))


def phrase_anchors(q: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, m, norm, pos, before, after): the rarest token of each phrase by counts (norm, n), its place, and the
    tokens on its sides. Phrases with a token that no word has are left out, as they can't match."""
    token = F.struct("n", "pos", "norm")
    all_ = F.array_sort(F.collect_list(F.struct("pos", "norm")))
    whole = q.join(counts, "norm").groupBy("query_id", "m").agg(F.min(token).alias("a"), all_.alias("all")).filter(F.size("all") == F.col("m"))
    at = lambda k: F.get("all", (F.col("a.pos") + k).cast("int"))["norm"]
    return whole.select("query_id", "m", "a.norm", "a.pos", at(-1).alias("before"), at(1).alias("after"))


def exact_places(words: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, clip_id, i, j): the first run of each clip that equals a whole phrase of q (query_tokens).

    Words are an index by position: a phrase probes it at its rarest token only, so a hot word is a probe only where a
    phrase has no rarer one. Places whose neighbours fit too are compared whole, with the words of their clips only.
    Anchors and places are stored, so that Spark knows how small they are and words needn't be shuffled to meet them.
    """
    from clipfleet.sources.scratch import stored

    w = _by_clip()
    seen = words.select("clip_id", "idx", "norm", F.lag("norm").over(w).alias("prev"), F.lead("norm").over(w).alias("next"))
    used = words.select("norm").join(q.select("norm").distinct(), "norm", "left_semi")
    anchors = stored(phrase_anchors(q, used.groupBy("norm").agg(F.count("*").alias("n"))), "anchors")
    hit = seen.join(anchors, "norm").filter("(before IS NULL OR before = prev) AND (after IS NULL OR after = next)")
    places = stored(hit.select("query_id", "m", "clip_id", (F.col("idx") - F.col("pos")).alias("i"), F.col("pos").alias("anchor")), "places")
    # the anchor and its neighbours are known to fit
    long = places.filter("m > 3 OR (m = 3 AND anchor <> 1)").join(q.select("query_id", "pos", "norm"), "query_id").filter("abs(pos - anchor) > 1")
    near = words.select("clip_id", "idx", "norm").join(places.select("clip_id").distinct(), "clip_id", "left_semi")
    whole = long.withColumn("idx", F.col("i") + F.col("pos")).join(near, ["clip_id", "idx", "norm"])
    far = F.greatest(F.lit(0), F.col("anchor") - 1) + F.greatest(F.lit(0), F.col("m") - 2 - F.col("anchor"))
    fits = whole.groupBy("query_id", "clip_id", "i", "m", "anchor").agg(F.count("*").alias("k")).filter(F.col("k") == far)
    one = places.filter("m < 3 OR (m = 3 AND anchor = 1)").unionByName(fits.drop("k"))
    return one.groupBy("query_id", "clip_id").agg(F.min("i").alias("i"), F.max("m").alias("m")).select("query_id", "clip_id", "i", (F.col("i") + F.col("m") - 1).alias("j"))


def propose_windows(words: DataFrame, queries: DataFrame, lead_ms: int = 0, tail_ms: int = 0, min_ms: int = 0, gap_ms: int = 600) -> DataFrame:
    """(query_id, clip_id, start_ms, end_ms, exact): the first run equal to the phrase, else the first..last keyword of
    pause-free cluster with the most distinct keywords, padded, clamped and stretched.

    Runs are probed at each phrase's rarest token; keyword hits are one row for each token of a cluster, with its times,
    before they meet the phrases. Tokens of phrases and exact runs are stored: they are small beside the words, which stay
    where their clips lie.
    """
    from clipfleet.sources.scratch import stored

    q = stored(query_tokens(queries), "phrase-tokens")
    w = _by_clip()
    exact = stored(exact_places(words, q), "exact")
    # with the times at which the clip begins and ends
    held = words.withColumn("lo", F.first("start_ms").over(w)).withColumn("hi", F.last("end_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    opens = F.coalesce((F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms).cast("long"), F.lit(0))
    clusters = held.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(w))
    keywords = q.filter("keyword").select("query_id", "norm").distinct()
    tokens = clusters.join(keywords.select("norm").distinct(), "norm", "left_semi").groupBy("clip_id", "cluster", "norm")
    tokens = tokens.agg(F.min("idx").alias("i"), F.min_by("start_ms", "idx").alias("s"), F.max("idx").alias("j"), F.max_by("end_ms", "idx").alias("e"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    best = tokens.join(keywords, "norm").groupBy("query_id", "clip_id", "cluster").agg(F.count("*").alias("distinct"), F.min_by("s", "i").alias("s"), F.max_by("e", "j").alias("e"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    first = F.min(F.struct((-F.col("distinct")).alias("few"), "cluster", "s", "e", "lo", "hi")).alias("x")
    fall = best.groupBy("query_id", "clip_id").agg(first).select("query_id", "clip_id", "x.s", "x.e", "x.lo", "x.hi").join(exact, ["query_id", "clip_id"], "left_anti")
    at = held.join(exact.select("clip_id").distinct(), "clip_id", "left_semi")
    one = at.select("clip_id", F.col("idx").alias("i"), F.col("start_ms").alias("s"), "lo", "hi")
    two = at.select("clip_id", F.col("idx").alias("j"), F.col("end_ms").alias("e"))
    found = exact.join(one, ["clip_id", "i"]).join(two, ["clip_id", "j"])
    spans = found.select("query_id", "clip_id", "s", "e", "lo", "hi", F.lit(True).alias("exact")).unionByName(fall.withColumn("exact", F.lit(False)))
    rows = spans.withColumn("s", F.greatest("lo", F.col("s") - lead_ms)).withColumn("e", F.least("hi", F.col("e") + tail_ms))
    lack = F.greatest(F.lit(min_ms) - (F.col("e") - F.col("s")), F.lit(0))
    rows = rows.withColumn("grown", lack > 0).withColumn("s1", F.greatest(F.col("lo"), F.col("s") - F.floor(lack / 2)))
    e1 = F.least(F.col("hi"), F.col("s1") + min_ms)
    rows = rows.withColumn("e1", F.when(F.col("grown"), e1).otherwise(F.col("e"))).withColumn("s2", F.when(F.col("grown"), F.greatest(F.col("lo"), F.col("e1") - min_ms)).otherwise(F.col("s")))
    return rows.select("query_id", "clip_id", F.col("s2").cast("long").alias("start_ms"), F.col("e1").cast("long").alias("end_ms"), "exact")
