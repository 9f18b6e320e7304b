"""Subject tracks and crop windows over time.

Sampling and interpolation are windows. Tracks that fit a task's memory with ease are smoothed and split as a stream, a
track at a time; nearly all do. Of longer ones the smoothing recurrences are scans in two levels over chunks: what a chunk
makes of the value before it is an affine map for means, and for limits a map of rising pieces whose corners are few; both
chain. Their keyframes come from splitting all tracks level by level.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipfleet.functions.exprs import half_even
from clipfleet.operators.intervals import as_of, join_points


def track_from_detections(boxes: DataFrame, frames: DataFrame, fps: int, width: int, height: int, sample_fps: int = 5) -> DataFrame:
    """(clip_id, frame_idx, cx2, cy2, conf, bx0, by0, bx1, by1): the largest box of each sampled frame (first on ties).

    cx2 and cy2 are twice the centre, so they are whole. Without a box the last cx holds (else the middle), cy is the
    middle and the confidence 0. frames: clip_id, n_frames. boxes: clip_id, frame_idx, ord, x, y, w, h.
    """
    step = max(1, round(fps / sample_fps))
    grid = frames.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1, F.lit(step).cast("long"))).alias("frame_idx"))
    best = boxes.groupBy("clip_id", "frame_idx").agg(F.max(F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("ord")).alias("late"), "x", "y", "w", "h")).alias("b"))
    rows = grid.join(best, ["clip_id", "frame_idx"], "left").withColumn("hit", F.col("b").isNotNull())
    cx2 = F.when(F.col("hit"), 2 * F.col("b.x") + F.col("b.w"))
    held = F.last(cx2, True).over(Window.partitionBy("clip_id").orderBy("frame_idx"))
    return rows.select("clip_id", "frame_idx", F.coalesce(held, F.lit(width)).cast("long").alias("cx2"), F.when(F.col("hit"), 2 * F.col("b.y") + F.col("b.h")).otherwise(height).cast("long").alias("cy2"), F.col("hit").cast("long").alias("conf"), F.col("b.x").alias("bx0"), F.col("b.y").alias("by0"), (F.col("b.x") + F.col("b.w")).alias("bx1"), (F.col("b.y") + F.col("b.h")).alias("by1"))


def resample_track(track: DataFrame, fps: int = 15) -> DataFrame:
    """(clip_id, g, t_ms, cx, cy): confident samples on an even grid from the first to the last, linear between."""
    sure = track.filter("conf > 0").select("clip_id", "t_ms", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    ends = sure.groupBy("clip_id").agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1"))
    n = F.greatest(F.lit(2), F.ceil((F.col("t1") - F.col("t0")) * fps / F.lit(1000.0)) + 1)
    grid = ends.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))).select("clip_id", "g", (F.col("t0") + F.col("g") * F.lit(1000.0) / fps).alias("t"), "t1")
    grid = grid.withColumn("t", F.least("t", F.col("t1").cast("double")))
    nxt = Window.partitionBy("clip_id").orderBy("t_ms")
    legs = sure.select("clip_id", F.col("t_ms").alias("ta"), F.lead("t_ms").over(nxt).alias("tb"), "cx", "cy", F.lead("cx").over(nxt).alias("cx1"), F.lead("cy").over(nxt).alias("cy1"))
    met = as_of(grid, legs.filter("tb IS NULL OR tb > ta"), "t", "ta").select("clip_id", "g", "t", "mark.*")
    lerp = lambda a, b: F.when(F.col("tb").isNull(), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * (F.col("t") - F.col("ta")) / (F.col("tb") - F.col("ta")))
    return met.select("clip_id", "g", F.col("t").alias("t_ms"), lerp("cx", "cx1").alias("cx"), lerp("cy", "cy1").alias("cy"))


# --- smoothing: scans in two levels -------------------------------------------------------------

#: Samples of one chunk of a track.
CHUNK = 512


def _means(values: list[float], before: float, keep: float) -> list[float]:
    """Exponential means of the values after a mean before them."""
    out = []
    for x in values:
        before = keep * before + (1 - keep) * x
        out.append(before)
    return out


def _held(values: list[float], before: float, limit: float) -> list[float]:
    """The values, each held to +-limit of the one before it."""
    out = []
    for x in values:
        before = min(max(x, before - limit), before + limit)
        out.append(before)
    return out


def _means_map(values: list[float], keep: float) -> list[tuple[float, float]]:
    """What a chunk makes of the mean before it: an affine map, by its values at 0 and 1."""
    zero = _means(values, 0.0, keep)[-1]
    return [(0.0, zero), (1.0, zero + keep ** len(values))]


def _held_map(values: list[float], limit: float) -> list[tuple[float, float]]:
    """What a chunk makes of the held value before it: rising pieces of slope 0 or 1, by their corners, with slope 1
    outside. One value draws what is before it toward itself by the limit; corners that come within the limit of it merge."""
    at: list[tuple[float, float]] = [(0.0, 0.0)]
    for x in values:
        lo, hi = x - limit, x + limit
        # [a, b] is what comes within the limit of x
        below, above = [p for p in at if p[1] < lo], [p for p in at if p[1] > hi]
        up, down = at[len(below) :], at[: len(at) - len(above)]
        a = up[0][0] - (up[0][1] - lo) if up else at[-1][0] + lo - at[-1][1]
        b = down[-1][0] + hi - down[-1][1] if down else at[0][0] - (at[0][1] - hi)
        at = [(v, y + limit) for v, y in below] + [(a, x), (b, x)] + [(v, y - limit) for v, y in above]
    return at


def _mapped(at: list[tuple[float, float]], v: float, affine: bool) -> float:
    if affine:
        return at[0][1] + (at[1][1] - at[0][1]) * v
    if v <= at[0][0]:
        return at[0][1] - (at[0][0] - v)
    if v >= at[-1][0]:
        return at[-1][1] + v - at[-1][0]
    i = bisect_right([p[0] for p in at], v) - 1
    (v0, y0), (v1, y1) = at[i], at[i + 1]
    return y0 if y1 == y0 else min(y1, y0 + v - v0)


def _scan(chunks: DataFrame, affine: bool, back: bool, strength: str) -> DataFrame:
    """chunks (clip_id, axis, c, v, ...) with v run through means (affine) or limits, backward or forward.

    Each chunk's map from what is before it to its last value is found in its own task; the maps of a clip, one small row
    a chunk, are then chained in order, and each chunk runs again from its own start.
    """
    turn = (lambda x: x[::-1]) if back else (lambda x: x)
    kind = "array<struct<v:double,y:double>>"

    @F.pandas_udf(kind)
    def mapped(v: pd.Series, by: pd.Series) -> pd.Series:
        found = [_means_map(turn(list(x)), k) if affine else _held_map(turn(list(x)), k) for x, k in zip(v, by, strict=True)]
        return pd.Series([[{"v": a, "y": b} for a, b in f] for f in found])

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, by: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([turn((_means if affine else _held)(turn(list(x)), b, k)) for x, k, b in zip(v, by, before, strict=True)])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, 0.0
        for b in batches:
            starts = []
            for clip, axis, at, first in zip(*(b.column(c).to_pylist() for c in ("clip_id", "axis", "map", "first")), strict=True):
                if (clip, axis) != key:
                    key, state = (clip, axis), first
                starts.append(state)
                state = _mapped([(p["v"], p["y"]) for p in at], state, affine)
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), b.column("axis"), b.column("c"), pa.array(starts, pa.float64())], names=["clip_id", "axis", "c", "before"])

    edge = F.element_at("v", -1 if back else 1)
    maps = chunks.select("clip_id", "axis", "c", mapped("v", strength).alias("map"), edge.alias("first"))
    maps = maps.repartition("clip_id", "axis").sortWithinPartitions("clip_id", "axis", F.desc("c") if back else F.asc("c"))
    starts = maps.mapInArrow(chain, "clip_id long, axis string, c long, before double")
    return chunks.join(starts, ["clip_id", "axis", "c"]).withColumn("v", run("v", strength, "before")).drop("before")


def smooth(samples: DataFrame, fps: int = 15, speed: float = 0.12, tau: float = 0.6, chunk: int = CHUNK) -> DataFrame:
    """samples (clip_id, axis, g, t_ms, raw, side; g counts from 0 in each clip and axis) with `v`: exponential means of
    raw forward, then backward; then steps held to `speed` sides a second forward, then backward.

    A track is cut into chunks, so a very long one spreads over tasks.
    """
    x = F.array_sort(F.collect_list(F.struct("g", "t_ms", "raw")))
    chunks = samples.groupBy("clip_id", "axis", F.expr(f"g div {chunk}").alias("c")).agg(x.alias("x"), F.max("side").alias("side"))
    chunks = chunks.withColumn("v", F.col("x.raw")).withColumn("keep", F.exp(F.lit(-1 / fps / tau))).withColumn("limit", F.col("side") * speed / fps)
    for affine, back in ((True, False), (True, True), (False, False), (False, True)):
        chunks = _scan(chunks, affine, back, "keep" if affine else "limit")
    each = chunks.select("clip_id", "axis", F.explode(F.arrays_zip("x", "v")).alias("s"))
    return each.select("clip_id", "axis", "s.x.g", "s.x.t_ms", "s.x.raw", "s.v")


def simplify(points: DataFrame, tolerance: float = 3.0, most: int = 200) -> DataFrame:
    """points (clip_id, axis, g, t_ms, v, ...) with `key`: those that keep the line through v(t_ms) within the tolerance,
    measured upright; both ends stay, and of equal distances the first point is kept.

    All open stretches of all tracks are split at once: one grouped maximum a level finds the farthest point of each, one
    join deals its points to the two sides. As many rounds as the splitting is deep; points of closed stretches leave.
    More than `most` rounds are an error.
    """
    from clipfleet.sources.scratch import rounds, stored

    own = ["clip_id", "axis"]
    with rounds(points.sparkSession):
        all_ = stored(points, "points", outlives=True)
        at = F.struct("g", F.col("t_ms").alias("t"), "v")
        ends = all_.groupBy(*own).agg(F.min(at).alias("a"), F.max(at).alias("b"))
        keys = ends.select(*own, F.explode(F.array("a.g", "b.g")).alias("g"))
        open_ = stored(all_.select(*own, "g", "t_ms", "v").join(ends, own).filter("g > a.g AND g < b.g"), "open")
        line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t_ms") - F.col("a.t")) / F.greatest(F.col("b.t") - F.col("a.t"), F.lit(1e-9))
        for _ in range(most):
            far = F.max(F.struct(F.abs(F.col("v") - line).alias("d"), (-F.col("g")).alias("late"), at.alias("p")))
            split = stored(open_.groupBy(*own, F.col("a.g").alias("from")).agg(far.alias("far")).filter(F.col("far.d") > tolerance).select(*own, "from", "far.p"), "split")
            if split.isEmpty():
                break
            keys = keys.union(split.select(*own, "p.g"))
            met = open_.withColumn("from", F.col("a.g")).join(split, [*own, "from"]).filter("g <> p.g")
            left = F.col("g") < F.col("p.g")
            met = met.select(*own, "g", "t_ms", "v", F.when(left, F.col("a")).otherwise(F.col("p")).alias("a"), F.when(left, F.col("p")).otherwise(F.col("b")).alias("b"))
            open_ = stored(met, "open")
        else:
            raise RuntimeError(f"splitting did not end in {most} rounds")
        keys = stored(keys.distinct().withColumn("key", F.lit(True)), "keys", outlives=True)
    return all_.join(keys, [*own, "g"], "left").withColumn("key", F.coalesce("key", F.lit(False)))


#: Samples of a track that one task smooths and splits at once: 55 minutes at 15 a second.
WHOLE = 50_000


def _split(t: np.ndarray, v: np.ndarray, first: np.ndarray, n: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether each point is kept, as of `simplify`, for tracks (their first point and length) that follow each other."""
    key = np.zeros(len(v), bool)
    a, b = first, first + n - 1
    key[a] = key[b] = True
    while True:
        inner = b - a > 1
        a, b = a[inner], b[inner]
        if not len(a):
            return key
        size = b - a - 1
        off = np.cumsum(size) - size
        of = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(of)) - off[of] + a[of] + 1
        p, q = a[of], b[of]
        d = np.abs(v[at] - (v[p] + (v[q] - v[p]) * (t[at] - t[p]) / np.maximum(t[q] - t[p], 1e-9)))
        top = np.maximum.reduceat(d, off)
        hits = np.flatnonzero(d == top[of])
        far = at[hits[np.searchsorted(of[hits], np.arange(len(a)))]][top > tolerance]
        a, b = a[top > tolerance], b[top > tolerance]
        key[far] = True
        a, b = np.concatenate([a, far]), np.concatenate([far, b])


def smooth_whole(samples: DataFrame, fps: int = 15, speed: float = 0.12, tau: float = 0.6, tolerance: float = 3.0) -> DataFrame:
    """`simplify` of `smooth` for tracks of which a task can hold any: one shuffle, then a stream of whole tracks."""
    keep = math.exp(-1 / fps / tau)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column("g").to_numpy() == 0)
            at = int(starts[-1]) if len(starts) else 0
            if len(starts) and (held or at):
                yield pa.Table.from_batches([*held, b.slice(0, at)])
                held = []
            held.append(b.slice(at))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole(batches):
            g, t, raw, side = (part.column(c).to_numpy() for c in ("g", "t_ms", "raw", "side"))
            first = np.flatnonzero(g == 0)
            n = np.diff(first, append=len(g))
            v = np.empty(len(g))
            for at, m in zip(first.tolist(), n.tolist(), strict=True):
                x, limit = raw[at : at + m].tolist(), float(side[at]) * speed / fps
                x = _means(x, x[0], keep)[::-1]
                x = _means(x, x[0], keep)[::-1]
                x = _held(x, x[0], limit)[::-1]
                v[at : at + m] = _held(x, x[0], limit)[::-1]
            rows = part.select(["clip_id", "axis", "g", "t_ms", "raw"]).append_column("v", pa.array(v)).append_column("key", pa.array(_split(t, v, first, n, tolerance)))
            yield from rows.combine_chunks().to_batches()

    rows = samples.select("clip_id", "axis", "g", "t_ms", "raw", "side").repartition("clip_id", "axis").sortWithinPartitions("clip_id", "axis", "g")
    return rows.mapInArrow(run, f"clip_id {samples.schema['clip_id'].dataType.simpleString()}, axis string, g long, t_ms double, raw double, v double, key boolean")


def smooth_tracks(grid: DataFrame, sizes: DataFrame, fps: int = 15, speed: float = 0.12, tolerance: float = 3.0, whole: int = WHOLE) -> DataFrame:
    """(clip_id, axis, g, t_ms, raw, v, key): both axes of each clip smoothed, with the points that keyframes need.

    sizes: clip_id, src_w, src_h. The step limit is `speed` source sides a second. Tracks of more than `whole` samples go
    by chunks and levels, which spread one over tasks but write all their points several times.
    """
    from clipfleet.sources.scratch import stored

    def axes(g: DataFrame) -> DataFrame:
        both = F.array(F.struct(F.lit("x").alias("axis"), F.col("cx").alias("raw"), F.col("src_w").alias("side")), F.struct(F.lit("y").alias("axis"), F.col("cy").alias("raw"), F.col("src_h").alias("side")))
        return g.join(sizes, "clip_id").select("clip_id", "g", "t_ms", F.explode(both).alias("a")).select("clip_id", "g", "t_ms", "a.*")

    grid = stored(grid, "grid")
    long = stored(grid.groupBy("clip_id").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("clip_id"), "long")
    if long.isEmpty():
        return smooth_whole(axes(grid), fps, speed, tolerance=tolerance)
    short = smooth_whole(axes(grid.join(long, "clip_id", "left_anti")), fps, speed, tolerance=tolerance)
    parted = simplify(smooth(axes(grid.join(long, "clip_id", "left_semi")), fps, speed), tolerance)
    return short.unionByName(parted.select(*short.columns))


def collapse_windows(windows: DataFrame, both: bool = True) -> DataFrame:
    """(clip_id, k, t_start_ms, t_end_ms, x, y, w, h): neighbours at the same place (x alone unless both) become one."""
    w = Window.partitionBy("clip_id").orderBy("k")
    same = F.col("x") == F.lag("x").over(w)
    same = same & (F.col("y") == F.lag("y").over(w)) if both else same
    rows = windows.withColumn("island", F.sum(F.when(same, 0).otherwise(1)).over(w))
    one = rows.groupBy("clip_id", "island").agg(F.min("t_start_ms").alias("t_start_ms"), F.max("t_end_ms").alias("t_end_ms"), *[F.min_by(c, "k").alias(c) for c in ("x", "y", "w", "h")])
    return one.select("clip_id", (F.col("island") - 1).cast("long").alias("k"), "t_start_ms", "t_end_ms", "x", "y", "w", "h")


def follow_crop(track: DataFrame, crops: DataFrame, lock: str = "none") -> DataFrame:
    """(clip_id, k, t_start_ms, t_end_ms, x, y, w, h): windows that follow the subject.

    lock none follows x around the subject at a fixed y; x, y or both keep the composition of the box (x, y) on those
    axes and park the other. crops: clip_id, src_w, src_h, crop_w, crop_h, x, y. Clips with fewer than two confident
    samples are left out; their crop is the static one.
    """
    enough = track.filter("conf > 0").groupBy("clip_id").agg(F.count("*").alias("c"), F.median("cx").alias("mx"), F.median("cy").alias("my")).filter("c > 1")
    some = track.join(enough.select("clip_id"), "clip_id", "left_semi")
    s = smooth_tracks(resample_track(some), crops.select("clip_id", "src_w", "src_h"))
    used = ["x"] if lock in ("none", "x") else ["y"] if lock == "y" else ["x", "y"]
    of = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("v"))).alias(f"v{axis}")
    at = s.groupBy("clip_id", "g", "t_ms").agg(of("x"), of("y"), F.bool_or(F.col("key") & F.col("axis").isin(used)).alias("key")).filter("key").drop("key")
    rows = at.join(enough.select("clip_id", "mx", "my"), "clip_id").join(crops, "clip_id")
    half = F.lit(2.0)
    x = {"none": F.col("vx") - F.col("crop_w") / half}.get(lock, F.col("x") + F.col("vx") - F.col("mx") if lock in ("x", "both") else F.col("x").cast("double"))
    y = F.col("y") + F.col("vy") - F.col("my") if lock in ("y", "both") else F.col("y").cast("double")
    hold = lambda v, src, crop: F.greatest(F.lit(0), F.least(half_even(v), F.col(src) - F.col(crop))).cast("long")
    w = Window.partitionBy("clip_id").orderBy("g")
    t = F.rint("t_ms").cast("long")
    rows = rows.select("clip_id", (F.row_number().over(w) - 1).cast("long").alias("k"), t.alias("t_start_ms"), F.coalesce(F.lead(t).over(w), t).alias("t_end_ms"), hold(x, "src_w", "crop_w").alias("nx"), hold(y, "src_h", "crop_h").alias("ny"), F.col("crop_w").alias("w"), F.col("crop_h").alias("h"))
    return collapse_windows(rows.withColumnRenamed("nx", "x").withColumnRenamed("ny", "y"), both=lock != "none")


def sample_crop(windows: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (clip_id, t_ms) with x and y between keyframes at t_start_ms, ends held, in thousandths of a pixel."""
    w = Window.partitionBy("clip_id").orderBy("k")
    legs = windows.select("clip_id", "k", F.col("t_start_ms").alias("ta"), F.lead("t_start_ms").over(w).alias("tb"), "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), (F.lag("k").over(w).isNull()).alias("first"))
    legs = legs.filter("tb IS NULL OR tb > ta OR first").withColumn("at", F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("ta")))
    met = as_of(probes, legs, "t_ms", "at").select("clip_id", "t_ms", "mark.*")
    share = F.when(F.col("tb").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("t_ms") - F.col("ta")))
    lerp = lambda a, b: F.when(F.col("tb").isNull(), F.col(a) * 1000).otherwise(F.col(a) * 1000 + F.floor((F.col(b) - F.col(a)) * 1000 * share / F.greatest(F.col("tb") - F.col("ta"), F.lit(1)))).cast("long")
    return met.select("clip_id", "t_ms", lerp("x", "x1").alias("mx"), lerp("y", "y1").alias("my"))


def subject_occupancy(windows: DataFrame, track: DataFrame, pad: int = 0) -> DataFrame:
    """windows with the median box (bx0..by1, widened by pad) of the confident samples in each closed interval; a plan
    of one window takes all samples."""
    n = F.count("*").over(Window.partitionBy("clip_id"))
    seen, counted = track.filter("conf > 0 AND bx0 IS NOT NULL").select("clip_id", "t_ms", "bx0", "by0", "bx1", "by1"), windows.withColumn("n", n)
    rows = counted.filter("n = 1").join(seen, "clip_id").unionByName(join_points(seen, counted.filter("n > 1"), "t_ms", "t_start_ms", "t_end_ms"))
    keys = ["clip_id", "k", "t_start_ms", "t_end_ms", "x", "y", "w", "h"]
    return rows.groupBy(*keys).agg(*[(F.median(c) + d * pad).alias(c) for c, d in (("bx0", -1), ("by0", -1), ("bx1", 1), ("by1", 1))])
