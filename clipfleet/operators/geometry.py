"""Crop and output geometry: column arithmetic on clips joined with small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfleet.functions.dims import aspect_presets, framing_intents, resolution_matrix
from clipfleet.functions.exprs import clamp, half_even

UPSCALE = 1.05


def crop_sides(src_w: Column, src_h: Column, aw: Column, ah: Column, scale: Column) -> tuple[Column, Column]:
    """Even sides of the widest crop of an aspect, then zoomed in by scale (1 or more)."""
    wide = src_h * aw <= src_w * ah
    even = lambda x: half_even(x / 2) * 2
    w = F.least(even(F.when(wide, src_h * aw / ah).otherwise(src_w)), src_w)
    h = F.least(even(F.when(wide, src_h).otherwise(src_w * ah / aw)), src_h)
    zoomed = lambda side, src: F.when(scale > 1, F.least(F.greatest(F.lit(2), half_even(side / scale / 2) * 2), src)).otherwise(side)
    return zoomed(w, src_w), zoomed(h, src_h)


def crop_dims(clips: DataFrame, scale: float | Column = 1.0) -> DataFrame:
    """clips (clip_id, src_w, src_h, aspect) with crop_w and crop_h; unknown aspects leave."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    rows = clips.join(F.broadcast(aspect_presets(clips.sparkSession)), "aspect")  # 7 rows
    w, h = crop_sides(F.col("src_w"), F.col("src_h"), F.col("aw"), F.col("ah"), scale)
    return rows.withColumn("crop_w", w).withColumn("crop_h", h)


def framing_to_window(crops: DataFrame, pan_x: Column, pan_y: Column) -> DataFrame:
    """crops with the window (x, y): centred at the pan (held in 0..1), held in the source."""
    edge = lambda pan, src, crop: clamp(half_even(clamp(pan, F.lit(0.0), F.lit(1.0)) * src - crop / F.lit(2.0)), F.lit(0), src - crop)
    return crops.withColumn("x", edge(pan_x, F.col("src_w"), F.col("crop_w")).cast("long")).withColumn("y", edge(pan_y, F.col("src_h"), F.col("crop_h")).cast("long"))


def window_to_framing(windows: DataFrame) -> DataFrame:
    """windows with the scale that gives their size again (width ratio, height ratio, 1: the first that does) and the
    pans of their centres. windows: src_w, src_h, aw, ah, crop_w, crop_h, x, y."""
    full_w, full_h = crop_sides(F.col("src_w"), F.col("src_h"), F.col("aw"), F.col("ah"), F.lit(1.0))

    def fits(s: Column) -> Column:
        w, h = crop_sides(F.col("src_w"), F.col("src_h"), F.col("aw"), F.col("ah"), s)
        return (w == F.col("crop_w")) & (h == F.col("crop_h"))

    tries = [F.greatest(F.lit(1.0), full_w / F.col("crop_w")), F.greatest(F.lit(1.0), full_h / F.col("crop_h"))]
    scale = F.when(fits(tries[0]), tries[0]).when(fits(tries[1]), tries[1]).otherwise(F.lit(1.0))
    mid = lambda at, size, src: clamp((at + size / F.lit(2.0)) / src, F.lit(0.0), F.lit(1.0))
    return windows.withColumn("scale", scale).withColumn("pan_x", mid(F.col("x"), F.col("crop_w"), F.col("src_w"))).withColumn("pan_y", mid(F.col("y"), F.col("crop_h"), F.col("src_h")))


def resolve_target(crops: DataFrame, selection: Column) -> DataFrame:
    """crops with tier, out_w, out_h: an explicit tier as it is; auto the highest tier within 5 % upscale, else the
    largest even box of the exact aspect."""
    best = crops.select("clip_id", "aspect", "crop_w", "crop_h", "aw", "ah", selection.alias("selection")).join(F.broadcast(resolution_matrix(crops.sparkSession)), "aspect")  # 28 rows
    fits = F.when(F.col("selection") == "auto", (F.col("tw") <= F.col("crop_w") * UPSCALE) & (F.col("th") <= F.col("crop_h") * UPSCALE)).otherwise(F.col("tier") == F.col("selection"))
    best = best.groupBy("clip_id", "aspect", "crop_w", "crop_h", "aw", "ah").agg(F.min(F.when(fits, F.struct("tier_rank", "tier", "tw", "th"))).alias("t"))
    m = F.least(F.floor(F.col("crop_w") / F.col("aw")), F.floor(F.col("crop_h") / F.col("ah")))
    m = m - m % 2  # every aspect has an odd side, so both sides are even where m is
    return best.select("clip_id", "aspect", "crop_w", "crop_h", F.coalesce("t.tier", F.lit("exact-fit")).alias("tier"), F.coalesce("t.tw", F.col("aw") * m).alias("out_w"), F.coalesce("t.th", F.col("ah") * m).alias("out_h"))


def zoom_budget(crops: DataFrame, requested: float, allow_upscale: bool = False) -> DataFrame:
    """crops (with native crop and out sizes) with max_zoom, the zoom used, and whether the output stays within 5 %."""
    most = F.greatest(F.lit(1.0), F.least(F.col("crop_w") * UPSCALE / F.col("out_w"), F.col("crop_h") * UPSCALE / F.col("out_h")))
    zoom = F.greatest(F.lit(1.0), F.lit(float(requested)))
    zoom = zoom if allow_upscale else F.least(zoom, most)
    rows = crops.withColumn("max_zoom", most).withColumn("zoom", zoom)
    upscale = F.greatest(F.col("out_w") * F.col("zoom") / F.col("crop_w"), F.col("out_h") * F.col("zoom") / F.col("crop_h"))
    return rows.withColumn("upscale", upscale).withColumn("within", upscale <= UPSCALE + 1e-9)


def subject_centre(track: DataFrame) -> DataFrame:
    """(clip_id, cx, cy, any_cx, any_cy, n_confident, first_ms, last_ms): medians of confident and of all samples."""
    sure = lambda c: F.median(F.when(F.col("conf") > 0, F.col(c)))
    return track.groupBy("clip_id").agg(sure("cx").alias("cx"), sure("cy").alias("cy"), F.median("cx").alias("any_cx"), F.median("cy").alias("any_cy"), F.sum((F.col("conf") > 0).cast("long")).alias("n_confident"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))


def propose_framing(crops: DataFrame, centres: DataFrame, intent: Column) -> DataFrame:
    """crops with scale, pan_x and pan_y: the intent's scale, and pans that put the subject where the intent wants it;
    without a subject the middle."""
    rows = crops.withColumn("intent", intent).join(F.broadcast(framing_intents(crops.sparkSession)), "intent").join(centres.select("clip_id", "cx", "cy"), "clip_id", "left")
    scale = F.greatest(F.lit(1.0), F.col("subject_scale"))
    _, h = crop_sides(F.col("src_w"), F.col("src_h"), F.col("aw"), F.col("ah"), scale)
    pan_y = (F.col("cy") - F.col("y_frac") * h + h / F.lit(2.0)) / F.col("src_h")
    hold = lambda c: clamp(c, F.lit(0.0), F.lit(1.0))
    return rows.withColumn("scale", scale).withColumn("pan_x", F.when(F.col("cx").isNull(), 0.5).otherwise(hold(F.col("cx") / F.col("src_w")))).withColumn("pan_y", F.when(F.col("cy").isNull() | F.col("y_frac").isNull(), 0.5).otherwise(hold(pan_y)))


def crop_anchor_y(crops: DataFrame, centres: DataFrame, pan_y: Column, y_frac: Column) -> DataFrame:
    """crops with y: by pan_y, else the fraction that anchors the median subject, else the middle; held in the source."""
    rows = crops.join(centres.select("clip_id", "cy", "any_cy"), "clip_id", "left")
    cy = F.coalesce("cy", "any_cy", F.col("src_h") / F.lit(2.0))
    y = F.when(pan_y.isNotNull(), pan_y * F.col("src_h") - F.col("crop_h") / F.lit(2.0)).when(y_frac.isNotNull(), cy - y_frac * F.col("crop_h")).otherwise((F.col("src_h") - F.col("crop_h")) / F.lit(2.0))
    return rows.withColumn("y", clamp(half_even(y), F.lit(0), F.col("src_h") - F.col("crop_h")).cast("long"))


def static_crop(crops: DataFrame, centres: DataFrame, pan_x: Column, pan_y: Column, y_frac: Column, duration_ms: Column) -> DataFrame:
    """(clip_id, k, t_start_ms, t_end_ms, x, y, w, h): one window over the whole clip at the pan, or at the subject's
    median."""
    rows = crop_anchor_y(crops, centres, pan_y, y_frac).join(centres.select("clip_id", "cx", "any_cx", "first_ms", "last_ms"), "clip_id", "left")
    cx = F.coalesce("cx", "any_cx", F.col("src_w") / F.lit(2.0))
    x = F.when(pan_x.isNotNull(), pan_x * F.col("src_w")).otherwise(cx) - F.col("crop_w") / F.lit(2.0)
    return rows.select("clip_id", F.lit(0).cast("long").alias("k"), F.coalesce("first_ms", F.lit(0)).alias("t_start_ms"), F.greatest(F.coalesce(duration_ms, F.lit(0)), F.coalesce("last_ms", F.lit(0))).alias("t_end_ms"), clamp(half_even(x), F.lit(0), F.col("src_w") - F.col("crop_w")).cast("long").alias("x"), "y", F.col("crop_w").alias("w"), F.col("crop_h").alias("h"))


def edit_framing(proposals: DataFrame, edits: DataFrame) -> DataFrame:
    """proposals (clip_id, scale, pan_x, pan_y) with hand edits (clip_id, scale, pan_x, pan_y, reset) applied.

    An edit makes a framing custom and keeps the proposal beside it; a reset brings the proposal back.
    """
    p = proposals.select("clip_id", F.struct("scale", "pan_x", "pan_y").alias("proposal"))
    e = edits.select("clip_id", F.struct("scale", "pan_x", "pan_y").alias("edit"), "reset")
    custom = F.col("edit").isNotNull() & ~F.coalesce("reset", F.lit(False))
    return p.join(e, "clip_id", "left").select("clip_id", F.when(custom, F.col("edit")).otherwise(F.col("proposal")).alias("framing"), "proposal", custom.alias("custom"))


def subject_to_frame(rows: DataFrame, out_w: Column, out_h: Column) -> DataFrame:
    """rows with the rectangle (ox, oy, ow, oh) of bx0..by1 seen through the window x, y, w, h; those outside leave."""
    put = lambda v, at, size, out: clamp(half_even((v - at) * out / size), F.lit(0), out)
    x0, x1 = put(F.col("bx0"), F.col("x"), F.col("w"), out_w), put(F.col("bx1"), F.col("x"), F.col("w"), out_w)
    y0, y1 = put(F.col("by0"), F.col("y"), F.col("h"), out_h), put(F.col("by1"), F.col("y"), F.col("h"), out_h)
    return rows.withColumn("ox", x0.cast("long")).withColumn("oy", y0.cast("long")).withColumn("ow", (x1 - x0).cast("long")).withColumn("oh", (y1 - y0).cast("long")).filter("ow > 0 AND oh > 0")


def target_invalidation(history: DataFrame) -> DataFrame:
    """(project_id, seq, effective, invalidated): an aspect change resets the resolution to auto and all that follows;
    a resolution change alone what depends on pixels. history: project_id, seq, aspect, resolution."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_id").orderBy("seq")
    first = F.lag("seq").over(w).isNull()
    turned = ~first & (F.col("aspect") != F.lag("aspect").over(w))
    rows = history.withColumn("first", first).withColumn("turned", turned).withColumn("effective", F.when(turned, "auto").otherwise(F.col("resolution")))
    rows = rows.withColumn("before", F.lag("effective").over(w))
    all_, some = F.lit("framing,reframe,safezone,captions,qc"), F.lit("safezone,captions,qc")
    return rows.select("project_id", "seq", "effective", F.when(F.col("first"), "").when(F.col("turned"), all_).when(F.col("effective") != F.col("before"), some).otherwise("").alias("invalidated"))
