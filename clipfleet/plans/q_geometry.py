"""Queries of crops, framing, targets and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipfleet.functions import dims
from clipfleet.operators import geometry as G
from clipfleet.operators import tracks as T
from clipfleet.plans.base import Tables, query

_even = lambda x: f"CAST(round_even({x} / 2.0, 0) AS BIGINT)"
_side = lambda s, src, k: f"least(greatest(2, CAST(round_even({s} / {k} / 2, 0) AS BIGINT) * 2), {src})"
_clamp = lambda x, hi: f"greatest(0, least({x}, {hi}))"
_int = lambda x: f"CAST(round_even({x}, 0) AS BIGINT)"
_matrix = [(a, t, k, *dims.RESOLUTIONS[a][k]) for a in dims.RESOLUTIONS for k, t in enumerate(dims.TIERS)]

STEPS = {
    "presets": f"SELECT * FROM {dims.values_sql(dims.ASPECTS, 'aspect, aw, ah')}",
    "matrix": f"SELECT * FROM {dims.values_sql(_matrix, 'aspect, tier, tier_rank, tw, th')}",
    "full_crops": """SELECT *, least(CAST(round_even(CASE WHEN src_h * aw <= src_w * ah THEN CAST(src_h * aw AS DOUBLE) / ah ELSE src_w END / 2.0, 0) AS BIGINT) * 2, src_w) AS crop_w,
  least(CAST(round_even(CASE WHEN src_h * aw <= src_w * ah THEN src_h ELSE CAST(src_w * ah AS DOUBLE) / aw END / 2.0, 0) AS BIGINT) * 2, src_h) AS crop_h FROM clips JOIN presets USING (aspect)""",
    "zoomed": f"SELECT clip_id, aspect, src_w, src_h, {_side('crop_w', 'src_w', 1.3)} AS crop_w, {_side('crop_h', 'src_h', 1.3)} AS crop_h, crop_w AS full_w, crop_h AS full_h FROM full_crops",
    "panned": f"SELECT *, {_clamp(_int('(clip_id % 11) / 10.0 * src_w - crop_w / 2.0'), 'src_w - crop_w')} AS x, {_clamp(_int('(clip_id % 7) / 6.0 * src_h - crop_h / 2.0'), 'src_h - crop_h')} AS y FROM zoomed",
    "targets": """SELECT c.clip_id, c.aspect, crop_w, crop_h, coalesce(arg_min(tier, tier_rank) FILTER (WHERE ok), 'exact-fit') AS tier, coalesce(arg_min(tw, tier_rank) FILTER (WHERE ok), max(aw * (m - m % 2))) AS out_w, coalesce(arg_min(th, tier_rank) FILTER (WHERE ok), max(ah * (m - m % 2))) AS out_h
  FROM (SELECT f.*, tier, tier_rank, tw, th, least(crop_w // aw, crop_h // ah) AS m, CASE clip_id % 5 WHEN 0 THEN tier = '4k' WHEN 1 THEN tier = '720p' ELSE tw <= crop_w * CAST(1.05 AS DOUBLE) AND th <= crop_h * CAST(1.05 AS DOUBLE) END AS ok FROM full_crops f JOIN matrix USING (aspect)) c GROUP BY c.clip_id, c.aspect, crop_w, crop_h""",
    "centres": "SELECT clip_id, median(cx) FILTER (WHERE conf > 0) AS cx, median(cy) FILTER (WHERE conf > 0) AS cy, median(cx) AS any_cx, median(cy) AS any_cy, CAST(count(*) FILTER (WHERE conf > 0) AS BIGINT) AS n_confident, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM subject_track GROUP BY clip_id",
    # the clips of the tracks, with the portrait crop of a 1920 x 1080 source
    "tracked": "SELECT clip_id, CAST(1920 AS BIGINT) AS src_w, CAST(1080 AS BIGINT) AS src_h, CAST(608 AS BIGINT) AS crop_w, CAST(1080 AS BIGINT) AS crop_h FROM centres",
    "tight": "SELECT clip_id, src_w, src_h, CAST(468 AS BIGINT) AS crop_w, CAST(830 AS BIGINT) AS crop_h FROM tracked",
    "sure": "SELECT clip_id, t_ms AS ta, lead(t_ms) OVER w AS tb, cx, cy, lead(cx) OVER w AS cx1, lead(cy) OVER w AS cy1 FROM subject_track WHERE conf > 0 WINDOW w AS (PARTITION BY clip_id ORDER BY t_ms)",
    "grid_n": "SELECT clip_id, min(ta) AS t0, max(ta) AS t1, greatest(2, CAST(ceil((max(ta) - min(ta)) * 15 / 1000.0) AS BIGINT) + 1) AS n FROM sure GROUP BY clip_id",
    "grid": "SELECT clip_id, g, least(t0 + g * CAST(1000 AS DOUBLE) / 15, t1) AS t FROM (SELECT clip_id, t0, t1, unnest(range(n)) AS g FROM grid_n) z",
    "moves": "SELECT clip_id, CAST(n AS BIGINT) AS k, t_ms AS t_start_ms, t_ms + 200 AS t_end_ms, cx // 400 * 100 AS x, cy // 500 * 100 AS y FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms) - 1 AS n FROM subject_track) s",
    "islands": "SELECT *, sum(o) OVER (PARTITION BY clip_id ORDER BY k) - 1 AS island FROM (SELECT *, CASE WHEN x = lag(x) OVER w AND y = lag(y) OVER w THEN 0 ELSE 1 END AS o FROM moves WINDOW w AS (PARTITION BY clip_id ORDER BY k)) i",
    "windows": "SELECT clip_id, CAST(island AS BIGINT) AS k, min(t_start_ms) AS t_start_ms, max(t_end_ms) AS t_end_ms, min(x) AS x, min(y) AS y, CAST(608 AS BIGINT) AS w, CAST(1080 AS BIGINT) AS h FROM islands GROUP BY clip_id, island",
}


def full_crops(t: Tables):
    return G.crop_dims(t.clips)


def tracked(t: Tables, w: int = 608, h: int = 1080):
    size = {"src_w": 1920, "src_h": 1080, "crop_w": w, "crop_h": h}
    return G.subject_centre(t.subject_track).select("clip_id", *[F.lit(v).cast("long").alias(k) for k, v in size.items()])


def moves(t: Tables):
    return t.subject_track.select("clip_id", F.floor(F.col("t_ms") / 200).alias("k"), F.col("t_ms").alias("t_start_ms"), (F.col("t_ms") + 200).alias("t_end_ms"), (F.floor(F.col("cx") / 400) * 100).alias("x"), (F.floor(F.col("cy") / 500) * 100).alias("y"), F.lit(608).cast("long").alias("w"), F.lit(1080).cast("long").alias("h"))


@query("SELECT clip_id, z.crop_w, z.crop_h, f.crop_w AS full_w, f.crop_h AS full_h FROM zoomed z JOIN full_crops f USING (clip_id)", STEPS)
def crop_dims(t: Tables):
    full = full_crops(t).select("clip_id", F.col("crop_w").alias("full_w"), F.col("crop_h").alias("full_h"))
    return G.crop_dims(t.clips, 1.3).select("clip_id", "crop_w", "crop_h").join(full, "clip_id")


@query("SELECT clip_id, x, y, crop_w, crop_h FROM panned", STEPS)
def framing_to_window(t: Tables):
    return G.framing_to_window(G.crop_dims(t.clips, 1.3), (F.col("clip_id") % 11) / 10, (F.col("clip_id") % 7) / 6).select("clip_id", "x", "y", "crop_w", "crop_h")


@query("SELECT clip_id, x, y, crop_w, crop_h FROM panned", STEPS)
def window_round_trip(t: Tables):
    there = G.framing_to_window(G.crop_dims(t.clips, 1.3), (F.col("clip_id") % 11) / 10, (F.col("clip_id") % 7) / 6)
    back = G.window_to_framing(there).select("clip_id", "src_w", "src_h", "aspect", "scale", "pan_x", "pan_y")
    again = G.framing_to_window(G.crop_dims(back, F.col("scale")), F.col("pan_x"), F.col("pan_y"))
    return again.select("clip_id", "x", "y", "crop_w", "crop_h")


@query("SELECT clip_id, tier, out_w, out_h FROM targets", STEPS)
def resolve_target(t: Tables):
    pick = F.when(F.col("clip_id") % 5 == 0, "4k").when(F.col("clip_id") % 5 == 1, "720p").otherwise("auto")
    return G.resolve_target(full_crops(t), pick).select("clip_id", "tier", "out_w", "out_h")


@query("""SELECT clip_id, CAST(round(zoom * 1000000) AS BIGINT) AS zoom_micro, greatest(out_w * zoom / crop_w, out_h * zoom / crop_h) <= 1.05 + 1e-9 AS within FROM (
  SELECT *, least(CAST(1.5 AS DOUBLE), greatest(CAST(1 AS DOUBLE), least(crop_w * CAST(1.05 AS DOUBLE) / out_w, crop_h * CAST(1.05 AS DOUBLE) / out_h))) AS zoom FROM targets) z""", STEPS)
def zoom_budget(t: Tables):
    pick = F.when(F.col("clip_id") % 5 == 0, "4k").when(F.col("clip_id") % 5 == 1, "720p").otherwise("auto")
    rows = G.zoom_budget(G.resolve_target(full_crops(t), pick), 1.5)
    return rows.select("clip_id", F.round(F.col("zoom") * 1000000).cast("long").alias("zoom_micro"), "within")


@query("SELECT clip_id, cx, cy, any_cx, any_cy, n_confident, first_ms, last_ms FROM centres", STEPS)
def subject_centre(t: Tables):
    return G.subject_centre(t.subject_track)


@query(f"SELECT clip_id, intent, CAST(round(greatest(0, least(1, coalesce(cx / 1920.0, 0.5))) * 1000000) AS BIGINT) AS pan_x, CAST(round(greatest(0, least(1, coalesce((cy - y_frac * h + h / 2.0) / 1080.0, 0.5))) * 1000000) AS BIGINT) AS pan_y FROM (SELECT *, CASE WHEN scale > 1 THEN {_side('1080', '1080', 'scale')} ELSE 1080 END AS h FROM (SELECT c.*, i.intent, i.scale, i.y_frac FROM centres c JOIN (SELECT intent, CAST(scale AS DOUBLE) AS scale, CAST(y_frac AS DOUBLE) AS y_frac FROM {dims.values_sql([r[:3] for r in dims.INTENTS], 'intent, scale, y_frac')}) i ON i.intent = CASE c.clip_id % 3 WHEN 0 THEN 'talking-head' WHEN 1 THEN 'performer' ELSE 'wide-context' END) j) p", STEPS)
def propose_framing(t: Tables):
    crops = tracked(t).withColumn("aw", F.lit(9)).withColumn("ah", F.lit(16))
    pick = F.when(F.col("clip_id") % 3 == 0, "talking-head").when(F.col("clip_id") % 3 == 1, "performer").otherwise("wide-context")
    rows = G.propose_framing(crops, G.subject_centre(t.subject_track), pick)
    return rows.select("clip_id", "intent", F.round(F.col("pan_x") * 1000000).cast("long").alias("pan_x"), F.round(F.col("pan_y") * 1000000).cast("long").alias("pan_y"))


@query(f"SELECT clip_id, greatest(0, least({_int('CASE clip_id % 3 WHEN 0 THEN 0.4 * 1080 - 415 WHEN 1 THEN coalesce(cy, any_cy, 540) - 0.35 * 830 ELSE 125 END')}, 250)) AS y FROM tight JOIN centres USING (clip_id)", STEPS)
def crop_anchor_y(t: Tables):
    pan, frac = F.when(F.col("clip_id") % 3 == 0, 0.4), F.when(F.col("clip_id") % 3 == 1, 0.35)
    return G.crop_anchor_y(tracked(t, 468, 830), G.subject_centre(t.subject_track), pan, frac).select("clip_id", "y")


@query(f"SELECT clip_id, CAST(0 AS BIGINT) AS k, first_ms AS t_start_ms, last_ms AS t_end_ms, greatest(0, least({_int('coalesce(cx, any_cx, 960) - 304')}, 1312)) AS x, CAST(0 AS BIGINT) AS y, CAST(608 AS BIGINT) AS w, CAST(1080 AS BIGINT) AS h FROM centres", STEPS)
def static_crop(t: Tables):
    none = F.lit(None).cast("double")
    return G.static_crop(tracked(t), G.subject_centre(t.subject_track), none, none, none, F.lit(None).cast("long"))


@query("SELECT clip_id, CASE WHEN clip_id % 4 = 1 AND clip_id % 8 <> 1 THEN 150 ELSE 100 END AS scale_pct, clip_id % 4 = 1 AND clip_id % 8 <> 1 AS custom FROM clips", STEPS)
def edit_framing(t: Tables):
    p = t.clips.select("clip_id", F.lit(1.0).alias("scale"), F.lit(0.5).alias("pan_x"), F.lit(0.5).alias("pan_y"))
    e = t.clips.filter("clip_id % 4 = 1").select("clip_id", F.lit(1.5).alias("scale"), F.lit(0.2).alias("pan_x"), F.lit(0.8).alias("pan_y"), (F.col("clip_id") % 8 == 1).alias("reset"))
    return G.edit_framing(p, e).select("clip_id", F.rint(F.col("framing.scale") * 100).cast("long").alias("scale_pct"), "custom")


@query("""SELECT project_id, seq, eff AS effective, CASE WHEN seq = 1 THEN '' WHEN turned THEN 'framing,reframe,safezone,captions,qc' WHEN eff <> lag(eff) OVER w THEN 'safezone,captions,qc' ELSE '' END AS invalidated FROM (
  SELECT *, CASE WHEN turned THEN 'auto' ELSE resolution END AS eff FROM (SELECT *, coalesce(aspect <> lag(aspect) OVER (PARTITION BY project_id ORDER BY seq), false) AS turned FROM target_history) a) b WINDOW w AS (PARTITION BY project_id ORDER BY seq)""")
def target_invalidation(t: Tables):
    return G.target_invalidation(t.target_history)


@query("""SELECT f.clip_id, f.frame_idx, CAST(coalesce(last_value(2 * x + w IGNORE NULLS) OVER (PARTITION BY f.clip_id ORDER BY f.frame_idx), 1920) AS BIGINT) AS cx2, coalesce(2 * y + h, 1080) AS cy2, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS conf, x AS bx0, y AS by0, x + w AS bx1, y + h AS by1
FROM (SELECT clip_id, unnest(range(0, max(frame_idx) + 3, 2)) AS frame_idx FROM detections GROUP BY clip_id) f
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY w * h DESC, ord, x DESC, y DESC) AS r FROM detections) d WHERE r = 1) b ON b.clip_id = f.clip_id AND b.frame_idx = f.frame_idx""")
def track_from_detections(t: Tables):
    frames = t.detections.groupBy("clip_id").agg((F.max("frame_idx") + 3).alias("n_frames"))
    return T.track_from_detections(t.detections, frames, 10, 1920, 1080)


@query("SELECT g.clip_id, g.g, CAST(round(CASE WHEN tb IS NULL THEN cx ELSE cx + (cx1 - cx) * (t - ta) / (tb - ta) END * 1000) AS BIGINT) AS cx_milli, CAST(round(CASE WHEN tb IS NULL THEN cy ELSE cy + (cy1 - cy) * (t - ta) / (tb - ta) END * 1000) AS BIGINT) AS cy_milli FROM grid g JOIN sure s ON s.clip_id = g.clip_id AND ta <= t AND (tb IS NULL OR t < tb)", STEPS)
def resample_track(t: Tables):
    rows = T.resample_track(t.subject_track)
    return rows.select("clip_id", "g", F.round(F.col("cx") * 1000).cast("long").alias("cx_milli"), F.round(F.col("cy") * 1000).cast("long").alias("cy_milli"))


@query("SELECT clip_id, k, t_start_ms, t_end_ms, x, y FROM windows", STEPS)
def collapse_windows(t: Tables):
    return T.collapse_windows(moves(t)).drop("w", "h")


@query("""SELECT p.clip_id, p.t_ms, CAST(CASE WHEN tb IS NULL THEN x * 1000 ELSE x * 1000 + floor((x1 - x) * 1000 * CAST(greatest(0, p.t_ms - ta) AS DOUBLE) / (tb - ta)) END AS BIGINT) AS mx, CAST(CASE WHEN tb IS NULL THEN y * 1000 ELSE y * 1000 + floor((y1 - y) * 1000 * CAST(greatest(0, p.t_ms - ta) AS DOUBLE) / (tb - ta)) END AS BIGINT) AS my
FROM (SELECT clip_id, t_ms + 70 AS t_ms FROM subject_track) p JOIN (SELECT clip_id, t_start_ms AS ta, lead(t_start_ms) OVER w AS tb, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(k) OVER w IS NULL AS first FROM windows WINDOW w AS (PARTITION BY clip_id ORDER BY k)) l ON l.clip_id = p.clip_id AND (ta <= p.t_ms OR first) AND (tb IS NULL OR p.t_ms < tb)""", STEPS)
def sample_crop(t: Tables):
    return T.sample_crop(T.collapse_windows(moves(t)), t.subject_track.select("clip_id", (F.col("t_ms") + 70).alias("t_ms")))


_occ = """SELECT w.clip_id, w.k, w.x, w.y, w.w, w.h, median(bx0) - 10 AS bx0, median(by0) - 10 AS by0, median(bx1) + 10 AS bx1, median(by1) + 10 AS by1 FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM windows) w JOIN subject_track t ON t.clip_id = w.clip_id AND conf > 0 AND (n = 1 OR (t_ms >= t_start_ms AND t_ms <= t_end_ms)) GROUP BY w.clip_id, w.k, w.x, w.y, w.w, w.h"""


@query("SELECT clip_id, k, bx0, by0, bx1, by1 FROM occ", STEPS | {"occ": _occ})
def subject_occupancy(t: Tables):
    return T.subject_occupancy(T.collapse_windows(moves(t)), t.subject_track, 10).select("clip_id", "k", "bx0", "by0", "bx1", "by1")


_put = lambda v, at, size, out: f"greatest(0, least(CAST(round_even(({v} - {at}) * {out} / CAST({size} AS DOUBLE), 0) AS BIGINT), {out}))"


@query(f"SELECT clip_id, k, ox, oy, x1 - ox AS ow, y1 - oy AS oh FROM (SELECT clip_id, k, {_put('bx0', 'x', 'w', 1080)} AS ox, {_put('by0', 'y', 'h', 1920)} AS oy, {_put('bx1', 'x', 'w', 1080)} AS x1, {_put('by1', 'y', 'h', 1920)} AS y1 FROM occ) r WHERE x1 > ox AND y1 > oy", STEPS | {"occ": _occ})
def subject_to_frame(t: Tables):
    rows = T.subject_occupancy(T.collapse_windows(moves(t)), t.subject_track, 10)
    return G.subject_to_frame(rows, F.lit(1080), F.lit(1920)).select("clip_id", "k", "ox", "oy", "ow", "oh")


_pass = lambda name, source, first, step, value: f"""SELECT clip_id, axis, g, v, side FROM {source} WHERE {first} UNION ALL SELECT a.clip_id, a.axis, a.g, {value}, a.side FROM {name} f JOIN {source} a ON a.clip_id = f.clip_id AND a.axis = f.axis AND a.g = f.g {step} 1"""
_mean, _limited = "exp(CAST(-1 AS DOUBLE) / 15 / CAST(0.6 AS DOUBLE)) * f.v + (1 - exp(CAST(-1 AS DOUBLE) / 15 / CAST(0.6 AS DOUBLE))) * a.v", "least(greatest(a.v, f.v - a.side * CAST(0.12 AS DOUBLE) / 15), f.v + a.side * CAST(0.12 AS DOUBLE) / 15)"
_last = "(clip_id, axis, g) IN (SELECT (clip_id, axis, max(g)) FROM raw_axes GROUP BY clip_id, axis)"

#: The recurrences row by row, and splitting level by level.
SMOOTH = STEPS | {
    "raw_grid": "SELECT g.clip_id, g.g, g.t, CASE WHEN tb IS NULL THEN cx ELSE cx + (cx1 - cx) * (t - ta) / (tb - ta) END AS cx, CASE WHEN tb IS NULL THEN cy ELSE cy + (cy1 - cy) * (t - ta) / (tb - ta) END AS cy FROM grid g JOIN sure s ON s.clip_id = g.clip_id AND ta <= t AND (tb IS NULL OR t < tb)",
    "raw_axes": "SELECT clip_id, 'x' AS axis, CAST(g AS BIGINT) AS g, CAST(cx AS DOUBLE) AS v, 1920 AS side, t FROM raw_grid UNION ALL SELECT clip_id, 'y', CAST(g AS BIGINT), CAST(cy AS DOUBLE), 1080, t FROM raw_grid",
    "mean_f": _pass("mean_f", "raw_axes", "g = 0", "+", _mean),
    "mean_b": _pass("mean_b", "mean_f", _last, "-", _mean),
    "held_f": _pass("held_f", "mean_b", "g = 0", "+", _limited),
    "held_b": _pass("held_b", "held_f", _last, "-", _limited),
    "smoothed": "SELECT h.clip_id, h.axis, h.g, h.v, r.t FROM held_b h JOIN raw_axes r USING (clip_id, axis, g)",
    "stretches": """SELECT clip_id, axis, CAST(0 AS BIGINT) AS a, max(g) AS b FROM raw_axes GROUP BY clip_id, axis UNION ALL SELECT clip_id, axis, unnest([a, far.g]), unnest([far.g, b]) FROM (
  SELECT s.clip_id, s.axis, s.a, s.b, max(struct_pack(d := abs(m.v - (p.v + (q.v - p.v) * (m.t - p.t) / greatest(q.t - p.t, 1e-9))), late := -m.g, g := m.g)) AS far FROM stretches s JOIN smoothed p ON p.clip_id = s.clip_id AND p.axis = s.axis AND p.g = s.a JOIN smoothed q ON q.clip_id = s.clip_id AND q.axis = s.axis AND q.g = s.b JOIN smoothed m ON m.clip_id = s.clip_id AND m.axis = s.axis AND m.g > s.a AND m.g < s.b GROUP BY s.clip_id, s.axis, s.a, s.b) z WHERE far.d > 3""",
    "key_points": "SELECT clip_id, axis, a AS g FROM stretches UNION SELECT clip_id, axis, b FROM stretches",
}


@query("SELECT s.clip_id, s.axis, s.g, CAST(round(v * 1000) AS BIGINT) AS v_milli, k.g IS NOT NULL AS key FROM smoothed s LEFT JOIN key_points k ON k.clip_id = s.clip_id AND k.axis = s.axis AND k.g = s.g", SMOOTH, recursive=True)
def smooth_tracks(t: Tables):
    rows = T.smooth_tracks(T.resample_track(t.subject_track), tracked(t).select("clip_id", "src_w", "src_h"))
    return rows.select("clip_id", "axis", "g", F.round(F.col("v") * 1000).cast("long").alias("v_milli"), "key")


def boxed(t: Tables):
    return tracked(t, 468, 830).withColumn("x", F.lit(726).cast("long")).withColumn("y", F.lit(125).cast("long"))


def _follow(axes: str, x: str, y: str, same: str) -> str:
    """The windows of crops that follow, as SQL: places at the keys of the axes, then equal neighbours as one."""
    return f"""SELECT clip_id, CAST(island - 1 AS BIGINT) AS k, min(t0) AS t_start_ms, max(t1) AS t_end_ms, arg_min(x, k) AS x, arg_min(y, k) AS y, CAST(468 AS BIGINT) AS w, CAST(830 AS BIGINT) AS h FROM (
  SELECT *, sum(CASE WHEN {same} THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY k) AS island FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (
    SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY g) AS k, t0, coalesce(lead(t0) OVER (PARTITION BY clip_id ORDER BY g), t0) AS t1, greatest(0, least({_int(x)}, 1920 - 468)) AS x, greatest(0, least({_int(y)}, 1080 - 830)) AS y
    FROM (SELECT a.clip_id, a.g, {_int('a.t')} AS t0, a.v AS vx, b.v AS vy, c.cx AS mx, c.cy AS my FROM smoothed a JOIN smoothed b ON b.clip_id = a.clip_id AND b.g = a.g AND b.axis = 'y' JOIN centres c ON c.clip_id = a.clip_id
      WHERE a.axis = 'x' AND n_confident > 1 AND EXISTS (SELECT 1 FROM key_points k WHERE k.clip_id = a.clip_id AND k.g = a.g AND k.axis IN ({axes}))) p) q WINDOW w AS (PARTITION BY clip_id ORDER BY k)) r) s GROUP BY clip_id, island"""


@query(_follow("'x'", "vx - 468 / 2.0", "125", "x = px"), SMOOTH, recursive=True)
def follow_crop(t: Tables):
    return T.follow_crop(t.subject_track, boxed(t))


@query(_follow("'x', 'y'", "726 + vx - mx", "125 + vy - my", "x = px AND y = py"), SMOOTH, recursive=True)
def follow_crop_locked(t: Tables):
    return T.follow_crop(t.subject_track, boxed(t), "both")
