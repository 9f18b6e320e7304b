"""Queries of zones, caption boxes, layout checks and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipfleet.functions import dims
from clipfleet.operators import overlays as O
from clipfleet.operators import qc as Q
from clipfleet.operators import zones as Z
from clipfleet.plans.base import Tables, query
from clipfleet.plans.q_timeline import STEPS as TIME
from clipfleet.plans.q_timeline import three_word_cues
from clipfleet.sources.scratch import stored

# the zone of the checks: bands and notch of a 1080 x 1920 frame
BANDS = [("reels", 35, 250, 1045, 1117), ("reels", 35, 1117, 915, 1470)]
NOTCHES = [("reels", 915, 1117, 1045, 1470)]
# zones of the checks: that one, one of overlapping, nested and repeated bands, and one of two islands side by side
CHECK_BANDS = [*BANDS, ("nested", 0, 100, 700, 900), ("nested", 100, 500, 1000, 1300), ("nested", 150, 600, 300, 700), ("nested", 0, 100, 700, 900), ("nested", 90, 1200, 880, 1500), ("split", 0, 0, 450, 1600), ("split", 500, 200, 1080, 1200), ("split", 450, 1000, 500, 1100)]
CHECK_NOTCHES = [*NOTCHES, ("nested", 700, 100, 1000, 500), ("split", 440, 0, 520, 90)]
_ZONE = "CASE clip_id % 3 WHEN 0 THEN 'reels' WHEN 1 THEN 'nested' ELSE 'split' END"
_NAMES = "zone string, x0 long, y0 long, x1 long, y1 long"

_over = lambda b: f"greatest(0, least(q.x1, {b}.x1) - greatest(q.x0, {b}.x0)) * greatest(0, least(q.y1, {b}.y1) - greatest(q.y0, {b}.y0))"
_best = lambda kind: f"""SELECT clip_id, ord, over_ord, common * 1000000 // area AS overlap_ppm, x0, y0, x1, y1, t_ms, t_end_ms FROM (SELECT c.clip_id, c.ord, c.x0, c.y0, c.x1, c.y1, c.t_ms, c.t_end_ms, o.ord AS over_ord, (c.x1 - c.x0) * (c.y1 - c.y0) AS area, greatest(0, least(c.x1, o.x1) - greatest(c.x0, o.x0)) * greatest(0, least(c.y1, o.y1) - greatest(c.y0, o.y0)) AS common,
  row_number() OVER (PARTITION BY c.clip_id, c.ord, c.x0, c.y0, c.x1, c.y1, c.t_ms, c.t_end_ms ORDER BY greatest(0, least(c.x1, o.x1) - greatest(c.x0, o.x0)) * greatest(0, least(c.y1, o.y1) - greatest(c.y0, o.y0)) DESC, o.ord) AS r
  FROM qc_elements c JOIN qc_elements o ON o.clip_id = c.clip_id AND o.kind = '{kind}' AND (c.t_ms IS NULL OR o.t_ms IS NULL OR (c.t_ms <= coalesce(o.t_end_ms, o.t_ms) AND o.t_ms <= coalesce(c.t_end_ms, c.t_ms))) WHERE c.kind = 'caption') b WHERE r = 1 AND common > 0"""  # noqa: E731

STEPS = TIME | {
    "zone_bands": f"SELECT * FROM {dims.values_sql(BANDS, 'zone, x0, y0, x1, y1')}",
    "zone_notches": f"SELECT * FROM {dims.values_sql(NOTCHES, 'zone, x0, y0, x1, y1')}",
    "mask_bands_": "SELECT mask_id, x0, min(y) AS y0, x1, max(y) + 1 AS y1 FROM (SELECT *, sum(o) OVER (PARTITION BY mask_id ORDER BY y) AS island FROM (SELECT *, CASE WHEN x0 = lag(x0) OVER w AND x1 = lag(x1) OVER w THEN 0 ELSE 1 END AS o FROM mask_runs WINDOW w AS (PARTITION BY mask_id ORDER BY y)) a) b GROUP BY mask_id, island, x0, x1",
    "check_bands": f"SELECT * FROM {dims.values_sql(CHECK_BANDS, 'zone, x0, y0, x1, y1')}",
    "check_notches": f"SELECT * FROM {dims.values_sql(CHECK_NOTCHES, 'zone, x0, y0, x1, y1')}",
    # the union of the bands, row by row
    "zone_rows": """SELECT zone, y, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(o) OVER (PARTITION BY zone, y ORDER BY x0, x1) AS island FROM (SELECT zone, y, x0, x1, CASE WHEN x0 <= max(x1) OVER (PARTITION BY zone, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o
  FROM (SELECT DISTINCT zone, x0, x1, unnest(range(y0, y1)) AS y FROM check_bands) a) b) c GROUP BY zone, y, island""",
    "safe_rects": f"SELECT zone, q.x0, q.y0, q.x1, q.y1, sum(greatest(0, least(q.x1, r.x1) - greatest(q.x0, r.x0))) AS safe FROM (SELECT *, unnest(range(y0, y1)) AS y FROM (SELECT DISTINCT {_ZONE} AS zone, x0, y0, x1, y1 FROM qc_elements) d) q JOIN zone_rows r USING (zone, y) GROUP BY ALL",
    "endangered": f"SELECT e.*, CASE WHEN area <= 0 THEN 0 ELSE 1000000 - CAST(coalesce(safe, 0) AS BIGINT) * 1000000 // area END AS danger_ppm, area > 0 AND EXISTS (SELECT 1 FROM check_notches n WHERE n.zone = e.zone AND n.x0 < e.x1 AND e.x0 < n.x1 AND n.y0 < e.y1 AND e.y0 < n.y1) AS hits_notch FROM (SELECT *, {_ZONE} AS zone, (x1 - x0) * (y1 - y0) AS area FROM qc_elements) e LEFT JOIN safe_rects s ON s.zone = e.zone AND s.x0 = e.x0 AND s.y0 = e.y0 AND s.x1 = e.x1 AND s.y1 = e.y1",
    "over_face": _best("face"),
    "over_overlay": _best("overlay"),
    "found": """SELECT clip_id, ord, 'danger-intrusion' AS kind, 'error' AS severity, danger_ppm AS ppm, x0, y0, x1, y1, t_ms, t_end_ms FROM endangered WHERE kind NOT IN ('face', 'overlay') AND danger_ppm > 0
  UNION ALL SELECT clip_id, ord, 'face-in-danger', 'warning', danger_ppm, x0, y0, x1, y1, t_ms, t_end_ms FROM endangered WHERE kind = 'face' AND danger_ppm >= 200000
  UNION ALL SELECT clip_id, ord, 'caption-over-face', 'warning', overlap_ppm, x0, y0, x1, y1, t_ms, t_end_ms FROM over_face WHERE overlap_ppm >= 100000
  UNION ALL SELECT clip_id, ord, 'caption-over-overlay', 'warning', overlap_ppm, x0, y0, x1, y1, t_ms, t_end_ms FROM over_overlay WHERE overlap_ppm >= 100000""",
    "placed": """SELECT *, CAST(CASE placement WHEN 'full-bleed' THEN 0 WHEN 'bottom-half' THEN 0 ELSE greatest(0, least(rx, 1080)) END AS BIGINT) AS px, CAST(CASE placement WHEN 'full-bleed' THEN 0 WHEN 'bottom-half' THEN 960 ELSE greatest(0, least(ry, 1920)) END AS BIGINT) AS py,
  CAST(CASE placement WHEN 'full-bleed' THEN 1080 WHEN 'bottom-half' THEN 1080 ELSE greatest(1, least(rw, 1080 - greatest(0, least(rx, 1080)))) END AS BIGINT) AS pw, CAST(CASE placement WHEN 'full-bleed' THEN 1920 WHEN 'bottom-half' THEN 960 ELSE greatest(1, least(rh, 1920 - greatest(0, least(ry, 1920)))) END AS BIGINT) AS ph FROM overlays""",
    "cap_boxes": f"""SELECT position, CAST(a + m AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(b - m - (a + m) AS BIGINT) AS w, CAST(y1 - y AS BIGINT) AS h, pref FROM (SELECT *, round_even((b - a) * 4 / 100.0, 0) AS m FROM (
  SELECT p.position, pref, p.y, p.y1, (SELECT max(x0) FROM zone_bands z WHERE z.y0 < p.y1 AND z.y1 > p.y) AS a, (SELECT min(x1) FROM zone_bands z WHERE z.y0 < p.y1 AND z.y1 > p.y) AS b
  FROM (SELECT position, pref, round_even(250 + lo * 1220 / 100.0, 0) AS y, round_even(250 + hi * 1220 / 100.0, 0) AS y1 FROM {dims.values_sql([(*a, dims.DODGE['lower-third'].index(a[0])) for a in dims.ANCHORS], 'position, lo, hi, pref')}) p) q) r""",
    "cue_rects": "SELECT q.clip_id, q.i, px, py, pw, ph FROM cues q JOIN placed o ON o.clip_id = q.clip_id AND least(q.end_ms, o.end_ms) > greatest(q.start_ms, o.start_ms)",
    "cue_boxes": """SELECT clip_id, i, coalesce(min(pref) FILTER (WHERE NOT hit), 0) AS pref FROM (SELECT q.clip_id, q.i, b.pref, EXISTS (SELECT 1 FROM cue_rects r WHERE r.clip_id = q.clip_id AND r.i = q.i AND b.x < r.px + r.pw AND r.px < b.x + b.w AND b.y < r.py + r.ph AND r.py < b.y + b.h) AS hit FROM cues q, cap_boxes b) t GROUP BY clip_id, i""",
}


def bands(t: Tables):
    return t.spark.createDataFrame(BANDS, _NAMES)


def check_zones(t: Tables):
    return t.spark.createDataFrame(CHECK_BANDS, _NAMES), t.spark.createDataFrame(CHECK_NOTCHES, _NAMES)


def zoned(t: Tables):
    """The elements, each with the zone of its clip."""
    return t.qc_elements.withColumn("zone", F.expr(_ZONE))


def placed(t: Tables):
    return O.place_overlays(t.overlays, 1080, 1920)


def rects(t: Tables):
    p = placed(t).select("clip_id", "start_ms", "end_ms", F.col("px").alias("rx"), F.col("py").alias("ry"), F.col("pw").alias("rw"), F.col("ph").alias("rh"))
    # times of the cues of clips with overlays, which are read several times
    return Z.avoid_rects(stored(three_word_cues(t, p).select("clip_id", "i", "start_ms", "end_ms"), "cue-times"), p)


@query("SELECT mask_id, x0, y0, x1, y1 FROM mask_bands_", STEPS)
def mask_bands(t: Tables):
    return Z.mask_bands(t.mask_runs)[0]


@query("SELECT mask_id, 'empty row inside' AS reason FROM mask_runs WHERE mask_id % 2 = 0 GROUP BY mask_id UNION ALL SELECT mask_id, 'several runs in a row' FROM mask_runs WHERE mask_id % 2 = 1 GROUP BY mask_id", STEPS)
def mask_rejects(t: Tables):
    runs = t.mask_runs.filter("NOT (mask_id % 2 = 0 AND y = 30)")
    more = t.mask_runs.filter("mask_id % 2 = 1 AND y = 20").select("mask_id", "y", F.lit(80).cast("long").alias("x0"), F.lit(90).cast("long").alias("x1"))
    return Z.mask_bands(runs.union(more))[1]


@query("SELECT mask_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM mask_bands_ GROUP BY mask_id", STEPS)
def zone_summary(t: Tables):
    return Z.zone_summary(Z.mask_bands(t.mask_runs)[0])


@query("SELECT b.mask_id, b.x1 AS x0, b.y0, z.x1, b.y1 FROM mask_bands_ b JOIN (SELECT mask_id, max(x1) AS x1 FROM mask_bands_ GROUP BY mask_id) z ON z.mask_id = b.mask_id WHERE b.x1 < z.x1", STEPS)
def band_notches(t: Tables):
    return Z.band_notches(Z.mask_bands(t.mask_runs)[0])


# each mask has two bands with a common left side, so six corners
@query("""SELECT a.mask_id, CAST(v.pos AS BIGINT) AS pos, CASE v.pos WHEN 0 THEN a.x1 WHEN 1 THEN a.x1 WHEN 2 THEN b.x1 WHEN 3 THEN b.x1 ELSE a.x0 END AS x, CASE v.pos WHEN 0 THEN a.y0 WHEN 1 THEN a.y1 WHEN 2 THEN a.y1 WHEN 3 THEN b.y1 WHEN 4 THEN b.y1 ELSE a.y0 END AS y
FROM mask_bands_ a JOIN mask_bands_ b ON a.mask_id = b.mask_id AND a.y1 = b.y0, (VALUES (0), (1), (2), (3), (4), (5)) AS v(pos)""", STEPS)
def band_ring(t: Tables):
    return Z.band_ring(Z.mask_bands(t.mask_runs)[0])


# masks with a hole (two runs in the rows 20 to 24), specks at the top and right, and a bar that touches corners only
_SPECKS = """SELECT mask_id, y, x0, CASE WHEN y BETWEEN 20 AND 24 THEN 20 ELSE x1 END AS x1 FROM mask_runs UNION ALL SELECT mask_id, y, 30, x1 FROM mask_runs WHERE y BETWEEN 20 AND 24
  UNION ALL SELECT DISTINCT mask_id, 0, 1, 3 FROM mask_runs UNION ALL SELECT mask_id, y, 80 + y % 2, 90 FROM mask_runs WHERE y BETWEEN 10 AND 15 AND mask_id % 2 = 0 UNION ALL SELECT DISTINCT mask_id, 62, 60, 70 FROM mask_runs"""


@query("SELECT mask_id, y, x0, x1 FROM reach", STEPS | {
    "specks": _SPECKS,
    "middle": "SELECT mask_id, y FROM (SELECT mask_id, y, row_number() OVER (PARTITION BY mask_id ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY mask_id) AS c FROM (SELECT DISTINCT mask_id, y FROM specks) d) e WHERE k = c // 2",
    "seed": "SELECT mask_id, y, x0, x1 FROM (SELECT s.*, sum(x1 - x0) OVER (PARTITION BY mask_id ORDER BY x0) - (x1 - x0) AS before, sum(x1 - x0) OVER (PARTITION BY mask_id) // 2 AS half FROM specks s JOIN middle USING (mask_id, y)) m WHERE before <= half AND half < before + x1 - x0",
    "reach": "SELECT mask_id, y, x0, x1 FROM seed UNION SELECT s.mask_id, s.y, s.x0, s.x1 FROM reach r JOIN specks s ON s.mask_id = r.mask_id AND abs(s.y - r.y) = 1 AND s.x0 < r.x1 AND r.x0 < s.x1",
}, recursive=True)
def main_component(t: Tables):
    long = lambda x, name: (F.lit(x) if isinstance(x, int) else x).cast("long").alias(name)
    holed = F.col("y").between(20, 24)
    one = lambda y, x0, x1: t.mask_runs.select("mask_id", long(y, "y"), long(x0, "x0"), long(x1, "x1")).distinct()
    runs = t.mask_runs.select("mask_id", "y", "x0", F.when(holed, F.lit(20).cast("long")).otherwise(F.col("x1")).alias("x1")).union(t.mask_runs.filter(holed).select("mask_id", "y", long(30, "x0"), "x1"))
    bar = t.mask_runs.filter(F.col("y").between(10, 15) & (F.col("mask_id") % 2 == 0)).select("mask_id", "y", long(80 + F.col("y") % 2, "x0"), long(90, "x1"))
    return Z.main_component(runs.union(one(0, 1, 3)).union(bar).union(one(62, 60, 70)))


@query(f"SELECT clip_id, ord FROM qc_elements e WHERE EXISTS (SELECT 1 FROM check_bands b WHERE b.zone = {_ZONE} AND e.x0 >= b.x0 AND e.x0 < b.x1 AND e.y0 >= b.y0 AND e.y0 < b.y1)", STEPS)
def zone_contains(t: Tables):
    points = zoned(t).select("clip_id", "ord", "zone", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return Z.zone_contains(points, check_zones(t)[0]).select("clip_id", "ord")


@query(f"""SELECT e.*, coalesce(n, 0) >= e.y1 - e.y0 AS clear FROM (SELECT DISTINCT clip_id, ord, x0, y0, x1, y1 FROM qc_elements) e LEFT JOIN (
  SELECT q.zone, q.x0, q.y0, q.x1, q.y1, count(DISTINCT y) AS n FROM (SELECT *, unnest(range(y0, y1)) AS y FROM (SELECT DISTINCT {_ZONE} AS zone, x0, y0, x1, y1 FROM qc_elements) d) q JOIN check_bands b ON b.zone = q.zone AND b.x0 <= q.x0 AND q.x1 <= b.x1 AND b.y0 <= y AND y < b.y1 GROUP BY ALL) c
  ON c.zone = {_ZONE} AND c.x0 = e.x0 AND c.y0 = e.y0 AND c.x1 = e.x1 AND c.y1 = e.y1""", STEPS)
def zone_clears(t: Tables):
    key = ["clip_id", "ord", "x0", "y0", "x1", "y1"]
    return Z.zone_clears(zoned(t), check_zones(t)[0], key)


@query("SELECT zone, count(*) AS n_rows, CAST(sum(x1 - x0) AS BIGINT) AS area, elements FROM zone_rows JOIN (SELECT " + _ZONE + " AS zone, count(*) AS elements FROM qc_elements GROUP BY ALL) n USING (zone) GROUP BY zone, elements", STEPS)
def zone_slabs(t: Tables):
    slabs = Z.zone_slabs(check_zones(t)[0]).withColumn("h", F.col("sy1") - F.col("sy0"))
    each = slabs.groupBy("zone").agg(F.sum("h").alias("n_rows"), F.sum(F.col("h") * (F.col("sx1") - F.col("sx0"))).alias("area"))
    return each.join(zoned(t).groupBy("zone").agg(F.count("*").alias("elements")), "zone")


_insets = [(a, p, *x[a]) for p, x in (("subject", dims.SUBJECT_INSETS), ("text", dims.TEXT_INSETS)) for a in x]
_edge = lambda pct, size: f"greatest(0, least(CAST(round_even({pct} * {size} / 100.0, 0) AS BIGINT), {size}))"


@query(f"SELECT clip_id, purpose, src_w AS width, src_h AS height, {_edge('il', 'src_w')} AS x0, {_edge('it', 'src_h')} AS y0, {_edge('(100 - ir)', 'src_w')} AS x1, {_edge('(100 - ib)', 'src_h')} AS y1 FROM clips JOIN (SELECT * FROM {dims.values_sql(_insets, 'aspect, purpose, it, ir, ib, il')}) i USING (aspect)")
def resolve_zones(t: Tables):
    return Z.resolve_generic(sizes(t)).drop("aspect")


@query("SELECT clip_id, p AS purpose, src_w AS width, src_h AS height, CAST(0 AS BIGINT) AS x0, CAST(0 AS BIGINT) AS y0, src_w AS x1, src_h AS y1 FROM clips, (VALUES ('subject'), ('text')) v(p)")
def resolve_zones_none(t: Tables):
    return Z.resolve_none(sizes(t)).drop("aspect")


def sizes(t: Tables):
    return t.clips.select("clip_id", "aspect", F.col("src_w").alias("width"), F.col("src_h").alias("height"))


def more_notches(t: Tables):
    """Notches of masks: the cut right sides, one on the left for odd masks, and whole rows for each fifth."""
    b = stored(Z.mask_bands(t.mask_runs)[0], "bands")  # read by both, and four times
    n = Z.band_notches(b).select("mask_id", F.col("x0").alias("nx0"), F.col("y0").alias("ny0"), F.col("x1").alias("nx1"), F.col("y1").alias("ny1"))
    own = lambda where, x0, y0, x1, y1: b.filter(where).groupBy("mask_id").agg(x0.alias("nx0"), F.lit(y0).cast("long").alias("ny0"), x1.alias("nx1"), F.lit(y1).cast("long").alias("ny1"))
    return Z.zone_summary(b).drop("area"), n.union(own("mask_id % 2 = 1", F.min("x0"), 10, F.min("x0") + 3, 20)).union(own("mask_id % 5 = 0", F.min("x0") - 1, 50, F.max("x1") + 1, 53))


_carved = """SELECT {key}, x0, min(y) AS y0, x1, max(y) + 1 AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY {key}, x0, x1 ORDER BY y) AS island FROM (
  SELECT b.{key}, y, max(CASE WHEN nx0 <= b.x0 AND nx1 < b.x1 THEN greatest(b.x0, nx1) WHEN nx0 <= b.x0 THEN b.x1 ELSE b.x0 END) AS x0, min(CASE WHEN nx1 >= b.x1 AND nx0 > b.x0 THEN least(b.x1, nx0) ELSE b.x1 END) AS x1
  FROM (SELECT *, unnest(range(y0, y1)) AS y FROM {boxes}) b LEFT JOIN {notches} n ON n.{key} = b.{key} AND ny0 <= y AND y < ny1 GROUP BY b.{key}, y) r WHERE x1 > x0) s GROUP BY {key}, x0, x1, island"""
_BOXES = "SELECT mask_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM mask_bands_ GROUP BY mask_id"
_NOTCHED = """SELECT b.mask_id, b.x1 AS nx0, b.y0 AS ny0, z.x1 AS nx1, b.y1 AS ny1 FROM mask_bands_ b JOIN mask_boxes z ON z.mask_id = b.mask_id WHERE b.x1 < z.x1
  UNION ALL SELECT mask_id, x0, 10, x0 + 3, 20 FROM mask_boxes WHERE mask_id % 2 = 1 UNION ALL SELECT mask_id, x0 - 1, 50, x1 + 1, 53 FROM mask_boxes WHERE mask_id % 5 = 0"""


@query(_carved.format(key="mask_id", boxes="mask_boxes", notches="mask_notches"), STEPS | {"mask_boxes": _BOXES, "mask_notches": _NOTCHED})
def carve_notches(t: Tables):
    return Z.carve(*more_notches(t), "mask_id")[0]


_scaled = lambda c, size, canvas: f"greatest(0, least(CAST(round_even({c} * {size} / CAST({canvas} AS DOUBLE), 0) AS BIGINT), {size}))"


# each clip takes the zone that was drawn for one of the masks on a canvas of 64 x 64, at its own size over ten
@query(_carved.format(key="clip_id", boxes="zone_boxes", notches="zone_cuts"), STEPS | {
    "mask_boxes": _BOXES, "mask_notches": _NOTCHED,
    "drawn": "SELECT clip_id, CAST(src_w // 10 AS BIGINT) AS w, CAST(src_h // 10 AS BIGINT) AS h, m.* FROM clips JOIN mask_boxes m ON m.mask_id = clip_id % 7 + 1",
    "zone_boxes": f"SELECT clip_id, {_scaled('x0', 'w', 64)} AS x0, {_scaled('y0', 'h', 64)} AS y0, {_scaled('x1', 'w', 64)} AS x1, {_scaled('y1', 'h', 64)} AS y1 FROM drawn",
    "zone_cuts": f"SELECT clip_id, {_scaled('nx0', 'w', 64)} AS nx0, {_scaled('ny0', 'h', 64)} AS ny0, {_scaled('nx1', 'w', 64)} AS nx1, {_scaled('ny1', 'h', 64)} AS ny1 FROM drawn JOIN mask_notches USING (mask_id)",
})
def resolve_zones_custom(t: Tables):
    boxes, notches = more_notches(t)
    corners = F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")]))
    drawn = boxes.select(F.col("mask_id").alias("zone"), F.lit(64).alias("canvas_w"), F.lit(64).alias("canvas_h"), corners.alias("c")).select("zone", "canvas_w", "canvas_h", "c.*")
    clips = t.clips.select("clip_id", (F.col("clip_id") % 7 + 1).alias("zone"), F.floor(F.col("src_w") / 10).alias("width"), F.floor(F.col("src_h") / 10).alias("height"))
    return Z.resolve_custom(clips, drawn, notches.withColumnRenamed("mask_id", "zone"), "clip_id")[0]


@query(f"""SELECT mask_id, position, CAST(a + m AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(b - m - (a + m) AS BIGINT) AS w, CAST(y1 - y AS BIGINT) AS h FROM (SELECT *, round_even((b - a) * 4 / 100.0, 0) AS m FROM (
  SELECT p.mask_id, p.position, p.y, p.y1, (SELECT max(x0) FROM mask_bands_ z WHERE z.mask_id = p.mask_id AND z.y0 < p.y1 AND z.y1 > p.y) AS a, (SELECT min(x1) FROM mask_bands_ z WHERE z.mask_id = p.mask_id AND z.y0 < p.y1 AND z.y1 > p.y) AS b
  FROM (SELECT mask_id, position, round_even(y0 + lo * (y1 - y0) / 100.0, 0) AS y, round_even(y0 + hi * (y1 - y0) / 100.0, 0) AS y1 FROM mask_boxes, {dims.values_sql(dims.ANCHORS, 'position, lo, hi')}) p) q) r""", STEPS | {"mask_boxes": _BOXES})
def caption_box(t: Tables):
    return Z.caption_boxes(Z.mask_bands(t.mask_runs)[0], "mask_id")


@query("SELECT clip_id, i, px AS rx, py AS ry, pw AS rw, ph AS rh FROM cue_rects", STEPS)
def avoid_rects(t: Tables):
    return rects(t)


@query("SELECT clip_id, i, position, x, y, w, h FROM cue_boxes JOIN cap_boxes USING (pref)", STEPS)
def caption_box_avoiding(t: Tables):
    return Z.boxes_avoiding(three_word_cues(t).select("clip_id", "i"), rects(t), Z.caption_boxes(bands(t)).drop("zone"))


@query("SELECT clip_id, ord, kind, CAST(danger_ppm AS BIGINT) AS danger_ppm, hits_notch FROM endangered", STEPS)
def danger_fraction(t: Tables):
    return Q.danger(zoned(t), *check_zones(t)).select("clip_id", "ord", "kind", "danger_ppm", "hits_notch")


@query("SELECT clip_id, ord, over_ord, overlap_ppm FROM over_face", STEPS)
def caption_over_face(t: Tables):
    return Q.caption_over(t.qc_elements, "face").select("clip_id", "ord", "over_ord", "overlap_ppm")


@query("SELECT clip_id, ord, over_ord, overlap_ppm FROM over_overlay", STEPS)
def caption_over_overlay(t: Tables):
    return Q.caption_over(t.qc_elements, "overlay").select("clip_id", "ord", "over_ord", "overlap_ppm")


@query("SELECT clip_id, ord, kind, severity, CAST(ppm AS BIGINT) AS ppm FROM found", STEPS)
def qc_violations(t: Tables):
    return Q.violations(zoned(t), *check_zones(t)).select("clip_id", "ord", "kind", "severity", "ppm")


_count = lambda k: f"CAST(count(*) FILTER (WHERE f.kind = '{k}') AS BIGINT) AS {k.replace('-', '_')}"


@query(f"""SELECT e.clip_id, elements_checked, faces_checked, overlays_checked, {', '.join(_count(k) for k in ('danger-intrusion', 'caption-over-face', 'caption-over-overlay', 'face-in-danger'))}, count(*) FILTER (WHERE severity = 'error') = 0 AS passed, count(f.clip_id) = 0 AS clean
FROM (SELECT clip_id, count(*) FILTER (WHERE kind NOT IN ('face', 'overlay')) AS elements_checked, count(*) FILTER (WHERE kind = 'face') AS faces_checked, count(*) FILTER (WHERE kind = 'overlay') AS overlays_checked FROM qc_elements GROUP BY clip_id) e LEFT JOIN found f ON f.clip_id = e.clip_id GROUP BY ALL""", STEPS)
def qc_report(t: Tables):
    return Q.qc_report(Q.violations(zoned(t), *check_zones(t)), t.qc_elements)


_told = "concat_ws(':', f.kind, f.ord, f.ppm, x0, y0, x1, y1, coalesce(t_ms, -1), coalesce(t_end_ms, -1))"


@query(f"""SELECT e.clip_id, coalesce(string_agg(concat('[', severity, '] ', f.kind, ' #', f.ord, ' ', ppm), chr(10) ORDER BY f.ord, f.kind, concat('[', severity, '] ', f.kind, ' #', f.ord, ' ', ppm)) FILTER (WHERE f.clip_id IS NOT NULL), '') AS summary,
coalesce(string_agg({_told}, ' ' ORDER BY {_told}) FILTER (WHERE f.clip_id IS NOT NULL), '') AS told, count(f.clip_id) AS n
FROM (SELECT DISTINCT clip_id FROM qc_elements) e LEFT JOIN found f ON f.clip_id = e.clip_id GROUP BY e.clip_id""", STEPS)
def qc_documents(t: Tables):
    docs = Q.qc_documents(Q.violations(zoned(t), *check_zones(t)), t.qc_elements)
    d = F.from_json("doc", "count bigint, violations array<struct<ord:bigint,kind:string,rect:struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>,t:double,t_end:double,ppm:bigint>>")
    ms = lambda x: F.coalesce(F.rint(x * 1000).cast("long"), F.lit(-1))
    told = F.transform(d["violations"], lambda v: F.concat_ws(":", v["kind"], v["ord"], v["ppm"], *[v["rect"][c] for c in ("x0", "y0", "x1", "y1")], ms(v["t"]), ms(v["t_end"])))
    return docs.select("clip_id", "summary", F.array_join(F.array_sort(told), " ").alias("told"), d["count"].alias("n"))


@query("SELECT clip_id, ord, CASE WHEN ord % 5 = 1 AND kind = 'face' THEN 'face as element' ELSE 'unknown kind' END AS reason FROM qc_elements WHERE (ord % 5 = 1 AND kind IN ('face', 'overlay')) OR ord % 5 = 3")
def qc_rejects(t: Tables):
    role = F.when(F.col("ord") % 5 == 1, "element").otherwise(F.when(F.col("kind").isin("face", "overlay"), F.col("kind")).otherwise("element"))
    return Q.rejects(t.qc_elements.withColumn("role", role).withColumn("kind", F.when(F.col("ord") % 5 == 3, "sticker").otherwise(F.col("kind"))))


_px = lambda c, to, size: f"CAST(round_even({c} * {to} / CAST({size} AS DOUBLE), 0) AS BIGINT)"


@query(f"SELECT s.clip_id, row_number() OVER (PARTITION BY s.clip_id ORDER BY t_ms) - 1 AS ord, {_px('bx0', 1080, 'src_w')} AS x0, {_px('by0', 1920, 'src_h')} AS y0, {_px('bx1', 1080, 'src_w')} AS x1, {_px('by1', 1920, 'src_h')} AS y1, t_ms FROM subject_track s JOIN clips c ON c.clip_id = s.clip_id WHERE bx0 IS NOT NULL")
def qc_faces_from(t: Tables):
    return Q.faces_from(t.subject_track, t.clips, 1080, 1920).select("clip_id", "ord", "x0", "y0", "x1", "y1", "t_ms")


@query("SELECT CAST(c_custkey AS BIGINT) AS clip_id, k AS ord, CASE k WHEN 0 THEN 'logo' ELSE 'cta' END AS kind, c_custkey % 900 AS x0, 10 * k AS y0, c_custkey % 900 + 80 AS x1, 10 * k + c_custkey % 50 AS y1, CASE k WHEN 0 THEN c_name ELSE '' END AS label FROM customer, range(2) r(k) WHERE k < c_custkey % 3")
def qc_static_elements(t: Tables):
    c = F.col("c_custkey").cast("long")
    box = lambda k, kind, label: F.struct(F.lit(kind).alias("kind"), (c % 900).alias("x"), F.lit(10 * k).cast("long").alias("y"), F.lit(80).cast("long").alias("width"), (c % 50).alias("height"), label.alias("label"))
    boxes = F.slice(F.array(box(0, "logo", F.col("c_name")), box(1, "cta", F.lit(None).cast("string"))), 1, (c % 3).cast("int"))
    return Q.static_elements(t.customer.select(c.alias("clip_id"), boxes.alias("elements"))).select("clip_id", "ord", "kind", "x0", "y0", "x1", "y1", "label")


_f = lambda x: f"CAST(round_even({x} * 30 / 1000.0, 0) AS BIGINT)"


@query(f"SELECT q.clip_id, q.i AS ord, 'caption' AS kind, x AS x0, y AS y0, x + w AS x1, y + h AS y1, start_ms AS t_ms, end_ms AS t_end_ms, left(line, 40) AS label, {_f('start_ms')} AS frame FROM cues q JOIN cue_boxes USING (clip_id, i) JOIN cap_boxes USING (pref) UNION ALL SELECT clip_id, i, 'overlay', px, py, px + pw, py + ph, start_ms, end_ms, '', {_f('start_ms')} FROM placed", STEPS)
def qc_elements_from(t: Tables):
    cues = Z.boxes_avoiding(three_word_cues(t), rects(t), Z.caption_boxes(bands(t)).drop("zone"), carry=("start_ms", "end_ms", "words", "keep"))
    return Q.elements_from(cues, None, placed(t), 30)


@query("SELECT clip_id, i, px, py, pw, ph, kind IN ('image', 'card') AS loop FROM placed", STEPS)
def place_overlays(t: Tables):
    return placed(t).select("clip_id", "i", "px", "py", "pw", "ph", "loop")


_reasons = "concat_ws('|', CASE WHEN end_ms <= start_ms THEN 'empty' END, CASE WHEN transition = 'cut' AND fade_ms <> 0 THEN 'cut with fade' END, CASE WHEN transition = 'fade' AND (fade_ms <= 0 OR 2 * fade_ms > end_ms - start_ms) THEN 'fade too long' END, CASE WHEN placement = 'pip-rect' AND (rw <= 0 OR rh <= 0) THEN 'no rect' END, CASE WHEN placement <> 'pip-rect' THEN 'rect' END)"


@query(f"SELECT clip_id, i, {_reasons} AS reasons FROM overlays")
def validate_overlays(t: Tables):
    good, bad = O.validate(t.overlays, O.overlay_reasons())
    return bad.select("clip_id", "i", F.array_join("reasons", "|").alias("reasons")).union(good.select("clip_id", "i", F.lit("")))


@query("""SELECT clip_id, i, kind, start_ms, end_ms, CASE WHEN i % 7 = 0 THEN 'no times' END AS reason FROM (SELECT *, CASE WHEN i % 7 <> 0 THEN row_number() OVER (PARTITION BY clip_id, i % 7 <> 0 ORDER BY start_ms, end_ms, p) - 1 END AS k FROM (SELECT clip_id, i AS p, i, kind, CASE WHEN i % 7 <> 0 THEN start_ms END AS start_ms, CASE WHEN i % 7 <> 0 THEN end_ms END AS end_ms FROM overlays) o) s""")
def parse_overlay_specs(t: Tables):
    s = lambda c: F.concat((F.col(c) / 1000).cast("decimal(20,3)").cast("string"))
    spec = F.when(F.col("i") % 7 == 0, F.concat(F.lit("kind= "), "kind", F.lit(";src=n"), F.col("i").cast("string"))).otherwise(F.concat(F.lit("kind="), "kind", F.lit("; start = "), s("start_ms"), F.lit(";end="), s("end_ms"), F.lit(";src=n"), F.col("i").cast("string")))
    rows = O.parse_specs(t.overlays.select("clip_id", F.col("i").alias("n"), spec.alias("spec")))
    return rows.select("clip_id", F.substring("src", 2, 20).cast("long").alias("i"), "kind", "start_ms", "end_ms", "reason")


_clip = lambda x, n: f"CASE WHEN length({x}) > {n} THEN concat(rtrim(regexp_replace(left({x}, {n}), ' [^ ]*$', '')), '…') ELSE {x} END"


@query(f"""SELECT page_id, {_clip('title', 90)} AS heading, {_clip('body', 280)} AS body, citation FROM (SELECT p.page_id, trim(regexp_replace(title, '[ \\n\\t\\r]+', ' ', 'g')) AS title, coalesce(b.body, '') AS body, regexp_replace(lower(coalesce(regexp_extract(url, '^[^:/]+://([^/?#]*)', 1), '')), '^www\\.', '') AS citation FROM pages_parsed p LEFT JOIN (
  SELECT page_id, string_agg(p, ' ' ORDER BY pos) AS body FROM (SELECT *, sum(length(p) + 1) OVER (PARTITION BY page_id ORDER BY pos) - 1 AS used, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM (SELECT page_id, unnest(range(len(paragraphs))) AS pos, unnest(paragraphs) AS p FROM pages_parsed) u WHERE p <> '') v WHERE k = 1 OR used <= 280 GROUP BY page_id) b ON b.page_id = p.page_id) x""")
def pack_paragraphs(t: Tables):
    return O.pack_paragraphs(t.pages_parsed)


@query("SELECT clip_id, query_id, concat('card-', query_id) AS src, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, 'card' AS kind, 'bottom-half' AS placement, 'fade' AS transition, 'mute' AS audio, CAST(300 AS BIGINT) AS fade_ms FROM (SELECT query_id, s.clip_id, a.start_ms AS s, b.end_ms AS e FROM spans_ s JOIN words a ON a.clip_id = s.clip_id AND a.idx = s.i JOIN words b ON b.clip_id = s.clip_id AND b.idx = s.j) w", STEPS)
def cards_to_overlays(t: Tables):
    from clipfleet.operators.roughcut import propose_windows

    cards = t.window_queries.select("query_id", F.concat(F.lit("card-"), F.col("query_id").cast("string")).alias("src"))
    return O.cards_to_overlays(cards, propose_windows(t.words, t.window_queries))


@query("SELECT 'overlay' AS origin, clip_id, start_ms, end_ms, px AS rx, py AS ry, pw AS rw, ph AS rh FROM placed UNION ALL SELECT 'subject', clip_id, t_ms, t_ms + 200, bx0, by0, bx1 - bx0, by1 - by0 FROM subject_track WHERE conf = 1", STEPS)
def union_avoid(t: Tables):
    s = t.subject_track.filter("conf = 1").select("clip_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 200).alias("end_ms"), F.col("bx0").alias("rx"), F.col("by0").alias("ry"), (F.col("bx1") - F.col("bx0")).alias("rw"), (F.col("by1") - F.col("by0")).alias("rh"))
    o = placed(t).select("clip_id", "start_ms", "end_ms", F.col("px").alias("rx"), F.col("py").alias("ry"), F.col("pw").alias("rw"), F.col("ph").alias("rh"))
    return O.union_avoid(s, o)



@query("SELECT clip_id, i, CASE WHEN i % 10 = 0 THEN 'removed' WHEN i % 10 = 1 THEN 'changed' END AS change FROM overlays WHERE i % 10 < 2 UNION ALL SELECT clip_id, i + 1000000, 'added' FROM overlays WHERE i % 10 = 2")
def diff_decisions(t: Tables):
    a = t.overlays
    b = a.filter("i % 10 <> 0").withColumn("fade_ms", F.when(F.col("i") % 10 == 1, F.col("fade_ms") + 1).otherwise(F.col("fade_ms")))
    return O.diff_decisions(a, b.union(a.filter("i % 10 = 2").withColumn("i", F.col("i") + 1000000).select(*b.columns)), ["clip_id", "i"])
