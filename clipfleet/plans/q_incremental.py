"""Recomputation after changes of targets, against a full run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfleet.operators import geometry as G
from clipfleet.operators import incremental as I
from clipfleet.plans.base import Tables, query
from clipfleet.plans.q_geometry import STEPS as _GEOMETRY
from clipfleet.sources.scratch import scratch_path

_EFFECTIVE = """SELECT project_id, seq, aspect, CASE WHEN turned THEN 'auto' ELSE resolution END AS effective, turned
  FROM (SELECT *, coalesce(aspect <> lag(aspect) OVER (PARTITION BY project_id ORDER BY seq), false) AS turned FROM target_history) a"""
STEPS = {
    "matrix": _GEOMETRY["matrix"],
    "presets": _GEOMETRY["presets"],
    "eff": _EFFECTIVE,
    "steps": "SELECT *, seq > 3 AND turned AS hit_all, seq > 3 AND (turned OR effective <> lag(effective) OVER (PARTITION BY project_id ORDER BY seq)) AS hit_some FROM eff",
    "latest": "SELECT project_id, arg_max(aspect, seq) AS aspect, arg_max(effective, seq) AS effective, bool_or(coalesce(hit_all, false)) AS hit_all, bool_or(coalesce(hit_some, false)) AS hit_some FROM steps GROUP BY project_id",
    "owned": "SELECT c.clip_id, c.src_w, c.src_h, l.aspect, l.effective, l.hit_all, l.hit_some FROM clips c JOIN orders o ON o.o_orderkey = c.clip_id JOIN latest l ON l.project_id = o.o_custkey",
    "cropped": _GEOMETRY["full_crops"].replace("FROM clips JOIN", "FROM owned JOIN"),
    "fitted": """SELECT c.clip_id, aspect, crop_w, crop_h, any_value(hit_all) AS hit_all, any_value(hit_some) AS hit_some, coalesce(arg_min(tier, tier_rank) FILTER (WHERE ok), 'exact-fit') AS tier, coalesce(arg_min(tw, tier_rank) FILTER (WHERE ok), max(aw * (m - m % 2))) AS out_w, coalesce(arg_min(th, tier_rank) FILTER (WHERE ok), max(ah * (m - m % 2))) AS out_h
  FROM (SELECT f.*, tier, tier_rank, tw, th, least(crop_w // aw, crop_h // ah) AS m, CASE WHEN effective = 'auto' THEN tw <= crop_w * CAST(1.05 AS DOUBLE) AND th <= crop_h * CAST(1.05 AS DOUBLE) ELSE tier = effective END AS ok FROM cropped f JOIN matrix USING (aspect)) c GROUP BY c.clip_id, aspect, crop_w, crop_h""",
}
ARTEFACTS = {
    "reframe": lambda clips: G.crop_dims(clips).select("clip_id", "aspect", "crop_w", "crop_h"),
    "qc": lambda clips: G.resolve_target(G.crop_dims(clips), F.col("effective")).select("clip_id", "tier", "out_w", "out_h"),
}


def owned(t: Tables, history: DataFrame) -> DataFrame:
    """Clips of each project with its target after history."""
    rows = G.target_invalidation(history).join(history.select("project_id", "seq", "aspect"), ["project_id", "seq"])
    now = rows.groupBy("project_id").agg(F.max_by("aspect", "seq").alias("aspect"), F.max_by("effective", "seq").alias("effective"))
    mine = t.orders.select(F.col("o_orderkey").alias("clip_id"), F.col("o_custkey").alias("project_id"))
    return t.clips.drop("aspect").join(mine, "clip_id").join(now, "project_id")


@query("SELECT clip_id, aspect, crop_w, crop_h, CAST(CASE WHEN hit_all THEN 2 ELSE 1 END AS BIGINT) AS reframed_in, tier, out_w, out_h, CAST(CASE WHEN hit_some THEN 2 ELSE 1 END AS BIGINT) AS checked_in FROM fitted", STEPS)
def refresh_targets(t: Tables):
    root = scratch_path(t.spark, "artefacts")
    I.refresh(root, owned(t, t.target_history.filter("seq <= 3")), ARTEFACTS)
    changes = G.target_invalidation(t.target_history).filter("seq > 3")
    I.refresh(root, owned(t, t.target_history), ARTEFACTS, changes)
    crop, out = (I.current(t.spark, root, a) for a in ("reframe", "qc"))
    return crop.withColumnRenamed("computed", "reframed_in").join(out.withColumnRenamed("computed", "checked_in"), "clip_id")
