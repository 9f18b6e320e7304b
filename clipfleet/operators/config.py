"""Configuration: layered styles, manifests, names and their rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfleet.functions.dims import ANCHORS, ASPECTS, FONTS, H_OFFSETS, STYLE_KEYS, TIERS

# fixed values: pattern of identities and profiles; defaults of a manifest's knobs, in milliseconds and percent
NAME = "^[a-z0-9][a-z0-9-]*$"
MANIFEST_DEFAULTS = {"silence_gap_ms": 600, "keep_pad_lead_ms": 60, "keep_pad_tail_ms": 150, "occlusion_pct": 10, "face_danger_pct": 20, "intrusion_pct": 0}


def merge_layers(layers: DataFrame) -> DataFrame:
    """A wide row for each clip of long rows (clip_id, priority, k, v): for each known key the value of the highest
    priority, cast to its type; nulls and unknown keys don't count."""
    known = dict(STYLE_KEYS)
    rows = layers.filter(F.col("k").isin(*known) & F.col("v").isNotNull())
    one = lambda k: F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("priority")))
    return rows.groupBy("clip_id").agg(*[one(k).try_cast(t).alias(k) for k, t in STYLE_KEYS])


def style_reasons() -> Column:
    """What is wrong with a style row (null keys are not set), as an array."""
    out = lambda c, lo, hi: F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(c))
    one_of = lambda c, known: F.when(F.col(c).isNotNull() & ~F.lower(c).isin(*[k.lower() for k in known]), F.lit(c))
    return F.array_compact(F.array(out("font_size", 24, 240), out("stroke_width", 0, 40), out("bg_radius", 0, 400), F.when((F.col("min_words") < 1) | (F.col("max_words") < F.col("min_words")), F.lit("words")), F.when((F.col("target_words") != 0) & ((F.col("target_words") < F.col("min_words")) | (F.col("target_words") > F.col("max_words"))), F.lit("target_words")), one_of("font_family", FONTS), one_of("position", [a for a, _, _ in ANCHORS]), one_of("h_offset", H_OFFSETS)))


def style_rejects(layers: DataFrame) -> DataFrame:
    """(clip_id, k): keys of style rows (clip_id, priority, k, v) that no style has."""
    return layers.filter(~F.col("k").isin(*dict(STYLE_KEYS))).select("clip_id", "k").distinct()


def read_manifests(manifests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Config columns of manifests (clip_id, identity, profile, target_aspect, target_resolution, knobs map): a target's
    aspect wins over the profile's; a profile follows from the aspect where it is missing; knobs have defaults.
    profiles: profile, p_aspect."""
    first = profiles.groupBy("p_aspect").agg(F.min("profile").alias("of_aspect")).withColumnRenamed("p_aspect", "aspect")
    rows = manifests.join(profiles, "profile", "left").withColumn("aspect", F.coalesce("target_aspect", "p_aspect")).join(first, "aspect", "left")
    knobs = [F.coalesce(F.try_element_at("knobs", F.lit(k)).cast("long"), F.lit(v)).cast("long").alias(k) for k, v in MANIFEST_DEFAULTS.items()]
    return rows.select("clip_id", "identity", F.coalesce("profile", "of_aspect").alias("profile"), "aspect", F.coalesce("target_resolution", F.lit("auto")).alias("resolution"), *knobs)


def manifest_reasons() -> Column:
    """What is wrong with a manifest row, as an array."""
    known = [a for a, _, _ in ASPECTS]
    allowed = F.array(*map(F.lit, MANIFEST_DEFAULTS))
    return F.array_compact(F.array(
        F.when(F.coalesce(F.col("identity"), F.lit("")) == "", F.lit("identity")),
        F.when(F.col("profile").isNull() & F.col("target_aspect").isNull(), F.lit("target or profile")),
        F.when(F.col("target_aspect").isNotNull() & ~F.col("target_aspect").isin(*known), F.lit("aspect")),
        F.when(F.size(F.array_except(F.map_keys("knobs"), allowed)) > 0, F.lit("unknown key")),
        F.when(F.exists(F.map_values("knobs"), lambda v: v < 0), F.lit("below 0")),
        F.when(F.col("identity").isNotNull() & (F.col("identity") != "") & ~F.col("identity").rlike(NAME), F.lit("identity pattern")),
        F.when(F.col("profile").isNotNull() & ~F.col("profile").rlike(NAME), F.lit("profile pattern")),
        F.when(F.col("target_resolution").isNotNull() & ~F.col("target_resolution").isin("auto", *TIERS), F.lit("resolution")),
    ))


def parse_project_names(names: DataFrame) -> DataFrame:
    """(name, date, token, hook, file, reason) of folder names `2026-01-02 Token Project - Hook`; others get a reason."""
    last = F.element_at(F.split(F.regexp_replace("name", "/+$", ""), "/"), -1)
    pattern = r"^(\d{4}-\d{2}-\d{2})\s+(\S+)\s+Project\s*-\s*(.+?)\s*$"
    rows = names.withColumn("last", last)
    part = lambda k: F.nullif(F.regexp_extract("last", pattern, k), F.lit(""))
    rows = rows.withColumn("date", part(1)).withColumn("token", part(2)).withColumn("hook", part(3))
    slug = F.btrim(F.regexp_replace(F.lower("hook"), "[^a-z0-9]+", "-"), F.lit("-"))
    return rows.select("name", "date", "token", "hook", F.when(F.col("date").isNotNull(), F.concat("date", F.lit("-"), F.lower("token"), F.lit("-"), slug, F.lit(".mp4"))).alias("file"), F.when(F.col("date").isNull(), F.lit("no match")).alias("reason"))
