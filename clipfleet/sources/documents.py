"""Readers and writers of JSON documents: transcripts, probes, tracks, occupancy, zones and decisions.

Readers take (clip_id, doc) rows, one JSON text each, so files come from any store by `text_documents`. A document that
doesn't parse gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipfleet.functions.exprs import half_even, normalize_token

_WORD = "array<struct<word:string,text:string,start:double,end:double>>"
_PROBE = "streams array<struct<width:bigint,height:bigint,tags:struct<rotate:string>,side_data_list:array<struct<rotation:string>>>>, format struct<duration:string>"
_WINDOW = "array<struct<x:double,y:double,w:double,h:double,start:double,end:double>>"


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc) of every file under path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def _ms(seconds):
    return half_even(seconds * 1000)


def read_word_transcripts(docs: DataFrame) -> DataFrame:
    """words of transcripts: the top-level list wins, else those of the segments; `word` before `text`; blank words and
    words without times leave; idx counts those left. A clip has one document."""
    d = F.from_json("doc", f"words {_WORD}, segments array<struct<words:{_WORD}>>")
    flat = F.flatten(F.transform(d["segments"], lambda s: F.coalesce(s["words"], F.array().cast(_WORD))))
    # counted within the array, below the explode, so words are neither shuffled nor sorted
    clean = F.transform("ws", lambda w: F.struct(F.btrim(F.coalesce(w["word"], w["text"])).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    left = F.filter(clean, lambda w: (w["word"] != "") & w["start"].isNotNull() & w["end"].isNotNull())
    rows = docs.select("clip_id", F.coalesce(d["words"], flat).alias("ws")).select("clip_id", F.posexplode(left).alias("idx", "w")).select("clip_id", "idx", "w.*")
    return rows.select("clip_id", F.col("idx").cast("long").alias("idx"), "word", _ms(F.col("start")).alias("start_ms"), _ms(F.col("end")).alias("end_ms"), normalize_token(F.col("word")).alias("norm"))


def read_transcript_languages(docs: DataFrame) -> DataFrame:
    """(clip_id, language) of each transcript that parses; null where it names none."""
    d = F.from_json("doc", "language string, words array<string>, segments array<string>")
    return docs.filter(F.get_json_object("doc", "$").isNotNull()).select("clip_id", d["language"].alias("language"))


def write_word_transcripts(words: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """(clip_id, doc): one transcript of each clip; languages: clip_id, language."""
    each = F.struct("idx", F.col("word").alias("word"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    rows = words.groupBy("clip_id").agg(F.array_sort(F.collect_list(each)).alias("words"))
    rows = rows.join(languages, "clip_id", "left") if languages is not None else rows.withColumn("language", F.lit(None).cast("string"))
    return rows.select("clip_id", F.to_json(F.struct("language", "words")).alias("doc"))


def read_media_probe(docs: DataFrame) -> DataFrame:
    """(clip_id, src_w, src_h, duration_ms) as shown: tags.rotate, else the first side rotation that parses; a quarter
    turn swaps the sides; no duration is 0."""
    d = F.from_json("doc", _PROBE)
    s = F.get(d["streams"], F.lit(0))
    side = F.get(F.filter(F.transform(s["side_data_list"], lambda x: x["rotation"].try_cast("double")), lambda x: x.isNotNull()), F.lit(0))
    turn = F.pmod(half_even(F.coalesce(s["tags"]["rotate"].try_cast("double"), side, F.lit(0.0))), F.lit(180))
    swap = turn == 90
    return docs.select("clip_id", F.when(swap, s["height"]).otherwise(s["width"]).alias("src_w"), F.when(swap, s["width"]).otherwise(s["height"]).alias("src_h"), F.coalesce(_ms(d["format"]["duration"].try_cast("double")), F.lit(0)).alias("duration_ms"))


def write_subject_tracks(track: DataFrame) -> DataFrame:
    """(clip_id, doc): one document of each clip's samples in order of time."""
    box = F.when(F.col("bx0").isNotNull(), F.array("bx0", "by0", "bx1", "by1"))
    each = F.struct("t_ms", F.round(F.col("t_ms") / 1000, 6).alias("t"), "cx", "cy", box.alias("bbox"), F.col("conf").alias("confidence"))
    return track.groupBy("clip_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(each)).alias("subjects"))).alias("doc"))


def read_subject_tracks(docs: DataFrame) -> DataFrame:
    """subject_track rows of documents; a missing confidence is 1, a missing box null."""
    d = F.from_json("doc", "subjects array<struct<t:double,cx:double,cy:double,bbox:array<double>,confidence:double>>")
    rows = docs.select("clip_id", F.explode(d["subjects"]).alias("s"))
    box = [F.get("s.bbox", F.lit(k)).cast("long").alias(c) for k, c in enumerate(("bx0", "by0", "bx1", "by1"))]
    return rows.select("clip_id", _ms(F.col("s.t")).alias("t_ms"), F.col("s.cx").cast("long").alias("cx"), F.col("s.cy").cast("long").alias("cy"), F.coalesce("s.confidence", F.lit(1.0)).cast("long").alias("conf"), *box)


def read_occupancy(docs: DataFrame, to_w: int, to_h: int) -> DataFrame:
    """(clip_id, origin, rx, ry, rw, rh, start_ms, end_ms, caption_position): the windows of both flavours
    (`avoid_windows` of subjects, `items` of overlays), scaled to the target frame."""
    d = F.from_json("doc", f"frame_w double, frame_h double, width double, height double, caption_position string, avoid_windows {_WINDOW}, items {_WINDOW}")
    tag = lambda field, name: F.transform(F.coalesce(d[field], F.array().cast(_WINDOW)), lambda w: F.struct(F.lit(name).alias("origin"), w.alias("w")))
    # each document is parsed below the explode: beside it, all its fields would be parsed again for each window
    heads = docs.select("clip_id", F.coalesce(d["frame_w"], d["width"]).alias("fw"), F.coalesce(d["frame_h"], d["height"]).alias("fh"), d["caption_position"].alias("caption_position"), F.concat(tag("avoid_windows", "subject"), tag("items", "overlay")).alias("xs"))
    rows = heads.select("clip_id", "fw", "fh", "caption_position", F.explode("xs").alias("x"))
    fit = lambda c, size, to: half_even(F.col(f"x.w.{c}") * to / F.coalesce(size, F.lit(float(to))))
    fw, fh = F.col("fw"), F.col("fh")
    return rows.select("clip_id", "x.origin", fit("x", fw, to_w).alias("rx"), fit("y", fh, to_h).alias("ry"), fit("w", fw, to_w).alias("rw"), fit("h", fh, to_h).alias("rh"), _ms(F.col("x.w.start")).alias("start_ms"), _ms(F.col("x.w.end")).alias("end_ms"), "caption_position")


def read_caption_hints(docs: DataFrame) -> DataFrame:
    """(clip_id, caption_position) of occupancy documents that hint at an anchor for captions."""
    return docs.select("clip_id", F.from_json("doc", "caption_position string")["caption_position"].alias("caption_position")).filter("caption_position IS NOT NULL")


def write_occupancy(windows: DataFrame, width: int, height: int, field: str = "avoid_windows", hints: DataFrame | None = None) -> DataFrame:
    """(clip_id, doc) of windows (clip_id, rx, ry, rw, rh, start_ms, end_ms) in a frame of that size; hints: clip_id,
    caption_position."""
    each = F.struct(F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rw").alias("w"), F.col("rh").alias("h"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    rows = windows.groupBy("clip_id").agg(F.array_sort(F.collect_list(each)).alias(field))
    rows = rows.join(hints, "clip_id", "left") if hints is not None else rows.withColumn("caption_position", F.lit(None).cast("string"))
    kind = F.lit("subject" if field == "avoid_windows" else "overlay").alias("kind")
    return rows.select("clip_id", F.to_json(F.struct(kind, F.lit(width).alias("frame_w"), F.lit(height).alias("frame_h"), "caption_position", field)).alias("doc"))


def pack_decisions(rows: DataFrame, fields: list[str], order: str = "i", key: str = "clip_id", head: dict[str, Column] | None = None) -> DataFrame:
    """(key, doc): the rows of each key as one document, in order, with their count and the aggregates of `head`."""
    each = F.struct(order, *[f for f in fields if f != order])
    head = {"count": F.count("*"), **(head or {})}
    top = rows.groupBy(key).agg(*[c.alias(n) for n, c in head.items()], F.array_sort(F.collect_list(each)).alias("rows"))
    return top.select(key, F.to_json(F.struct(*head, "rows")).alias("doc"))


def pack_segments(segments: DataFrame) -> DataFrame:
    """(clip_id, doc) of segments, with the kept and the source's duration in the head."""
    kept = F.coalesce(F.sum(F.when(F.col("keep"), F.col("end_ms") - F.col("start_ms"))), F.lit(0))
    return pack_decisions(segments, ["i", "start_ms", "end_ms", "keep", "reason", "text"], head={"kept_duration_ms": kept, "source_duration_ms": F.max("end_ms")})


def pack_cues(cues: DataFrame, karaoke: bool | Column = False, key: str = "clip_id") -> DataFrame:
    """(key, doc) of cues: the words as one text, and the words' times (wt) with karaoke only, which holds for all cues of
    a key."""
    timed = F.lit(karaoke) if isinstance(karaoke, bool) else karaoke
    rows = cues.withColumn("timed", timed).withColumn("text", F.array_join("words", " ")).withColumn("wt", F.when(F.col("timed") & (F.size("word_times") > 0), F.transform("word_times", lambda w: F.array(w["s"], w["e"]))))
    return pack_decisions(rows, ["i", "start_ms", "end_ms", "keep", "text", "emphasis", "wt"], key=key, head={"cue_count": F.count("*"), "karaoke": F.first("timed")})


def unpack_cues(docs: DataFrame) -> DataFrame:
    """Cues of documents: words by the list if there is one, else by the text; times that don't fit the words, and
    emphasis outside them, are dropped; cues are kept unless they say otherwise."""
    rows = unpack_decisions(docs, "i bigint, start_ms bigint, end_ms bigint, keep boolean, text string, words array<string>, emphasis array<bigint>, wt array<array<bigint>>", {"keep": True})
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(split))
    times = F.when(F.size("wt") == F.size("words"), F.transform("wt", lambda w: F.struct(F.get(w, F.lit(0)).alias("s"), F.get(w, F.lit(1)).alias("e"))))
    inside = F.array_sort(F.array_distinct(F.filter("emphasis", lambda k: (k >= 0) & (k < F.size("words")))))
    return rows.select("clip_id", "i", "start_ms", "end_ms", "words", F.coalesce(inside, F.array().cast("array<bigint>")).alias("emphasis"), "keep", F.coalesce(times, F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("word_times"))


_FRAMING = "struct<scale:double,pan_x:double,pan_y:double>"
# fixed values: what a crop definition is without saying so
REFRAME_DEFAULTS = {"aspect": "full-portrait", "resolution": "auto", "mode": "static", "lock": "none"}


def pack_reframe(rows: DataFrame) -> DataFrame:
    """(clip_id, doc) of crop definitions (clip_id, aspect, resolution, mode, lock, custom, framing, proposal)."""
    doc = F.struct(F.struct("aspect", "resolution").alias("target"), "mode", "lock", "custom", "framing", "proposal")
    return rows.select("clip_id", F.to_json(doc).alias("doc"))


def unpack_reframe(docs: DataFrame) -> DataFrame:
    """Crop definitions of documents; missing fields take their defaults, scale and pan are held to their ranges."""
    d = F.from_json("doc", f"target struct<aspect:string,resolution:string>, mode string, lock string, custom boolean, framing {_FRAMING}, proposal {_FRAMING}")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))
    model = lambda m: F.struct(F.greatest(F.lit(1.0), F.coalesce(m["scale"], F.lit(1.0))).alias("scale"), unit(m["pan_x"]).alias("pan_x"), unit(m["pan_y"]).alias("pan_y"))
    or_else = lambda c, k: F.coalesce(c, F.lit(REFRAME_DEFAULTS[k])).alias(k)
    return docs.select("clip_id", or_else(d["target"]["aspect"], "aspect"), or_else(d["target"]["resolution"], "resolution"), or_else(d["mode"], "mode"), or_else(d["lock"], "lock"), F.coalesce(d["custom"], F.lit(False)).alias("custom"), model(d["framing"]).alias("framing"), F.when(d["proposal"].isNotNull(), model(d["proposal"])).alias("proposal"))


def unpack_decisions(docs: DataFrame, schema: str, defaults: dict[str, object] | None = None, key: str = "clip_id") -> DataFrame:
    """The rows of documents by a schema like `i bigint, keep boolean`; missing fields take their defaults."""
    kind = ",".join(f"{n}:{t}" for n, t in (part.strip().split(" ", 1) for part in schema.split(", ")))
    rows = docs.select(key, F.explode(F.from_json("doc", f"rows array<struct<{kind}>>")["rows"]).alias("r")).select(key, "r.*")
    return rows.fillna(defaults) if defaults else rows


def read_safezone_specs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bands and notches (zone, x0, y0, x1, y1) of zone documents (zone, doc)."""
    rect = "array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>"
    d = F.from_json("doc", f"bands {rect}, notch_rects {rect}")
    return tuple(docs.select("zone", F.inline(d[f])) for f in ("bands", "notch_rects"))
