"""Small literal cases of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipfleet.functions import exprs
from clipfleet.operators import captions, geometry, overlays, roughcut, timeline, tracks, zones
from clipfleet.sources import documents


def words_of(spark, rows):
    df = spark.createDataFrame([(1, k, w, s, e) for k, (w, s, e) in enumerate(rows)], "clip_id long, idx long, word string, start_ms long, end_ms long")
    return df.withColumn("norm", exprs.normalize_token(F.col("word")))


def even(spark, text, each=350, gap=50):
    return words_of(spark, [(w, k * (each + gap), k * (each + gap) + each) for k, w in enumerate(text.split())])


def test_fillers_and_false_starts(spark):
    w = words_of(spark, [("Hello", 0, 500), ("um", 550, 900), ("I", 950, 1000), ("I", 1100, 1200), ("go", 1250, 1400), ("go", 2500, 2600)])
    assert [r.label for r in roughcut.label_words(w).orderBy("idx").collect()] == [None, "filler", "false-start", None, None, None]


def test_runs_pads_and_pieces(spark):
    w = words_of(spark, [("a", 1000, 1500), ("b", 1600, 2000), ("c", 3000, 3500)])
    d = spark.createDataFrame([(1, 5000)], "clip_id long, duration_ms long")
    runs = roughcut.keep_runs(roughcut.label_words(w))
    assert [(r.start_ms, r.end_ms) for r in runs.orderBy("n").collect()] == [(1000, 2000), (3000, 3500)]
    pieces = roughcut.cut_pieces(roughcut.pad_runs(runs, d), d).orderBy("i").collect()
    assert [(r.start_ms, r.end_ms, r.keep) for r in pieces] == [(0, 940, False), (940, 2150, True), (2150, 2940, False), (2940, 3650, True), (3650, 5000, False)]


def test_clip_without_words_is_one_keep(spark):
    d = spark.createDataFrame([(1, 5000)], "clip_id long, duration_ms long")
    got = roughcut.rough_cut(words_of(spark, [("um", 0, 100)]), d).collect()
    assert [(r.start_ms, r.end_ms, r.keep) for r in got] == [(0, 5000, True)]


def test_empty_words(spark):
    d = spark.createDataFrame([], "clip_id long, duration_ms long")
    assert roughcut.rough_cut(words_of(spark, [("a", 0, 1)]).limit(0), d).count() == 0


def test_silence_log_edges(spark):
    lines = ["x silence_end: 1.0", "x silence_start: 2.0", "x silence_start: 3.5", "x silence_end: 4.25 | d", "x silence_start: -0.5"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "clip_id long, line_no long, line string")
    assert [(r.start_ms, r.end_ms) for r in roughcut.read_silence_log(df).orderBy("n").collect()] == [(3500, 4250), (-500, None)]


def test_window_proposals(spark):
    w = even(spark, "the rates went up and then inflation rose again")
    q = spark.createDataFrame([(1, "went up"), (2, "inflation rates"), (3, "zebra")], "query_id long, phrase string")
    got = {r.query_id: (r.start_ms, r.end_ms, r.exact) for r in roughcut.propose_windows(w, q).collect()}
    assert got == {1: (800, 1550, True), 2: (400, 2750, False)}


def test_chunks_balance_phrases(spark):
    w = even(spark, "I still have the first record I ever bought.")
    got = captions.words_to_cues(captions.chunk_words(w)).orderBy("i").collect()
    assert [" ".join(r.words) for r in got] == ["I still have", "the first record", "I ever bought."]


@pytest.mark.parametrize("seed", range(20))
def test_chunk_cost_is_least(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    chars, norms = rng.integers(1, 14, n).tolist(), rng.choice(["the", "x", "of", "y"], n).tolist()
    commas = (rng.random(n) < 0.3).tolist()
    breaks = frozenset({"the", "of"})

    def cost(cuts):
        total = 0.0
        for a, z in zip(cuts, [*cuts[1:], n], strict=True):
            size = z - a
            if size > 4 or (size > 1 and sum(chars[a:z]) + size - 1 > 24):
                return float("inf")
            total += 2 + (size - 3) ** 2 + (3 * (2 - size) if size < 2 else 0)
            if a:
                total += (-1.5 if norms[a] in breaks else 0) + (2 if norms[a - 1] in breaks else 0) - (1 if commas[a - 1] else 0)
        return total

    part = captions.partition_span(chars, [x in breaks for x in norms], commas, 4, 2, 24, 3)
    cuts = [k for k in range(n) if k == 0 or part[k] != part[k - 1]]
    best = min(cost([0, *[i for i in range(1, n) if mask >> (i - 1) & 1]]) for mask in range(1 << (n - 1)))
    assert cost(cuts) == pytest.approx(best)


def test_glossary_cascades(spark):
    got = captions.apply_glossary(even(spark, "state of the art of the day"), [("of the", "OF-THE"), ("day", "DAY")]).orderBy("idx").collect()
    assert [r.word for r in got] == ["state", "OF-THE", "art", "OF-THE", "DAY"]
    assert got[1].start_ms == 400 and got[1].end_ms == 1150


def test_fix_text_is_whole_word_and_case_blind(spark):
    df = spark.createDataFrame([("Open  AI and openair É é",)], "t string")
    assert df.select(captions.fix_text(F.col("t"), [("open ai", "OpenAI"), ("é", "E")]).alias("t")).first().t == "OpenAI and openair E E"


def test_srt(spark):
    cues = captions.words_to_cues(even(spark, "one two").withColumn("cue", F.lit(0)))
    assert captions.srt(cues).first().text == "1\n00:00:00,000 --> 00:00:00,750\none two\n"


def test_source_to_cut(spark):
    seg = spark.createDataFrame([(1, 0, 400, 3000, True), (1, 1, 3000, 3500, False), (1, 2, 3500, 6000, True)], "clip_id long, i long, start_ms long, end_ms long, keep boolean")
    base = timeline.base_cut(seg, 30)
    at = spark.createDataFrame([(1, t, t, t + 1) for t in (0, 400, 1400, 3200, 3500, 9000)], "clip_id long, i long, start_ms long, end_ms long")
    assert [r.start_f for r in timeline.to_cut(at, base, 30).orderBy("i").collect()] == [0, 0, 30, 78, 78, 153]


def test_crop_and_targets(spark):
    clips = spark.createDataFrame([(1, 1920, 1080, "full-portrait"), (2, 600, 1000, "full-portrait")], "clip_id long, src_w long, src_h long, aspect string")
    got = {r.clip_id: (r.tier, r.out_w, r.out_h) for r in geometry.resolve_target(geometry.crop_dims(clips), F.lit("auto")).collect()}
    assert got == {1: ("exact-fit", 594, 1056), 2: ("exact-fit", 558, 992)}


def test_follow_crop_stays_inside(spark, sf_dir):
    from clipfleet.plans.base import Tables
    from clipfleet.plans.q_geometry import boxed

    t = Tables(spark, sf_dir)
    for lock in ("none", "x", "both"):
        got = tracks.follow_crop(t.subject_track, boxed(t), lock)
        assert got.filter("x < 0 OR y < 0 OR x + w > 1920 OR y + h > 1080 OR t_end_ms < t_start_ms").count() == 0


def test_main_component_drops_islands(spark):
    runs = [(1, 0, 0, 2), (1, 1, 0, 10), (1, 2, 0, 3), (1, 2, 8, 10), (1, 3, 0, 10), (1, 6, 4, 5)]
    got = zones.main_component(spark.createDataFrame(runs, "mask_id long, y long, x0 long, x1 long"))
    assert got.count() == 5 and got.filter("y = 6").count() == 0


def test_carve_rejects_inner_notches(spark):
    box = spark.createDataFrame([(1, 0, 0, 100, 100), (2, 0, 0, 100, 100)], "k long, x0 long, y0 long, x1 long, y1 long")
    cut = spark.createDataFrame([(1, 80, 50, 100, 60), (1, 0, 0, 100, 10), (2, 40, 40, 60, 60)], "k long, nx0 long, ny0 long, nx1 long, ny1 long")
    bands, bad = zones.carve(box, cut, "k")
    assert sorted(tuple(r) for r in bands.collect()) == [(1, 0, 10, 100, 50), (1, 0, 50, 80, 60), (1, 0, 60, 100, 100)]
    assert [r.k for r in bad.collect()] == [2]


def test_overlay_reasons(spark):
    rows = [("image", "full-bleed", "cut", 0, 0, 100, None), ("gif", "pip-rect", "fade", 80, 0, 100, None)]
    df = spark.createDataFrame([(k, p, t, f, s, e, r, r) for k, p, t, f, s, e, r in rows], "kind string, placement string, transition string, fade_ms long, start_ms long, end_ms long, rw long, rh long")
    good, bad = overlays.validate(df, overlays.overlay_reasons())
    assert good.count() == 1 and bad.first().reasons == ["kind", "fade too long", "no rect"]


def test_transcript_prefers_top_level_words(spark):
    docs = ['{"words":[{"word":" a ","start":0,"end":1},{"text":"b","start":1,"end":2},{"word":"c","end":3}],"segments":[{"words":[{"word":"z","start":0,"end":1}]}]}', '{"segments":[{"words":[{"word":"z","start":0,"end":1}]},{}]}', "not json"]
    df = spark.createDataFrame(list(enumerate(docs)), "clip_id long, doc string")
    assert [(r.clip_id, r.idx, r.word) for r in documents.read_word_transcripts(df).orderBy("clip_id", "idx").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "z")]


def test_text_forms(spark):
    df = spark.createDataFrame([("https://u@WWW.Example.com:80/x", "aa bb  cc")], "u string, t string")
    assert tuple(df.select(exprs.citation(F.col("u")), exprs.clip_text(F.col("t"), 7), exprs.srt_time(F.lit(-5)), exprs.term_key(F.lit(' "Hi!" '))).first()) == ("u@www.example.com:80", "aa bb…", "00:00:00,000", "hi")
