"""Findings of the third round: queries that formed the words of all clips many times."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clipfleet.operators import captions, timeline
from clipfleet.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def word_passes(spark, sf_dir, name):
    return plan(registry.QUERIES[name](spark, sf_dir)).count("posexplode(filter(split(text")


def test_cut_time_forms_words_once(spark, sf_dir):
    # the base cut is stored; before, each of its readers formed the words anew, and times were scanned twice
    for name in ("source_to_cut", "remap_cues", "timeline_events"):
        assert word_passes(spark, sf_dir, name) == 1
    assert word_passes(spark, sf_dir, "remap_overlays") == 0


def test_rows_keep_their_columns_in_the_cut(spark):
    base = spark.createDataFrame([(1, 0, 0, 30, 0), (1, 1, 60, 90, 30)], "clip_id long, n long, in_f long, out_f long, offset_f long")
    rows = spark.createDataFrame([(1, 5, 500, 2500, "x", None), (1, 6, 1200, 1500, None, 7), (2, 5, 0, 10, "y", 1)], "clip_id long, i long, start_ms long, end_ms long, side string, ms long")
    got = sorted(map(tuple, timeline.to_cut(rows, base, 30).select("clip_id", "i", "side", "ms", "start_f", "end_f", "kept").collect()))
    assert got == [(1, 5, "x", None, 15, 45, True), (1, 6, None, 7, 30, 30, False), (2, 5, "y", 1, 0, 0, False)]


def test_cues_by_looking_ahead(spark):
    rows = [(c, k, f"w{k}", 10 * k, 10 * k + 5, k // 3 + (k > 6)) for c in (1, 2) for k in range(c * 9)]
    words = spark.createDataFrame(rows, "clip_id long, idx long, word string, start_ms long, end_ms long, cue long")
    terms = spark.createDataFrame([(1, ["w4"])], "clip_id long, terms array<string>")
    told = lambda **how: sorted(map(str, captions.words_to_cues(words, terms, **how).collect()))
    assert told(most=3) == told(most=5) == told()
    assert "Aggregate" not in plan(captions.words_to_cues(words, most=3))
    with pytest.raises(Exception, match="more than 2 words"):
        captions.words_to_cues(words, most=2).select(F.sum("start_ms"), F.max("words")).collect()


def test_words_stay_where_their_clips_lie(spark, sf_dir):
    # the joins that find phrases and their times meet words by broadcast of what is known to be small
    for name in ("propose_windows", "cards_to_overlays"):
        assert word_passes(spark, sf_dir, name) <= 3  # tokens of clusters, and both ends of the exact runs; 7 before
        assert "SortMergeJoin" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_to_many_tasks(spark, sf_dir):
    from clipfleet.plans.fixtures import fixture

    assert fixture(spark, sf_dir, "whole_texts").rdd.getNumPartitions() >= 16  # 4 a split before, too few to sort words in memory


def test_untrimmed_cut_shuffles_texts_only(spark, sf_dir):
    # words met their clip's one segment by bucket before, which shuffled all of them
    text = registry.QUERIES["rough_cut_untrimmed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(clip_id" not in text


def test_untrimmed_cut_takes_words_by_their_centre(spark):
    from clipfleet.operators import roughcut

    words = spark.createDataFrame([(1, 1, "b", 900, 1000), (1, 0, "a", 0, 100), (1, 2, "c", 950, 1051), (2, 0, "d", 0, 9)], "clip_id long, idx long, word string, start_ms long, end_ms long")
    lengths = spark.createDataFrame([(1, 1000), (3, 5)], "clip_id long, duration_ms long")
    got = sorted(map(tuple, roughcut.rough_cut(words, lengths, trim=False).select("clip_id", "end_ms", "text").collect()))
    assert got == [(1, 1000, "a b"), (3, 5, "")]


def test_glossary_streams_clips_over_batches(spark):
    rows = [(c, k, "of" if (k + c) % 5 == 0 else "the" if (k + c) % 5 == 1 and k % 3 else "Art", 10 * k, 10 * k + 5) for c in range(6) for k in range(c * 30)]
    words = spark.createDataFrame([(*r, r[2].lower()) for r in rows], "clip_id long, idx long, word string, start_ms long, end_ms long, norm string")
    want = []
    for c in range(6):
        now = [r for r in rows if r[0] == c]
        out, k = [], 0
        while k < len(now):
            pair = now[k][2] == "of" and k + 1 < len(now) and now[k + 1][2] == "the"
            out.append((c, len(out), "OF-THE" if pair else "THE" if now[k][2] == "the" else now[k][2], now[k][3], now[k + pair][4]))
            k += 1 + pair
        want += out
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, 7)
    try:
        done = captions.apply_glossary(words, [("of the", "OF-THE"), ("the", "THE")])
        assert "FlatMapGroups" not in plan(done)  # a group of pandas rows a clip before
        assert sorted(tuple(r)[:5] for r in done.collect()) == sorted(want)
    finally:
        spark.conf.set(conf, before)


def test_boxes_do_not_multiply_cues(spark, sf_dir):
    for name, most in (("avoid_rects", 6), ("caption_box_avoiding", 2), ("qc_elements_from", 4)):
        assert word_passes(spark, sf_dir, name) <= most
    text = plan(registry.QUERIES["caption_box_avoiding"](spark, sf_dir))
    assert "min_by" not in text  # three rows a cue were grouped before


def test_transcript_words_are_counted_in_their_array(spark):
    from clipfleet.sources import documents

    doc = '{"segments": [{"words": [{"text": " a ", "start": 0, "end": 0.5}, {"word": " ", "start": 1, "end": 2}]}, {}, {"words": [{"word": "B", "start": 1}, {"word": "C!", "start": 1, "end": 1.25}]}]}'
    rows = documents.read_word_transcripts(spark.createDataFrame([(1, doc), (2, "no json")], "clip_id long, doc string"))
    assert "Window" not in plan(rows)  # words were shuffled and sorted to be counted before
    assert [tuple(r) for r in rows.orderBy("idx").collect()] == [(1, 0, "a", 0, 500, "a"), (1, 1, "C!", 1000, 1250, "c")]
