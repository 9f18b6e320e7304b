"""Findings of the third round: work that grew faster than the input."""

from __future__ import annotations

from clipfleet.operators import overlays, roughcut
from clipfleet.plans import registry
from clipfleet.sources import documents


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rough_cut_derives_words_a_few_times(spark, sf_dir):
    # the runs, the lengths of clips (twice) and the words that segments hold
    for name in ("rough_cut", "kept_segments", "decision_heads", "decision_round_trip"):
        assert plan(registry.QUERIES[name](spark, sf_dir)).count("posexplode(filter(split(text") <= 4
    assert plan(registry.QUERIES["rough_cut_untrimmed"](spark, sf_dir)).count("posexplode(filter(split(text") <= 2


def test_segments_that_overlap_share_words(spark):
    segments = spark.createDataFrame([(1, 0, 0, 25_000, True), (1, 1, 9_000, 11_000, False), (1, 2, 30_000, 30_000, True)], "clip_id long, i long, start_ms long, end_ms long, keep boolean")
    labelled = spark.createDataFrame([(1, 0, "a", 0, 200, None), (1, 1, "um", 9_900, 10_500, "filler"), (1, 2, "b", 10_600, 10_800, None), (1, 3, "c", 24_800, 25_200, "false-start")], "clip_id long, idx long, word string, start_ms long, end_ms long, label string")
    want = [(0, "", "a um b"), (1, "filler", "um b"), (2, "", "")]
    told = roughcut._told(segments, labelled).orderBy("i").select("i", "reason", "text").collect()
    apart = roughcut.segment_text(roughcut.drop_reasons(segments, labelled), labelled).orderBy("i").select("i", "reason", "text").collect()
    assert list(map(tuple, told)) == want == list(map(tuple, apart))


def test_occupancy_is_parsed_once_a_document(spark):
    docs = spark.createDataFrame([(1, '{"frame_w": 100, "frame_h": 50, "items": [{"x": 1, "y": 2, "w": 3, "h": 4, "start": 0, "end": 1}]}')], "clip_id long, doc string")
    rows = documents.read_occupancy(docs, 200, 100)
    above = plan(rows).split("Generate explode")[0]
    assert "from_json" not in above  # else each window parses its whole document again
    assert [tuple(r) for r in rows.collect()] == [(1, "overlay", 2, 4, 6, 8, 0, 1000, None)]


def test_rows_added_under_a_key_in_use(spark):
    of = lambda rows: spark.createDataFrame(rows, "clip_id long, i long, fade_ms long")
    before = of([(1, 1, 0), (1, 2, 5), (1, 3, 7), (1, 4, 9), (1, 4, 9)])
    after = of([(1, 1, 0), (1, 1, 4), (1, 2, 6), (1, 4, 9), (1, 5, None)])
    got = sorted(map(tuple, overlays.diff_decisions(before, after, ["clip_id", "i"]).collect()))
    assert got == [(1, 1, "added"), (1, 2, "changed"), (1, 3, "removed"), (1, 4, "removed"), (1, 5, "added")]


def test_streams_arrive_in_the_files_of_many_tasks(spark):
    import glob

    from pyspark.sql import functions as F

    from clipfleet.plans.q_streaming import streamed
    from clipfleet.sources.scratch import scratch_root

    folder = scratch_root(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/stream-*"))
    rows = spark.range(0, 300, 1, 4)
    got = streamed(rows, F.col("id") % 3, lambda s: s)
    (new,) = set(glob.glob(f"{folder}/stream-*")) - before
    assert len(glob.glob(f"{new}/in/*.parquet")) > 3  # one task wrote each step before
    assert sorted(r.id for r in got.collect()) == list(range(300))
