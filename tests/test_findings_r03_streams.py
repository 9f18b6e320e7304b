"""Findings of the third round: cues and tracks that are formed in a stream."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from clipfleet.operators import captions, tracks
from clipfleet.plans import registry


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spans_side_by_side_are_parted_like_single_ones():
    for seed in range(60):
        rng = random.Random(seed)
        n = [rng.choice([1, 2, 3, 5, 9, rng.randrange(1, 80)]) for _ in range(rng.choice([0, 1, 5, 40, 200]))]
        chars, breaks, commas = ([f() for _ in range(sum(n))] for f in (lambda: rng.randrange(1, 14), lambda: rng.random() < 0.2, lambda: rng.random() < 0.2))
        limits = rng.choice([1, 2, 4, 7]), rng.choice([1, 2, 3]), rng.choice([5, 24, 60]), rng.choice([1, 3, 4])
        first, want = np.cumsum([0, *n])[:-1], []
        for f, m in zip(first.tolist(), n, strict=True):
            cue = captions.partition_span(chars[f : f + m], breaks[f : f + m], commas[f : f + m], *limits)
            want += [k == 0 or cue[k] != cue[k - 1] for k in range(m)]
        got = captions.partition_spans(first.astype(int), np.array(n, int), np.array(chars, int), np.array(breaks, bool), np.array(commas, bool), *limits)
        assert got.tolist() == want


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_spans_go_on_over_batches(size):
    rows = [(c, 100 * k + (900 if k in (4, 9) else 0), 100 * k + 90 + (900 if k in (4, 9) else 0), k == 6) for c in (1, 1 << 60, (1 << 60) + 1) for k in range(12)]
    table = pa.table({"clip_id": [r[0] for r in rows], "start_ms": [r[1] for r in rows], "end_ms": [r[2] for r in rows], "__ends": [r[3] for r in rows]})
    parts = list(captions._by_whole_spans(iter(table.to_batches(max_chunksize=size)), 600))
    assert pa.concat_tables([p for p, _, _ in parts]).to_pylist() == table.to_pylist()
    opens = np.concatenate([o for _, _, o in parts])
    assert np.flatnonzero(opens).tolist() == [12 * c + k for c in range(3) for k in (0, 4, 7, 9)]
    assert all(o[0] for _, _, o in parts)


def test_plain_cues_take_few_windows(spark, sf_dir):
    # spans, places in spans and cues were windows over all words: seven of them, and words were formed twice
    for name in ("words_to_cues", "emphasis", "cue_round_trip"):
        text = optimized(registry.QUERIES[name](spark, sf_dir))
        assert text.count("Window [") <= 2 and text.count("posexplode(filter(split(text") == 1


def test_whole_tracks_are_those_of_chunks(spark):
    rng, rows = random.Random(5), []
    for clip, n in enumerate((1, 2, 3, 700, 90)):
        rows += [(clip, g, g * 1000 / 15, rng.uniform(0, 1920), 500.0 if clip == 2 else rng.uniform(0, 1080)) for g in range(n)]
    grid = spark.createDataFrame(rows, "clip_id long, g long, t_ms double, cx double, cy double")
    sizes = spark.createDataFrame([(c, 1920, 1080) for c in range(5)], "clip_id long, src_w long, src_h long")
    told = lambda whole: [(r.clip_id, r.axis, r.g, r.t_ms, r.raw, round(r.v, 6), r.key) for r in tracks.smooth_tracks(grid, sizes, whole=whole).orderBy("clip_id", "axis", "g").collect()]
    assert told(50_000) == told(0) == told(100)
    assert "MapInArrow" in optimized(tracks.smooth_tracks(grid, sizes)) and "Join" not in optimized(tracks.smooth_whole(spark.range(0).selectExpr("id clip_id", "'x' axis", "id g", "0D t_ms", "0D raw", "1L side")))
