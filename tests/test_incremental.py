"""Refreshed artefacts equal whole runs, and only what a change touches is written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clipfleet.operators import incremental as I

ART = {a: (lambda clips: clips.filter("size <> 0").select("clip_id", (F.col("size") * 2).alias("v"))) for a in ("reframe", "qc")}
CLIPS, CHANGES = "clip_id long, project_id long, size long, version string", "project_id long, seq long, effective string, invalidated string"


def rows(spark, root, name):
    return {r.clip_id: (r.v, r.computed) for r in I.current(spark, root, name).collect()}


def test_only_touched_rows_change(spark, tmp_path):
    root = str(tmp_path)
    clips = [(c, c % 7, c + 1, "x") for c in range(60)] + [(None, 1, 5, "x"), (100, None, 6, None)]
    assert I.refresh(root, spark.createDataFrame(clips, CLIPS), ART, buckets=8) == 1
    now = [(c, p, 0 if c == 3 else (s or 0) + 1000, v) for c, p, s, v in clips]
    changes = spark.createDataFrame([(3, 2, "4k", "safezone,captions,qc"), (3, 3, "4k", "qc"), (4, 2, "auto", ""), (None, 2, "auto", "qc")], CHANGES)
    assert I.refresh(root, spark.createDataFrame(now, CLIPS), ART, changes, 8) == 2
    want = {c: ((s + 1000) * 2, 2) if p == 3 else (s * 2, 1) for c, p, s, _ in clips if c != 3}
    assert rows(spark, root, "qc") == want  # clip 3 has no rows any more
    assert rows(spark, root, "reframe") == {c: (s * 2, 1) for c, p, s, _ in clips}
    old = I.superseded(spark, root)
    assert old and all("/qc/version=1/" in p for p in old)


def test_a_run_that_breaks_off_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    clips = spark.createDataFrame([(1, 1, 1, "x"), (2, 2, 2, "x")], CLIPS)
    I.refresh(root, clips, ART, buckets=4)

    def breaks(clips):
        raise RuntimeError("lost")

    hit = spark.createDataFrame([(1, 2, "auto", "reframe,qc")], CHANGES)
    with pytest.raises(RuntimeError):
        I.refresh(root, clips.withColumn("size", F.col("size") + 1), ART | {"qc": breaks}, hit, 4)
    assert rows(spark, root, "reframe") == {1: (2, 1), 2: (4, 1)}
    assert I.refresh(root, clips.withColumn("size", F.col("size") + 5), ART, hit, 4) == 2
    assert rows(spark, root, "reframe") == rows(spark, root, "qc") == {1: (12, 2), 2: (4, 1)}


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    none = spark.createDataFrame([], CLIPS)
    assert I.refresh(root, none, ART, buckets=4) == 1 and rows(spark, root, "qc") == {}
    assert I.refresh(root, none, ART, spark.createDataFrame([], CHANGES), 4) == 1
    with pytest.raises(ValueError):
        I.current(spark, root, "captions")
