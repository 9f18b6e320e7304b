"""Findings of the third round: zones that many clips share, and rectangles that were shuffled several times."""

from __future__ import annotations

import re

from clipfleet.operators import zones
from clipfleet.plans import registry


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rectangles_are_shuffled_once(spark, sf_dir):
    # they were made distinct, dealt to nodes and joined back before: nine shuffles and five passes over the lines
    text = executed(registry.QUERIES["zone_clears"](spark, sf_dir))
    assert text.count("lineitem.parquet") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(clip_id", text)) == 1 and "SortMergeJoin" not in text


def test_rectangles_over_nodes_and_repeated(spark):
    bands = spark.createDataFrame([("a", 0, 0, 100, 130), ("a", 0, 130, 100, 1000), ("a", 0, 900, 50, 2000), ("a", 0, 0, 100, 130)], "zone string, x0 long, y0 long, x1 long, y1 long")
    rows = [(1, "a", 0, 60, 100, 1000), (1, "a", 0, 60, 100, 1000), (2, "a", 0, 60, 100, 1001), (3, "a", 0, 60, 50, 2000), (4, "a", 0, 60, 50, 2001), (5, "b", 0, 0, 1, 1), (6, "b", 0, 5, 1, 5), (7, "a", 0, -1, 5, 20), (8, "a", 3, 7, 9, 7)]
    rects = spark.createDataFrame(rows, "k long, zone string, x0 long, y0 long, x1 long, y1 long")
    got = {r.k: r.clear for r in zones.zone_clears(rects, bands, ["k"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: True}


def test_shared_zones_are_carved_once_a_size(spark, sf_dir):
    # orders were joined with their seven zones by zone and then carved one by one: windows over all of them
    text = executed(registry.QUERIES["resolve_zones_custom"](spark, sf_dir))
    assert "Window" not in text and "SortMergeJoin" not in text


def test_boxes_are_carved_in_one_row(spark):
    boxes = spark.createDataFrame([(k, 0, 0, 10, 20) for k in range(1, 6)], "k long, x0 long, y0 long, x1 long, y1 long")
    cuts = spark.createDataFrame([(1, 8, 5, 12, 9), (1, -1, 7, 3, 9), (2, 3, 4, 5, 6), (3, -5, 8, 20, 12), (4, 0, -5, 10, 40), (1, 8, 9, 12, 11)], "k long, nx0 long, ny0 long, nx1 long, ny1 long")
    bands, bad = zones.carve(boxes, cuts, "k")
    assert "Window" not in executed(bands)
    got = sorted(map(tuple, bands.select("k", "x0", "y0", "x1", "y1").collect()))
    assert got == [(1, 0, 0, 10, 5), (1, 0, 5, 8, 7), (1, 0, 9, 8, 11), (1, 0, 11, 10, 20), (1, 3, 7, 8, 9), (3, 0, 0, 10, 8), (3, 0, 12, 10, 20), (5, 0, 0, 10, 20)]
    assert list(map(tuple, bad.collect())) == [(2, "notch inside a row")]
