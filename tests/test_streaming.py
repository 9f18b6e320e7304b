"""Streams: order, restarts from a checkpoint, and state that goes."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from clipfleet.streaming import timeline as S

SCHEMA = "clip_id long, line_no long, opens boolean, ms long, at timestamp"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event(clip, line, opens, ms):
    return (clip, line, opens, ms, DAY + dt.timedelta(milliseconds=ms))


def run(spark, root, run, schema):
    """Reads all files that are new in root/in, one a batch, from the checkpoint of the last run."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    with S.with_rocksdb(spark):
        run(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{root}/out").collect()), key=repr)


def put(spark, root, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")


def held(spark, root, name):
    return spark.read.format("statestore").option("path", f"{root}/state").option("stateVarName", name).load().count()


def pairs(events):
    out, pending = [], {}
    for c, _, opens, ms, _ in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1])):
        if opens:
            pending[c] = ms
        elif pending.get(c) is not None:
            out.append((c, pending.pop(c), ms))
    return sorted([*out, *((c, ms, None) for c, ms in pending.items())], key=repr)


def test_rows_out_of_order_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    events = [event(c, k, rng.random() < 0.6, 1000 * (k + c)) for c in range(6) for k in range(1, 90)]
    arrive = lambda e: e[3] + rng.randrange(25_000)
    order = sorted(events, key=arrive)
    cuts = [order[i : i + 120] for i in range(0, len(order), 120)]
    for part in cuts[:2]:
        put(spark, tmp_path, part)
    first = run(spark, tmp_path, lambda s: S.silence_pairs(s, 30_000), SCHEMA)
    assert held(spark, tmp_path, "early") > 0  # what the watermark hasn't passed waits for the next run
    for part in [*cuts[2:], [event(99, 0, False, 10_000_000)], [event(99, 1, False, 20_000_000)]]:
        put(spark, tmp_path, part)
    both = run(spark, tmp_path, lambda s: S.silence_pairs(s, 30_000), SCHEMA)
    assert set(first) < set(both) and both == pairs(events)
    assert held(spark, tmp_path, "early") == 1 and held(spark, tmp_path, "carry") == 1  # only the clip that came last


def test_state_goes_and_late_or_odd_rows(spark, tmp_path):
    odd = [event(None, 1, True, 1000), event(None, 2, False, 2000), (7, 3, None, 5, DAY), (7, None, True, 5, DAY), (7, 4, True, None, DAY), (7, 4, True, 5, None)]
    put(spark, tmp_path, [event(1, 1, True, -500), event(1, 2, False, 700), event(1, 3, True, 900), event(2, 1, False, 100), *odd])
    put(spark, tmp_path, [event(3, 1, True, 5_000_000), event(3, 1, True, 5_000_000)])
    put(spark, tmp_path, [event(3, 2, True, 5_000_001)])  # late rows go by the watermark of the batch before
    put(spark, tmp_path, [event(1, 4, False, 950), event(1, 5, False, 4_999_999)])  # line 4 is too late; line 5 begins anew
    got = run(spark, tmp_path, S.silence_pairs, SCHEMA)
    assert got == sorted([(1, -500, 700), (1, 900, None), (None, 1000, 2000)], key=repr)


@pytest.mark.parametrize("idle,want", [(None, "safezone,captions,qc"), (600_000, "")])
def test_targets_are_kept_unless_they_expire(spark, tmp_path, idle, want):
    schema = "project_id long, seq long, aspect string, resolution string, at timestamp"
    row = lambda p, seq, res, s: (p, seq, "square", res, DAY + dt.timedelta(seconds=s))
    put(spark, tmp_path, [row(1, 1, "auto", 0)], schema)
    for s in (2000, 4000):
        put(spark, tmp_path, [row(2, s, "auto", s)], schema)
    put(spark, tmp_path, [row(1, 2, "4k", 4001)], schema)
    put(spark, tmp_path, [row(2, 9999, "auto", 9000)], schema)
    got = run(spark, tmp_path, lambda s: S.target_changes(s, idle_ms=idle), schema)
    assert (1, 1, "auto", "") in got and (1, 2, "4k", want) in got


def test_empty_stream(spark, tmp_path):
    put(spark, tmp_path, [])
    assert run(spark, tmp_path, S.silence_pairs, SCHEMA) == []
