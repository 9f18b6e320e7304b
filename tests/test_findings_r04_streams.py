"""Findings of the fourth round: streams whose calls on state grew with the number of keys."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd

from clipfleet.plans.fixtures import fixture
from clipfleet.streaming import timeline as S
from tests.test_streaming import DAY, SCHEMA, event, held, pairs, put, run


class Store:
    """A state that counts calls."""

    calls = 0

    def __init__(self):
        self.value = None

    def __getattr__(self, name):
        Store.calls += 1
        return {"get": lambda: self.value, "update": lambda x: setattr(self, "value", x), "clear": lambda: setattr(self, "value", None)}[name]


def processor(idle_ms):
    p = S._Targets(idle_ms)
    p.init(SimpleNamespace(getValueState=lambda name, schema: Store(), listTimers=lambda: [], deleteTimer=lambda at: None, registerTimer=lambda at: None))
    return p


def test_a_bucket_of_many_keys_asks_for_its_state_once():
    # each key asked for, and wrote, states of its own before: five calls and more a key
    for n in (10, 2000):
        p, before = processor(None), Store.calls
        frame = pd.DataFrame([(False, k, 1000 * s, s, "square", "auto") for k in range(n) for s in (1, 2)], columns=["without", "key", "at_ms", "seq", "aspect", "resolution"])
        (out,) = p.handleInputRows((0,), iter([frame]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1500))
        assert len(out) == n and Store.calls - before <= 4
        (out,) = p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2500), None)
        assert sorted(out["seq"]) == [2] * n and Store.calls - before <= 8


def test_keys_of_one_bucket_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 1)
    rng = random.Random(7)
    events = [event(c, k, rng.random() < 0.6, 1000 * (k + (c or 0))) for c in (None, *range(20)) for k in range(1, 30)]
    order = sorted(events, key=lambda e: e[3] + rng.randrange(25_000))
    for i in range(0, len(order), 150):
        put(spark, tmp_path, order[i : i + 150])
    for at in (10_000_000, 20_000_000):
        put(spark, tmp_path, [event(99, at, False, at)])
    assert run(spark, tmp_path, lambda s: S.silence_pairs(s, 30_000), SCHEMA) == pairs(events)
    assert held(spark, tmp_path, "carry") == 1


def test_the_closing_row_comes_from_what_was_stored(spark):
    from pyspark.sql import functions as F

    from clipfleet.plans.q_streaming import streamed

    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (seen.add(1), x)[1], "long")
    rows = spark.range(40).select("id", count("id").alias("v")).withColumn("at", F.lit(DAY) + F.make_interval(secs=F.col("v")))
    got = streamed(rows, F.least(F.floor(F.col("v") / 20), F.lit(2)), lambda s: s, "id").collect()
    assert seen.value == 40  # rows were computed again to find the last one before
    (last,) = [r for r in got if r.id is None]
    assert len(got) == 41 and last.v == 39 and last.at == max(r.at for r in got if r.id is not None) + dt.timedelta(days=1)


def test_the_silence_log_forms_words_once(spark, sf_dir):
    plan = fixture(spark, sf_dir, "silence_log")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(filter(split(text") == 1
