"""Streaming queries, run over what the tables hold in three steps until all is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clipfleet.plans.base import Tables, query
from clipfleet.plans.q_roughcut import STEPS
from clipfleet.sources.scratch import scratch_root
from clipfleet.streaming import timeline as S


def streamed(rows: DataFrame, step, run, key: str | None = None) -> DataFrame:
    """run over a stream of rows that arrive in three steps (the value of `step`), as a table.

    rows are computed once, and each step arrives in as many files as tasks write it; the stream reads them as one batch
    and goes on from its checkpoint when the next step has come. With a key a row of no key (null; other columns as in some
    row) comes a day after all, so that the watermark passes them.
    """
    spark = rows.sparkSession
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    stepped = lambda df: df.withColumn("__step", step.cast("long"))
    stepped(rows).write.partitionBy("__step").parquet(f"{root}/all")
    come = spark.read.schema(StructType([*rows.schema.fields, StructField("__step", LongType())])).parquet(f"{root}/all")
    if key is not None:
        last = come.agg(F.max_by(F.struct(*rows.columns), "at").alias("r")).filter("r IS NOT NULL").select("r.*")
        last = last.withColumn(key, F.lit(None).cast(rows.schema[key].dataType)).withColumn("at", F.col("at") + F.expr("INTERVAL 1 DAY"))
        come = come.unionByName(stepped(last))
    with S.with_rocksdb(spark):
        for k in range(3):
            come.filter(F.col("__step") == k).drop("__step").write.mode("append").parquet(f"{root}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
            run(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("SELECT clip_id, start_ms, end_ms FROM silences", STEPS)
def stream_silence_pairs(t: Tables):
    e = t.silence_log.select("clip_id", "line_no", F.col("line").contains("silence_start:").alias("opens"), F.rint(F.regexp_extract("line", r"(-?[0-9]+\.[0-9]+)$", 1).cast("double") * 1000).cast("long").alias("ms"))
    e = e.withColumn("at", F.timestamp_millis(F.col("ms") + 86_400_000))
    # every other line comes half a minute late, so rows of all batches but the last are out of order across batches
    step = F.least(F.floor((F.unix_millis("at") - 86_400_000 + F.col("line_no") % 2 * 30_000) / 60_000), F.lit(2))
    return streamed(e, step, S.silence_pairs, "clip_id").filter("clip_id IS NOT NULL")


@query("""SELECT project_id, seq, eff AS effective, CASE WHEN seq = 1 THEN '' WHEN turned THEN 'framing,reframe,safezone,captions,qc' WHEN eff <> lag(eff) OVER w THEN 'safezone,captions,qc' ELSE '' END AS invalidated FROM (
  SELECT *, CASE WHEN turned THEN 'auto' ELSE resolution END AS eff FROM (SELECT *, coalesce(aspect <> lag(aspect) OVER (PARTITION BY project_id ORDER BY seq), false) AS turned FROM target_history) a) b WINDOW w AS (PARTITION BY project_id ORDER BY seq)""")
def stream_target_changes(t: Tables):
    # a change a minute; every other one comes a minute late
    h = t.target_history.withColumn("at", F.timestamp_millis(F.col("seq") * 60_000 + 86_400_000))
    step = F.least(F.floor((F.col("seq") + F.col("seq") % 2) / 4), F.lit(2))
    return streamed(h, step, lambda s: S.target_changes(s, 120_000), "project_id").filter("project_id IS NOT NULL")


@query("SELECT clip_id, min(start_ms) AS start_ms, max(start_ms) AS end_ms, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY clip_id ORDER BY start_ms) AS session FROM (SELECT clip_id, start_ms, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY clip_id ORDER BY start_ms) > 600 THEN 1 ELSE 0 END AS o FROM words) a) b GROUP BY clip_id, session")
def stream_pause_sessions(t: Tables):
    w = t.words.select("clip_id", F.timestamp_millis("start_ms").alias("at"), "start_ms")
    # a word of no clip, an hour after all others, lets the watermark close their sessions
    last = w.agg((F.max("start_ms") + 3_600_000).alias("start_ms")).select(F.lit(None).cast("long").alias("clip_id"), F.timestamp_millis("start_ms").alias("at"), "start_ms")
    return streamed(w.union(last), F.least(F.floor(F.col("start_ms") / 60000), F.lit(2)), lambda s: S.pause_sessions(s))
