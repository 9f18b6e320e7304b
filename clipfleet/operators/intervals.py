"""Joins by time within clips. None compares all pairs of a clip: an interval stands at the level of a binary hierarchy
that fits its length, where it meets two nodes at most, and a point probes one node of each level that its clip uses.
Points find the last mark before them by a scan in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 10_000
#: Width of a node of the lowest level.
UNIT = 8192


def over_buckets(rows: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """rows with `bucket`, once for each time bucket that the closed interval touches; empty intervals leave. For
    intervals that part a clip, whose buckets are no more than the clip has; others take join_intervals."""
    each = F.sequence(F.floor(F.col(start) / BUCKET_MS), F.floor(F.col(end) / BUCKET_MS))
    return rows.filter(F.col(end) >= F.col(start)).withColumn("bucket", F.explode(each))


def _node(t: Column, level: Column, unit: int) -> Column:
    return F.floor(t / (F.lit(float(unit)) * F.pow(F.lit(2.0), level))).cast("long")


def nodes(rows: DataFrame, start: str, end: str, unit: int = UNIT) -> DataFrame:
    """rows with `level` and `node`, once or twice each: the lowest level whose nodes are as wide as the closed interval,
    and the nodes that it touches there. Empty intervals leave."""
    length = F.col(end) - F.col(start) + 1
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(float(unit))))).cast("long")
    rows = rows.filter(F.col(end) >= F.col(start)).withColumn("level", level)
    return rows.withColumn("node", F.explode(F.sequence(_node(F.col(start), F.col("level"), unit), _node(F.col(end), F.col("level"), unit))))


def join_points(points: DataFrame, rows: DataFrame, t: str, start: str, end: str, keys: tuple[str, ...] = ("clip_id",), unit: int = UNIT) -> DataFrame:
    """points with the rows of the same keys for which start <= t <= end, each pair once."""
    covered = nodes(rows, start, end, unit)
    levels = covered.groupBy(*keys).agg(F.collect_set("level").alias("__levels"))
    probes = points.join(levels, list(keys)).withColumn("level", F.explode("__levels")).drop("__levels")
    probes = probes.withColumn("node", _node(F.col(t), F.col("level"), unit))
    return probes.join(covered, [*keys, "level", "node"]).filter((F.col(start) <= F.col(t)) & (F.col(t) <= F.col(end))).drop("level", "node")


def join_intervals(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, keys: tuple[str, ...] = ("clip_id",), unit: int = UNIT) -> DataFrame:
    """Pairs of rows of the same keys whose closed intervals share a time, each once: one of them holds the other's start,
    and of equal starts the left one counts as the earlier."""
    left, right = left.filter(F.col(le) >= F.col(ls)), right.filter(F.col(re) >= F.col(rs))
    inside = join_points(right, left, rs, ls, le, keys, unit)
    around = join_points(left, right, ls, rs, re, keys, unit).filter(F.col(ls) > F.col(rs))
    return inside.unionByName(around).select(*keys, *[c for c in (*left.columns, *right.columns) if c not in keys])


#: Width of the ranges of time that a scan within a clip is parted into.
RANGE_MS = 600_000


def as_of(points: DataFrame, marks: DataFrame, t: str, at: str, width: int = RANGE_MS) -> DataFrame:
    """points (clip_id, t, ...) with `mark`, the last row of marks (clip_id, at, ...) at or before t, as a struct.

    A scan in two levels, so that a very long clip spreads over tasks: the last marks of the ranges of time are carried
    over one small row a range, each range then begins with the mark carried into it, and is sorted by itself.
    """
    block = lambda x: F.floor(F.greatest(x, F.lit(-1e15)) / width).cast("long")
    p = points.withColumn("__at", F.col(t).cast("double")).withColumn("__late", F.lit(2)).withColumn("__block", block(F.col("__at")))
    m = marks.select("clip_id", F.col(at).cast("double").alias("__at"), F.lit(1).alias("__late"), F.struct(*[F.col(c) for c in marks.columns if c != "clip_id"]).alias("mark"))
    m = m.filter("__at IS NOT NULL").withColumn("__block", block(F.col("__at")))
    ends = m.groupBy("clip_id", "__block").agg(F.max_by("mark", "__at").alias("mark"))
    used = ends.unionByName(p.select("clip_id", "__block").distinct(), allowMissingColumns=True).groupBy("clip_id", "__block").agg(F.first("mark", True).alias("mark"))
    ahead = Window.partitionBy("clip_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = used.withColumn("mark", F.last("mark", True).over(ahead)).filter("mark IS NOT NULL").withColumn("__at", F.lit(float("-inf"))).withColumn("__late", F.lit(0))
    w = Window.partitionBy("clip_id", "__block").orderBy("__at", "__late").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(m, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True).withColumn("mark", F.last("mark", True).over(w))
    return both.filter("__late = 2").select(*points.columns, "mark")
