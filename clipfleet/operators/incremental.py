"""Recomputing only what a change of targets invalidates: artefacts in versioned buckets of clips.

An artefact's rows lie under root/<artefact>/version=V/bucket=B. The manifest, a small table under root/manifest, says which
version of each bucket counts; its rows are added last, in one file for all artefacts, so a run that breaks off leaves
nothing that readers see. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "artefact string, bucket int, version long, schema string"


def _manifest(spark: SparkSession, root: str) -> list:
    """The newest row of each (artefact, bucket): at most artefacts x buckets rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    return rows.groupBy("artefact", "bucket").agg(F.max(F.struct("version", "schema")).alias("m")).select("artefact", "bucket", "m.*").collect()


def _counting(rows: list) -> Column:
    """The partitions that count, as a filter that prunes folders."""
    versions: dict[int, list[int]] = {}
    for r in rows:
        versions.setdefault(r.version, []).append(r.bucket)
    keep = F.lit(False)
    for v, buckets in sorted(versions.items()):
        keep = keep | ((F.col("version") == v) & F.col("bucket").isin(buckets))
    return keep


def _read(spark: SparkSession, root: str, artefact: str, rows: list) -> DataFrame:
    schema = max(rows, key=lambda r: r.version).schema
    table = spark.read.schema(f"{schema}, version long, bucket int").parquet(f"{root}/{artefact}")
    return table.filter(_counting(rows)).drop("version", "bucket")


def current(spark: SparkSession, root: str, artefact: str) -> DataFrame:
    """The artefact's rows as of the newest version, with `computed`, the version in which the clip's rows were made."""
    rows = [r for r in _manifest(spark, root) if r.artefact == artefact]
    if not rows:
        raise ValueError(f"{artefact} was never computed under {root}")
    return _read(spark, root, artefact, rows)


def refresh(root: str, clips: DataFrame, artefacts: Mapping[str, Callable[[DataFrame], DataFrame]], changes: DataFrame | None = None, buckets: int = 64) -> int:
    """Recomputes the artefacts that changes invalidate and returns the version.

    clips: clip_id, project_id and what the artefacts' functions need, as of now. changes: rows of `target_invalidation`
    since the last version; None computes all. A function takes the clips to do and returns rows with clip_id; `computed`,
    `version` and `bucket` are names of the store. Buckets of clips that are done again are written anew, with the rows of
    their other clips as they were; other buckets aren't read. Artefacts that were never computed are computed whole.
    Clips without an id or a project belong to no change, so only whole runs compute them; no clips or no changes leave
    the store as it is, but for a first, empty version. `buckets` holds for the life of a store.
    """
    spark = clips.sparkSession
    known = _manifest(spark, root)
    version = max((r.version for r in known), default=0) + 1
    at = F.pmod(F.xxhash64("clip_id"), F.lit(buckets)).cast("int")
    done = []
    for name, compute in artefacts.items():
        mine = [r for r in known if r.artefact == name]
        whole = changes is None or not mine
        todo = clips
        if not whole:
            hit = changes.filter(F.array_contains(F.split("invalidated", ","), name)).select("project_id").distinct()
            todo = clips.join(hit, "project_id", "left_semi")
        touched = range(buckets) if whole else sorted(r[0] for r in todo.select(at.alias("bucket")).distinct().collect())  # at most `buckets` numbers
        if not touched:
            continue
        fresh = compute(todo).withColumn("computed", F.lit(version).cast("long"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
        if not whole:
            old = _read(spark, root, name, [r for r in mine if r.bucket in set(touched)])
            fresh = fresh.unionByName(old.join(todo.select("clip_id").distinct(), "clip_id", "left_anti"), allowMissingColumns=True)
        # rebalancing splits a bucket whose clips have very many rows over several files
        fresh.withColumn("bucket", at).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}/version={version}")
        done += [(name, b, version, schema) for b in touched]
    if done:
        spark.createDataFrame(done, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version if done else version - 1


def superseded(spark: SparkSession, root: str) -> list[str]:
    """The folders under root that no reader of the newest version opens, to be deleted once older readers have ended."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = _manifest(spark, root)
    counts = {(r.artefact, r.version, r.bucket) for r in rows}
    out = []
    for name in sorted({r.artefact for r in rows}):
        for s in fs.Path(root).getFileSystem(conf).globStatus(fs.Path(f"{root}/{name}/version=*/bucket=*")):
            path = s.getPath()
            v, b = int(path.getParent().getName().split("=")[1]), int(path.getName().split("=")[1])
            if (name, v, b) not in counts:
                out.append(path.toString())
    return out
