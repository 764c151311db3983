"""Stored tables: upserts, deletions, pruning, overlays and the write spool, as rebuilt DataFrames.

Tables are written to a new version directory and the pointer is moved, so a job never reads what it overwrites.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import backoff_ms


def upsert_by_path(stored: DataFrame, new: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """stored without the paths of new (or of paths), and new."""
    changed = (paths if paths is not None else new).select("path").distinct()
    return stored.join(changed, "path", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_paths(stored: DataFrame, paths: DataFrame) -> DataFrame:
    return stored.join(paths.select("path").distinct(), "path", "left_anti")


def prune_to_paths(stored: DataFrame, paths: DataFrame) -> DataFrame:
    return stored.join(paths.select("path").distinct(), "path", "left_semi")


def apply_changes(stored: DataFrame, changes: DataFrame, rows: DataFrame) -> DataFrame:
    """stored after changes (seq, operation, path): upsert_file, delete_file or prune_to_paths (path in the set to keep).

    Of the changes to a path the last counts. A pruning takes every path that isn't in its set and that no later
    upsert brings back. rows has the new rows of upserted paths.
    """
    pruned = changes.filter("operation = 'prune_to_paths'")
    last_prune = pruned.agg(F.max("seq").alias("at"))
    keep = pruned.join(F.broadcast(last_prune), F.col("seq") == F.col("at"), "left_semi").select("path")
    single = changes.filter("operation <> 'prune_to_paths'")
    newest = single.groupBy("path").agg(F.max_by("operation", "seq").alias("operation"), F.max("seq").alias("seq"))
    out = upsert_by_path(stored, prune_to_paths(rows, newest.filter("operation = 'upsert_file'")), newest)
    if pruned.isEmpty():
        return out
    later = newest.join(F.broadcast(last_prune), F.col("seq") > F.col("at"), "left_semi").filter("operation = 'upsert_file'").select("path")
    return prune_to_paths(out, keep.union(later))


def file_blobs(nested: DataFrame) -> DataFrame:
    """(path, blob): each file's nested row as JSON."""
    return nested.select("path", F.to_json(F.struct(*nested.columns)).alias("blob"))


def load_blobs(blobs: DataFrame, schema: str) -> DataFrame:
    return blobs.select(F.from_json("blob", schema).alias("f")).select("f.*")


def write_version(df: DataFrame, root: str, version: int) -> None:
    """Write df as a version of the table at root; the same version twice, as after a retry, is written once over."""
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{root}/_current")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(f"{root}/_current").first()["version"]
    return spark.read.parquet(f"{root}/v={version}")


#: For each stored table: columns that a version of its schema added, with what older rows have in them.
SCHEMAS: dict[str, dict[int, dict[str, str]]] = {
    "snapshots": {2: {"project_key": "'default'"}},
    "symbols": {7: {"usage_tag": "''", "confidence": "0.0D", "ancestry": "''", "line": "0"}},
}


def migrated(df: DataFrame, table: str, version: int) -> DataFrame:
    """df, written under a version of its table's schema, with the columns of the newest one; ValueError for a newer version."""
    steps = SCHEMAS.get(table, {})
    if version > max(steps, default=1):
        raise ValueError(f"{table} was written by a newer version: {version}")
    for at in sorted(steps):
        if at > version:
            df = df.withColumns({c: F.expr(e) for c, e in steps[at].items() if c not in df.columns})
    return df


ACTIVE, STALE = "ACTIVE", "RE-VERIFICATION"
OVERLAY_TYPES = ("EXCLUSION", "VETTED_USAGE", "RE-ALIAS")


def add_overlay(overlays: DataFrame, new: DataFrame) -> DataFrame:
    """overlays with the rows of new as active ones; an unknown type is an error."""
    bad = new.filter(~F.col("overlay_type").isin(*OVERLAY_TYPES)).first()
    if bad:
        raise ValueError(f"unknown overlay type {bad['overlay_type']!r}")
    return overlays.unionByName(new.withColumn("status", F.lit(ACTIVE)), allowMissingColumns=True)


def list_overlays(overlays: DataFrame, project: str, symbol: str = "", path: str = "", limit: int = 0) -> DataFrame:
    rows = overlays.filter(F.col("project_key") == (project or "default"))
    if symbol:
        rows = rows.filter(F.col("symbol") == symbol)
    if path:
        rows = rows.filter(F.col("file_path") == path)
    ordered = rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered.limit(limit) if limit > 0 else ordered


def check_overlays(overlays: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (project_key, symbol, file_path) with the newest active overlay for the symbol in that file or for the whole project."""
    active = overlays.filter(F.col("status") == ACTIVE).select(
        F.col("project_key").alias("_p"), F.col("symbol").alias("_s"), F.col("file_path").alias("_f"), "id", "overlay_type", "reason", "created_at"
    )
    fits = (F.col("project_key") == F.col("_p")) & (F.col("symbol") == F.col("_s")) & ((F.col("_f") == "") | (F.col("_f") == F.col("file_path")))
    newest = W.partitionBy("project_key", "symbol", "file_path").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return asked.join(active, fits).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_p", "_s", "_f")


def mark_stale(overlays: DataFrame, hashes: DataFrame) -> DataFrame:
    """overlays whose file has another hash now (path, hash), and that are active with a hash, ask for verification."""
    now = hashes.select(F.col("path").alias("file_path"), F.col("hash").alias("_h"))
    joined = overlays.join(now, "file_path", "left")
    stale = (F.col("status") == ACTIVE) & (F.col("source_hash") != "") & F.col("_h").isNotNull() & (F.col("source_hash") != F.col("_h"))
    return joined.withColumn("status", F.when(stale, STALE).otherwise(F.col("status"))).select(*overlays.columns)


def spool_due(spool: DataFrame, now: datetime, limit: int) -> DataFrame:
    """The rows whose time has come, in order of id."""
    return spool.filter(F.col("next_attempt_at") <= F.lit(now)).orderBy("id").limit(limit)


def spool_ack(spool: DataFrame, done: DataFrame) -> DataFrame:
    return spool.join(done.select("id"), "id", "left_anti")


def spool_nack(spool: DataFrame, failed: DataFrame, now: datetime, error: str, base_ms: int = 500, most_ms: int = 30_000) -> DataFrame:
    """spool with the failed rows' attempts one up and their next time after a doubling delay."""
    marked = spool.join(failed.select("id").withColumn("_f", F.lit(True)), "id", "left")
    hit = F.coalesce("_f", F.lit(False))
    attempts = F.col("attempts") + F.when(hit, 1).otherwise(0)
    later = F.timestamp_millis(F.unix_millis(F.lit(now)) + backoff_ms(base_ms, attempts, most_ms))
    return marked.select(
        *[
            {"attempts": attempts, "next_attempt_at": F.when(hit, later).otherwise(F.col(c)), "last_error": F.when(hit, error).otherwise(F.col(c))}.get(c, F.col(c)).alias(c)
            for c in spool.columns
        ]
    )
