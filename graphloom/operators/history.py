"""Snapshots over time: trends, moving averages and upserts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import round2

DELTAS = {
    "delta_modules": "module_count",
    "delta_files": "file_count",
    "delta_cycles": "cycle_count",
    "delta_unresolved": "unresolved_count",
    "delta_unused": "unused_import_count",
    "delta_violations": "violation_count",
    "delta_hotspots": "hotspot_count",
}
FAN_DELTAS = {"delta_fan_in": "avg_fan_in", "delta_fan_out": "avg_fan_out"}
AVERAGES = {"avg_cycles": "cycle_count", "avg_unresolved": "unresolved_count"}


def _growth(now: Column, before: Column) -> Column:
    return F.when(before.isNull() | (before == 0), 0.0).otherwise(round2((now - before) * 100.0 / before))


def trend_deltas(snapshots: DataFrame) -> DataFrame:
    """snapshots with the change of each count since the one before (0 for a project's first) and growth in percent."""
    order = W.partitionBy("project_key").orderBy("ts", "commit_hash")
    out = snapshots
    for name, column in DELTAS.items():
        out = out.withColumn(name, F.coalesce(F.col(column) - F.lag(column).over(order), F.lit(0)))
    for name, column in FAN_DELTAS.items():
        out = out.withColumn(name, F.coalesce(round2(F.col(column) - F.lag(column).over(order)), F.lit(0.0)))
    return out.withColumn("module_growth_pct", _growth(F.col("module_count"), F.lag("module_count").over(order))).withColumn(
        "file_growth_pct", _growth(F.col("file_count"), F.lag("file_count").over(order))
    )


def moving_averages(snapshots: DataFrame, window: timedelta = timedelta(hours=24)) -> DataFrame:
    """snapshots with averages over the window that ends at each, both ends included.

    Of snapshots with one time only those up to the row itself count: a range takes them all, so the later ones
    are taken off again. A window of nothing gives the row's own values.
    """
    if window <= timedelta(0):
        return snapshots.withColumns({k: F.col(v).cast("double") for k, v in AVERAGES.items()})
    micros = F.unix_micros("ts")
    trailing = W.partitionBy("project_key").orderBy(micros).rangeBetween(-int(window.total_seconds() * 1_000_000), 0)
    later = W.partitionBy("project_key", "ts").orderBy("commit_hash").rowsBetween(1, W.unboundedFollowing)
    n = F.count("*").over(trailing) - F.count("*").over(later)
    return snapshots.withColumns({k: round2((F.sum(v).over(trailing) - F.coalesce(F.sum(v).over(later), F.lit(0))) / n) for k, v in AVERAGES.items()})


def trend_report(snapshots: DataFrame, window: timedelta = timedelta(hours=24)) -> DataFrame:
    """Deltas and averages of each snapshot; ValueError without any."""
    if snapshots.isEmpty():
        raise ValueError("a trend needs at least one snapshot")
    return moving_averages(trend_deltas(snapshots), window)


def upsert_snapshots(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the rows of new; of rows with one (project, time, commit) the new one stays. A blank project is ``default``."""
    key = F.when(F.trim("project_key") == "", "default").otherwise(F.col("project_key"))
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("project_key", key)
    newest = W.partitionBy("project_key", "ts", "commit_hash").orderBy(F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_new")
