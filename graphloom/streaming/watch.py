"""Incremental updates with Structured Streaming: change events in, refreshed results out.

Events are rows of files in a landing directory: path, content (null for a deletion) and ts. Each micro-batch keeps
the last event of each path, drops those whose content hasn't changed, finds what the changes invalidate in the old
graph, writes a new version of the tables and recomputes results for the affected files only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.globs import to_regex
from graphloom.operators.graph import levels, reversed_edges
from graphloom.operators.store import delete_paths, read_current, upsert_by_path, write_version
from graphloom.session import cut
from graphloom.sources.languages import Language, base_name, is_test, language_of

EVENTS = "path string, content string, ts timestamp"
STATE = "path string, content string, hash bigint, ts timestamp"


def change_events(spark: SparkSession, landing: str, files_per_trigger: int = 100) -> DataFrame:
    """The stream of change events; a trigger takes a bounded number of files, which is its backpressure."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(landing)


def watched(events: DataFrame, languages: dict[str, Language], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Events of source files that aren't tests and whose base name no glob excludes."""
    out = events.filter((language_of(F.col("path"), languages) != "") & ~is_test(F.col("path"), languages))
    for g in exclude:
        out = out.filter(~base_name(F.col("path")).rlike(to_regex(g, "flat")))
    return out


def debounced(events: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(window, paths): bursts of events, each ended by a quiet time, with the paths that changed in it."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", quiet).alias("window"))
        .agg(F.sort_array(F.collect_set("path")).alias("paths"))
    )


def last_changes(batch: DataFrame, state: DataFrame) -> DataFrame:
    """The last event of each path of a batch, unless its content has the hash that is stored."""
    newest = W.partitionBy("path").orderBy(F.col("ts").desc())
    last = batch.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    hashed = last.withColumn("hash", F.when(F.col("content").isNotNull(), F.xxhash64("content")))
    known = state.select("path", F.col("hash").alias("_old"))
    return hashed.join(known, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def affected_paths(changed: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path): changed files, and the files of modules that reach their modules."""
    own = files.join(changed.select("path"), "path", "left_semi").select(F.col("module").alias("node"))
    above = levels(reversed_edges(edges), own).filter("depth > 0").select(F.col("node").alias("module"))
    return changed.select("path").union(files.join(above, "module", "left_semi").select("path")).distinct()


def refreshed(cached: DataFrame, recomputed: DataFrame, affected: DataFrame) -> DataFrame:
    """Cached results without the affected paths, and the ones that were recomputed for them."""
    return delete_paths(cached, affected).unionByName(recomputed, allowMissingColumns=True)


Handler = Callable[[DataFrame, DataFrame, int], None]


def start(
    events: DataFrame, root: str, checkpoint: str, on_update: Handler | None = None, available_now: bool = False, interval: str = "500 milliseconds"
) -> StreamingQuery:
    """Keep the newest content of each path in a versioned table at root; on_update gets (state, changes, batch id).

    A batch that runs again after a failure writes its version over, so each event takes effect once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _state_before(spark, root, number)
        changes = cut(last_changes(batch, state))
        if changes.isEmpty():
            return
        kept = upsert_by_path(state, changes.filter("content is not null").select("path", "content", "hash", "ts"), changes)
        write_version(kept, root, number)
        if on_update:
            on_update(read_current(spark, root), changes, number)

    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def versions_below(spark: SparkSession, root: str, number: int) -> list[int]:
    """The versions of a table that are older than number; one of number itself is left from a run that failed later."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return [int(v[2:]) for v in found if v.startswith("v=") and int(v[2:]) < number]


def _state_before(spark: SparkSession, root: str, number: int) -> DataFrame:
    versions = versions_below(spark, root, number)
    return spark.read.parquet(f"{root}/v={max(versions)}") if versions else spark.createDataFrame([], STATE)
