"""Reanalysis on change: file events in, a project's tables and results kept up to date.

A micro-batch extracts the changed files only. The modules that reached them in the graph before the batch, or reach
them after it, are affected: for their files references and imports are assessed again, and what is known of all
other files stays. Each batch writes a version of every table and then, last, the number of the version, so a reader
never sees half a batch and a batch that runs again after a failure writes the same version over.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import model, resolve, secrets, symbols
from graphloom.operators.store import upsert_by_path, write_version
from graphloom.session import cut
from graphloom.sources import extract, naming, scan
from graphloom.sources.languages import Language, base_name, language_of, registry
from graphloom.streaming.watch import EVENTS, affected_paths, last_changes, refreshed, versions_below, watched

SOURCES = "path string, content string, hash bigint, ts timestamp"
GO_MOD = "go.mod"


@dataclass
class Update:
    """What a batch did: its number, its changes, the paths whose results are new, all tables, and findings in changed lines."""

    version: int
    changes: DataFrame
    affected: DataFrame
    tables: dict[str, DataFrame]
    new_secrets: DataFrame


@dataclass
class Analysis:
    """The tables below a folder that all executors share: sources, rows, files, imports, definitions, references, and
    the results assessed, unused and secrets."""

    root: str
    languages: Mapping[str, Language] = field(default_factory=registry)
    options: resolve.Options = field(default_factory=resolve.Options)
    settings: secrets.Settings = field(default_factory=secrets.Settings)
    module_root: str = ""

    def start(
        self, events: DataFrame, checkpoint: str, on_update: Callable[[Update], None] | None = None, quiet: str = "", available_now: bool = False, interval: str = "500 milliseconds"
    ) -> StreamingQuery:
        """Apply a stream of events (path, content, ts); with ``quiet``, the last event of each burst that a quiet time ends."""
        wanted = watched(events, dict(self.languages)).unionByName(events.filter(base_name(F.col("path")) == GO_MOD))
        stream = settled(wanted, quiet) if quiet else wanted

        def apply(batch: DataFrame, number: int) -> None:
            update = self.apply(batch, number)
            if update is not None and on_update:
                on_update(update)

        writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

    def table(self, spark: SparkSession, name: str, below: int | None = None) -> DataFrame | None:
        """A table as the last whole batch left it, or the last batch with a number below; None before the first."""
        done = spark.read.parquet(f"{self.root}/done/_current").first()["version"] if below is None else below - 1
        found = [v for v in versions_below(spark, f"{self.root}/{name}", done + 1)]
        return spark.read.parquet(f"{self.root}/{name}/v={max(found)}") if found else None

    def apply(self, batch: DataFrame, number: int) -> Update | None:
        """Bring the tables up to date with one batch of events; None if nothing has changed."""
        spark = batch.sparkSession
        before = {n: self.table(spark, n, number) for n in ("sources", "rows", "files", "imports", "assessed", "unused", "secrets")}
        known = before["sources"] if before["sources"] is not None else spark.createDataFrame([], SOURCES)
        changes = cut(last_changes(batch.select(*[c.split()[0] for c in EVENTS.split(", ")]), known))
        if changes.isEmpty():
            return None
        sources = upsert_by_path(known, changes.filter("content is not null").select("path", "content", "hash", "ts"), changes)
        out = {"sources": self._write("sources", sources, number, spark)}
        new = self._sources(out["sources"].join(changes.select("path"), "path", "left_semi"))
        rows = extract.extract(new)
        out["rows"] = self._write("rows", rows if before["rows"] is None else upsert_by_path(before["rows"], rows, changes), number, spark)
        gomods = out["sources"].filter(base_name(F.col("path")) == GO_MOD).select("path", "content")
        named = naming.with_modules(self._sources(out["sources"]).select("path", "language"), gomods, self.module_root)
        for name, frame in extract.tables(out["rows"], cut(named)).items():
            out[name] = self._write(name, frame, number, spark)
        graphs = [(out["imports"], out["files"]), *([(before["imports"], before["files"])] if before["files"] is not None else [])]
        affected = cut(reduce(DataFrame.union, [affected_paths(changes, model.edges(i), f) for i, f in graphs]).distinct())

        def merged(name: str, fresh: DataFrame, gone: DataFrame) -> DataFrame:
            return self._write(name, fresh if before[name] is None else refreshed(before[name], fresh, gone), number, spark)

        table = symbols.symbol_table(out["definitions"], out["files"])
        asked = out["references"].join(affected, "path", "left_semi")
        out["assessed"] = merged("assessed", resolve.assess(asked, out["files"], out["imports"], out["definitions"], table, self.options), affected)
        unused = resolve.unused_imports(out["imports"], out["references"], out["files"], self.options, affected)
        out["unused"] = merged("unused", unused, affected)
        found = secrets.detect(new, self.settings).withColumn("path", F.col("file"))
        out["secrets"] = merged("secrets", found, changes)
        versions = new.select("path", F.col("content").alias("after")).join(known.select("path", F.col("content").alias("before")), "path", "left")
        ranges = secrets.changed_ranges(versions.withColumn("before", F.coalesce("before", F.lit(""))))
        write_version(spark.createDataFrame([(number,)], "number long"), f"{self.root}/done", number)
        return Update(number, changes, affected, out, secrets.detect(new, self.settings, ranges))

    def _sources(self, sources: DataFrame) -> DataFrame:
        """(path, language, content) of files that are to be extracted."""
        told = sources.withColumn("language", language_of(F.col("path"), self.languages))
        return told.filter((F.col("language") != "") & ~scan.is_generated(F.col("content"))).select("path", "language", "content")

    def _write(self, name: str, frame: DataFrame, number: int, spark: SparkSession) -> DataFrame:
        write_version(frame, f"{self.root}/{name}", number)
        return spark.read.parquet(f"{self.root}/{name}/v={number}")

    def unresolved(self, spark: SparkSession) -> DataFrame:
        return resolve.unresolved(self.table(spark, "assessed"))

    def probable_bridges(self, spark: SparkSession) -> DataFrame:
        return resolve.probable_bridges(self.table(spark, "assessed"))


def settled(events: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last event of each path's bursts; a burst ends when nothing happens to its path for the quiet time."""
    bursts = events.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet).alias("window"))
    return bursts.agg(F.max_by(F.struct("content", "ts"), "ts").alias("last")).select("path", "last.content", "last.ts")

