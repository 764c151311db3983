"""Metrics of modules: fan-in and fan-out, depth, complexity, importance; leaders and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import is_api_module
from graphloom.operators.graph import components_and_depths
from graphloom.operators.model import best_definitions, internal_edges, with_complexity
from graphloom.schemas import FUNCTION, METHOD


def fan_metrics(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(name, fan_in, fan_out) over edges between modules; an edge to itself counts on both sides."""
    inner = internal_edges(edges, modules).join(modules.select(F.col("name").alias("src")), "src", "left_semi")
    ends = F.explode(F.array(F.struct(F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    sums = inner.select(ends.alias("e")).groupBy("e.name").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return modules.select("name").join(sums, "name", "left").select("name", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def max_complexity(definitions: DataFrame) -> DataFrame:
    return with_complexity(definitions).groupBy(F.col("module").alias("name")).agg(F.max("score").alias("complexity"))


def importance(fan_in: Column, fan_out: Column, complexity: Column, name: Column) -> Column:
    """2 * fan-in + fan-out + half the complexity, and 10 for an API module."""
    return fan_in * 2.0 + fan_out + complexity * 0.5 + F.when(is_api_module(name), 10.0).otherwise(0.0)


def module_depths(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(name, depth): the longest way over components of modules to one that imports no other."""
    inner = internal_edges(edges, modules).join(modules.select(F.col("name").alias("src")), "src", "left_semi")
    found = components_and_depths(inner).select(F.col("node").alias("name"), "depth")
    return modules.select("name").join(found, "name", "left").select("name", F.coalesce("depth", F.lit(0)).alias("depth"))


#: Columns of module_metrics(), each with what it needs beyond the module names.
METRICS = ("fan_in", "fan_out", "depth", "complexity", "importance")


def module_metrics(edges: DataFrame, modules: DataFrame, definitions: DataFrame | None, wanted: tuple[str, ...] = METRICS) -> DataFrame:
    """(name, wanted metrics); what isn't wanted isn't computed, so a query without depth runs no loop."""
    out = modules.select("name")
    if {"fan_in", "fan_out", "importance"} & {*wanted}:
        out = out.join(fan_metrics(edges, modules), "name")
    if {"complexity", "importance"} & {*wanted} and definitions is not None:
        out = out.join(max_complexity(definitions), "name", "left").withColumn("complexity", F.coalesce("complexity", F.lit(0)))
    elif {"complexity", "importance"} & {*wanted}:
        out = out.withColumn("complexity", F.lit(0))
    if "importance" in wanted:
        out = out.withColumn("importance", importance(F.col("fan_in"), F.col("fan_out"), F.col("complexity"), F.col("name")))
    if "depth" in wanted:
        out = out.join(module_depths(edges, modules), "name")
    return out.select("name", *[w for w in METRICS if w in wanted])


def fan_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.coalesce(F.avg("fan_in"), F.lit(0.0)).alias("avg_fan_in"),
        F.coalesce(F.avg("fan_out"), F.lit(0.0)).alias("avg_fan_out"),
        F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in"),
        F.coalesce(F.max("fan_out"), F.lit(0)).alias("max_fan_out"),
    )


def leaders(metrics: DataFrame, score: Column, n: int, least: float = 1) -> DataFrame:
    """(name, score): the n greatest scores of at least ``least``; ties by name."""
    return metrics.select("name", score.alias("score")).filter(F.col("score") >= least).orderBy(F.col("score").desc(), "name").limit(max(n, 0))


def top_complexity(definitions: DataFrame, n: int) -> DataFrame:
    """(module, definition, path, score, branches, params, nesting, loc): the n most complex functions and methods with lines."""
    best = best_definitions(definitions).filter(F.col("kind").isin(FUNCTION, METHOD) & (F.col("loc") > 0))
    scored = best.withColumn("score", F.when(F.col("score") == 0, 1).otherwise(F.col("score")))
    return (
        scored.select("module", F.col("name").alias("definition"), "path", "score", "branches", "params", "nesting", "loc")
        .orderBy(F.col("score").desc(), "module", "definition", "path")
        .limit(max(n, 0))
    )
