"""Views over the model tables: current files, modules, edges and best definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_files(files: DataFrame) -> DataFrame:
    """The newest version of each path, unless that is a deletion."""
    newest = W.partitionBy("path").orderBy(F.col("ingest_seq").desc())
    return files.withColumn("_n", F.row_number().over(newest)).filter("_n = 1 and not deleted").drop("_n")


def of_files(child: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of a child table whose path is in files."""
    return child.join(files.select("path"), "path", "left_semi")


def modules(files: DataFrame) -> DataFrame:
    """(name, file_count, sample_path): a module is a name that a file has; the sample is its smallest path."""
    return files.groupBy(F.col("module").alias("name")).agg(F.count("*").alias("file_count"), F.min("path").alias("sample_path"))


def edges(imports: DataFrame, order: tuple[str, ...] = ("path", "seq")) -> DataFrame:
    """(src, dst, path, line, col): one edge for each pair of modules, with the evidence of its last import."""
    last = F.max_by(F.struct("path", "line", "col"), F.struct(*order))
    grouped = imports.groupBy(F.col("module").alias("src"), F.col("target").alias("dst")).agg(last.alias("e"))
    return grouped.select("src", "dst", "e.path", "e.line", "e.col")


def internal_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges whose target is a module."""
    return edges.join(modules.select(F.col("name").alias("dst")), "dst", "left_semi")


def external_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    return edges.join(modules.select(F.col("name").alias("dst")), "dst", "left_anti")


def external_counts(edges: DataFrame, modules: DataFrame) -> DataFrame:
    return external_edges(edges, modules).groupBy("src").agg(F.count("*").alias("external_count"))


def complexity(score: Column, branches: Column, params: Column, nesting: Column, loc: Column) -> Column:
    """The score, or where it is 0 one from branches, nesting, parameters and lines."""
    return F.when(score == 0, branches * 2 + nesting * 2 + params + F.floor(loc / 10)).otherwise(score).cast("int")


def with_complexity(definitions: DataFrame) -> DataFrame:
    return definitions.withColumn("score", complexity(*(F.col(c) for c in ("complexity_score", "branches", "params", "nesting", "loc"))))


def best_definitions(definitions: DataFrame) -> DataFrame:
    """The definition that stands for each (module, name): most complex, then longest, most branches, parameters, nesting, first."""
    ranked = with_complexity(definitions)
    best = W.partitionBy("module", "name").orderBy(
        *[F.col(c).desc() for c in ("score", "loc", "branches", "params", "nesting")], "path", "seq"
    )
    return ranked.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
