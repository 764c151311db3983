"""Tab-separated blocks. Each function gives rows of one column ``line`` that begin with a header, in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import mask


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("-")), r"[\t\r\n]+", " ")


def block(rows: DataFrame, columns: Sequence[tuple[str, Column]], order: Sequence[str]) -> DataFrame:
    """A header line and one line for each row, sorted."""
    head = rows.sparkSession.createDataFrame([("\t".join(name for name, _ in columns), 0)], "line string, _h int")
    body = rows.select(F.concat_ws("\t", *[_clean(c) for _, c in columns]).alias("line"), F.lit(1).alias("_h"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    return head.unionByName(body, allowMissingColumns=True).orderBy("_h", *keys).select("line")


def edges_block(edges: DataFrame) -> DataFrame:
    return block(edges, [("From", F.col("src")), ("To", F.col("dst")), ("File", F.col("path")), ("Line", F.col("line")), ("Column", F.col("col"))], ("src", "dst"))


def unused_imports_block(rows: DataFrame) -> DataFrame:
    names = {"Type": F.lit("unused_import"), "File": F.col("path"), "Language": F.col("language"), "Module": F.col("target"), "Alias": F.col("alias"), "Item": F.col("item")}
    return block(rows, [*names.items(), ("Line", F.col("line")), ("Column", F.col("col")), ("Confidence", F.col("confidence"))], ("path", "line", "col", "item"))


def layer_violations_block(rows: DataFrame) -> DataFrame:
    names = {"Type": F.lit("architecture_violation"), "Rule": F.col("rule"), "FromModule": F.col("from_module"), "FromLayer": F.col("from_layer"), "ToModule": F.col("to_module")}
    return block(rows, [*names.items(), ("ToLayer", F.col("to_layer")), ("File", F.col("path")), ("Line", F.col("line")), ("Column", F.col("col"))], ("from_module", "to_module", "rule"))


def rule_violations_block(rows: DataFrame) -> DataFrame:
    names = {"Type": F.lit("rule_violation"), "Rule": F.col("rule"), "Violation": F.col("type"), "Module": F.col("module"), "Target": F.when(F.col("target") != "", F.col("target"))}
    return block(rows, [*names.items(), ("File", F.col("path")), ("Line", F.col("line")), ("Actual", F.col("actual")), ("Limit", F.col("limit"))], ("rule", "module", "target"))


def probable_bridges_block(rows: DataFrame) -> DataFrame:
    names = {"Type": F.lit("probable_bridge"), "File": F.col("path"), "Reference": F.col("name"), "Line": F.col("line"), "Column": F.col("col")}
    return block(rows, [*names.items(), ("Confidence", F.col("confidence")), ("Score", F.col("score")), ("Reasons", F.array_join("reasons", ","))], ("path", "line", "col", "name"))


def secrets_block(rows: DataFrame) -> DataFrame:
    names = {"Type": F.lit("secret"), "Kind": F.col("kind"), "Severity": F.col("severity"), "Value": mask(F.col("value"))}
    numbers = {"Entropy": F.format_string("%.4f", F.col("entropy")), "Confidence": F.format_string("%.2f", F.col("confidence"))}
    return block(rows, [*names.items(), *numbers.items(), ("File", F.col("file")), ("Line", F.col("line")), ("Column", F.col("col"))], ("file", "line", "col", "kind"))


def trend_block(report: DataFrame) -> DataFrame:
    columns = [c for c in report.columns if c not in ("project_key", "commit_ts")]
    return block(report, [(c, F.col(c)) for c in columns], ("project_key", "ts", "commit_hash"))


def trend_json(report: DataFrame) -> DataFrame:
    """One JSON object for each project: since, until and its points in order."""
    points = [c for c in report.columns if c != "project_key"]
    grouped = report.groupBy("project_key").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.sort_array(F.collect_list(F.struct("ts", *[c for c in points if c != "ts"]))).alias("points"))
    return grouped.select("project_key", F.to_json(F.struct("project_key", "since", "until", "points")).alias("json"))


def write_lines(block_: DataFrame, path: str) -> None:
    """One text file below path; the rows come in their order."""
    block_.coalesce(1).write.mode("overwrite").text(path)
