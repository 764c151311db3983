"""The module query language, and queries over modules, chains and trends."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import import_chain
from graphloom.operators.metrics import module_metrics
from graphloom.operators.model import best_definitions

_SELECT = re.compile(r"^\s*SELECT\s+(\w+)(?:\s+WHERE\s+(.+))?\s*$", re.I)
_NUMBER = re.compile(r"^\s*([a-z_]+)\s*(>=|<=|!=|=|>|<)\s*(-?[0-9]+)\s*$", re.I)
_CONTAINS = re.compile(r"^\s*([a-z_]+)\s+CONTAINS\s+['\"]([^'\"]+)['\"]\s*$", re.I)
_TEXT = re.compile(r"^\s*([a-z_]+)\s*(=|!=)\s*['\"]([^'\"]+)['\"]\s*$", re.I)
METRIC_FIELDS = ("fan_in", "fan_out", "depth")
NUMBER_FIELDS = (*METRIC_FIELDS, "file_count", "export_count", "dependency_count", "reverse_dependency_count")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: int | str


def parse(text: str) -> list[Condition]:
    """The conditions of ``SELECT modules [WHERE condition AND ...]``; ValueError for anything else.

    A condition compares a field with a whole number, or a name with a quoted text by =, != or CONTAINS. Each AND
    parts conditions, one inside quotes too.
    """
    whole = _SELECT.match(text.strip())
    if not whole or whole[1].lower() != "modules":
        raise ValueError("expected SELECT modules [WHERE ...]")
    out = []
    for part in re.split(r"\s+AND\s+", whole[2], flags=re.I) if whole[2] else []:
        if m := _NUMBER.match(part):
            out.append(Condition(m[1].lower(), m[2], int(m[3])))
        elif m := _CONTAINS.match(part):
            out.append(Condition(m[1].lower(), "contains", m[2].strip()))
        elif m := _TEXT.match(part):
            out.append(Condition(m[1].lower(), m[2], m[3].strip()))
        else:
            raise ValueError(f"invalid condition {part.strip()!r}")
    return out


def predicate(condition: Condition) -> Column:
    """A column expression; a field that doesn't exist or a value of the wrong type holds for no row."""
    field, op, value = F.col(condition.field), condition.op, condition.value
    if condition.field == "name" and isinstance(value, str):
        name, text = F.lower(field), F.lower(F.lit(value))
        return {"contains": name.contains(text), "=": name == text, "!=": name != text}[op]
    if condition.field in NUMBER_FIELDS and isinstance(value, int):
        return {">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value, "=": field == value, "!=": field != value}[op]
    return F.lit(False)


def module_summaries(modules: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """(name, file_count, export_count, dependency_count, reverse_dependency_count).

    exports has (module, name). Dependencies count external modules too, and a module that imports itself
    depends on itself.
    """
    out = edges.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("dependency_count"))
    back = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("reverse_dependency_count"))
    public = exports.select("module", "name").distinct().groupBy(F.col("module").alias("name")).agg(F.count("*").alias("export_count"))
    joined = modules.select("name", "file_count").join(public, "name", "left").join(out, "name", "left").join(back, "name", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("export_count", "dependency_count", "reverse_dependency_count")]
    return joined.select("name", "file_count", *zero)


def list_modules(summaries: DataFrame, containing: str = "", limit: int = 0) -> DataFrame:
    kept = summaries.filter(F.lower("name").contains(containing.strip().lower())) if containing.strip() else summaries
    ordered = kept.orderBy("name")
    return ordered.limit(limit) if limit > 0 else ordered


def run_cql(text: str, modules: DataFrame, edges: DataFrame, exports: DataFrame, limit: int = 0) -> DataFrame:
    """The summaries of the modules that a query selects, by name. Only the metrics that it names are computed."""
    conditions = parse(text)
    table = module_summaries(modules, edges, exports)
    wanted = tuple(f for f in METRIC_FIELDS if any(c.field == f for c in conditions))
    if wanted:
        table = table.join(module_metrics(edges, modules, None, wanted), "name")
    if conditions:
        table = table.filter(reduce(lambda a, b: a & b, map(predicate, conditions)))
    return list_modules(table.drop(*METRIC_FIELDS), limit=limit)


def module_details(name: str, files: DataFrame, edges: DataFrame, definitions: DataFrame, limit: int = 0) -> DataFrame:
    """One row: name, files, exports, dependencies (to, path, line, col) and reverse_dependencies; no row if there is no module.

    Lists are sorted; limit, if above 0, shortens each. The module itself isn't among its reverse dependencies.
    """
    own = files.filter(F.col("module") == name).groupBy(F.col("module").alias("name")).agg(F.sort_array(F.collect_set("path")).alias("files"))
    exports = best_definitions(definitions.filter((F.col("module") == name) & F.col("exported")))
    exported = exports.agg(F.sort_array(F.collect_set("name")).alias("exports"))
    onward = edges.filter(F.col("src") == name).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("to"), "path", "line", "col"))).alias("dependencies"))
    back = edges.filter((F.col("dst") == name) & (F.col("src") != name)).agg(F.sort_array(F.collect_set("src")).alias("reverse_dependencies"))
    row = own.crossJoin(exported).crossJoin(onward).crossJoin(back)  # four tables of one row each
    if limit <= 0:
        return row
    return row.select("name", *[F.slice(c, 1, limit).alias(c) for c in ("files", "exports", "dependencies", "reverse_dependencies")])


@dataclass(frozen=True)
class Trace:
    start: str
    end: str
    path: list[str]

    @property
    def depth(self) -> int:
        return len(self.path) - 1


def dependency_trace(edges: DataFrame, modules: DataFrame, start: str, end: str, max_depth: int = 0) -> Trace:
    """The shortest chain of imports; LookupError if there is none or it is longer than max_depth, if that is above 0."""
    found = Trace(start, end, import_chain(edges, modules, start, end))
    if not found.path:
        raise LookupError(f"no import chain from {start} to {end}")
    if 0 < max_depth < found.depth:
        raise LookupError(f"the chain has {found.depth} steps, over {max_depth}")
    return found


def trend_slice(snapshots: DataFrame, since: datetime | None = None, limit: int = 0) -> DataFrame:
    """Snapshots from ``since`` on, in order; with a limit above 0 the last ones of each project."""
    kept = snapshots.filter(F.col("ts") >= F.lit(since)) if since else snapshots
    if limit > 0:
        newest = W.partitionBy("project_key").orderBy(F.col("ts").desc(), F.col("commit_hash").desc())
        kept = kept.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit).drop("_n")
    return kept.orderBy("project_key", "ts", "commit_hash")


def clamp_limit(value: int, most: int) -> int:
    return most if value <= 0 or value > most else value
