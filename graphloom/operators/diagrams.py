"""Tables behind diagrams: component edges, clusters, treemap and call sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import import_name
from graphloom.operators.graph import levels
from graphloom.operators.model import best_definitions, internal_edges

PREVIEW_DEFINITIONS, PREVIEW_SYMBOLS = 12, 3


def component_edges(imports: DataFrame, references: DataFrame, definitions: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, import_count, reference_count, symbols) between different modules, by imports and by used symbols.

    A reference's head finds the first import of its file with that name, or one that imports the item; the
    symbol is its last part and must be a definition of the target.
    """
    target = modules.select(F.col("name").alias("dst"))
    counts = imports.select(F.col("module").alias("src"), F.col("target").alias("dst")).join(target, "dst", "left_semi").filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("import_count"))
    named = imports.join(files.select("path", "language"), "path").join(target.withColumnRenamed("dst", "target"), "target", "left_semi")
    alias = named.groupBy("path", import_name(F.col("language"), F.col("target"), F.col("alias")).alias("head")).agg(F.min_by("target", "seq").alias("dst"))
    item = named.select("path", F.explode("items").alias("head"), F.col("target").alias("dst"))
    heads = alias.union(item).distinct()
    refs = references.select("path", F.col("module").alias("src"), F.substring_index("name", ".", 1).alias("head"), F.substring_index("name", ".", -1).alias("symbol"))
    known = best_definitions(definitions).select(F.col("module").alias("dst"), F.col("name").alias("symbol"))
    used = refs.join(heads, ["path", "head"]).filter("src <> dst").join(known, ["dst", "symbol"], "left_semi")
    by_symbol = used.groupBy("src", "dst").agg(F.count("*").alias("reference_count"), F.sort_array(F.collect_set("symbol")).alias("symbols"))
    both = counts.join(by_symbol, ["src", "dst"], "full")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("import_count", "reference_count")]
    return both.select("src", "dst", *zero, F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def definition_preview(definitions: DataFrame) -> DataFrame:
    """(module, names): the first names of each module's definitions."""
    return best_definitions(definitions).groupBy("module").agg(F.slice(F.sort_array(F.collect_set("name")), 1, PREVIEW_DEFINITIONS).alias("names"))


def cluster_edges(edges: DataFrame, modules: DataFrame, violations: DataFrame, separator: str = "/") -> DataFrame:
    """(src, dst, edge_count, violated) between the first path segments of modules."""
    bad = violations.select(F.col("from_module").alias("src"), F.col("to_module").alias("dst")).distinct().withColumn("bad", F.lit(True))
    marked = internal_edges(edges, modules).join(bad, ["src", "dst"], "left")
    first = [F.substring_index(c, separator, 1).alias(c) for c in ("src", "dst")]
    named = marked.select(*first, F.coalesce("bad", F.lit(False)).alias("bad")).filter("src <> dst")
    return named.groupBy("src", "dst").agg(F.count("*").alias("edge_count"), F.max("bad").alias("violated"))


def hotspot_by_module(hotspots: DataFrame) -> DataFrame:
    return hotspots.groupBy("module").agg(F.max("score").alias("score"))


def treemap(metrics: DataFrame, files: DataFrame) -> DataFrame:
    """(group, module_count, file_count, modules): modules by their first path segment, with size and importance."""
    sizes = files.groupBy(F.col("module").alias("name")).agg(F.count("*").alias("size"))
    each = metrics.join(sizes, "name").withColumn("group", F.substring_index("name", "/", 1))
    leafs = F.sort_array(F.collect_list(F.struct("name", "size", "importance")))
    return each.groupBy("group").agg(F.count("*").alias("module_count"), F.sum("size").alias("file_count"), leafs.alias("modules"))


def call_sequence(references: DataFrame, definitions: DataFrame, entry: str, max_depth: int = 5) -> DataFrame:
    """(src, dst, symbol): distinct calls from module to module within max_depth of the entry; a symbol's last exporting file owns it."""
    owner = definitions.filter("exported").groupBy("name").agg(F.max_by("module", F.struct("path", "seq")).alias("dst"))
    called = references.select(F.col("module").alias("src"), F.substring_index("name", ".", -1).alias("name")).distinct()
    hops = called.join(owner, "name").filter("src <> dst").select("src", "dst", F.col("name").alias("symbol")).distinct()
    start = references.sparkSession.createDataFrame([(entry,)], "node string")
    depth = max_depth if max_depth > 0 else 5
    near = levels(hops, start, depth).filter(F.col("depth") < depth).select(F.col("node").alias("src"))
    return hops.join(near, "src", "left_semi")


def in_order(ordered: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ordered (name, ord) whose name is among members, in their order."""
    return ordered.join(members.select("name").distinct(), "name", "left_semi").orderBy("ord")
