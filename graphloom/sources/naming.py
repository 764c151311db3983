"""Names of modules from the paths of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.sources.languages import base_name


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def go_modules(files: DataFrame, gomods: DataFrame) -> DataFrame:
    """files with ``module``: the module of the nearest go.mod above (path, content), and the directory below it."""
    roots = gomods.select(directory(F.col("path")).alias("_root"), F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1).alias("_name")).filter("_name <> ''")
    own = files.withColumn("_dir", directory(F.col("path")))
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(F.split("_dir", "/"))), lambda k: F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), k), "/")
    )
    found = own.withColumn("_root", F.explode(F.array_distinct(ancestors))).join(roots, "_root")
    nearest = W.partitionBy("path").orderBy(F.length("_root").desc())
    best = found.withColumn("_n", F.row_number().over(nearest)).filter("_n = 1").select("path", "_root", "_name")
    joined = own.drop("module").join(best, "path", "left")
    rest = F.when(F.col("_root") == "", F.col("_dir")).otherwise(F.substring("_dir", F.length("_root") + 2, F.length("_dir")))
    name = F.when(F.col("_name").isNull(), "").when(rest == "", F.col("_name")).otherwise(F.concat_ws("/", "_name", rest))
    return joined.withColumn("module", name).drop("_dir", "_root", "_name")


def python_modules(files: DataFrame, root: str = "") -> DataFrame:
    """files with ``module``: the dotted path below root from the first directory on that is a package; ``__init__`` is the package."""
    base = root.rstrip("/") + "/" if root else ""
    own = files.withColumn("_rel", F.when(F.lit(bool(base)) & F.col("path").startswith(base), F.substring("path", F.lit(len(base) + 1), F.length("path"))).otherwise(F.col("path")))
    packages = own.filter(base_name(F.col("path")) == "__init__.py").select(directory(F.col("_rel")).alias("_pkg")).distinct()
    parts = F.split(directory(F.col("_rel")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    first = own.select("path", F.explode(prefixes).alias("_pkg")).join(packages, "_pkg", "left_semi").groupBy("path").agg(F.min_by("_pkg", F.length("_pkg")).alias("_pkg"))
    joined = own.drop("module").join(first, "path", "left")
    above = F.when(F.col("_pkg").isNull(), directory(F.col("_rel"))).otherwise(directory(F.col("_pkg")))
    below = F.when(above == "", F.col("_rel")).otherwise(F.substring("_rel", F.length(above) + 2, F.length("_rel")))
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace(below, r"\.py$", ""), "/", "."), r"\.?__init__$", "")
    return joined.withColumn("module", dotted).drop("_rel", "_pkg")


def with_modules(files: DataFrame, gomods: DataFrame, root: str = "") -> DataFrame:
    """files with module names: Go and Python have rules, other languages share the empty name."""
    go = go_modules(files.filter("language = 'go'"), gomods)
    python = python_modules(files.filter("language = 'python'"), root)
    rest = files.filter(~F.col("language").isin("go", "python")).drop("module").withColumn("module", F.lit(""))
    return go.unionByName(python, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def script_module(path: Column) -> Column:
    """The leaf of a JavaScript import path: without leading dots, extension and ``index``."""
    clean = F.regexp_replace(F.regexp_replace(path, r"^(\.{1,2}/)+", ""), r"\.(js|jsx|ts|tsx|mjs|cjs)$", "")
    trimmed = F.regexp_replace(clean, "/index$", "")
    return F.substring_index(trimmed, "/", -1)


def java_module(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.trim(path), r"\.\*$", ""), ".", -1)


def rust_module(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.trim(path), r"::\*$", ""), "::", -1)
