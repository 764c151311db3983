"""Architecture rules: layers with allowed dependencies, and packages with limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.globs import has_wildcard, normalize_path, to_regex
from graphloom.operators.model import internal_edges

# Suffixes of test files.
TEST_SUFFIXES = ("_test.go", "_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts")


def compiled(patterns: DataFrame, column: str = "pattern", dialect: str = "path") -> DataFrame:
    """patterns with ``norm`` (normalised), ``regex`` (null for a literal). Patterns are configuration, so they pass the driver."""
    spark = patterns.sparkSession
    texts = sorted({r[0] for r in patterns.select(column).distinct().collect() if r[0] is not None})
    rows = [(t, n, to_regex(n, dialect) if has_wildcard(n) else None) for t in texts for n in [normalize_path(t)] if n]
    table = spark.createDataFrame(rows, "_p string, norm string, regex string")
    return patterns.join(F.broadcast(table), patterns[column] == table["_p"]).drop("_p")


def matches(regex: Column, norm: Column, name: Column, path: Column | None = None) -> Column:
    """A wildcard fits the module's name or its sample path; a literal fits what equals it or lies below it."""

    def fits(value: Column) -> Column:
        return F.when(regex.isNotNull(), F.regexp_like(value, regex)).otherwise((value == norm) | value.startswith(F.concat(norm, F.lit("/"))))

    return fits(name) if path is None else fits(name) | fits(path)


def layer_assignment(modules: DataFrame, layers: DataFrame, dialect: str = "path") -> DataFrame:
    """(name, layer): the layer with the longest pattern that fits; of equally long ones the first by name."""
    patterns = compiled(layers.select(F.col("name").alias("layer"), "pattern"), dialect=dialect)
    fit = matches(F.col("regex"), F.col("norm"), F.col("name"), F.col("sample_path"))
    joined = modules.select("name", "sample_path").join(F.broadcast(patterns), fit)
    best = F.min_by("layer", F.struct(-F.length("norm"), "layer"))
    return joined.groupBy("name").agg(best.alias("layer"))


def layer_violations(edges: DataFrame, modules: DataFrame, assignment: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, from_module, from_layer, to_module, to_layer, path, line, col) of edges that a layer's rule doesn't allow.

    Of rules for one layer the last by name counts. A layer that doesn't allow itself may not import itself;
    targets without a layer are never violations.
    """
    last = rules.groupBy("from_layer").agg(F.max_by(F.struct("name", "allow"), "name").alias("r"))
    start = assignment.select(F.col("name").alias("src"), F.col("layer").alias("from_layer"))
    end = assignment.select(F.col("name").alias("dst"), F.col("layer").alias("to_layer"))
    joined = internal_edges(edges, modules).join(start, "src").join(end, "dst").join(F.broadcast(last), "from_layer")
    return joined.filter(~F.array_contains("r.allow", F.col("to_layer"))).select(
        F.col("r.name").alias("rule"), F.col("src").alias("from_module"), "from_layer", F.col("dst").alias("to_module"), "to_layer", "path", "line", "col"
    )


def layer_dependencies(edges: DataFrame, modules: DataFrame, assignment: DataFrame, violations: DataFrame) -> DataFrame:
    """(from_layer, to_layer, edge_count, violation_count) between different layers, and inside one where it has violations."""
    start = assignment.select(F.col("name").alias("src"), F.col("layer").alias("from_layer"))
    end = assignment.select(F.col("name").alias("dst"), F.col("layer").alias("to_layer"))
    counts = internal_edges(edges, modules).join(start, "src").join(end, "dst").filter("from_layer <> to_layer").groupBy("from_layer", "to_layer").agg(F.count("*").alias("edge_count"))
    bad = violations.groupBy("from_layer", "to_layer").agg(F.count("*").alias("violation_count"))
    both = counts.join(bad, ["from_layer", "to_layer"], "full")
    return both.select("from_layer", "to_layer", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("violation_count", F.lit(0)).alias("violation_count"))


def is_test_file(path: Column) -> Column:
    out = F.lit(False)
    for suffix in TEST_SUFFIXES:
        out = out | F.lower(path).endswith(suffix)
    return out


def _rule_patterns(rules: DataFrame, column: str) -> DataFrame:
    return compiled(rules.select(F.col("name").alias("rule"), F.explode(column).alias("pattern")))


def _fits_any(rows: DataFrame, patterns: DataFrame, value: str) -> DataFrame:
    """(rule, value) of rows (rule, value) that some pattern of their rule fits."""
    fit = matches(F.col("regex"), F.col("norm"), F.col(value))
    return rows.join(F.broadcast(patterns.withColumnRenamed("rule", "_r")), (F.col("rule") == F.col("_r")) & fit, "left_semi")


def rule_modules(modules: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, module): which modules each package rule is about."""
    patterns = _rule_patterns(rules, "modules")
    fit = matches(F.col("regex"), F.col("norm"), F.col("module"))
    return modules.select(F.col("name").alias("module")).join(F.broadcast(patterns), fit).select("rule", "module").distinct()


def package_violations(files: DataFrame, edges: DataFrame, modules: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, type, module, target, path, line, col, actual, limit): too many files, or an import that isn't allowed.

    Test files and excluded files don't count where the rule says so. A denied target is never allowed; without
    allow patterns every other one is. Only imports of modules are looked at.
    """
    covered = rule_modules(modules, rules)
    limits = rules.select(F.col("name").alias("rule"), "max_files", "exclude_tests")
    owned = covered.join(files.select("module", "path"), "module").join(F.broadcast(limits), "rule")
    counted = owned.filter(~(F.col("exclude_tests") & is_test_file(F.col("path"))))
    excluded = _rule_patterns(rules, "exclude_files")
    counted = counted.join(_fits_any(counted.select("rule", "path"), excluded, "path").distinct(), ["rule", "path"], "left_anti")
    many = counted.groupBy("rule", "module", "max_files").agg(F.count("*").alias("actual")).filter("max_files > 0 and actual > max_files")
    none = F.lit(None)
    too_many = many.select(
        "rule", F.lit("file_count").alias("type"), "module", F.lit("").alias("target"), F.lit("").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col"),
        F.col("actual").cast("long").alias("actual"), F.col("max_files").cast("long").alias("limit"),
    )
    used = covered.join(internal_edges(edges, modules).withColumnRenamed("src", "module"), "module").filter("module <> dst").withColumnRenamed("dst", "target")
    pairs = used.select("rule", "target").distinct()
    denied = _fits_any(pairs, _rule_patterns(rules, "deny"), "target").withColumn("denied", F.lit(True))
    allowed = _fits_any(pairs, _rule_patterns(rules, "allow"), "target").withColumn("allowed", F.lit(True))
    open_rules = rules.select(F.col("name").alias("rule"), (F.size("allow") == 0).alias("open"))
    judged = used.join(denied, ["rule", "target"], "left").join(allowed, ["rule", "target"], "left").join(F.broadcast(open_rules), "rule")
    bad = judged.filter(F.coalesce("denied", F.lit(False)) | ~(F.col("open") | F.coalesce("allowed", F.lit(False))))
    imports = bad.select("rule", F.lit("import").alias("type"), "module", "target", "path", "line", "col", none.cast("long").alias("actual"), none.cast("long").alias("limit"))
    return too_many.unionByName(imports)


def rule_summary(modules: DataFrame, rules: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: rule_count, evaluated_modules, violation_count, file_count_violations, import_violations."""
    seen = rule_modules(modules, rules).agg(F.countDistinct("module").alias("evaluated_modules"))
    counts = violations.agg(
        F.count("*").alias("violation_count"), F.count_if(F.col("type") == "file_count").alias("file_count_violations"), F.count_if(F.col("type") == "import").alias("import_violations")
    )
    return rules.agg(F.count("*").alias("rule_count")).crossJoin(seen).crossJoin(counts)  # three tables of one row each


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Package rules by name; of one name those with fewer module patterns come first."""
    return rules.orderBy("name", F.size("modules"))
