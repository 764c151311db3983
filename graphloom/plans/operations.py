"""Queries of names, sources, storage and streaming steps over the driver's tables, each with SQL of its own.

Inputs are made by SQL that Spark and DuckDB both run; what an operator makes of them is then stated a second time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names, text
from graphloom.operators import diagrams, graph, model, resolve, rules, secrets, store
from graphloom.plans.derived import Derived, oracle
from graphloom.plans.driver import _HUB, _SEARCH, _file_imports, _hub, _longs, _violations, register
from graphloom.schemas import FFI, PROCESS, SERVICE
from graphloom.sinks import tsv
from graphloom.sources import extract, languages, naming, scan
from graphloom.streaming import watch

# Names of references.

_NAMED = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'java' ELSE 'rust' END AS language, p_brand AS module,
  CASE p_partkey % 9 WHEN 0 THEN replace(p_name, ' ', '.') WHEN 1 THEN concat('*', a, '[0].', b) WHEN 2 THEN concat('ctypes.', a) WHEN 3 THEN concat('exec.', a, '.Command')
    WHEN 4 THEN concat(upper(a), '(', b, ')') WHEN 5 THEN concat('grpc.', b) WHEN 6 THEN concat('tonic::', a, '::', b) WHEN 7 THEN concat('lib.', a, '.CDLL') ELSE concat('&', a, '/', b) END AS name
  FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM {part})"""
_NAMED_CTE = f"named AS ({_NAMED.format(part='part')})"


def _named(d: Derived) -> DataFrame:
    return d.spark.sql(_NAMED, part=d.read("part"))


@register(
    f"""WITH {_NAMED_CTE} SELECT id, name, coalesce(list_filter(string_split_regex(trim(name), '[.:/()\\[\\]]'), lambda x: x <> '')[-1], trim(name)) AS leaf,
      regexp_replace(regexp_extract(trim(name), '^([^.\\[]*)', 1), '^[*&]+', '') AS prefix, regexp_matches(name, '^[A-Z]') AS exported,
      CASE WHEN module = '' OR starts_with(name, module || '.') THEN name ELSE module || '.' || name END AS qualified,
      CASE WHEN regexp_matches(name, '^[0-9]') THEN 'n_' ELSE '' END || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS diagram_id FROM named"""
)
def reference_parts(d: Derived) -> DataFrame:
    n = F.col("name")
    return _named(d).select(
        "id", "name", names.leaf(n).alias("leaf"), names.prefix(n).alias("prefix"), names.is_exported_name(n).alias("exported"),
        names.qualified(F.col("module"), n).alias("qualified"), text.sanitized_id(n).alias("diagram_id"),
    )


def _starts_sql(value: str, prefixes: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({value}, '{p}')" for p in prefixes) + ")"


def _contexts_sql() -> str:
    cases = []
    for language, kinds in names.CALL_CONTEXTS.items():
        for kind in (FFI, PROCESS, SERVICE):
            test = _starts_sql("name", kinds[kind])
            if (language, kind) == ("python", FFI):
                test += " OR contains(name, '.CDLL') OR contains(name, '.PyDLL') OR contains(name, '.dlopen')"
            if (language, kind) == ("go", PROCESS):
                test += " AND ends_with(name, '.Command')"
            cases.append(f"WHEN language = '{language}' AND ({test}) THEN '{kind}'")
    return "CASE " + " ".join(cases) + " ELSE '' END"


_BRIDGE_SQL = " OR ".join(f"language = '{k}' AND {_starts_sql('name', v)}" for k, v in names.BRIDGE_PREFIXES.items())


@register(f"WITH {_NAMED_CTE} SELECT id, language, name, context, context <> '' OR {_BRIDGE_SQL} AS bridge FROM (SELECT *, {_contexts_sql()} AS context FROM named)")
def call_contexts(d: Derived) -> DataFrame:
    told = _named(d).withColumn("context", names.call_context(F.col("language"), F.col("name")))
    return told.select("id", "language", "name", "context", names.is_bridge_reference(F.col("language"), F.col("name"), F.col("context")).alias("bridge"))


_SERVED = """SELECT p_partkey AS id, concat(split_part(p_name, ' ', 1), CASE p_partkey % 6 WHEN 0 THEN 'Server' WHEN 1 THEN 'Stub' WHEN 2 THEN 'Rpc' ELSE '' END) AS name,
  CAST(p_partkey % 4 AS INT) AS kind, CASE p_partkey % 7 WHEN 0 THEN '@Route(x)' WHEN 1 THEN 'cached' ELSE '' END AS decorator FROM {part}"""


@register(
    f"""WITH served AS ({_SERVED.format(part="part")}), told AS (SELECT *, CASE WHEN regexp_matches(lower(name), '(server|stub|rpc)$') THEN regexp_replace(lower(name), '(server|stub|rpc)$', '')
      ELSE lower(name) END AS stem FROM served)
    SELECT id, name, regexp_matches(lower(name), 'grpc|thrift|rpc|route|endpoint|handler|service|servicer|server') OR regexp_matches(lower(decorator), 'grpc|thrift|route|api')
      OR (kind IN (1, 3) AND stem <> lower(name) AND length(stem) > 2) AS service FROM told"""
)
def service_definitions(d: Derived) -> DataFrame:
    from graphloom.schemas import CLASS, INTERFACE

    served = d.spark.sql(_SERVED, part=d.read("part"))
    kind = F.when(F.col("kind") == 1, CLASS).when(F.col("kind") == 3, INTERFACE).otherwise(-1)
    blank = F.lit("")
    service = names.is_service_definition(F.col("name"), F.col("name"), blank, blank, F.array("decorator"), kind)
    return served.select("id", "name", service.alias("service"))


@register(
    """SELECT p_partkey AS id, p_size AS level, module, list_aggregate(list_filter(string_split(module, '.')[1:greatest(len(string_split(module, '.')) - p_size % 4, 0)]
        || [ltrim(statement, '.')], lambda x: x <> ''), 'string_agg', '.') AS target
    FROM (SELECT *, replace(p_name, ' ', '.') AS module, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '..pkg.mod' END AS statement FROM part) WHERE p_size % 4 > 0
    UNION ALL SELECT p_partkey, p_size, replace(p_name, ' ', '.'), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '..pkg.mod' END FROM part WHERE p_size % 4 = 0"""
)
def relative_imports(d: Derived) -> DataFrame:
    rows = d.read("part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("level"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("module"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise("..pkg.mod").alias("statement"),
    )
    target = names.python_relative(F.col("module"), F.col("statement"), F.col("level") % 4)
    return rows.select("id", "level", "module", F.when((F.col("level") % 4 > 0) & (target == ""), None).otherwise(target).alias("target"))


@register("SELECT p_partkey AS id, CAST(least(500.0 * pow(2, greatest(p_size % 12, 1) - 1), 30000.0) AS BIGINT) AS delay FROM part")
def retry_delays(d: Derived) -> DataFrame:
    return d.read("part").select(F.col("p_partkey").alias("id"), text.backoff_ms(500, F.col("p_size") % 12, 30_000).alias("delay"))


# Source files.

_PATHS = """SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'src/core/' ELSE 'src/' END, lower(replace(p_brand, '#', '')), '/',
  replace(p_name, ' ', '/'), CASE p_partkey % 7 WHEN 0 THEN '_test.go' WHEN 1 THEN '_test.py' WHEN 2 THEN '.go' WHEN 3 THEN '.py' WHEN 4 THEN '.js' WHEN 5 THEN '.GO' ELSE '.gen.go' END) AS path,
  CASE p_partkey % 11 WHEN 0 THEN '// Code Generated By tool' WHEN 1 THEN '/* @generated */' WHEN 2 THEN '// graphloom:ignore' ELSE '// plain' END AS content FROM {part}"""
_PATHS_CTE = f"paths AS ({_PATHS.format(part='part')})"


def _paths(d: Derived) -> DataFrame:
    return d.spark.sql(_PATHS, part=d.read("part"))


@register(
    f"""WITH {_PATHS_CTE} SELECT path, CASE WHEN ends_with(lower(path), '.go') THEN 'go' ELSE 'python' END AS language, content FROM paths
    WHERE regexp_matches(lower(path), '\\.(go|py)$') AND NOT regexp_matches(path, '(_test\\.go|_test\\.py)$') AND NOT starts_with(path, 'vendor/') AND NOT ends_with(path, '.gen.go')
      AND NOT regexp_matches(lower(content), 'code generated by|@generated|graphloom:ignore')"""
)
def scanned_files(d: Derived) -> DataFrame:
    return scan.source_files(_paths(d).select("path", "content"), languages.registry(), exclude_dirs=["vend*"], exclude_files=["*.gen.go"])


@register(f"WITH {_PATHS_CTE} SELECT path FROM paths WHERE NOT regexp_matches(path, '/s[^/]*$') AND NOT regexp_matches(path, '/core/')")
def secret_scan_paths(d: Derived) -> DataFrame:
    return secrets.skipped_paths(_paths(d).select("path"), ["s*"], ["core"])


@register(
    f"""WITH {_PATHS_CTE}, mods AS (SELECT DISTINCT regexp_extract(path, '^((vendor|src/core|src)/[^/]*)/', 1) AS root FROM paths WHERE id % 3 = 0 UNION SELECT 'src')
    SELECT path, coalesce(CASE WHEN root IS NULL THEN '' WHEN dir = root THEN 'example/' || root ELSE 'example/' || root || substr(dir, length(root) + 1) END, '') AS module
    FROM (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, (SELECT max_by(root, length(root)) FROM mods WHERE starts_with(regexp_replace(path, '/?[^/]*$', '') || '/', root || '/')) AS root
      FROM (SELECT DISTINCT path FROM paths))"""
)
def go_module_names(d: Derived) -> DataFrame:
    files = _paths(d).select("path", "id")
    roots = files.filter("id % 3 = 0").select(F.regexp_extract("path", "^((vendor|src/core|src)/[^/]*)/", 1).alias("root")).distinct().union(d.spark.createDataFrame([("src",)], "root string")).distinct()
    gomods = roots.select(F.concat("root", F.lit("/go.mod")).alias("path"), F.concat(F.lit("// head\nmodule example/"), "root", F.lit("\n")).alias("content"))
    return naming.go_modules(files.select("path").distinct(), gomods).select("path", "module")


@register(
    f"""WITH {_PATHS_CTE}, packages AS (SELECT DISTINCT regexp_extract(path, '^((vendor|src/core|src)/[^/]*)/', 1) AS pkg FROM paths WHERE id % 2 = 0),
    all_paths AS (SELECT path FROM paths UNION SELECT pkg || '/__init__.py' FROM packages)
    SELECT path, regexp_replace(replace(regexp_replace(below, '\\.py$', ''), '/', '.'), '\\.?__init__$', '') AS module FROM (
      SELECT path, CASE WHEN pkg IS NULL THEN regexp_extract(path, '[^/]*$') ELSE substr(path, length(regexp_replace(pkg, '/?[^/]*$', '')) + CASE WHEN contains(pkg, '/') THEN 2 ELSE 1 END) END AS below
      FROM (SELECT path, (SELECT min_by(pkg, length(pkg)) FROM packages WHERE starts_with(path, pkg || '/')) AS pkg FROM all_paths))"""
)
def python_module_names(d: Derived) -> DataFrame:
    files = _paths(d)
    packages = files.filter("id % 2 = 0").select(F.concat(F.regexp_extract("path", "^((vendor|src/core|src)/[^/]*)/", 1), F.lit("/__init__.py")).alias("path"))
    return naming.python_modules(files.select("path").union(packages).distinct()).select("path", "module")


@register(
    """SELECT path, issue FROM (SELECT coalesce(m.c_custkey, f.c_custkey) AS path, CASE WHEN f.c_custkey IS NULL THEN 'missing' WHEN m.c_custkey IS NULL THEN 'unlisted'
      WHEN m.c_custkey % 5 = 0 THEN 'mismatch' END AS issue FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) m
      FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) f ON m.c_custkey = f.c_custkey) WHERE issue IS NOT NULL"""
)
def artifact_issues(d: Derived) -> DataFrame:
    every = d.read("customer").select(F.col("c_custkey").alias("path"), F.col("c_name").cast("binary").alias("content"))
    manifest = every.filter("path % 3 <> 0").select("path", F.when(F.col("path") % 5 == 0, "0" * 64).otherwise(F.upper(F.sha2("content", 256))).alias("sha256"))
    return scan.verify_artifacts(every.filter("path % 4 <> 0"), manifest)


# Extractors. Each source is one text of rows that are known beforehand.


def _texts(lines: DataFrame, language: str, head: str = "") -> DataFrame:
    """Files of lines (path, n, line), in order of n, after a head."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("path").agg(F.concat(F.lit(head), body).alias("content")).withColumn("language", F.lit(language))


_LISTED = "SELECT concat('n', c_nationkey) AS path, c_custkey AS n, c_custkey AS k FROM {customer}"
_LISTED_CTE = f"listed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS i FROM ({_LISTED.format(customer='customer')}))"


def _listed(d: Derived) -> DataFrame:
    return d.spark.sql(_LISTED, customer=d.read("customer"))


def _extracted(sources: DataFrame, *columns: str) -> DataFrame:
    return _longs(extract.extract(sources).select("path", "row", *columns), *[c for c in columns if c in ("line", "kind", "params")])


@register(
    f"""WITH {_LISTED_CTE} SELECT path, 'import' AS row, 'example.com/s' || k AS name, i + 2 AS line FROM listed WHERE k % 3 <> 0
    UNION ALL SELECT DISTINCT path, r, 'example.com/root', 1 FROM listed, (VALUES ('package'), ('definition')) v(r)"""
)
def gomod_rows(d: Derived) -> DataFrame:
    name = F.concat(F.lit("example.com/s"), F.col("k").cast("string"))
    line = F.when(F.col("k") % 3 == 0, F.concat(F.lit("// require "), name, F.lit(" v1"))).otherwise(F.concat(F.lit("require "), name, F.lit(" v1 // indirect")))
    return _extracted(_texts(_listed(d).withColumn("line", line), "gomod", "module example.com/root\n\n"), "name", "line")


@register(f"WITH {_LISTED_CTE} SELECT path, 'import' AS row, 'example.com/m' || (k % 4) AS name, min(i) AS line FROM listed GROUP BY path, k % 4")
def gosum_rows(d: Derived) -> DataFrame:
    name = F.concat(F.lit("example.com/m"), (F.col("k") % 4).cast("string"))
    line = F.concat(name, F.when(F.col("k") % 2 == 0, F.lit(" v1/go.mod h1:x=")).otherwise(F.lit(" v1 h1:y=")))
    return _extracted(_texts(_listed(d).withColumn("line", line), "gosum"), "name", "line")


@register(
    f"""WITH {_LISTED_CTE} SELECT path, 'import' AS row, CASE k % 4 WHEN 3 THEN './s' ELSE 's' END || k AS name, CASE k % 4 WHEN 0 THEN 'a' || k WHEN 2 THEN 'b' || k ELSE '' END AS alias,
      CASE k % 4 WHEN 1 THEN 'x' || k || ',y' WHEN 3 THEN 'z' || k ELSE '' END AS items, k % 4 = 3 AS is_relative, i AS line FROM listed"""
)
def script_imports(d: Derived) -> DataFrame:
    line = F.expr(
        """CASE k % 4 WHEN 0 THEN concat('import a', k, ' from "s', k, '";') WHEN 1 THEN concat('import { x', k, ' as q, y } from "s', k, '"')
        WHEN 2 THEN concat("const b", k, " = require('s", k, "');") ELSE concat("const { z", k, " } = require('./s", k, "')") END"""
    )
    found = _extracted(_texts(_listed(d).withColumn("line", line), "javascript"), "name", "alias", "items", "is_relative", "line")
    return found.withColumn("items", F.array_join("items", ","))


@register(
    f"""WITH {_LISTED_CTE} SELECT path, 'import' AS row, 'example.com/s' || k AS name, CASE k % 4 WHEN 0 THEN 'a' || k WHEN 1 THEN '_' WHEN 2 THEN '.' ELSE '' END AS alias, i + 3 AS line FROM listed
    UNION ALL SELECT DISTINCT path, 'package', 'main', '', 1 FROM listed"""
)
def go_imports(d: Derived) -> DataFrame:
    line = F.expr("""concat('\t', CASE k % 4 WHEN 0 THEN concat('a', k, ' ') WHEN 1 THEN '_ ' WHEN 2 THEN '. ' ELSE '' END, '"example.com/s', k, '"')""")
    sources = _texts(_listed(d).withColumn("line", line), "go", "package main\n\nimport (\n").withColumn("content", F.concat("content", F.lit("\n)\n")))
    return _extracted(sources, "name", "alias", "line")


@register(
    f"""WITH {_LISTED_CTE} SELECT path, 'definition' AS row, CASE k % 2 WHEN 0 THEN 'Do' ELSE 'do' END || k AS name, k % 2 = 0 AS exported, k % 3 AS params, 2 * i AS line FROM listed"""
)
def go_functions(d: Derived) -> DataFrame:
    line = F.expr("""concat('func ', CASE k % 2 WHEN 0 THEN 'Do' ELSE 'do' END, k, CASE k % 3 WHEN 0 THEN '()' WHEN 1 THEN '(a int)' ELSE '(a int, b string)' END, ' {\n}')""")
    return _extracted(_texts(_listed(d).withColumn("line", line), "go", "\n"), "name", "exported", "params", "line").filter("row = 'definition'")


@register(f"WITH {_LISTED_CTE} SELECT path, 'import' AS row, 'java.s' || k || CASE k % 2 WHEN 0 THEN '.*' ELSE '.X' END AS name, i + 1 AS line FROM listed UNION ALL SELECT DISTINCT path, 'package', 'com.example', 1 FROM listed")
def java_imports(d: Derived) -> DataFrame:
    line = F.expr("concat('import ', CASE k % 3 WHEN 0 THEN 'static ' ELSE '' END, 'java.s', k, CASE k % 2 WHEN 0 THEN '.*' ELSE '.X' END, ';')")
    return _extracted(_texts(_listed(d).withColumn("line", line), "java", "package com.example;\n"), "name", "line")


@register(
    f"""WITH {_LISTED_CTE} SELECT path, 'import' AS row, 'crate::s' || k || '::a' AS name, '' AS alias, i AS line FROM listed WHERE k % 2 = 0
    UNION ALL SELECT path, 'import', 'crate::s' || k || '::b', 'c', i FROM listed WHERE k % 2 = 0 UNION ALL SELECT path, 'import', 's' || k, 't' || k, i FROM listed WHERE k % 2 = 1"""
)
def rust_uses(d: Derived) -> DataFrame:
    line = F.expr("CASE k % 2 WHEN 0 THEN concat('use crate::s', k, '::{a, b as c};') ELSE concat('pub use s', k, ' as t', k, ';') END")
    return _extracted(_texts(_listed(d).withColumn("line", line), "rust"), "name", "alias", "line")


@register(
    f"""WITH {_LISTED_CTE} SELECT path, 'import' AS row, '/s' || k || '.js' AS name, i AS line FROM listed WHERE k % 3 = 0
    UNION ALL SELECT path, 'import', 's' || k || '.css', i FROM listed WHERE k % 3 = 1 UNION ALL SELECT path, 'definition', 'id' || k, i FROM listed WHERE k % 3 = 2
    UNION ALL SELECT path, 'reference', unnest(['x' || k, 'y']), i FROM listed WHERE k % 3 = 2"""
)
def html_rows(d: Derived) -> DataFrame:
    line = F.expr(
        """CASE k % 3 WHEN 0 THEN concat('<script async src="/s', k, '.js"></script>') WHEN 1 THEN concat("<LINK rel='stylesheet' href='s", k, ".css'>")
        ELSE concat('<div id="id', k, '" class="x', k, ' y">text > text</div>') END"""
    )
    return _extracted(_texts(_listed(d).withColumn("line", line), "html"), "name", "line")


@register(
    """SELECT CAST(page_id AS VARCHAR) AS path, name, count(*) AS uses FROM (SELECT page_id, unnest(string_split(c, ' ')) AS name FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<\\w+[^<>]*class="([^"<>]*)"[^<>]*>', 1)) AS c FROM pages)) WHERE name <> '' GROUP BY ALL"""
)
def page_classes(d: Derived) -> DataFrame:
    sources = d.read("pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    return extract.extract(sources).filter("row = 'reference'").groupBy("path", "name").agg(F.count("*").alias("uses"))


@register(
    f"""WITH {_LISTED_CTE} SELECT path, 'import' AS row, 's' || k || '.css' AS name, i AS line FROM listed WHERE k % 2 = 0
    UNION ALL SELECT path, 'definition', unnest(['.c' || k, '#d' || k, 'p']), i FROM listed WHERE k % 2 = 1"""
)
def css_rows(d: Derived) -> DataFrame:
    line = F.expr("""CASE k % 2 WHEN 0 THEN concat('@import url("s', k, '.css"); /* .gone { } */') ELSE concat('.c', k, ', #d', k, ' p { color: red }') END""")
    return _extracted(_texts(_listed(d).withColumn("line", line), "css"), "name", "line")


@register(
    f"""WITH {_LISTED_CTE} SELECT path, 'import' AS row, CASE k % 3 WHEN 2 THEN 'p' || k ELSE 'm' || k END AS name, CASE k % 3 WHEN 1 THEN 'a' || k ELSE '' END AS alias,
      CASE k % 3 WHEN 2 THEN 'x,y' ELSE '' END AS items, i AS line FROM listed"""
)
def python_imports(d: Derived) -> DataFrame:
    line = F.expr("CASE k % 3 WHEN 0 THEN concat('import m', k) WHEN 1 THEN concat('import m', k, ' as a', k) ELSE concat('from p', k, ' import x, y') END")
    found = _extracted(_texts(_listed(d).withColumn("line", line), "python"), "name", "alias", "items", "line").filter("row = 'import'")
    return found.withColumn("items", F.array_join("items", ","))


# Storage.


@register("SELECT p_partkey AS path, p_size + 100 AS size FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size <= 25 AND p_size > 5")
def path_upsert(d: Derived) -> DataFrame:
    part = d.read("part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    stored, new = part.filter("size > 5"), part.filter("size > 25").withColumn("size", F.col("size") + 100)
    return store.upsert_by_path(stored, new).withColumn("size", F.col("size").cast("int"))


@register(
    """SELECT p_partkey AS path, CASE WHEN p_partkey % 5 IN (1, 4) THEN p_size + 100 ELSE p_size END AS size FROM part
    WHERE p_partkey % 5 <> 2 AND (p_partkey % 2 = 0 OR p_partkey % 5 = 4)"""
)
def batch_changes(d: Derived) -> DataFrame:
    """Upserts (1), deletions (2), upserts deleted (3 is left alone), a pruning to even paths, and upserts after it (4)."""
    part = d.read("part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    turn = F.col("path") % 5
    one = part.filter(turn.isin(1, 2, 4)).select(F.when(turn == 4, 900).otherwise(1).alias("seq"), F.when(turn == 2, "delete_file").otherwise("upsert_file").alias("operation"), "path")
    early = part.filter(turn == 2).select(F.lit(0).alias("seq"), F.lit("upsert_file").alias("operation"), "path")
    prune = part.filter("path % 2 = 0").select(F.lit(500).alias("seq"), F.lit("prune_to_paths").alias("operation"), "path")
    rows = part.withColumn("size", (F.col("size") + 100).cast("int"))
    return store.apply_changes(part, one.union(early).union(prune), rows)


_OVERLAYS = """SELECT o_orderkey AS id, 'default' AS project_key, concat('s', o_custkey % 40) AS symbol, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat('f', o_orderkey % 5) END AS file_path,
  CASE o_orderkey % 4 WHEN 0 THEN 'RE-VERIFICATION' ELSE 'ACTIVE' END AS status, 'EXCLUSION' AS overlay_type, concat('r', o_orderkey) AS reason, o_orderkey % 1000 AS created_at,
  concat('h', o_orderkey % 2) AS source_hash FROM {orders}"""
_OVERLAYS_CTE = f"overlays AS ({_OVERLAYS.format(orders='orders')})"


@register(
    f"""WITH {_OVERLAYS_CTE}, asked AS (SELECT DISTINCT 'default' AS project_key, 's' || (c_custkey % 50) AS symbol, 'f' || (c_custkey % 7) AS file_path FROM customer)
    SELECT a.project_key, a.symbol, a.file_path, o.id, o.overlay_type, o.reason, o.created_at FROM asked a JOIN overlays o ON o.project_key = a.project_key AND o.symbol = a.symbol
      AND (o.file_path = '' OR o.file_path = a.file_path) WHERE o.status = 'ACTIVE'
    QUALIFY row_number() OVER (PARTITION BY a.symbol, a.file_path ORDER BY o.created_at DESC, o.id DESC) = 1"""
)
def overlay_checks(d: Derived) -> DataFrame:
    key = F.col("c_custkey")
    asked = d.read("customer").select(F.lit("default").alias("project_key"), F.concat(F.lit("s"), (key % 50).cast("string")).alias("symbol"), F.concat(F.lit("f"), (key % 7).cast("string")).alias("file_path"))
    return store.check_overlays(d.spark.sql(_OVERLAYS, orders=d.read("orders")), asked.distinct())


@register(
    f"""WITH {_OVERLAYS_CTE} SELECT id, file_path, CASE WHEN status = 'ACTIVE' AND file_path IN ('f1', 'f2') AND source_hash <> 'h1' THEN 'RE-VERIFICATION' ELSE status END AS status FROM overlays"""
)
def stale_overlays(d: Derived) -> DataFrame:
    hashes = d.spark.createDataFrame([("f1", "h1"), ("f2", "h1")], "path string, hash string")
    return store.mark_stale(d.spark.sql(_OVERLAYS, orders=d.read("orders")), hashes).select("id", "file_path", "status")


@register(
    f"""WITH {_OVERLAYS_CTE} SELECT id, symbol, created_at FROM overlays WHERE symbol = 's7' ORDER BY created_at DESC, id DESC LIMIT 20"""
)
def listed_overlays(d: Derived) -> DataFrame:
    return store.list_overlays(d.spark.sql(_OVERLAYS, orders=d.read("orders")), "", "s7", limit=20).select("id", "symbol", "created_at")


_SPOOL = "SELECT event_id AS id, CAST(user_id % 9 AS INT) AS attempts, ts AS next_attempt_at, '' AS last_error FROM {events}"
_NOW = "2024-01-10 00:00:00"


@register(f"SELECT event_id AS id, CAST(user_id % 9 AS INT) AS attempts, ts AS next_attempt_at FROM events WHERE ts <= TIMESTAMP '{_NOW}' ORDER BY event_id LIMIT 100")
def due_spool(d: Derived) -> DataFrame:
    spool = d.spark.sql(_SPOOL, events=d.read("events"))
    return store.spool_due(spool, datetime.fromisoformat(_NOW), 100).select("id", "attempts", "next_attempt_at")


@register(
    f"""SELECT event_id AS id, CAST(user_id % 9 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS attempts, CASE WHEN event_id % 5 = 0 THEN 'down' ELSE '' END AS last_error,
      CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '{_NOW}' + to_milliseconds(CAST(least(500 * pow(2, user_id % 9), 30000) AS BIGINT)) ELSE ts END AS next_attempt_at
    FROM events WHERE event_id % 7 <> 0"""
)
def spool_after_a_run(d: Derived) -> DataFrame:
    spool = d.spark.sql(_SPOOL, events=d.read("events"))
    left = store.spool_ack(spool, spool.filter("id % 7 = 0"))
    return store.spool_nack(left, left.filter("id % 5 = 0"), datetime.fromisoformat(_NOW), "down").withColumn("attempts", F.col("attempts").cast("int"))


@register("SELECT p_partkey AS path, p_name AS name, [CAST(p_size AS BIGINT), p_partkey] AS sizes FROM part")
def blobs_again(d: Derived) -> DataFrame:
    nested = d.read("part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("name"), F.array(F.col("p_size").cast("long"), "p_partkey").alias("sizes"))
    return store.load_blobs(store.file_blobs(nested), "path long, name string, sizes array<bigint>")


# Changes.

_CHANGED = """SELECT doc_id AS path, text AS before, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, '\n', 'new line') WHEN 2 THEN concat('new line', '\n', text) ELSE replace(text, ' the ', ' THE ') END AS after
  FROM {documents}"""


@register(
    f"""WITH changed AS ({_CHANGED.format(documents="documents").replace("'" + chr(10) + "'", "chr(10)")}),
    cut AS (SELECT path, string_split(before, chr(10)) AS o, string_split(after, chr(10)) AS n FROM changed WHERE before <> after),
    sized AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(o), len(n)) + 1), lambda i: o[i] <> n[i])) - 1, least(len(o), len(n))) AS head,
      coalesce(list_min(list_filter(range(1, least(len(o), len(n)) + 1), lambda i: o[len(o) - i + 1] <> n[len(n) - i + 1])) - 1, least(len(o), len(n))) AS tail FROM cut),
    told AS (SELECT path, len(n) AS size, least(head + 1, len(n)) AS first, least(tail, least(len(o), len(n)) - head) AS tail FROM sized)
    SELECT path, CAST(first AS BIGINT) AS start, CAST(greatest(size - tail, first) AS BIGINT) AS "end" FROM told"""
)
def changed_lines(d: Derived) -> DataFrame:
    versions = d.spark.sql(_CHANGED.replace("\n'", "\\n'"), documents=d.read("documents"))
    return _longs(secrets.changed_ranges(versions.filter("before is not null")), "start", "end")


_EVENTS = "SELECT concat('f', user_id, CASE user_id % 5 WHEN 0 THEN '_test.go' WHEN 1 THEN '.js' WHEN 2 THEN '.py' ELSE '.go' END) AS path, CASE WHEN value < 5 THEN NULL ELSE concat('v', CAST(floor(value / 40) AS INT)) END AS content, ts, event_id FROM {events}"


@register(
    f"""WITH events_ AS (SELECT * FROM ({_EVENTS.format(events="events")}) WHERE regexp_matches(path, '\\.(go|py)$') AND NOT regexp_matches(path, '_test\\.go$')),
    last AS (SELECT path, content FROM events_ QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1)
    SELECT path, content FROM last WHERE content IS NULL OR content <> 'v1'"""
)
def last_file_changes(d: Derived) -> DataFrame:
    events = d.spark.sql(_EVENTS, events=d.read("events"))
    first = events.groupBy("path").agg(F.max_by(F.struct("content", "ts"), F.struct("ts", "event_id")).alias("x")).select("path", "x.content", "x.ts")
    state = events.select("path").distinct().select("path", F.xxhash64(F.lit("v1")).alias("hash"))
    found = watch.last_changes(watch.watched(first, languages.registry()), state.filter(F.col("path") != ""))
    return found.select("path", "content")


# Graphs, rules and diagrams.


@register(
    oracle(
        "SELECT DISTINCT names[cycle[i]] AS src, names[cycle[i % len(cycle) + 1]] AS dst FROM (SELECT cycle, unnest(range(1, len(cycle) + 1)) AS i FROM search WHERE cycle IS NOT NULL), (SELECT list(name ORDER BY i) AS names FROM ids)",
        "inner_edges", more=_SEARCH,
    )
)
def cycle_edges(d: Derived) -> DataFrame:
    return graph.cycle_edges(graph.detect_cycles(model.internal_edges(d.edges, d.modules)))


@register(
    oracle(
        "SELECT DISTINCT e.src, e.dst FROM inner_edges e JOIN flows f ON f.node = e.src WHERE f.d < 3",
        "inner_edges", more=f"flows(node, d) AS (SELECT {_HUB}, 0 UNION SELECT e.dst, f.d + 1 FROM flows f JOIN inner_edges e ON f.node = e.src WHERE f.d < 2)",
    )
)
def flow_edges(d: Derived) -> DataFrame:
    entry = d.spark.createDataFrame([(_hub(d, "src"),)], "node string")
    return graph.flow(d.edges, d.modules, entry, 3)[1]


@register(oracle("SELECT name AS node FROM modules WHERE name NOT IN (SELECT dst FROM inner_edges)", "inner_edges", "modules"))
def flow_roots(d: Derived) -> DataFrame:
    return graph.entry_modules(d.files, d.edges, d.modules, [])


@register(oracle("SELECT DISTINCT module AS node FROM files WHERE ends_with(path, '/f2.py') OR module LIKE 'brand#11/%' AND path = (SELECT min(path) FROM files WHERE module LIKE 'brand#11/%')", "files"))
def flow_entries(d: Derived) -> DataFrame:
    first = d.files.filter("module like 'brand#11/%'").agg(F.min("path")).first()[0]
    return graph.entry_modules(d.files, d.edges, d.modules, ["f2.py", first or ""])


@register(oracle("SELECT module, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT module, name FROM best QUALIFY row_number() OVER (PARTITION BY module ORDER BY name) <= 12) GROUP BY module", "best"))
def definition_previews(d: Derived) -> DataFrame:
    return diagrams.definition_preview(d.definitions).select("module", F.array_join("names", ",").alias("names"))


@register(
    oracle(
        """SELECT 'From' || chr(9) || 'To' || chr(9) || 'File' || chr(9) || 'Line' || chr(9) || 'Column' AS line
        UNION ALL SELECT src || chr(9) || dst || chr(9) || path || chr(9) || line || chr(9) || 0 FROM edges""",
        "edges",
    )
)
def edges_tsv(d: Derived) -> DataFrame:
    return tsv.edges_block(d.edges)


@register(
    oracle(
        """SELECT concat_ws(chr(9), 'Type', 'Rule', 'FromModule', 'FromLayer', 'ToModule', 'ToLayer', 'File', 'Line', 'Column') AS line
        UNION ALL SELECT concat_ws(chr(9), 'architecture_violation', 'rule-' || a, from_module, a, to_module, b, path, line, 0) FROM (
          SELECT e.src AS from_module, split_part(e.src, '/', 1) AS a, e.dst AS to_module, split_part(e.dst, '/', 1) AS b, e.path, e.line FROM inner_edges e) WHERE substr(a, 1, 7) <> substr(b, 1, 7) OR a = b""",
        "inner_edges",
    )
)
def violations_tsv(d: Derived) -> DataFrame:
    return tsv.layer_violations_block(_violations(d)[1])


@register(
    oracle(
        """SELECT concat_ws(chr(9), 'Type', 'File', 'Reference', 'Line', 'Column', 'Confidence', 'Score', 'Reasons') AS line
        UNION ALL SELECT concat_ws(chr(9), 'probable_bridge', a.path, a.name, seq + 1, 0, confidence, score, reasons) FROM assessed a WHERE status = 'probable'""",
        "assessed",
    )
)
def bridges_tsv(d: Derived) -> DataFrame:
    from graphloom.plans.driver import _resolution

    return tsv.probable_bridges_block(resolve.probable_bridges(_resolution(d)))


EXPLICIT = (resolve.Bridge("go", "brand#1*", "python", "worker", references=("lime.*", "Fn3")), resolve.Bridge("python", "*", "go", "x"))


@register(
    oracle(
        """SELECT path, seq, name, language = 'go' AND starts_with(module, 'brand#1') AND (context IN ('ffi_bridge', 'process_bridge', 'service_bridge') OR name = 'Fn3' OR starts_with(name, 'lime.'))
          OR language = 'python' AND context IN ('ffi_bridge', 'process_bridge', 'service_bridge') AS declared FROM refs""",
        "refs",
    )
)
def declared_bridges(d: Derived) -> DataFrame:
    return d.references.select("path", "seq", "name", resolve.matches_bridge(EXPLICIT).alias("declared"))


_ODD_NAMES = "SELECT p_partkey AS id, concat(' ', replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN ' . ' WHEN 1 THEN ',, ' ELSE ' , ' END), '`\"') AS name FROM {part}"


@register(
    f"""WITH odd AS ({_ODD_NAMES.format(part="part")}) SELECT id, replace(name, ' ', '') AS tight, regexp_replace(regexp_replace(trim(name), '^["''`]+', ''), '["''`]+$', '') AS bare,
      list_filter(list_transform(string_split(name, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM odd"""
)
def tidied_names(d: Derived) -> DataFrame:
    odd = d.spark.sql(_ODD_NAMES, part=d.read("part"))
    n = F.col("name")
    return odd.select("id", names.without_space(n).alias("tight"), names.unquoted(n).alias("bare"), names.split_trimmed(n, ",").alias("parts"))


@register("SELECT name, CAST(ord AS BIGINT) AS ord FROM (SELECT p_name AS name, p_partkey AS ord FROM part) WHERE name IN (SELECT p_name FROM part WHERE p_size > 45)")
def ordered_members(d: Derived) -> DataFrame:
    part = d.read("part")
    return diagrams.in_order(part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")), part.filter("p_size > 45").select(F.col("p_name").alias("name")))


@register("SELECT p_name AS name, [p_brand] || CASE WHEN p_size % 2 = 0 THEN ['x'] ELSE [] END AS modules FROM part")
def rule_order(d: Derived) -> DataFrame:
    patterns = F.concat(F.array("p_brand"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return rules.ordered_rules(d.read("part").select(F.col("p_name").alias("name"), patterns.alias("modules")))


# More of resolution, and of what a change affects.


@register(
    oracle(
        """SELECT path, seq, CAST(best AS BIGINT) AS best, CAST(second AS BIGINT) AS second, best >= CASE context WHEN 'service_bridge' THEN 6 WHEN 'ffi_bridge' THEN 7 ELSE 8 END AND best - second >= 2 AS resolved,
          CAST(least(abroad, 2) AS BIGINT) AS abroad FROM guesses""",
        "guesses",
    )
)
def candidate_scores(d: Derived) -> DataFrame:
    from graphloom.operators import symbols

    files = d.files.withColumn("local_symbols", F.array().cast("array<string>"))
    scores = resolve.candidate_scores(resolve.with_context(d.references, files, _file_imports(d)), symbols.symbol_table(d.definitions, d.files))
    return _longs(scores.select("rid.path", "rid.seq", "best", "second", "resolved", F.least("abroad", F.lit(2)).alias("abroad")), "best", "second", "abroad")


@register(oracle("SELECT path, name, count(*) AS hits FROM refs GROUP BY path, name", "refs"))
def reference_hits(d: Derived) -> DataFrame:
    return resolve.reference_hits(d.references)


_IMPORTED = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'tsx' WHEN 3 THEN 'java' WHEN 4 THEN 'rust' ELSE 'css' END AS language,
  CASE p_partkey % 4 WHEN 0 THEN concat('lib/', a, '/', b, '.js') WHEN 1 THEN concat('io.grpc.', a, '.', b) WHEN 2 THEN concat('thrift::', a, '::', b) ELSE concat('os/exec', b) END AS target,
  CASE p_partkey % 5 WHEN 0 THEN a ELSE '' END AS alias FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM {part})"""
_IMPORT_BASE = """CASE language WHEN 'go' THEN split_part(target, '/', -1) WHEN 'python' THEN split_part(target, '.', -1) WHEN 'java' THEN split_part(target, '.', -1) WHEN 'rust' THEN split_part(target, '::', -1)
  WHEN 'tsx' THEN regexp_replace(split_part(target, '/', -1), '\\.[^.]*$', '') ELSE target END"""
_IMPORT_HINT = " OR ".join(
    f"{'language IN (' + ', '.join(map(repr, names.SCRIPT_LANGUAGES)) + ')' if k == 'javascript' else f"language = '{k}'"} AND ({_starts_sql('lower(target)', v)} OR {_starts_sql('lower(base)', v)})"
    for k, v in names.BRIDGE_IMPORTS.items()
)


@register(f"SELECT id, language, target, base, CASE WHEN alias <> '' THEN alias ELSE base END AS name, {_IMPORT_HINT} AS bridge FROM (SELECT *, {_IMPORT_BASE} AS base FROM ({_IMPORTED.format(part='part')}))")
def import_names(d: Derived) -> DataFrame:
    rows = d.spark.sql(_IMPORTED, part=d.read("part"))
    language, target = F.col("language"), F.col("target")
    told = rows.withColumn("base", names.module_base(language, target))
    return told.select("id", "language", "target", "base", names.import_name(language, target, F.col("alias")).alias("name"), names.is_bridge_import(language, target, F.col("base")).alias("bridge"))


@register(
    """SELECT p_partkey AS id, split_part(regexp_replace(j, '\\.\\*$', ''), '.', -1) AS java, split_part(regexp_replace(r, '::\\*$', ''), '::', -1) AS rust
    FROM (SELECT p_partkey, replace(p_name, ' ', '.') || CASE WHEN p_size % 2 = 0 THEN '.*' ELSE '' END AS j, replace(p_name, ' ', '::') || CASE WHEN p_size % 3 = 0 THEN '::*' ELSE '' END AS r FROM part)"""
)
def import_leaves(d: Derived) -> DataFrame:
    java = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.when(F.col("p_size") % 2 == 0, ".*").otherwise(""))
    rust = F.concat(F.replace("p_name", F.lit(" "), F.lit("::")), F.when(F.col("p_size") % 3 == 0, "::*").otherwise(""))
    return d.read("part").select(F.col("p_partkey").alias("id"), naming.java_module(java).alias("java"), naming.rust_module(rust).alias("rust"))


@register(f"WITH {_PATHS_CTE} SELECT id, path, regexp_matches(path, '(_test\\.go|_test\\.py)$') AS test FROM paths")
def test_files(d: Derived) -> DataFrame:
    return _paths(d).select("id", "path", languages.is_test(F.col("path"), languages.registry()).alias("test"))


@register(
    oracle(
        """SELECT path FROM files WHERE p_partkey % 211 = 7 UNION SELECT path FROM files WHERE module IN (SELECT n FROM importers)""",
        "files", "edges", more="importers(n) AS (SELECT src FROM edges WHERE dst IN (SELECT module FROM files WHERE p_partkey % 211 = 7) UNION SELECT e.src FROM importers i JOIN edges e ON e.dst = i.n)",
    )
)
def affected_files(d: Derived) -> DataFrame:
    return watch.affected_paths(d.files.filter("p_partkey % 211 = 7"), d.edges, d.files)


@register("SELECT p_partkey AS path, CASE WHEN p_size % 5 = 0 THEN 'new' ELSE 'old' END AS result FROM part WHERE p_size % 5 > 0 OR p_size % 2 = 0")
def refreshed_results(d: Derived) -> DataFrame:
    part = d.read("part")
    cached = part.select(F.col("p_partkey").alias("path"), F.lit("old").alias("result"))
    affected = part.filter("p_size % 5 = 0").select(F.col("p_partkey").alias("path"))
    again = part.filter("p_size % 5 = 0 and p_size % 2 = 0").select(F.col("p_partkey").alias("path"), F.lit("new").alias("result"))
    return watch.refreshed(cached, again, affected)


@register(
    """SELECT doc_id, CAST(line AS BIGINT) AS line, t AS text, CASE WHEN doc_id % 2 = 0 AND line <= 4 THEN 'REF_CALL' END AS tag FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    WHERE regexp_matches(substr(t, instr(t, 'License') - 1, 9), '^[^A-Za-z0-9_]License([^A-Za-z0-9_]|$)') AND instr(t, 'License') > 1 OR regexp_matches(t, '^License([^A-Za-z0-9_]|$)')"""
)
def tagged_context(d: Derived) -> DataFrame:
    from graphloom.operators import snippets

    docs = d.read("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    tags = docs.filter("path % 2 = 0").select("path", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("line"), F.lit("REF_CALL").alias("tag"))
    return _longs(snippets.symbol_context(docs, "License", tags=tags).select(F.col("path").alias("doc_id"), "line", "text", "tag"), "line")
