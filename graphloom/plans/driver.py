"""Queries over the driver's tables, one for each operator, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import names, text
from graphloom.operators import diagrams, graph, history, metrics, model, query, resolve, rules, secrets, snippets, store, symbols
from graphloom.plans.derived import Derived, oracle

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a function of the derived tables as a query by its own name."""

    def wrap(run: Callable[[Derived], DataFrame]) -> Callable[[Derived], DataFrame]:
        _QUERIES[run.__name__] = lambda spark, sf_dir: run(Derived(spark, sf_dir))
        if sql:
            _SQL[run.__name__] = sql
        return run

    return wrap


def queries() -> dict[str, Query]:
    _with_operations()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _with_operations()
    return dict(_SQL)


def _with_operations() -> None:
    """The queries of the other module register themselves when it is imported."""
    import graphloom.plans.operations  # noqa: F401


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


COUNTS = ("file_count", "export_count", "dependency_count", "reverse_dependency_count")
SUMMARY = "SELECT name, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS) + " FROM summaries"
CQL = "SELECT modules WHERE dependency_count >= 1 AND fan_out >= 1"
CQL_NAMED = "SELECT modules WHERE name CONTAINS 'BRAND#1' AND reverse_dependency_count > 0 AND fan_in != 3"
CQL_DEPTH = "SELECT modules WHERE depth >= 2 AND file_count < 3"


def _exports(d: Derived) -> DataFrame:
    return d.definitions.filter("exported")


# Modules, edges and the query language.


@register(oracle(SUMMARY, "summaries"))
def list_modules(d: Derived) -> DataFrame:
    return _longs(query.list_modules(query.module_summaries(d.modules, d.edges, _exports(d))), *COUNTS)


@register(oracle(SUMMARY + " WHERE contains(lower(name), 'brand#3')", "summaries"))
def filtered_modules(d: Derived) -> DataFrame:
    return _longs(query.list_modules(query.module_summaries(d.modules, d.edges, _exports(d)), "Brand#3"), *COUNTS)


@register(oracle(SUMMARY + " JOIN fans USING (name) WHERE dependency_count >= 1 AND fan_out >= 1", "summaries", "fans"))
def cql_modules(d: Derived) -> DataFrame:
    return _longs(query.run_cql(CQL, d.modules, d.edges, _exports(d)), *COUNTS)


@register(oracle(SUMMARY + " JOIN fans USING (name) WHERE contains(lower(name), 'brand#1') AND reverse_dependency_count > 0 AND fan_in <> 3", "summaries", "fans"))
def cql_named(d: Derived) -> DataFrame:
    return _longs(query.run_cql(CQL_NAMED, d.modules, d.edges, _exports(d)), *COUNTS)


@register(oracle(SUMMARY + " JOIN depths USING (name) WHERE depth >= 2 AND file_count < 3", "summaries", "depths"))
def cql_depth(d: Derived) -> DataFrame:
    return _longs(query.run_cql(CQL_DEPTH, d.modules, d.edges, _exports(d)), *COUNTS)


@register(oracle("SELECT src, dst, path, CAST(line AS BIGINT) AS line FROM inner_edges", "inner_edges"))
def internal_edges(d: Derived) -> DataFrame:
    return _longs(model.internal_edges(d.edges, d.modules).select("src", "dst", "path", "line"), "line")


@register(oracle("SELECT src, dst, path, CAST(line AS BIGINT) AS line FROM edges WHERE dst NOT IN (SELECT name FROM modules)", "edges", "modules"))
def external_edges(d: Derived) -> DataFrame:
    return _longs(model.external_edges(d.edges, d.modules).select("src", "dst", "path", "line"), "line")


@register(oracle("SELECT src, count(*) AS external_count FROM edges WHERE dst NOT IN (SELECT name FROM modules) GROUP BY src", "edges", "modules"))
def external_counts(d: Derived) -> DataFrame:
    return model.external_counts(d.edges, d.modules)


_HUB = "(SELECT src FROM inner_edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_HUB_IN = "(SELECT dst FROM inner_edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _hub(d: Derived, column: str) -> str:
    """The module with most edges at one end."""
    inner = model.internal_edges(d.edges, d.modules)
    return inner.groupBy(column).count().orderBy(F.col("count").desc(), column).first()[0]


@register(
    oracle(
        f"""SELECT h AS name, (SELECT string_agg(path, ',' ORDER BY path) FROM files WHERE module = h) AS files,
        coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM exports WHERE module = h), '') AS exports,
        coalesce((SELECT string_agg(dst || '@' || path || ':' || line, ',' ORDER BY dst, path, line) FROM edges WHERE src = h), '') AS dependencies,
        coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM edges WHERE dst = h AND src <> h), '') AS reverse_dependencies FROM (SELECT {_HUB} AS h)""",
        "inner_edges", "exports",
    )
)
def module_details(d: Derived) -> DataFrame:
    row = query.module_details(_hub(d, "src"), d.files, d.edges, d.definitions)
    shown = F.transform("dependencies", lambda x: F.concat(x["to"], F.lit("@"), x["path"], F.lit(":"), x["line"].cast("string")))
    return row.select("name", *[F.array_join(c, ",").alias(c) for c in ("files", "exports")], F.array_join(shown, ",").alias("dependencies"), F.array_join("reverse_dependencies", ",").alias("reverse_dependencies"))


# Metrics.


@register(oracle("SELECT name, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out FROM fans", "fans"))
def fan_metrics(d: Derived) -> DataFrame:
    return _longs(metrics.fan_metrics(d.edges, d.modules), "fan_in", "fan_out")


@register(oracle("SELECT round(avg(fan_in), 6) AS avg_fan_in, round(avg(fan_out), 6) AS avg_fan_out, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out FROM fans", "fans"))
def fan_summary(d: Derived) -> DataFrame:
    s = metrics.fan_summary(metrics.fan_metrics(d.edges, d.modules))
    return _longs(s.withColumns({c: F.round(c, 6) for c in ("avg_fan_in", "avg_fan_out")}), "max_fan_in", "max_fan_out")


_IMPORTANCE = """SELECT name, fan_in * 2.0 + fan_out + 0.5 * coalesce(c.score, 0)
  + CASE WHEN regexp_matches(name, 'api|gateway|handler|server|service') THEN 10 ELSE 0 END AS importance
  FROM fans LEFT JOIN (SELECT module AS name, max(score) AS score FROM scored GROUP BY module) c USING (name)"""


@register(oracle(f"SELECT name, CAST(importance AS DOUBLE) AS importance FROM ({_IMPORTANCE})", "fans", "scored"))
def importance(d: Derived) -> DataFrame:
    return metrics.module_metrics(d.edges, d.modules, d.definitions, ("importance",))


@register(oracle(f"SELECT name, CAST(importance AS DOUBLE) AS score FROM ({_IMPORTANCE}) WHERE importance >= 5 ORDER BY importance DESC, name LIMIT 20", "fans", "scored"))
def metric_leaders(d: Derived) -> DataFrame:
    return metrics.leaders(metrics.module_metrics(d.edges, d.modules, d.definitions, ("importance",)), F.col("importance"), 20, 5)


@register(oracle("SELECT name, CAST(depth AS BIGINT) AS depth FROM depths", "depths"))
def module_depth(d: Derived) -> DataFrame:
    return _longs(metrics.module_depths(d.edges, d.modules), "depth")


@register(oracle("SELECT module, name, path, CAST(score AS BIGINT) AS score, CAST(loc AS BIGINT) AS loc FROM best", "best"))
def best_definition(d: Derived) -> DataFrame:
    return _longs(model.best_definitions(d.definitions).select("module", "name", "path", "score", "loc"), "score", "loc")


@register(
    oracle(
        """SELECT module, name AS definition, path, CAST(CASE WHEN score = 0 THEN 1 ELSE score END AS BIGINT) AS score, CAST(loc AS BIGINT) AS loc
        FROM best WHERE kind IN (0, 2) AND loc > 0 ORDER BY score DESC, module, definition, path LIMIT 25""",
        "best",
    )
)
def top_complexity(d: Derived) -> DataFrame:
    return _longs(metrics.top_complexity(d.definitions, 25).select("module", "definition", "path", "score", "loc"), "score", "loc")


@register(
    oracle(
        """SELECT module, CAST(max(score) AS BIGINT) AS score FROM (SELECT module, name, path, CASE WHEN score = 0 THEN 1 ELSE score END AS score
        FROM best WHERE kind IN (0, 2) AND loc > 0 ORDER BY 4 DESC, module, name, path LIMIT 200) GROUP BY module""",
        "best",
    )
)
def hotspot_by_module(d: Derived) -> DataFrame:
    return _longs(diagrams.hotspot_by_module(metrics.top_complexity(d.definitions, 200)), "score")


# Graph operators.


@register(oracle("SELECT node, component, CAST(size AS BIGINT) AS size FROM comps WHERE node IN (SELECT src FROM inner_edges UNION SELECT dst FROM inner_edges)", "comps"))
def scc_components(d: Derived) -> DataFrame:
    return graph.components_and_depths(model.internal_edges(d.edges, d.modules)).select("node", "component", "size")


@register(oracle("SELECT DISTINCT a AS node FROM reach WHERE a = b", "reach(a, b)"))
def modules_in_cycles(d: Derived) -> DataFrame:
    return graph.modules_in_cycles(model.internal_edges(d.edges, d.modules))


def _put(values: str, i: str, x: str) -> str:
    """A list of DuckDB with x at place i."""
    return f"({values}[1:{i} - 1] || [{x}] || {values}[{i} + 1:])"


#: A depth-first search, one step a turn: sorted nodes by number, their sorted neighbours in one list, the path, and where each node goes on.
_SEARCH = f"""ids AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (SELECT src AS name FROM inner_edges UNION SELECT dst FROM inner_edges)),
  ways AS (SELECT n.i, coalesce(list(m.i ORDER BY m.i) FILTER (m.i IS NOT NULL), []::BIGINT[]) AS outs FROM ids n
    LEFT JOIN (SELECT DISTINCT src, dst FROM inner_edges) e ON e.src = n.name LEFT JOIN ids m ON m.name = e.dst GROUP BY n.i),
  whole AS (SELECT list(outs ORDER BY i) AS outs, count(*) AS n FROM ways),
  search(turn, path, state, place, cycle) AS (
    SELECT 0, []::BIGINT[], list_transform(range(n), lambda x: 0), list_transform(range(n), lambda x: 0), NULL::BIGINT[] FROM whole
    UNION ALL
    SELECT turn + 1,
      CASE WHEN len(path) = 0 THEN [root] WHEN step IS NULL THEN path[1:len(path) - 1] WHEN state[step] = 0 THEN path || [step] ELSE path END,
      CASE WHEN len(path) = 0 THEN {_put("state", "root", "1")} WHEN step IS NULL THEN {_put("state", "path[-1]", "2")} WHEN state[step] = 0 THEN {_put("state", "step", "1")} ELSE state END,
      CASE WHEN len(path) = 0 OR step IS NULL THEN place ELSE {_put("place", "path[-1]", "place[path[-1]] + 1")} END,
      CASE WHEN len(path) > 0 AND state[step] = 1 THEN path[list_position(path, step):] END
    FROM (SELECT s.*, CAST(list_position(state, 0) AS BIGINT) AS root, w.outs[path[-1]][place[path[-1]] + 1] AS step FROM search s, whole w
      WHERE len(path) > 0 OR list_position(state, 0) > 0))"""


@register(
    oracle(
        """SELECT row_number() OVER (ORDER BY turn) - 1 AS cycle_id, array_to_string(list_transform(cycle, lambda x: names[x]), '>') AS cycle
        FROM search, (SELECT list(name ORDER BY i) AS names FROM ids) WHERE cycle IS NOT NULL""",
        "inner_edges", more=_SEARCH,
    )
)
def detect_cycles(d: Derived) -> DataFrame:
    found = graph.detect_cycles(model.internal_edges(d.edges, d.modules))
    return found.select("cycle_id", F.array_join("cycle", ">").alias("cycle"))


def _far(d: Derived) -> tuple[str, str]:
    """The hub and the farthest module that it reaches."""
    hub = _hub(d, "src")
    start = d.spark.createDataFrame([(hub,)], "node string")
    inner = model.internal_edges(d.edges, d.modules)
    return hub, graph.levels(inner, start).orderBy(F.col("depth").desc(), "node").first()["node"]


_CHAIN = f"""ahead(node, d) USING KEY (node) AS (SELECT {_HUB}, 0 UNION
    SELECT e.dst, a.d + 1 FROM ahead a JOIN inner_edges e ON e.src = a.node WHERE e.dst NOT IN (SELECT node FROM recurring.ahead)),
  far AS (SELECT node FROM ahead ORDER BY d DESC, node LIMIT 1),
  home(node, d) USING KEY (node) AS (SELECT node, 0 FROM far UNION
    SELECT e.src, h.d + 1 FROM home h JOIN inner_edges e ON e.dst = h.node WHERE e.src NOT IN (SELECT node FROM recurring.home)),
  near AS (SELECT e.src, min(e.dst) AS dst FROM inner_edges e JOIN home a ON a.node = e.src JOIN home b ON b.node = e.dst WHERE b.d = a.d - 1 GROUP BY e.src),
  chain(node, i) AS (SELECT {_HUB}, 0 UNION ALL SELECT n.dst, c.i + 1 FROM chain c JOIN near n ON n.src = c.node)"""


@register(
    oracle(
        f"""SELECT {_HUB} AS start, (SELECT node FROM far) AS "end", CAST(count(*) - 1 AS BIGINT) AS depth, string_agg(node, '>' ORDER BY i) AS chain FROM chain""",
        "inner_edges", more=_CHAIN,
    )
)
def import_chain(d: Derived) -> DataFrame:
    start, end = _far(d)
    chain = graph.import_chain(d.edges, d.modules, start, end)
    return d.spark.createDataFrame([(start, end, len(chain) - 1, ">".join(chain))], "start string, end string, depth long, chain string")


@register(oracle("SELECT node AS name, CAST(min(d) AS BIGINT) AS depth FROM flows GROUP BY node", "inner_edges", more=f"""flows(node, d) AS (SELECT {_HUB}, 0
  UNION SELECT e.dst, f.d + 1 FROM flows f JOIN inner_edges e ON f.node = e.src WHERE f.d < 6)"""))  # fmt: skip
def flow_bfs(d: Derived) -> DataFrame:
    entry = d.spark.createDataFrame([(_hub(d, "src"),)], "node string")
    return _longs(graph.flow(d.edges, d.modules, entry, 6)[0].select("name", "depth"), "depth")


_ABOVE = f"above(n) AS (SELECT src FROM edges WHERE dst = {_HUB_IN} UNION SELECT e.src FROM above a JOIN edges e ON e.dst = a.n)"


@register(
    oracle(
        f"""SELECT src AS name, 'direct' AS kind FROM edges WHERE dst = {_HUB_IN} UNION SELECT n, 'transitive' FROM above WHERE n NOT IN (SELECT src FROM edges WHERE dst = {_HUB_IN})
        UNION SELECT name, 'symbol' FROM exports WHERE module = {_HUB_IN}""",
        "inner_edges", "exports", more=_ABOVE,
    )
)
def impact(d: Derived) -> DataFrame:
    return graph.impact(d.edges, d.definitions, _hub(d, "dst"))


@register(
    oracle(f"SELECT path FROM files WHERE module IN (SELECT n FROM above) UNION SELECT min(path) FROM files WHERE module = {_HUB_IN}", "inner_edges", more=_ABOVE)
)
def invalidate_transitive(d: Derived) -> DataFrame:
    hub = _hub(d, "dst")
    changed = d.files.filter(F.col("module") == hub).agg(F.min("path")).first()[0]
    return graph.invalidated_files(d.edges, d.files, changed)


# Architecture rules. Layers are brands; a layer may use the brands with its own first digit.

_LAYERS = "layers AS (SELECT DISTINCT lower(p_brand) AS layer FROM part)"
_LAYER_OF = "laid AS (SELECT name, substr(name, 1, instr(name, '/') - 1) AS layer FROM modules)"
_BAD = """bad AS (SELECT 'rule-' || a.layer AS rule, e.src AS from_module, a.layer AS from_layer, e.dst AS to_module, b.layer AS to_layer, e.path, e.line
  FROM inner_edges e JOIN laid a ON e.src = a.name JOIN laid b ON e.dst = b.name WHERE substr(a.layer, 1, 7) <> substr(b.layer, 1, 7) OR a.layer = b.layer)"""


def _layers(d: Derived) -> tuple[DataFrame, DataFrame]:
    brands = d.read("part").select(F.lower("p_brand").alias("name")).distinct()
    layers = brands.select("name", F.lit(0).alias("ord"), F.when(F.col("name").endswith("1"), F.concat("name", F.lit("/**"))).otherwise(F.col("name")).alias("pattern"))
    pairs = brands.alias("a").join(brands.alias("b"), (F.substring("a.name", 1, 7) == F.substring("b.name", 1, 7)) & (F.col("a.name") != F.col("b.name")), "left")
    allow = pairs.groupBy(F.col("a.name").alias("from_layer")).agg(F.collect_list("b.name").alias("allow"))
    return layers, allow.select(F.concat(F.lit("rule-"), "from_layer").alias("name"), "from_layer", "allow")


def _violations(d: Derived) -> tuple[DataFrame, DataFrame]:
    layers, allowed = _layers(d)
    assigned = rules.layer_assignment(d.modules, layers)
    return assigned, rules.layer_violations(d.edges, d.modules, assigned, allowed)


@register(oracle("SELECT name, layer FROM laid", "modules", more=_LAYER_OF))
def layer_assignment(d: Derived) -> DataFrame:
    return rules.layer_assignment(d.modules, _layers(d)[0])


@register(oracle("SELECT rule, from_module, from_layer, to_module, to_layer, path, CAST(line AS BIGINT) AS line FROM bad", "inner_edges", more=_LAYER_OF + ", " + _BAD))
def layer_violations(d: Derived) -> DataFrame:
    return _longs(_violations(d)[1].drop("col"), "line")


@register(
    oracle(
        """SELECT from_layer, to_layer, coalesce(n, 0) AS edge_count, coalesce(v, 0) AS violation_count
        FROM (SELECT a.layer AS from_layer, b.layer AS to_layer, count(*) AS n FROM inner_edges e JOIN laid a ON e.src = a.name JOIN laid b ON e.dst = b.name WHERE a.layer <> b.layer GROUP BY ALL)
        FULL JOIN (SELECT from_layer, to_layer, count(*) AS v FROM bad GROUP BY ALL) USING (from_layer, to_layer)""",
        "inner_edges", more=_LAYER_OF + ", " + _BAD,
    )
)
def layer_dependencies(d: Derived) -> DataFrame:
    assigned, bad = _violations(d)
    return rules.layer_dependencies(d.edges, d.modules, assigned, bad)


def _package_rules(d: Derived) -> DataFrame:
    rows = [
        ("small", ["brand#1*/**", "brand#2*/**"], 1, [], [], False, []),
        ("closed", ["brand#3*/**"], 0, ["brand#3*/*", "brand#4*/*"], ["brand#41"], False, []),
    ]
    return d.spark.createDataFrame(rows, "name string, modules array<string>, max_files int, allow array<string>, deny array<string>, exclude_tests boolean, exclude_files array<string>")


_PACKAGE = """package AS (SELECT 'small' AS rule, 'file_count' AS type, name AS module, '' AS target, '' AS path, 0 AS line, CAST(file_count AS BIGINT) AS actual, CAST(1 AS BIGINT) AS max_allowed
  FROM modules WHERE regexp_matches(name, '^brand#[12]') AND file_count > 1
  UNION ALL SELECT 'closed', 'import', src, dst, path, line, NULL, NULL FROM inner_edges
  WHERE regexp_matches(src, '^brand#3') AND src <> dst AND (starts_with(dst, 'brand#41/') OR NOT regexp_matches(dst, '^brand#[34]')))"""


@register(oracle("SELECT rule, type, module, target, path, CAST(line AS BIGINT) AS line, actual, max_allowed FROM package", "inner_edges", more=_PACKAGE))
def package_violations(d: Derived) -> DataFrame:
    found = rules.package_violations(d.files, d.edges, d.modules, _package_rules(d))
    return _longs(found.drop("col").withColumnRenamed("limit", "max_allowed"), "line")


@register(
    oracle(
        """SELECT CAST(2 AS BIGINT) AS rule_count, (SELECT count(*) FROM modules WHERE regexp_matches(name, '^brand#[123]')) AS evaluated_modules, count(*) AS violation_count,
        count(*) FILTER (type = 'file_count') AS file_count_violations, count(*) FILTER (type = 'import') AS import_violations FROM package""",
        "inner_edges", more=_PACKAGE,
    )
)
def rule_summary(d: Derived) -> DataFrame:
    r = _package_rules(d)
    return rules.rule_summary(d.modules, r, rules.package_violations(d.files, d.edges, d.modules, r))


# Symbols and resolution.



def _service_sql(column: str) -> str:
    """The service key by eight rounds of suffix cuts, more than any name here has."""
    base = f"lower(regexp_replace({column}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"
    for _ in range(8):
        cases = " ".join(f"WHEN ends_with(v, '{s}') AND length(v) > {len(s) + 2} THEN left(v, length(v) - {len(s)})" for s in names.SERVICE_SUFFIXES)
        base = f"(SELECT CASE {cases} ELSE v END FROM (SELECT {base} AS v))"
    return base


@register(f"SELECT DISTINCT p_name AS name, lower(regexp_replace(p_name, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS canonical, {_service_sql('p_name')} AS service_key FROM part")
def symbol_keys(d: Derived) -> DataFrame:
    name = F.col("name")
    return d.read("part").select(F.col("p_name").alias("name")).distinct().select("name", names.canonical(name).alias("canonical"), names.service_key(name).alias("service_key"))


@register(
    oracle(
        """SELECT path, name, CAST(line AS BIGINT) AS line, usage_tag, confidence FROM (
        SELECT path, name, seq + 1 AS line, 'SYM_DEF' AS usage_tag, CAST(1.0 AS DOUBLE) AS confidence, 0 AS o, seq FROM definitions UNION ALL
        SELECT path, name, line, CASE WHEN contains(context, '|') THEN split_part(context, '|', 1) WHEN context <> '' THEN 'REF_' || upper(context) ELSE '' END,
          CASE WHEN starts_with(context, 'REF_CALL|') THEN 0.9 WHEN context <> '' THEN 0.6 ELSE 0.0 END, 1, seq FROM refs)
        QUALIFY row_number() OVER (PARTITION BY path, name, line ORDER BY confidence DESC, o, seq) = 1""",
        "definitions", "refs",
    )
)
def symbol_rows(d: Derived) -> DataFrame:
    return _longs(symbols.symbol_rows(d.definitions, d.references, d.files).select("path", "name", "line", "usage_tag", "confidence"), "line")


@register(oracle("SELECT module, name, path FROM best WHERE lower(name) = 'fn3' OR lower(regexp_replace(full_name, '[^A-Za-z0-9]', '', 'g')) = 'fn3'", "best"))
def symbol_lookup(d: Derived) -> DataFrame:
    return symbols.lookup(symbols.symbol_table(d.definitions, d.files), "Fn.3").select("module", "name", "path")


def _resolution(d: Derived) -> DataFrame:
    files = d.files.withColumn("local_symbols", F.array().cast("array<string>"))
    imports = _file_imports(d)
    return resolve.assess(d.references, files, imports, d.definitions, symbols.symbol_table(d.definitions, d.files))


def _file_imports(d: Derived) -> DataFrame:
    """Each edge as an import of its module's first file, with the items of odd targets."""
    first = d.files.filter("k = 0").select("module", "path")
    edges = d.edges.select(F.col("src").alias("module"), F.col("dst").alias("target"), "line")
    part = F.split("target", "/")[1]
    items = F.when(part.cast("int") % 2 == 1, F.array(F.concat(F.lit("Fn"), (part.cast("int") % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    return edges.join(first, "module").select("path", "module", F.col("line").alias("seq"), "target", F.lit("").alias("alias"), items.alias("items"), "line", F.lit(0).alias("col"))


@register(oracle("SELECT path, seq, name, status, CAST(score AS BIGINT) AS score, confidence, reasons FROM assessed", "assessed"))
def resolved_references(d: Derived) -> DataFrame:
    return _longs(_resolution(d).select("path", "seq", "name", "status", "score", "confidence", F.array_join("reasons", ",").alias("reasons")), "seq", "score")


@register(oracle("SELECT path, name, context FROM assessed WHERE status = 'unresolved' AND contains(name, '.')", "assessed"))
def unresolved_references(d: Derived) -> DataFrame:
    return resolve.unresolved(_resolution(d)).select("path", "name", "context")


@register(oracle("SELECT path, name, context, CAST(score AS BIGINT) AS score FROM assessed WHERE status = 'probable'", "assessed"))
def probable_bridges(d: Derived) -> DataFrame:
    return resolve.probable_bridges(_resolution(d)).select("path", "name", "context", F.col("score").cast("long").alias("score"))


@register(
    oracle(
        """SELECT path, target, item, confidence FROM (SELECT f.path, f.language, e.dst AS target, e.t, CASE WHEN e.t % 2 = 1 THEN 'Fn' || (e.t % 7) ELSE '' END AS item,
            CASE WHEN e.t % 2 = 1 THEN 'high' ELSE 'medium' END AS confidence,
            CASE WHEN f.language = 'python' THEN e.dst ELSE split_part(e.dst, '/', 2) END AS base
          FROM (SELECT *, CAST(split_part(dst, '/', 2) AS INT) AS t FROM edges) e JOIN files f ON f.module = e.src AND f.k = 0) i
        WHERE NOT (language = 'javascript' AND item = '') AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.path = i.path AND (
          CASE WHEN i.item = '' THEN r.name = i.base OR starts_with(r.name, i.base || '(') OR ends_with(r.name, '.' || i.base) OR contains(r.name, i.base || '.')
          ELSE r.name = i.item OR starts_with(r.name, i.item || '(') OR ends_with(r.name, '.' || i.item) OR contains(r.name, i.item || '.')
            OR r.name = i.base || '.' || i.item OR contains(r.name, i.base || '.' || i.item || '.') OR ends_with(r.name, '.' || i.base || '.' || i.item) END))""",
        "edges", "refs",
    )
)
def unused_imports(d: Derived) -> DataFrame:
    return resolve.unused_imports(_file_imports(d), d.references, d.files).select("path", "target", "item", "confidence")


# History.

def _delta_sql(name: str, column: str, kind: str = "BIGINT") -> str:
    return f"CAST(coalesce({column} - lag({column}) OVER w, 0) AS {kind}) AS {name}"


def _growth_sql(column: str) -> str:
    change = f"({column} - lag({column}) OVER w)"
    return f"""CASE WHEN coalesce(lag({column}) OVER w, 0) = 0 THEN 0.0::DOUBLE
      ELSE sign({change}) * floor(abs({change} * 100.0::DOUBLE / lag({column}) OVER w) * 100 + 0.5) / 100 END"""


_SNAPSHOT_ZEROS = "SELECT *, 0 AS unused_import_count, 0 AS violation_count, 0 AS hotspot_count, 0.0::DOUBLE AS avg_fan_in, 0.0::DOUBLE AS avg_fan_out FROM snapshots"
_TREND = f"""SELECT project_key, ts, {", ".join(_delta_sql(k, v) for k, v in history.DELTAS.items())}, {", ".join(_delta_sql(k, v, "DOUBLE") for k, v in history.FAN_DELTAS.items())},
  {_growth_sql("module_count")} AS module_growth_pct, {_growth_sql("file_count")} AS file_growth_pct
  FROM ({_SNAPSHOT_ZEROS}) WINDOW w AS (PARTITION BY project_key ORDER BY ts, commit_hash)"""


def _snapshots(d: Derived) -> DataFrame:
    zeros = {c: F.lit(0) for c in ("unused_import_count", "violation_count", "hotspot_count")}
    return d.snapshots.withColumns(zeros | {"avg_fan_in": F.lit(0.0), "avg_fan_out": F.lit(0.0)})


@register(oracle(_TREND, "snapshots"))
def trend_deltas(d: Derived) -> DataFrame:
    found = history.trend_deltas(_snapshots(d)).select("project_key", "ts", *history.DELTAS, *history.FAN_DELTAS, "module_growth_pct", "file_growth_pct")
    return _longs(found, *history.DELTAS)


@register(
    oracle(
        """SELECT project_key, ts, floor(avg(cycle_count) OVER w * 100 + 0.5) / 100 AS avg_cycles, floor(avg(unresolved_count) OVER w * 100 + 0.5) / 100 AS avg_unresolved
        FROM snapshots WINDOW w AS (PARTITION BY project_key ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)""",
        "snapshots",
    )
)
def trend_moving_avg(d: Derived) -> DataFrame:
    return history.moving_averages(_snapshots(d), timedelta(hours=24)).select("project_key", "ts", "avg_cycles", "avg_unresolved")


@register(oracle("SELECT project_key, ts, CAST(module_count AS BIGINT) AS module_count FROM snapshots QUALIFY row_number() OVER (PARTITION BY project_key ORDER BY ts DESC) <= 5", "snapshots"))
def trend_tail(d: Derived) -> DataFrame:
    return _longs(query.trend_slice(d.snapshots, limit=5).select("project_key", "ts", "module_count"), "module_count")


@register(
    oracle("SELECT project_key, ts, CAST(CASE WHEN date_part('hour', ts) % 2 = 0 THEN module_count + 1000 ELSE module_count END AS BIGINT) AS module_count FROM snapshots", "snapshots")
)
def snapshot_upsert(d: Derived) -> DataFrame:
    new = d.snapshots.filter(F.hour("ts") % 2 == 0).withColumn("module_count", F.col("module_count") + 1000)
    return _longs(history.upsert_snapshots(d.snapshots, new).select("project_key", "ts", "module_count"), "module_count")


# Secrets, over documents as files.

CUSTOM = secrets.Settings(patterns=(secrets.Pattern("hex-40", f"{secrets.BEFORE}[0-9a-f]{{40}}{secrets.AFTER}", "low"),))


def _sources(d: Derived) -> DataFrame:
    return d.read("documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".env")).alias("path"), F.col("text").alias("content"))


_LINES = """lines AS (SELECT 'doc/' || doc_id || '.env' AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)"""
_SOUND = "NOT regexp_matches(lower(value), 'example|sample|dummy|placeholder|changeme|notasecret|test')"
_ENTROPY_OF = "(SELECT entropy(c) FROM (SELECT unnest(string_split(value, '')) AS c))"


def _matches_sql(regex: str, quoted: bool = False, where: str = "true") -> str:
    """(file, line, col, value) of the matches in lines, with columns from the bytes before each one."""
    p, inner = "'" + regex.replace("'", "''") + "'", "substr(m, 2, length(m) - 2)" if quoted else "m"
    before = "coalesce(list_sum(list_transform(gaps[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: strlen(x))), 0)"
    return f"""SELECT file, line, CAST({before} AS BIGINT) + {2 if quoted else 1} AS col, {inner} AS value FROM (
      SELECT file, line, ms, gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
        SELECT file, line, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gaps FROM lines WHERE regexp_matches(t, {p}) AND {where}))"""


def _bounded(regex: str) -> str:
    """A pattern with word boundaries as DuckDB writes them."""
    return regex.replace(secrets.BEFORE, r"\b").replace(secrets.AFTER, r"\b")


_PATTERN_SQL = " UNION ALL ".join(
    f"SELECT '{p.name}' AS kind, '{p.severity}' AS severity, CAST(0.99 AS DOUBLE) AS confidence, {i} AS r, * FROM ({_matches_sql(_bounded(p.regex))}) WHERE {_SOUND}"
    for i, p in enumerate((*secrets.PATTERNS, *CUSTOM.patterns))
)
_SENSITIVE_LINE = "regexp_matches(t, '" + _bounded(secrets.SENSITIVE) + "')"
_CONTEXT_SQL = f"""SELECT 'sensitive-assignment' AS kind, 'medium' AS severity, CAST(CASE WHEN e >= 4.0 THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence, 1000 AS r, file, line, col, value
  FROM (SELECT *, {_ENTROPY_OF} AS e FROM ({_matches_sql(secrets.QUOTED_VALUE, True, _SENSITIVE_LINE)}) WHERE strlen(value) >= 20 AND {_SOUND}) WHERE e >= 3.2"""
_ENTROPY_SQL = f"""SELECT 'high-entropy-string' AS kind, 'low' AS severity, CAST(0.6 AS DOUBLE) AS confidence, 2000 AS r, file, line, col, value
  FROM ({_matches_sql(secrets.QUOTED_TOKEN, True)}) WHERE strlen(value) >= 20 AND {_SOUND} AND regexp_matches(value, '\\p{{L}}') AND regexp_matches(value, '\\p{{Nd}}') AND {_ENTROPY_OF} >= 4.0"""


@register(f"WITH {_LINES} SELECT kind, severity, file, CAST(line AS BIGINT) AS line, col, value, confidence, round({_ENTROPY_OF}, 6) AS entropy FROM ({_PATTERN_SQL})")
def secrets_pattern(d: Derived) -> DataFrame:
    found = secrets.pattern_findings(secrets.file_lines(_sources(d)), CUSTOM)
    return _longs(found.drop("_r").withColumn("entropy", F.round("entropy", 6)), "line", "col")


@register(f"WITH {_LINES} SELECT kind, severity, file, CAST(line AS BIGINT) AS line, col, value, confidence, round({_ENTROPY_OF}, 6) AS entropy FROM ({_CONTEXT_SQL})")
def secrets_context(d: Derived) -> DataFrame:
    found = secrets.context_findings(secrets.file_lines(_sources(d)))
    return _longs(found.drop("_r").withColumn("entropy", F.round("entropy", 6)), "line", "col")


@register(
    f"""WITH {_LINES} SELECT kind, severity, file, CAST(line AS BIGINT) AS line, col, confidence, round({_ENTROPY_OF}, 6) AS entropy,
      CASE WHEN strlen(value) <= 8 THEN repeat('*', strlen(value)) ELSE left(value, 4) || '...' || right(value, 4) END AS value
    FROM ({_PATTERN_SQL} UNION ALL {_CONTEXT_SQL} UNION ALL {_ENTROPY_SQL}) QUALIFY row_number() OVER (PARTITION BY file, line, col, value ORDER BY confidence DESC, r) = 1"""
)
def secrets_detected(d: Derived) -> DataFrame:
    return _longs(secrets.masked(secrets.detect(_sources(d), CUSTOM)).withColumn("entropy", F.round("entropy", 6)), "line", "col")


@register("SELECT DISTINCT p_name AS value, CASE WHEN strlen(p_name) <= 8 THEN repeat('*', strlen(p_name)) ELSE left(p_name, 4) || '...' || right(p_name, 4) END AS masked FROM part")
def secrets_masked(d: Derived) -> DataFrame:
    return d.read("part").select(F.col("p_name").alias("value")).distinct().select("value", text.mask(F.col("value")).alias("masked"))


@register(
    """WITH r AS (SELECT o_custkey AS k, o_orderkey % 1000 AS s, o_orderkey % 1000 + o_orderkey % 17 AS e FROM orders),
    m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m)
    SELECT CAST(k AS VARCHAR) AS path, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM g GROUP BY k, n"""
)
def merged_ranges(d: Derived) -> DataFrame:
    start = F.col("o_orderkey") % 1000
    rows = d.read("orders").select(F.col("o_custkey").cast("string").alias("path"), start.alias("start"), (start + F.col("o_orderkey") % 17).alias("end"))
    return _longs(secrets.merged_ranges(rows), "start", "end")


# Storage, snippets and diagrams.


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)")
def prune_paths(d: Derived) -> DataFrame:
    stored = d.read("part").select(F.col("p_partkey").alias("path"), "p_name")
    current = d.read("lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("path"))
    return store.prune_to_paths(stored, current).withColumnRenamed("path", "p_partkey")


@register(
    """SELECT doc_id, CAST(line AS BIGINT) AS line, t AS text, array_to_string(ls[greatest(line - 5, 1):line + 5], chr(10)) AS context FROM (
      SELECT doc_id, ls, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
    WHERE regexp_matches(substr(t, instr(t, 'License') - 1, 9), '^[^A-Za-z0-9_]License([^A-Za-z0-9_]|$)') AND instr(t, 'License') > 1 OR regexp_matches(t, '^License([^A-Za-z0-9_]|$)')"""
)
def symbol_context(d: Derived) -> DataFrame:
    files = d.read("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return _longs(snippets.symbol_context(files, "License").select(F.col("path").alias("doc_id"), "line", "text", F.array_join("context", "\n").alias("context")), "line")


@register(
    oracle(
        f"""SELECT substr(name, 1, instr(name, '/') - 1) AS grp, count(*) AS module_count, CAST(sum(file_count) AS BIGINT) AS file_count, CAST(sum(importance) AS DOUBLE) AS importance
        FROM ({_IMPORTANCE}) JOIN modules USING (name) GROUP BY ALL""",
        "fans", "scored", "modules",
    )
)
def treemap(d: Derived) -> DataFrame:
    tree = diagrams.treemap(metrics.module_metrics(d.edges, d.modules, d.definitions, ("importance",)), d.files)
    total = F.aggregate("modules", F.lit(0.0), lambda a, m: a + m["importance"])
    return tree.select(F.col("group").alias("grp"), "module_count", "file_count", total.alias("importance"))


@register(
    oracle(
        """SELECT split_part(e.src, '/', 1) AS src, split_part(e.dst, '/', 1) AS dst, count(*) AS edge_count, bool_or(b.from_module IS NOT NULL) AS violated
        FROM inner_edges e LEFT JOIN bad b ON e.src = b.from_module AND e.dst = b.to_module WHERE split_part(e.src, '/', 1) <> split_part(e.dst, '/', 1) GROUP BY ALL""",
        "inner_edges", more=_LAYER_OF + ", " + _BAD,
    )
)
def c4_clusters(d: Derived) -> DataFrame:
    return diagrams.cluster_edges(d.edges, d.modules, _violations(d)[1])


@register(
    oracle(
        """SELECT src, dst, coalesce(n, 0) AS import_count, coalesce(r, 0) AS reference_count, coalesce(symbols, '') AS symbols FROM
          (SELECT module AS src, target AS dst, count(*) AS n FROM file_imports WHERE target IN (SELECT name FROM modules) AND module <> target GROUP BY ALL)
          FULL JOIN (SELECT src, dst, count(*) AS r, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM used GROUP BY ALL) USING (src, dst)""",
        "file_imports", "best", "modules", "refs",
        more="""known AS (SELECT i.*, CASE WHEN f.language = 'python' THEN split_part(target, '.', -1) ELSE split_part(target, '/', -1) END AS base
            FROM file_imports i JOIN files f USING (path) WHERE target IN (SELECT name FROM modules)),
          heads AS (SELECT path, base AS head, arg_min(target, seq) AS dst FROM known GROUP BY path, base UNION SELECT path, item, target FROM known WHERE item IS NOT NULL),
          used AS (SELECT r.module AS src, h.dst, split_part(r.name, '.', -1) AS symbol FROM refs r JOIN heads h ON h.path = r.path AND h.head = split_part(r.name, '.', 1)
            WHERE r.module <> h.dst AND EXISTS (SELECT 1 FROM best b WHERE b.module = h.dst AND b.name = split_part(r.name, '.', -1)))""",
    )
)
def component_edges(d: Derived) -> DataFrame:
    found = diagrams.component_edges(_file_imports(d), d.references, d.definitions, d.files, d.modules)
    return _longs(found.withColumn("symbols", F.array_join("symbols", ",")), "import_count", "reference_count")


@register(
    oracle(
        "SELECT src, dst, symbol FROM hops WHERE src IN (SELECT node FROM reached WHERE d < 5)",
        "definitions", "refs",
        more="""owner AS (SELECT name, arg_max(module, (path, seq)) AS dst FROM definitions WHERE exported GROUP BY name),
          hops AS (SELECT DISTINCT r.module AS src, o.dst, o.name AS symbol FROM refs r JOIN owner o ON o.name = split_part(r.name, '.', -1) WHERE r.module <> o.dst),
          reached(node, d) AS (SELECT min(module), 0 FROM files UNION SELECT h.dst, r.d + 1 FROM reached r JOIN hops h ON h.src = r.node WHERE r.d < 4)""",
    )
)
def call_sequence(d: Derived) -> DataFrame:
    entry = d.files.agg(F.min("module")).first()[0]
    return diagrams.call_sequence(d.references, d.definitions, entry)


# Sources.


@register(
    """SELECT page_id, name, count(*) AS uses FROM (SELECT page_id, unnest(string_split(c, ' ')) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM pages))
    WHERE name <> '' GROUP BY page_id, name"""
)
def html_refs(d: Derived) -> DataFrame:
    classes = d.read("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1))).alias("c"))
    tokens = classes.select("page_id", F.explode(F.split("c", " ")).alias("name")).filter("name <> ''")
    return tokens.groupBy("page_id", "name").agg(F.count("*").alias("uses"))


@register(
    oracle(
        """SELECT path, CASE WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.py') THEN 'python' ELSE '' END AS detected,
        lower(regexp_replace(split_part(path, '/', -1), '\\.(js|ts)$', '')) AS leaf FROM files""",
        "files",
    )
)
def languages_of_files(d: Derived) -> DataFrame:
    from graphloom.sources import languages, naming

    path = F.col("path")
    return d.files.select("path", languages.language_of(path, languages.registry()).alias("detected"), F.lower(naming.script_module(path)).alias("leaf"))
