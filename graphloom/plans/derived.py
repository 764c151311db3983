"""The model tables derived from order data, by SQL that Spark and DuckDB both run.

Parts are modules (those of size up to 40; others are external), brands are layers, consecutive lines of large
orders are imports, and events are snapshots.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.stdlib import stdlib_names

NAME = "lower({p}.p_brand) || '/' || CAST({p}.p_partkey AS STRING)"


def _name(p: str) -> str:
    return NAME.replace("{p}", p)


FILES = f"""
SELECT {_name("p")} || '/f' || CAST(k AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '.go' WHEN 1 THEN '.py' ELSE '.js' END AS path,
       CASE p_partkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'javascript' END AS language,
       {_name("p")} AS module, p_partkey, p_size, p_name, k
FROM {{part}} p JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) s ON k <= p_size % 3
WHERE p_size <= 40"""
IMPORTS = f"""
SELECT DISTINCT {_name("pa")} AS module, {_name("pb")} AS target, 'order/' || CAST(a.l_orderkey AS STRING) AS path,
       CAST(a.l_linenumber AS INT) AS line
FROM {{lineitem}} a
JOIN {{lineitem}} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
JOIN {{part}} pa ON a.l_partkey = pa.p_partkey AND pa.p_size <= 40
JOIN {{part}} pb ON b.l_partkey = pb.p_partkey
WHERE a.l_quantity >= 48"""
DEFINITIONS = """
SELECT path, module, k AS seq, 'Fn' || CAST((p_partkey + k) % 7 AS STRING) AS name,
       'pkg.Fn' || CAST((p_partkey + k) % 7 AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN 'Server' ELSE '' END AS full_name,
       CAST((p_partkey + k) % 3 AS INT) AS kind, (p_partkey + k) % 2 = 0 AS exported,
       CAST(p_size % 5 AS INT) AS branches, CAST(length(p_name) % 6 AS INT) AS params, CAST(p_size % 4 AS INT) AS nesting,
       CAST(CASE WHEN k = 2 THEN 0 ELSE p_size END AS INT) AS loc,
       CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size + k END AS INT) AS complexity_score
FROM {files}"""
REFERENCES = """
SELECT path, module, language, k AS seq, CASE k WHEN 0 THEN 'Fn' || CAST(p_partkey % 11 AS STRING)
         WHEN 1 THEN split_part(p_name, ' ', 1) || '.Fn' || CAST(p_partkey % 7 AS STRING) ELSE split_part(p_name, ' ', 2) || '.Other' END AS name,
       CASE p_partkey % 4 WHEN 0 THEN 'service_bridge' WHEN 1 THEN 'REF_CALL|file->call' WHEN 2 THEN '' ELSE 'ffi_bridge' END AS context,
       CAST(k + 1 AS INT) AS line
FROM {files}"""
SNAPSHOTS = """
SELECT event_type AS project_key, date_trunc('hour', ts) AS ts, 'c' AS commit_hash,
       CAST(count(*) AS INT) AS module_count, CAST(count(DISTINCT user_id) AS INT) AS file_count,
       CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS INT) AS cycle_count, CAST(sum(CASE WHEN value <= 10 THEN 1 ELSE 0 END) AS INT) AS unresolved_count
FROM {events} GROUP BY event_type, date_trunc('hour', ts)"""


class Derived:
    """The derived tables over one directory, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        return self.spark.sql(FILES, part=self.read("part"))

    @cached_property
    def imports(self) -> DataFrame:
        return self.spark.sql(IMPORTS, part=self.read("part"), lineitem=self.read("lineitem")).selectExpr("*", "line AS seq", "0 AS col")

    @cached_property
    def definitions(self) -> DataFrame:
        return self.spark.sql(DEFINITIONS, files=self.files).selectExpr(
            "*", "'' AS visibility", "'' AS scope", "'' AS signature", "'' AS type_hint", "cast(array() AS array<string>) AS decorators", "seq + 1 AS line", "0 AS col"
        )

    @cached_property
    def references(self) -> DataFrame:
        return self.spark.sql(REFERENCES, files=self.files).selectExpr("*", "0 AS col")

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.spark.sql(SNAPSHOTS, events=self.read("events"))

    @cached_property
    def modules(self) -> DataFrame:
        from graphloom.operators.model import modules

        return modules(self.files)

    @cached_property
    def edges(self) -> DataFrame:
        from graphloom.operators.model import edges

        return edges(self.imports)


#: The same tables as common table expressions of DuckDB, and some views over them.
CTES = {
    "files": FILES.format(part="part"),
    "imports": IMPORTS.format(part="part", lineitem="lineitem"),
    "definitions": DEFINITIONS.format(files="files"),
    "refs": REFERENCES.format(files="files"),
    "snapshots": SNAPSHOTS.format(events="events"),
    "modules": "SELECT module AS name, count(*) AS file_count, min(path) AS sample_path FROM files GROUP BY module",
    "edges": "SELECT src, dst, e.p AS path, e.l AS line FROM (SELECT module AS src, target AS dst, max(struct_pack(p := path, l := line)) AS e FROM imports GROUP BY ALL)",
    "inner_edges": "SELECT e.* FROM edges e WHERE e.dst IN (SELECT name FROM modules)",
    "scored": """SELECT *, CASE WHEN complexity_score = 0 THEN branches * 2 + nesting * 2 + params + loc // 10 ELSE complexity_score END AS score FROM definitions""",
    "best": """SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY module, name ORDER BY score DESC, loc DESC, branches DESC, params DESC, nesting DESC, path, seq) = 1""",
    "exports": "SELECT DISTINCT module, name FROM definitions WHERE exported",
    "fans": """SELECT m.name, (SELECT count(*) FROM inner_edges WHERE dst = m.name) AS fan_in, (SELECT count(*) FROM inner_edges WHERE src = m.name) AS fan_out FROM modules m""",
    "summaries": """SELECT m.name, m.file_count, (SELECT count(*) FROM exports x WHERE x.module = m.name) AS export_count,
      (SELECT count(*) FROM edges WHERE src = m.name) AS dependency_count, (SELECT count(*) FROM edges WHERE dst = m.name) AS reverse_dependency_count FROM modules m""",
    "reach(a, b)": "SELECT src, dst FROM inner_edges UNION SELECT r.a, e.dst FROM reach r JOIN inner_edges e ON r.b = e.src",
    "comps": """SELECT m.name AS node, coalesce(least(min(r.b), m.name), m.name) AS component, greatest(count(r.b), 1) AS size FROM modules m
      LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = m.name GROUP BY m.name""",
    "links": "SELECT DISTINCT a.component AS x, b.component AS y FROM inner_edges e JOIN comps a ON e.src = a.node JOIN comps b ON e.dst = b.node WHERE a.component <> b.component",
    "long_ways(c, d)": "SELECT DISTINCT component, 0 FROM comps UNION SELECT l.x, w.d + 1 FROM long_ways w JOIN links l ON l.y = w.c",
    "file_imports": """SELECT f.path, e.src AS module, e.line AS seq, e.dst AS target, CAST(split_part(e.dst, '/', 2) AS INT) AS t,
      CASE WHEN CAST(split_part(e.dst, '/', 2) AS INT) % 2 = 1 THEN 'Fn' || (CAST(split_part(e.dst, '/', 2) AS INT) % 7) END AS item FROM edges e JOIN files f ON f.module = e.src AND f.k = 0""",
    "symbols": """SELECT b.name, b.full_name, b.module, f.language, b.exported, lower(b.name) AS cname, lower(replace(b.full_name, '.', '')) AS cfull,
      contains(lower(b.full_name), 'server') AS service FROM best b JOIN files f USING (path)""",
    "keys": """SELECT 'name' AS way, cname AS key, * FROM symbols UNION ALL SELECT 'name', cfull, * FROM symbols WHERE cfull <> cname UNION ALL SELECT 'service', cname, * FROM symbols WHERE service""",
    "asked": """SELECT path, seq, name, language, module, context, lower(replace(name, '.', '')) AS own, lower(split_part(name, '.', -1)) AS leaf,
      context IN ('service_bridge', 'ffi_bridge') AS bridge FROM refs""",
    "hits": """SELECT a.path, a.seq, a.context, k.way, t.tier, k.module AS smodule, k.language AS slanguage, k.name AS sname, k.full_name AS sfull, a.language,
      8 * (own = cname)::INT + 6 * (leaf = cname)::INT + 6 * (own = cfull)::INT + 4 * (leaf = cfull)::INT + 5 * (a.module = k.module)::INT + 2 * (a.language = k.language)::INT + k.exported::INT
      + 5 * (a.context = 'service_bridge' AND k.service)::INT + (a.context = 'ffi_bridge' AND NOT k.service)::INT + 2 * (a.bridge AND a.language <> k.language)::INT AS score
      FROM asked a, (VALUES ('name', 0), ('name', 1), ('service', 0), ('service', 1)) t(way, tier), keys k
      WHERE k.way = t.way AND k.key = CASE t.tier WHEN 0 THEN a.own ELSE a.leaf END AND NOT (t.tier = 1 AND a.own = a.leaf) AND (t.way = 'name' OR a.context = 'service_bridge')
      QUALIFY t.tier = min(t.tier) OVER (PARTITION BY a.path, a.seq, k.way)""",
    "guesses": """SELECT path, seq, max(score) AS best, coalesce(list_sort(list(score), 'DESC')[2], 0) AS second, any_value(context) AS context,
      count(DISTINCT (slanguage, smodule, sfull, sname)) FILTER (slanguage <> language) AS abroad FROM hits GROUP BY path, seq""",
    "lib": " UNION ALL ".join(f"SELECT '{k}' AS language, unnest({sorted(v)}) AS name" for k, v in stdlib_names().items() if k in ("go", "python", "javascript")),
    "assessed": """SELECT *, CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN answered OR score >= 8 THEN 'resolved' WHEN score >= 5 THEN 'probable' ELSE 'unresolved' END AS status
      FROM (SELECT a.path, a.seq, a.name, a.context, CASE WHEN bridge THEN 5 ELSE 0 END + CASE WHEN g.abroad = 1 THEN 2 WHEN g.abroad > 1 THEN -2 ELSE 0 END
          - CASE WHEN EXISTS (SELECT 1 FROM lib l WHERE l.language = a.language AND l.name = split_part(a.name, '.', 1)) THEN 3 ELSE 0 END AS score,
        array_to_string(list_filter([CASE WHEN bridge THEN 'bridge_context' END, CASE WHEN bridge THEN 'bridge_prefix_heuristic' END, CASE WHEN g.abroad = 1 THEN 'unique_cross_language_candidate' END,
          CASE WHEN g.abroad > 1 THEN 'ambiguous_cross_language_candidates' END,
          CASE WHEN EXISTS (SELECT 1 FROM lib l WHERE l.language = a.language AND l.name = split_part(a.name, '.', 1)) THEN 'stdlib_conflict' END], lambda x: x IS NOT NULL), ',') AS reasons,
        EXISTS (SELECT 1 FROM lib l WHERE l.language = a.language AND l.name IN (a.name, split_part(a.name, '.', 1)))
        OR EXISTS (SELECT 1 FROM definitions d WHERE d.module = a.module AND d.name = a.name)
        OR EXISTS (SELECT 1 FROM file_imports i WHERE i.path = a.path AND i.item = a.name AND (i.target NOT IN (SELECT module FROM files)
          OR EXISTS (SELECT 1 FROM definitions d WHERE d.module = i.target AND d.name = i.item AND d.exported)))
        OR coalesce(g.best >= CASE g.context WHEN 'service_bridge' THEN 6 WHEN 'ffi_bridge' THEN 7 ELSE 8 END AND g.best - g.second >= 2, false) AS answered
      FROM asked a LEFT JOIN guesses g USING (path, seq))""",
    "depths": "SELECT node AS name, max(d) AS depth FROM comps JOIN long_ways ON component = c GROUP BY node",
}
NEEDS = {
    "definitions": ["files"], "refs": ["files"], "modules": ["files"], "edges": ["imports"], "inner_edges": ["edges", "modules"], "scored": ["definitions"], "best": ["scored"],
    "exports": ["definitions"], "fans": ["inner_edges"], "summaries": ["edges", "modules", "exports"], "reach(a, b)": ["inner_edges"], "comps": ["reach(a, b)"],
    "file_imports": ["edges", "files"], "symbols": ["best", "files"], "keys": ["symbols"], "asked": ["refs"], "hits": ["asked", "keys"], "guesses": ["hits"],
    "assessed": ["guesses", "definitions", "file_imports", "lib"], "links": ["comps"], "long_ways(c, d)": ["links"], "depths": ["long_ways(c, d)"],
}


def oracle(query: str, *tables: str, more: str = "") -> str:
    """A DuckDB query over the named expressions and those that they need; more has further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + (f", {more} " if more else " ") + query
