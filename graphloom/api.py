"""The analysis service over one project's tables, and its operations by name.

An operation gets a dictionary of parameters and gives a dictionary that JSON can hold; limits are checked and
clamped before any plan runs.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import diagrams, graph, history, metrics, model, query, resolve, rules, secrets, symbols
from graphloom.schemas import DEFINITIONS, FILES, IMPORTS, REFERENCES, SNAPSHOTS
from graphloom.session import cut
from graphloom.sinks import diagrams as draw
from graphloom.sinks import outputs, reports
from graphloom.sources import config as settings
from graphloom.sources import extract, naming, scan
from graphloom.sources.languages import Language, registry

MAX_ITEMS, MAX_LIMIT, MAX_DEPTH, MAX_FILTER, MAX_PATHS = 500, 5_000, 100, 200, 64
VERSION = 1


class OperationError(Exception):
    """An error with a code: invalid_argument, not_found, unavailable or forbidden."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Project:
    """The tables of one project; results are DataFrames that are planned when they are asked for."""

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    config: settings.Config = field(default_factory=settings.Config)
    name: str = settings.DEFAULT_PROJECT
    targets: outputs.Targets = field(default_factory=outputs.Targets)
    #: Starts the background watch; what it gives has isActive and stop(), as streaming queries do.
    watcher: Callable[[], Any] | None = None
    watching: Any = None
    lock: Any = field(default_factory=threading.Lock, repr=False)

    @classmethod
    def scanned(cls, spark: SparkSession, roots: list[str], config: settings.Config | None = None, languages: Mapping[str, Language] | None = None) -> Project:
        """Scan roots: read, filter, name modules, extract."""
        config = config or settings.Config()
        return cls(spark, cls._scan(spark, roots, roots, config, languages or registry()), config)

    @staticmethod
    def _scan(
        spark: SparkSession, paths: Sequence[str], roots: Sequence[str], config: settings.Config, languages: Mapping[str, Language], known: Mapping[str, DataFrame] | None = None
    ) -> dict[str, DataFrame]:
        """The tables after a scan of paths; of ``known`` what lies elsewhere stays. Names of modules follow from all files."""
        raw = scan.read_files(spark, list(paths))
        # Not cached: a plan that is equal to an earlier scan's would get that one's files.
        sources = cut(scan.source_files(raw, languages, config.exclude_dirs, config.exclude_files))
        gomods = raw.filter(F.substring_index("path", "/", -1) == "go.mod").select("path", F.decode("content", "UTF-8").alias("content"))
        new = {"sources": sources, "rows": extract.extract(sources), "gomods": gomods}
        if known:
            inside = [F.col("path").startswith(p.rstrip("/") + "/") | (F.col("path") == p) for p in scan.scan_roots(paths)]
            other = ~reduce(lambda a, b: a | b, inside)
            new = {k: known[k].filter(other).unionByName(v) for k, v in new.items()}
        # Results join these tables many times over, so their plans end here.
        new = {k: cut(v) for k, v in new.items()}
        named = naming.with_modules(new["sources"].select("path", "language"), new["gomods"], roots[0].rstrip("/") if len(roots) == 1 else "")
        return {k: cut(v) for k, v in extract.tables(new["rows"], cut(named)).items()} | new

    def scan(self, paths: Sequence[str] = (), languages: Mapping[str, Language] | None = None) -> dict:
        """Scan again: all roots, and files that are gone go; or some paths, whose files replace what is known of them.

        One scan runs at a time; a second one is an error.
        """
        if paths and "rows" not in self.tables:
            raise OperationError("unavailable", "paths can be scanned once the roots have been")
        if not self.lock.acquire(blocking=False):
            raise OperationError("unavailable", "a scan is running")
        try:
            began = time.monotonic()
            roots = self.config.roots
            new = self._scan(self.spark, list(paths) or roots, roots, self.config, languages or registry(), self.tables if paths else None)
            self.tables = {**self.tables, **new}
            self.forget()
            return {"files": self.files.count(), "modules": self.modules.count(), "seconds": round(time.monotonic() - began, 3)}
        finally:
            self.lock.release()

    def forget(self) -> None:
        """Results that were planned over the tables as they were."""
        for name in [k for k in self.__dict__ if isinstance(getattr(type(self), k, None), cached_property)]:
            del self.__dict__[name]

    def health(self) -> dict:
        """up, or degraded if tables are missing; and the state of each part."""
        parts = {"graph": f"ok ({self.files.count()} files, {self.modules.count()} modules)" if "files" in self.tables else "missing"}
        parts["sources"] = "ok" if "sources" in self.tables else "missing"
        parts["watch"] = "ok" if self.watching is not None and self.watching.isActive else "off"
        return {"status": "degraded" if "missing" in parts.values() else "up", "components": parts}

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], schema)

    @cached_property
    def files(self) -> DataFrame:
        files = self._table("files", FILES)
        return model.latest_files(files) if "ingest_seq" in files.columns else files

    @cached_property
    def imports(self) -> DataFrame:
        return model.of_files(self._table("imports", IMPORTS), self.files)

    @cached_property
    def definitions(self) -> DataFrame:
        return model.of_files(self._table("definitions", DEFINITIONS), self.files)

    @cached_property
    def references(self) -> DataFrame:
        return model.of_files(self._table("references", REFERENCES), self.files)

    @cached_property
    def snapshots(self) -> DataFrame:
        return self._table("snapshots", SNAPSHOTS).filter(F.col("project_key") == self.name)

    @cached_property
    def modules(self) -> DataFrame:
        return model.modules(self.files)

    @cached_property
    def edges(self) -> DataFrame:
        return model.edges(self.imports)

    @cached_property
    def summaries(self) -> DataFrame:
        return query.module_summaries(self.modules, self.edges, self.definitions.filter("exported"))

    @cached_property
    def symbols(self) -> DataFrame:
        return symbols.symbol_table(self.definitions, self.files)

    @cached_property
    def options(self) -> resolve.Options:
        found = [b for p in settings.bridge_files(self.config.roots) for b in settings.load_bridges(p)]
        return resolve.Options(tuple(self.config.excluded_symbols), tuple(self.config.excluded_imports), tuple(found))

    @cached_property
    def assessed(self) -> DataFrame:
        return resolve.assess(self.references, self.files, self.imports, self.definitions, self.symbols, self.options)

    def unresolved(self) -> DataFrame:
        return resolve.unresolved(self.assessed)

    def probable_bridges(self) -> DataFrame:
        return resolve.probable_bridges(self.assessed)

    def unused_imports(self) -> DataFrame:
        return resolve.unused_imports(self.imports, self.references, self.files, self.options)

    def cycles(self) -> DataFrame:
        return graph.detect_cycles(model.internal_edges(self.edges, self.modules))

    def metrics(self) -> DataFrame:
        return metrics.module_metrics(self.edges, self.modules, self.definitions)

    def hotspots(self, n: int | None = None) -> DataFrame:
        return metrics.top_complexity(self.definitions, self.config.top_complexity if n is None else n)

    def secrets(self) -> DataFrame:
        if "sources" not in self.tables:
            raise OperationError("unavailable", "secrets need the files' contents")
        found = secrets.Settings(self.config.entropy_threshold, self.config.min_token_length)
        return secrets.detect(self.tables["sources"], found)

    def violations(self) -> tuple[DataFrame, DataFrame]:
        """Layer violations and package rule violations."""
        layers, layer_rules, packages = settings.rule_tables(self.spark, self.config)
        assigned = rules.layer_assignment(self.modules, layers)
        return rules.layer_violations(self.edges, self.modules, assigned, layer_rules), rules.package_violations(self.files, self.edges, self.modules, packages)

    def cql(self, text: str, limit: int = 0) -> DataFrame:
        return query.run_cql(text, self.modules, self.edges, self.definitions.filter("exported"), limit)

    def impact(self, target: str) -> DataFrame:
        """The impact of a module, or of the module of a file; LookupError if there is none."""
        row = self.files.filter((F.col("path") == target) | (F.col("module") == target)).select("module").first()
        if row is None:
            raise LookupError(f"no file or module {target!r}")
        return graph.impact(self.edges, self.definitions, row["module"])

    def trend(self, window: str = "") -> DataFrame:
        return history.trend_report(self.snapshots, settings.parse_window(window))

    def results(self) -> dict[str, DataFrame]:
        layer, package = self.violations()
        out = {"cycles": self.cycles(), "violations": layer, "rule_violations": package, "hotspots": self.hotspots(), "bridges": self.probable_bridges()}
        out |= {"unresolved": self.unresolved(), "unused": self.unused_imports()}
        return out | ({"secrets": self.secrets()} if "sources" in self.tables else {})

    def diagram(self, mode: str = "dependency") -> draw.Diagram:
        if mode == "flow":
            entry = graph.entry_modules(self.files, self.edges, self.modules, [])
            return draw.flow(*graph.flow(self.edges, self.modules, entry, self.config.flow_depth))
        if mode == "component":
            found = diagrams.component_edges(self.imports, self.references, self.definitions, self.files, self.modules)
            return draw.components(found, diagrams.definition_preview(self.definitions))
        layers, layer_rules, _ = settings.rule_tables(self.spark, self.config)
        assigned = rules.layer_assignment(self.modules, layers)
        bad = rules.layer_violations(self.edges, self.modules, assigned, layer_rules)
        if mode == "architecture":
            return draw.layered(rules.layer_dependencies(self.edges, self.modules, assigned, bad))
        return draw.dependency(self.modules, self.edges, graph.cycle_edges(self.cycles()), bad, assigned)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _limit(params: Mapping[str, Any], most: int = MAX_ITEMS) -> int:
    value = int(params.get("limit") or 0)
    if value < 0 or value > MAX_LIMIT:
        raise OperationError("invalid_argument", f"limit must be within 0 and {MAX_LIMIT}")
    return query.clamp_limit(value, most)


def _limited(df: DataFrame, limit: int, name: str) -> dict:
    return {name: _rows(df.limit(limit)), "total": df.count()}


def _cycles(p: Project, params: Mapping[str, Any]) -> dict:
    found = p.cycles().orderBy("cycle_id")
    return {"cycles": [list(r["cycle"]) for r in found.limit(_limit(params)).collect()], "total": found.count()}


def _modules(p: Project, params: Mapping[str, Any]) -> dict:
    text = str(params.get("filter") or "")
    if len(text) > MAX_FILTER:
        raise OperationError("invalid_argument", f"filter is longer than {MAX_FILTER}")
    return {"modules": _rows(query.list_modules(p.summaries, text, _limit(params)))}


def _details(p: Project, params: Mapping[str, Any]) -> dict:
    found = _rows(query.module_details(params["module"], p.files, p.edges, p.definitions, _limit(params)))
    if not found:
        raise OperationError("not_found", f"no module {params['module']!r}")
    return found[0]


def _trace(p: Project, params: Mapping[str, Any]) -> dict:
    depth = int(params.get("max_depth") or 0)
    if depth < 0 or depth > MAX_DEPTH:
        raise OperationError("invalid_argument", f"max_depth must be within 0 and {MAX_DEPTH}")
    try:
        found = query.dependency_trace(p.edges, p.modules, params["from_module"], params["to_module"], depth)
    except LookupError as e:
        raise OperationError("not_found", str(e)) from e
    return {"path": found.path, "depth": found.depth}


def _trends(p: Project, params: Mapping[str, Any]) -> dict:
    rows = query.trend_slice(p.snapshots, settings.parse_since(str(params.get("since") or "")), _limit(params))
    return {"snapshots": _rows(rows.select(F.col("ts").cast("string").alias("ts"), "module_count", "file_count"))}


def _diagrams(p: Project, params: Mapping[str, Any]) -> dict:
    if params.get("write"):
        return {"written": outputs.write_outputs(p, p.targets, params.get("formats"))}
    wanted = [str(f).strip().lower() for f in params.get("formats") or draw.WRITERS]
    if bad := [f for f in wanted if f not in draw.WRITERS]:
        raise OperationError("invalid_argument", f"unknown format {bad[0]!r}")
    diagram = p.diagram(str(params.get("mode") or "dependency"))
    return {"texts": {f: draw.WRITERS[f](diagram) for f in wanted}}


def _report(p: Project, params: Mapping[str, Any]) -> dict:
    text = reports.markdown({k: cut(v) for k, v in p.results().items()}, project=p.name, verbosity=str(params.get("verbosity") or "standard"))
    return {"markdown": text} | ({"written": outputs.write_text(p.targets.output(str(params["path"])), text)} if params.get("path") else {})


def _select(p: Project, params: Mapping[str, Any]) -> dict:
    try:
        p.name = settings.active_project(p.config.projects, str(params["name"]))
    except LookupError as e:
        raise OperationError("not_found", str(e)) from e
    p.forget()
    return {"project": p.name}


def _watch(p: Project, params: Mapping[str, Any]) -> dict:
    """The watch is started once; asking again while it runs changes nothing."""
    if p.watcher is None:
        raise OperationError("unavailable", "the project has nothing to watch")
    running = p.watching is not None and p.watching.isActive
    if not running:
        p.watching = p.watcher()
    return {"status": "already_watching" if running else "watching"}


def _secrets(p: Project, params: Mapping[str, Any]) -> dict:
    return _limited(secrets.masked(p.secrets()), _limit(params), "findings")


OPERATIONS: dict[str, Callable[[Project, Mapping[str, Any]], dict]] = {
    "scan.run": lambda p, params: p.scan([str(x) for x in params.get("paths") or ()]) if params.get("paths") or params.get("again") else {"files": p.files.count(), "modules": p.modules.count()},
    "secrets.scan": _secrets,
    "secrets.list": _secrets,
    "graph.cycles": _cycles,
    "graph.sync_diagrams": _diagrams,
    "query.modules": _modules,
    "query.module_details": _details,
    "query.trace": _trace,
    "query.trends": _trends,
    "query.cql": lambda p, params: {"modules": _rows(p.cql(params["query"], _limit(params)))},
    "report.generate_markdown": _report,
    "system.select_project": _select,
    "system.watch": _watch,
    "system.health": lambda p, _: p.health(),
}
#: Operations that change something outside their answer, with the parameter that makes them do so, if it takes one.
MUTATIONS = {"graph.sync_diagrams": "write", "report.generate_markdown": "path", "system.select_project": "", "system.watch": ""}
ALIASES = {"system.sync_outputs": "graph.sync_diagrams", "modules": "query.modules", "cycles": "graph.cycles", "trace": "query.trace"}


def call(project: Project, operation: str, params: Mapping[str, Any] | None = None, allowed: set[str] | None = None, mutations: bool = False) -> dict:
    """{version, operation, result} of an operation; OperationError for one that isn't there or allowed, or wrong parameters.

    Files are written, the project is switched and the watch is started only with mutations.
    """
    name = ALIASES.get(operation.strip().lower(), operation.strip().lower())
    if name not in OPERATIONS or (allowed is not None and name not in allowed):
        raise OperationError("invalid_argument", f"no operation {operation!r}")
    params = params or {}
    if not mutations and name in MUTATIONS and (not MUTATIONS[name] or params.get(MUTATIONS[name])):
        raise OperationError("forbidden", f"{name} isn't allowed to change anything")
    if len(params.get("paths") or ()) > MAX_PATHS:
        raise OperationError("invalid_argument", f"{MAX_PATHS} paths at most")
    try:
        result = OPERATIONS[name](project, params)
    except KeyError as e:
        raise OperationError("invalid_argument", f"parameter {e} is missing") from e
    except ValueError as e:
        raise OperationError("invalid_argument", str(e)) from e
    return {"version": VERSION, "operation": name, "result": result}
