"""Configuration: TOML files, environment overrides, projects, bridges, rules and their checks."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.globs import has_wildcard, normalize_path
from graphloom.operators.resolve import Bridge, parse_endpoint
from graphloom.schemas import LAYER_RULES, LAYERS, PACKAGE_RULES

ENV_PREFIX = "GRAPHLOOM_"
DEFAULT_PROJECT = "default"


@dataclass
class Config:
    roots: list[str] = field(default_factory=lambda: ["."])
    exclude_dirs: list[str] = field(default_factory=list)
    exclude_files: list[str] = field(default_factory=list)
    excluded_symbols: list[str] = field(default_factory=list)
    excluded_imports: list[str] = field(default_factory=list)
    entropy_threshold: float = 4.0
    min_token_length: int = 20
    layers: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    projects: list[dict] = field(default_factory=list)
    top_complexity: int = 5
    max_items: int = 500
    flow_depth: int = 8


def load(path: str, environ: Mapping[str, str] = os.environ) -> Config:
    """A TOML file's settings over the defaults, and those of the environment over both."""
    with open(path, "rb") as f:
        return apply_env(Config(**tomllib.load(f)), environ)


def apply_env(config: Config, environ: Mapping[str, str] = os.environ) -> Config:
    """Settings from GRAPHLOOM_<NAME>; lists are separated by commas."""
    for name, value in list(vars(config).items()):
        text = environ.get(ENV_PREFIX + name.upper())
        if text is None or name in ("layers", "rules", "projects"):
            continue
        setattr(config, name, [x.strip() for x in text.split(",") if x.strip()] if isinstance(value, list) else type(value)(text))
    return config


def load_bridges(path: str) -> list[Bridge]:
    """Declared bridges: tables ``bridges`` with from, to, reason and references; without references the target's last name with ``.*``."""
    with open(path, "rb") as f:
        entries = tomllib.load(f).get("bridges", [])
    out = []
    for e in entries:
        (from_lang, from_module), (to_lang, to_module) = parse_endpoint(e["from"]), parse_endpoint(e["to"])
        inferred = to_module.replace("::", "/").replace(".", "/").rstrip("/*").rsplit("/", 1)[-1]
        refs = tuple(dict.fromkeys(r.strip() for r in e.get("references", []) if r.strip())) or ((f"{inferred}.*",) if inferred else ())
        out.append(Bridge(from_lang, from_module, to_lang, to_module, e.get("reason", ""), refs))
    return out


def bridge_files(roots: Sequence[str], name: str = ".graphloom-bridge.toml") -> list[str]:
    """Bridge files of the roots and of the working directory, each once."""
    found = [str((Path(r) / name).resolve()) for r in (*roots, ".") if (Path(r) / name).is_file()]
    return list(dict.fromkeys(found))


def active_project(projects: Sequence[Mapping], name: str = "", cwd: str = ".") -> str:
    """The project with that name, else the one whose root is nearest above cwd, else the default one."""
    if name:
        if all(p["name"] != name for p in projects):
            raise LookupError(f"no project {name!r}")
        return name
    here = str(Path(cwd).resolve())
    above = [p for p in projects if here == str(Path(p["root"]).resolve()) or here.startswith(str(Path(p["root"]).resolve()) + "/")]
    return max(above, key=lambda p: len(str(Path(p["root"]).resolve())))["name"] if above else DEFAULT_PROJECT


def overlapping(a: str, b: str) -> bool:
    """Whether two layer patterns can fit one path: literals by prefix, wildcards by their literal beginnings."""
    x, y = normalize_path(a), normalize_path(b)
    if has_wildcard(x) or has_wildcard(y):
        x, y = (p[: min((p.index(c) for c in "*?[{" if c in p), default=len(p))].rstrip("/") for p in (x, y))
    return x == y or x.startswith(y + "/") or y.startswith(x + "/") or not x or not y


def check(config: Config) -> None:
    """ValueError for thresholds out of range, layers without name or pattern or that overlap, and rules that contradict."""
    if config.entropy_threshold < 0 or config.entropy_threshold > 8 or config.min_token_length < 0:
        raise ValueError("entropy_threshold must be within 0 and 8, min_token_length 0 or more")
    names: set[str] = set()
    patterns: list[tuple[str, str]] = []
    for layer in config.layers:
        name = layer.get("name", "").strip()
        if not name or name in names or not layer.get("paths"):
            raise ValueError(f"layer {name!r} needs a name of its own and paths")
        for p in layer["paths"]:
            for other, q in patterns:
                if other != name and overlapping(p, q):
                    raise ValueError(f"layers {other!r} and {name!r} overlap: {q}, {p}")
            patterns.append((name, p))
        names.add(name)
    seen: set[str] = set()
    for rule in config.rules:
        if rule_kind(rule) != "layer":
            continue
        if rule.get("from") not in names or rule["from"] in seen:
            raise ValueError(f"rule {rule.get('name')!r} needs a layer of its own")
        if not rule.get("allow") or any(a not in names for a in rule["allow"]):
            raise ValueError(f"rule {rule.get('name')!r} must allow known layers")
        seen.add(rule["from"])


def rule_kind(rule: Mapping) -> str:
    """A rule with modules is about packages, else about layers, unless it says what it is."""
    return rule.get("kind") or ("package" if rule.get("modules") else "layer")


def rule_tables(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of layers, layer rules and package rules; rules are ordered by name, then by their number of modules."""
    layers = [(x["name"], i, p) for i, x in enumerate(config.layers) for p in x["paths"]]
    ordered = sorted(config.rules, key=lambda r: (r.get("name", ""), len(r.get("modules", []))))
    layer_rules = [(r.get("name", ""), r["from"], list(r["allow"])) for r in ordered if rule_kind(r) == "layer"]
    packages = [
        (r["name"], list(r["modules"]), int(r.get("max_files", 0)), list(r.get("allow", [])), list(r.get("deny", [])), bool(r.get("exclude_tests")), list(r.get("exclude_files", [])))
        for r in ordered
        if rule_kind(r) == "package"
    ]
    return spark.createDataFrame(layers, LAYERS), spark.createDataFrame(layer_rules, LAYER_RULES), spark.createDataFrame(packages, PACKAGE_RULES)


def parse_since(text: str) -> datetime | None:
    """A time with zone, or a date; none for an empty text."""
    text = text.strip()
    if not text:
        return None
    value = datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=UTC)


def parse_window(text: str) -> timedelta:
    """A positive duration like 90m, 24h or 1h30m; 24 hours for an empty text."""
    import re

    if not text.strip():
        return timedelta(hours=24)
    parts = re.findall(r"(\d+(?:\.\d+)?)(h|m|s)", text.strip())
    total = sum((timedelta(**{{"h": "hours", "m": "minutes", "s": "seconds"}[u]: float(n)}) for n, u in parts), timedelta())
    if "".join(n + u for n, u in parts) != text.strip() or total <= timedelta(0):
        raise ValueError(f"no positive duration: {text!r}")
    return total


def parse_trace(text: str) -> tuple[str, str]:
    start, colon, end = text.partition(":")
    if not colon or not start.strip() or not end.strip():
        raise ValueError("expected from:to")
    return start.strip(), end.strip()


def openapi_operations(path: str, allow: Sequence[str] = ()) -> list[dict]:
    """(id, method, path, summary) of the operations of an OpenAPI file in JSON, only the allowed ids if any are given."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    methods = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
    out = [
        {"id": op.get("operationId") or f"{m}_{p}", "method": m.upper(), "path": p, "summary": op.get("summary", "")}
        for p, item in sorted(spec.get("paths", {}).items())
        for m in methods
        if (op := item.get(m))
    ]
    return [o for o in out if not allow or o["id"] in allow]
