"""Markdown reports, SARIF, the treemap page, and texts for a terminal."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import mask, relative_path

VERBOSITY = ("summary", "standard", "detailed")
COLLAPSE_CYCLES, COLLAPSE_ROWS = 10, 15
#: Rows of a section that a report shows at most; the number of all is given.
MAX_ROWS = {"summary": 10, "standard": 200, "detailed": 5_000}


def _table(rows: DataFrame, columns: Sequence[tuple[str, str]], order: Sequence[str], title: str, verbosity: str) -> list[str]:
    total = rows.count()
    out = [f"## {title} ({total})", ""]
    if not total:
        return [*out, "None.", ""]
    shown = rows.orderBy(*order).select(*[F.col(c).cast("string") for _, c in columns]).limit(MAX_ROWS[verbosity]).collect()
    clean = [[(v or "-").replace("|", "\\|").replace("\n", " ") for v in r] for r in shown]
    table = ["| " + " | ".join(n for n, _ in columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(r) + " |" for r in clean]]
    if len(shown) < total:
        table.append(f"\n{total - len(shown)} more rows are left out.")
    if total > COLLAPSE_ROWS:
        table = ["<details>", f"<summary>{total} rows</summary>", "", *table, "", "</details>"]
    return [*out, *table, ""]


def cycle_lines(cycles: Sequence[Sequence[str]]) -> list[str]:
    """A line for each cycle with its impact: ten for each module, high from four modules on."""
    return [f"{i}. `{' -> '.join([*c, c[0]])}` (impact {len(c) * 10}, {'High' if len(c) >= 4 else 'Medium'})" for i, c in enumerate(cycles, 1)]


def markdown(results: Mapping[str, DataFrame], title: str = "Analysis report", project: str = "default", root: str = "", verbosity: str = "standard", stamp: str = "") -> str:
    """A report with front matter, a summary and a section for each result that is there.

    results may have cycles (cycle), violations, rule_violations, hotspots, unresolved, bridges, unused and secrets.
    """
    verbosity = verbosity.strip().lower() if verbosity.strip().lower() in VERBOSITY else "standard"
    counts = {k: v.count() for k, v in results.items()}
    out = ["---", f"title: {title}", f"project: {project}", *([f"generated_at: {stamp}"] if stamp else []), f"verbosity: {verbosity}", "---", "", f"# {title}", "", "## Summary", ""]
    out += ["| Result | Count |", "| --- | --- |", *[f"| {k} | {n} |" for k, n in counts.items()], ""]
    own = {k: v.withColumn("path", relative_path(root, F.col("path"))) if root and "path" in v.columns else v for k, v in results.items()}
    if "cycles" in own:
        lines = cycle_lines([list(r["cycle"]) for r in own["cycles"].orderBy("cycle").limit(MAX_ROWS[verbosity]).collect()])
        body = lines or ["None."]
        if len(lines) > COLLAPSE_CYCLES:
            body = ["<details>", f"<summary>{len(lines)} cycles</summary>", "", *lines, "", "</details>"]
        out += [f"## Cycles ({counts['cycles']})", "", *body, ""]
    sections = {
        "violations": ("Layer violations", [("Rule", "rule"), ("From", "from_module"), ("To", "to_module"), ("File", "path"), ("Line", "line")], ("from_module", "to_module")),
        "rule_violations": ("Package rule violations", [("Rule", "rule"), ("Kind", "type"), ("Module", "module"), ("Target", "target"), ("Actual", "actual"), ("Limit", "limit")], ("rule", "module", "target")),
        "hotspots": ("Complexity hotspots", [("Module", "module"), ("Definition", "definition"), ("Score", "score"), ("Lines", "loc"), ("File", "path")], ("module", "definition")),
        "bridges": ("Probable bridges", [("File", "path"), ("Line", "line"), ("Reference", "name"), ("Score", "score")], ("path", "line", "name")),
        "unresolved": ("Unresolved references", [("File", "path"), ("Line", "line"), ("Reference", "name")], ("path", "line", "name")),
        "unused": ("Unused imports", [("File", "path"), ("Line", "line"), ("Module", "target"), ("Item", "item"), ("Confidence", "confidence")], ("path", "line", "item")),
    }
    for key, (name, columns, order) in sections.items():
        if key in own:
            out += _table(own[key], columns, order, name, verbosity)
    if "secrets" in own:
        hidden = own["secrets"].withColumn("value", mask(F.col("value")))
        out += _table(hidden, [("File", "file"), ("Line", "line"), ("Kind", "kind"), ("Severity", "severity"), ("Value", "value")], ("file", "line", "kind"), "Secrets", verbosity)
    return "\n".join(out)


def replace_between(text: str, marker: str, replacement: str) -> str:
    """text with what stands between ``<!-- marker:start -->`` and ``<!-- marker:end -->`` replaced; each must be there once."""
    start, end = f"<!-- {marker}:start -->", f"<!-- {marker}:end -->"
    if text.count(start) != 1 or text.count(end) != 1 or text.index(start) > text.index(end):
        raise ValueError(f"the markers of {marker!r} must be there once each, in order")
    head, rest = text.split(start)
    return f"{head}{start}\n{replacement.strip()}\n{end}{rest.split(end)[1]}"


def inject(path: str, marker: str, replacement: str) -> None:
    """replace_between() in a file, which is exchanged as a whole."""
    with open(path, encoding="utf-8") as f:
        text = replace_between(f.read(), marker, replacement)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, path)


# Rules of the SARIF output, with their default levels.
SARIF_RULES = {"import-cycle": "error", "hardcoded-secret": "error", "layer-violation": "warning", "package-rule-violation": "warning"}


def findings(results: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, level, message, path, line, col) of cycles, secrets and violations, as one table."""
    parts = []
    place = [F.col("path"), F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col")]
    if "cycles" in results:
        text = F.concat(F.lit("Import cycle: "), F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), " -> "))
        parts.append(results["cycles"].select(F.lit("import-cycle").alias("rule"), F.lit("error").alias("level"), text.alias("message"), F.lit("").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col")))
    if "secrets" in results:
        level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
        text = F.concat(F.lit("Possible secret ("), "kind", F.lit("): "), mask(F.col("value")))
        parts.append(results["secrets"].select(F.lit("hardcoded-secret").alias("rule"), level.alias("level"), text.alias("message"), F.col("file").alias("path"), *place[1:]))
    if "violations" in results:
        text = F.concat("from_layer", F.lit(" must not import "), "to_layer", F.lit(": "), "from_module", F.lit(" -> "), "to_module")
        parts.append(results["violations"].select(F.lit("layer-violation").alias("rule"), F.lit("warning").alias("level"), text.alias("message"), *place))
    if "rule_violations" in results:
        text = F.concat("rule", F.lit(": "), "type", F.lit(" in "), "module", F.when(F.col("target") != "", F.concat(F.lit(" -> "), "target")).otherwise(""))
        parts.append(results["rule_violations"].select(F.lit("package-rule-violation").alias("rule"), F.lit("warning").alias("level"), text.alias("message"), *place))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sarif(results: Mapping[str, DataFrame], tool: str = "graphloom", version: str = "0.1", root: str = "") -> str:
    """A SARIF 2.1.0 log; results are made to JSON by Spark, in a fixed order."""
    rows = findings(results).withColumn("uri", relative_path(root, F.col("path")) if root else F.col("path"))
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"), F.greatest("col", F.lit(1)).alias("startColumn")))
    location = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    one = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.when(F.col("uri") != "", F.array(location)).alias("locations"))
    texts = rows.orderBy("rule", "uri", "line", "col", "message").select(F.to_json(one).alias("j"), "rule").collect()
    used = sorted({r["rule"] for r in texts})
    rules = [{"id": r, "defaultConfiguration": {"level": SARIF_RULES[r]}} for r in used]
    log = {
        "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0",
        "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": [json.loads(r["j"]) for r in texts]}],
    }
    return json.dumps(log, indent=2)


def treemap_json(tree: DataFrame) -> str:
    """The hierarchy of the treemap page: groups with their modules."""
    rows = sorted(tree.collect(), key=lambda r: r["group"])
    children = [{"name": r["group"], "children": [{"name": m["name"], "value": m["size"], "importance": m["importance"]} for m in r["modules"]]} for r in rows]
    return json.dumps({"name": "modules", "children": children})


def treemap_page(tree: DataFrame) -> str:
    """A page that draws the hierarchy as nested boxes, without anything from elsewhere."""
    data = treemap_json(tree).replace("</", "<\\/")
    script = (
        "const d=JSON.parse(document.getElementById('d').textContent);for(const g of d.children){const b=document.createElement('section');"
        "b.innerHTML='<h2></h2>';b.firstChild.textContent=g.name;for(const m of g.children){const x=document.createElement('span');"
        "x.textContent=m.name;x.style.flexGrow=m.value;b.append(x)}document.body.append(b)}"
    )
    style = "section{display:flex;flex-wrap:wrap;border:1px solid;margin:4px}h2{width:100%;margin:2px}span{border:1px solid;padding:2px}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>{style}</style></head><body><script type="application/json" id="d">{data}</script><script>{script}</script></body></html>'


def impact_text(module: str, rows: DataFrame) -> str:
    kinds: dict[str, list[str]] = {"direct": [], "transitive": [], "symbol": []}
    for r in rows.orderBy("kind", "name").collect():
        kinds[r["kind"]].append(r["name"])
    names = {"direct": "Direct importers", "transitive": "Transitive importers", "symbol": "Exported symbols"}
    return "\n".join([f"Impact of {module}", *[f"{names[k]} ({len(v)}): {', '.join(v) or 'none'}" for k, v in kinds.items()]])


def trace_text(path: Sequence[str]) -> str:
    return "Import chain:\n" + "\n".join("  " * i + ("-> " if i else "") + m for i, m in enumerate(path))


def summary_text(counts: Mapping[str, int]) -> str:
    width = max(map(len, counts), default=0)
    return "\n".join(f"{k.ljust(width)}  {v}" for k, v in counts.items())
