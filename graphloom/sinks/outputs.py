"""Artifacts of a project, written in one go: diagrams by mode and format, tables, report, SARIF and treemap."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from graphloom.functions.globs import normalize_path
from graphloom.operators import diagrams
from graphloom.session import cut
from graphloom.sinks import diagrams as draw
from graphloom.sinks import reports, tsv

if TYPE_CHECKING:
    from graphloom.api import Project


@dataclass(frozen=True)
class Targets:
    """Where each artifact goes; an empty path leaves it out. A bare diagram name goes to diagrams_dir, other relative paths to root."""

    root: str = "."
    diagrams_dir: str = "docs/diagrams"
    dot: str = ""
    mermaid: str = ""
    plantuml: str = ""
    tsv: str = ""
    markdown: str = ""
    sarif: str = ""
    treemap: str = ""
    modes: tuple[str, ...] = ("dependency",)

    def output(self, path: str) -> str:
        path = path.strip()
        if not path or path.startswith("/"):
            return normalize_path(path)
        return os.path.join(self.root, normalize_path(path))

    def diagram(self, path: str) -> str:
        path = path.strip()
        if not path or "/" in path or "\\" in path:
            return self.output(path)
        return os.path.join(self.output(self.diagrams_dir.strip() or "docs/diagrams"), path)


def write_text(path: str, parts: str | Iterable[str]) -> str:
    """Write a file, with the folders above it, and exchange it as a whole."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.writelines([parts] if isinstance(parts, str) else parts)
    os.replace(temporary, path)
    return path


def _lines(blocks: Iterable) -> Iterable[str]:
    """The lines of several blocks with an empty line between them; rows come one partition at a time."""
    for k, block in enumerate(blocks):
        if k:
            yield "\n"
        for row in block.toLocalIterator():
            yield row["line"] + "\n"


def write_outputs(project: Project, targets: Targets, formats: Sequence[str] | None = None) -> list[str]:
    """The paths that were written, in order; with formats only diagrams of these. Unknown formats and modes are errors."""
    wanted = tuple(draw.WRITERS) if formats is None else tuple(f.strip().lower() for f in formats)
    if bad := [f for f in wanted if f not in draw.WRITERS]:
        raise ValueError(f"unknown format {bad[0]!r}")
    written = []
    bases = {f: targets.diagram(getattr(targets, f)) for f in wanted}
    paths = {f: draw.output_paths(base, targets.modes) for f, base in bases.items() if base}
    for mode in targets.modes if paths else ():
        diagram = project.diagram(mode)
        written += [write_text(by_mode[mode], draw.WRITERS[f](diagram)) for f, by_mode in paths.items()]
    if formats is not None:
        return written
    # Each result is counted, sorted and written by several artifacts, so it is made once.
    results = {k: cut(v) for k, v in project.results().items()} if targets.tsv or targets.markdown or targets.sarif else {}
    if path := targets.output(targets.tsv):
        blocks = [tsv.edges_block(project.edges), tsv.unused_imports_block(results["unused"]), tsv.layer_violations_block(results["violations"])]
        blocks += [tsv.rule_violations_block(results["rule_violations"]), tsv.probable_bridges_block(results["bridges"])]
        blocks += [tsv.secrets_block(results["secrets"])] if "secrets" in results else []
        written.append(write_text(path, _lines(blocks)))
    if path := targets.output(targets.markdown):
        written.append(write_text(path, reports.markdown(results, project=project.name)))
    if path := targets.output(targets.sarif):
        written.append(write_text(path, reports.sarif({k: results[k] for k in ("cycles", "secrets", "violations", "rule_violations") if k in results})))
    if path := targets.output(targets.treemap):
        written.append(write_text(path, reports.treemap_json(diagrams.treemap(project.metrics(), project.files))))
    return written
