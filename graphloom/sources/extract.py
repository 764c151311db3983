"""Source text to rows: imports, definitions and references, by one extractor for each language.

Extractors are Python functions from text to tagged rows and run in one mapInPandas stage. Python is parsed by its
own grammar; the other languages are read by patterns over lines, which find top-level statements and calls but
build no tree.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import call_context
from graphloom.schemas import CLASS, CONSTANT, FUNCTION, INTERFACE, METHOD, TYPE, VARIABLE
from graphloom.sources.languages import Dynamic

Row = dict
Extractor = Callable[[str], Iterator[Row]]

# Kinds of tree nodes by usage tag, in the order in which they are tried, and by kind of definition.
TAG_TIERS = (
    (r"(?i)(^|_)(declaration|definition)$", "SYM_DEF"),
    (r"(?i)^(function_item|method_declaration|class_definition|struct_item|enum_item|interface_declaration|trait_item|impl_item)$", "SYM_DEF"),
    (r"(?i)^(type_identifier|qualified_type|generic_type|scoped_type_identifier|type_spec|type_ref)$", "REF_TYPE"),
    (r"(?i)^(call_expression|method_invocation|function_call|invocation_expression|call_stmt)$", "REF_CALL"),
    (r"(?i)^(string_literal|interpreted_string_literal|raw_string_literal|string|string_content)$", "REF_DYN"),
    (r"(?i)^blank_identifier$", "REF_SIDE"),
)
DEFINITION_KINDS = {
    METHOD: ("method_declaration", "method_definition", "method", "method_spec", "method_signature", "constructor_declaration"),
    FUNCTION: ("function_declaration", "function_definition", "function_item", "function_signature", "function_statement"),
    CLASS: ("class_declaration", "class_definition", "class_specifier"),
    INTERFACE: ("interface_declaration", "interface_definition", "trait_item"),
    TYPE: ("type_declaration", "type_definition", "type_spec", "struct_item", "struct_declaration", "enum_item", "enum_declaration", "impl_item"),
    VARIABLE: ("variable_declaration", "const_declaration", "const_item", "let_declaration", "var_declaration"),
}


def usage_tag(node_kind: str) -> str:
    return next((tag for pattern, tag in TAG_TIERS if re.search(pattern, node_kind)), "")


def definition_kind(node_kind: str) -> int | None:
    return next((kind for kind, nodes in DEFINITION_KINDS.items() if node_kind in nodes), None)


def _import(target: str, line: int, col: int = 1, alias: str = "", items: tuple[str, ...] = (), raw: str = "", relative: bool = False) -> Row:
    return {"row": "import", "name": target, "alias": alias, "items": list(items), "raw": raw or target, "is_relative": relative, "line": line, "col": col}


def _definition(name: str, kind: int, line: int, col: int = 1, **more) -> Row:
    return {"row": "definition", "name": name, "kind": kind, "line": line, "col": col} | more


def _reference(name: str, line: int, col: int = 1, context: str = "REF_CALL|") -> Row:
    return {"row": "reference", "name": name, "context": context, "line": line, "col": col}


class _PythonWalk(ast.NodeVisitor):
    BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.IfExp, ast.match_case, ast.ExceptHandler)
    NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)

    def __init__(self, source: str) -> None:
        self.lines = source.split("\n")
        self.rows: list[Row] = []
        self.scope: list[str] = []

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.rows.append(_import(a.name, node.lineno, node.col_offset + 1, a.asname or "", raw=f"import {a.name}"))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        target = "." * node.level + (node.module or "")
        items = tuple(a.name for a in node.names)
        self.rows.append(_import(target, node.lineno, node.col_offset + 1, items=items, relative=node.level > 0))

    def _size(self, node: ast.AST) -> tuple[int, int]:
        branches = deepest = 0
        work = [(child, 0) for child in ast.iter_child_nodes(node)]
        while work:
            at, depth = work.pop()
            if isinstance(at, ast.FunctionDef | ast.AsyncFunctionDef):
                continue
            branches += isinstance(at, self.BRANCHES)
            depth += isinstance(at, self.NESTS)
            deepest = max(deepest, depth)
            work += [(child, depth) for child in ast.iter_child_nodes(at)]
        return branches, deepest + 1

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, in_class: bool) -> None:
        a = node.args
        params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
        branches, nesting = self._size(node)
        loc = sum(bool(x.strip()) for x in self.lines[node.lineno - 1 : node.end_lineno])
        self.rows.append(
            _definition(
                node.name, METHOD if in_class else FUNCTION, node.lineno, node.col_offset + 1, branches=branches, nesting=nesting, params=params, loc=loc,
                scope="->".join(self.scope), exported=not node.name.startswith("_"), signature=f"def {node.name}({ast.unparse(a)})",
                decorators=[ast.unparse(d) for d in node.decorator_list],
            )
        )
        self._inside(node)

    def _inside(self, node) -> None:
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._function(node, bool(self.scope) and self.scope[-1][:1].isupper())

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.rows.append(
            _definition(
                node.name, CLASS, node.lineno, node.col_offset + 1, scope="->".join(self.scope), exported=not node.name.startswith("_"),
                loc=node.end_lineno - node.lineno + 1, decorators=[ast.unparse(d) for d in node.decorator_list],
            )
        )
        self._inside(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        if not self.scope:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.rows.append(_definition(t.id, CONSTANT if t.id.isupper() else VARIABLE, node.lineno, t.col_offset + 1))
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.rows.append({"row": "local", "name": t.id, "line": node.lineno, "col": t.col_offset + 1})
        self.generic_visit(node)

    def visit_arg(self, node: ast.arg) -> None:
        self.rows.append({"row": "local", "name": node.arg, "line": node.lineno, "col": node.col_offset + 1})

    def visit_Call(self, node: ast.Call) -> None:
        name = "".join(ast.unparse(node.func).split())
        if len(name) <= 128:
            self.rows.append(_reference(name, node.lineno, node.col_offset + 1, "REF_CALL|" + "->".join(self.scope)))
        self.generic_visit(node)


def python(source: str) -> Iterator[Row]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    walk = _PythonWalk(source)
    walk.visit(tree)
    yield from walk.rows


def _code_lines(source: str, comment: str = "//") -> Iterator[tuple[int, str]]:
    """Lines without line comments and block comments."""
    plain = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), source, flags=re.S)
    for n, line in enumerate(plain.split("\n"), 1):
        yield n, line.split(comment)[0] if comment and comment in line and "://" not in line else line


def _calls(n: int, line: str, keywords: frozenset[str]) -> Iterator[Row]:
    for m in re.finditer(r"([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)!?\s*\(", line):
        if m[1] not in keywords and not re.search(r"\b(func|fn|function|def|class|new)\s+(\([^)]*\)\s*)?$", line[: m.start()]):
            yield _reference(m[1], n, len(line[: m.start()].encode()) + 1)


_KEYWORDS = frozenset("if for while switch return func fn function catch match super sizeof typeof await new else in of and or not".split())


def _blocks(source: str, start: int) -> tuple[int, int, int]:
    """(lines, branches, nesting) of the block that opens on line start."""
    depth, opened, lines, branches, deepest = 0, False, 0, 0, 0
    for n, line in enumerate(source.split("\n")[start - 1 :]):
        lines += bool(line.strip())
        branches += len(re.findall(r"\b(if|for|while|case|catch|match|select|loop)\b", line)) if n else 0
        for c in line:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
            deepest = max(deepest, depth)
        if opened and depth <= 0:
            break
    return lines, branches, deepest


def _function_row(source: str, name: str, kind: int, n: int, params: str, exported: bool, col: int = 1, **more) -> Row:
    loc, branches, nesting = _blocks(source, n)
    count = len([p for p in params.split(",") if p.strip()])
    return _definition(name, kind, n, col, loc=loc, branches=branches, nesting=nesting, params=count, exported=exported) | more


def go(source: str) -> Iterator[Row]:
    inside = False
    for n, line in _code_lines(source):
        if m := re.match(r"\s*package\s+(\w+)", line):
            yield {"row": "package", "name": m[1], "line": n, "col": 1}
        if re.match(r"\s*import\s*\(", line):
            inside = True
        elif inside and line.strip() == ")":
            inside = False
        elif m := re.match(r'\s*(?:import\s+)?([\w.]+\s+)?"([^"]+)"\s*$', line) if inside or line.lstrip().startswith("import") else None:
            yield _import(m[2], n, len(line) - len(line.lstrip()) + 1, (m[1] or "").strip())
        elif m := re.match(r"func\s+(?:\(([^)]*)\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(([^)]*)\)?", line):
            yield _function_row(source, m[2], METHOD if m[1] else FUNCTION, n, m[3], m[2][:1].isupper())
            for p in re.findall(r"(\w+)\s+[\w.*\[\]]+", (m[1] or "") + "," + m[3]):
                yield {"row": "local", "name": p, "line": n, "col": 1}
            yield from _calls(n, line, _KEYWORDS)
        elif m := re.match(r"type\s+(\w+)\s+(interface)?", line):
            yield _definition(m[1], INTERFACE if m[2] else TYPE, n, exported=m[1][:1].isupper())
        elif m := re.match(r"(?:var|const)\s+(\w+)", line):
            yield _definition(m[1], CONSTANT if line.startswith("const") else VARIABLE, n, exported=m[1][:1].isupper())
        else:
            for names in re.findall(r"((?:\w+\s*,\s*)*\w+)\s*:=", line):
                for name in names.split(","):
                    yield {"row": "local", "name": name.strip(), "line": n, "col": 1}
            yield from _calls(n, line, _KEYWORDS)


def script(source: str) -> Iterator[Row]:
    for n, line in _code_lines(source):
        if m := re.search(r"""import\s+(?:(.+?)\s+from\s+)?['"]([^'"]+)['"]""", line):
            what = m[1] or ""
            items = tuple(re.split(r"\s+as\s+", x.strip())[0] for x in re.search(r"\{(.*)\}", what)[1].split(",") if x.strip()) if "{" in what else ()
            alias = re.sub(r"\{.*\}", "", what).strip(" ,").replace("* as ", "")
            yield _import(m[2], n, alias=alias, items=items, relative=m[2].startswith("."))
        elif m := re.search(r"""(?:const|let|var)\s+(?:(\w+)|\{([^}]*)\})\s*=\s*require\(\s*['"]([^'"]+)['"]""", line):
            yield _import(m[3], n, alias=m[1] or "", items=tuple(x.strip() for x in (m[2] or "").split(",") if x.strip()), relative=m[3].startswith("."))
        else:
            public = "export" in line
            if m := re.search(r"\bfunction\s*\*?\s*(\w+)\s*\(([^)]*)", line) or re.search(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>", line):
                yield _function_row(source, m[1], FUNCTION, n, m[2], public, visibility="public" if public else "private")
            elif m := re.search(r"\bclass\s+(\w+)", line):
                yield _definition(m[1], CLASS, n, exported=public)
            elif m := re.search(r"\b(interface|type|enum)\s+(\w+)\s*[={<]", line):
                yield _definition(m[2], INTERFACE if m[1] == "interface" else TYPE, n, exported=public, type_hint=m[1])
            elif m := re.match(r"\s+(?:async\s+|static\s+)*(\w+)\s*\(([^)]*)\)\s*\{", line):
                if m[1] not in _KEYWORDS:
                    yield _function_row(source, m[1], METHOD, n, m[2], not m[1].startswith("_"))
            elif m := re.search(r"\b(?:const|let|var)\s+(\w+)", line):
                yield {"row": "local", "name": m[1], "line": n, "col": 1}
            yield from _calls(n, line, _KEYWORDS)


def java(source: str) -> Iterator[Row]:
    for n, line in _code_lines(source):
        visibility = next((v for v in ("public", "protected", "private") if re.search(rf"\b{v}\b", line)), "package")
        if m := re.match(r"\s*package\s+([\w.]+)\s*;", line):
            yield {"row": "package", "name": m[1], "line": n, "col": 1}
        elif m := re.match(r"\s*import\s+(?:static\s+)?([\w.*]+)\s*;", line):
            yield _import(m[1], n)
        elif m := re.search(r"\b(class|interface|enum|record)\s+(\w+)", line):
            kind = {"class": CLASS, "interface": INTERFACE}.get(m[1], TYPE)
            yield _definition(m[2], kind, n, exported=visibility == "public", visibility=visibility, type_hint=m[1])
        elif m := re.match(r"\s+(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\(([^)]*)\)", line):
            yield _function_row(source, m[1], METHOD, n, m[2], visibility == "public", visibility=visibility)
            yield from _calls(n, line[line.find("{") :] if "{" in line else "", _KEYWORDS)
        else:
            yield from _calls(n, line, _KEYWORDS)


def rust(source: str) -> Iterator[Row]:
    for n, line in _code_lines(source):
        public = bool(re.match(r"\s*pub\b", line))
        if m := re.match(r"\s*(?:pub\s+)?use\s+(.+?)\s*;", line):
            head, brace, tail = m[1].partition("{")
            for part in tail.rstrip("}").split(",") if brace else [""]:
                path = (head + part.strip()).strip().rstrip(":")
                target, _, alias = path.partition(" as ")
                if target:
                    yield _import(target.strip(), n, alias=alias.strip(), relative=target.startswith(("self", "super", "crate")))
        elif m := re.match(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)\s*(?:<[^>]*>)?\(([^)]*)", line):
            yield _function_row(source, m[1], METHOD if "self" in m[2] else FUNCTION, n, m[2], public, visibility="public" if public else "private")
            yield from _calls(n, line, _KEYWORDS)
        elif m := re.match(r"\s*(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait|type|const|static)\s+(\w+)", line):
            kind = {"trait": INTERFACE, "const": CONSTANT, "static": VARIABLE}.get(m[1], TYPE)
            yield _definition(m[2], kind, n, exported=public, visibility="public" if public else "private", type_hint=m[1])
        elif m := re.match(r"\s*let\s+(?:mut\s+)?(\w+)", line):
            yield {"row": "local", "name": m[1], "line": n, "col": 1}
            yield from _calls(n, line, _KEYWORDS)
        else:
            yield from _calls(n, line, _KEYWORDS)


def html(source: str) -> Iterator[Row]:
    for m in re.finditer(r"<(\w+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", source):
        line, tag = source.count("\n", 0, m.start()) + 1, m[1].lower()
        attributes = {k.lower(): v.strip("\"'") for k, v in re.findall(r"([\w-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", m[2])}
        wanted = {"script": "src", "link": "href"}.get(tag)
        if wanted and attributes.get(wanted):
            yield _import(attributes[wanted], line, raw=tag)
        if attributes.get("id"):
            yield _definition(attributes["id"], VARIABLE, line, exported=True)
        for name in attributes.get("class", "").split():
            yield _reference(name, line, context="")


def css(source: str) -> Iterator[Row]:
    plain = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), source, flags=re.S)
    for m in re.finditer(r"@import\s+(?:url\()?\s*[\"']?([^\"')\s;]+)", plain):
        yield _import(m[1], plain.count("\n", 0, m.start()) + 1)
    for m in re.finditer(r"([^{}@;]+)\{", plain):
        line = plain.count("\n", 0, m.start(1) + len(m[1]) - len(m[1].lstrip())) + 1
        for name in re.findall(r"[.#][A-Za-z_][\w-]*|(?<![\w.#:-])[a-z][a-z0-9]*", m[1]):
            yield _definition(name, VARIABLE, line, exported=True)


def gomod(source: str) -> Iterator[Row]:
    for n, line in enumerate(source.split("\n"), 1):
        words = line.split("//")[0].split()
        if words[:1] == ["module"] and len(words) > 1:
            yield {"row": "package", "name": words[1], "line": n, "col": 1}
            yield _definition(words[1], CONSTANT, n, exported=True)
        elif words[:1] == ["require"] and len(words) > 2 and words[1] != "(":
            yield _import(words[1], n, raw=" ".join(words[1:]))


def gosum(source: str) -> Iterator[Row]:
    seen: set[str] = set()
    for n, line in enumerate(source.split("\n"), 1):
        words = line.split()
        name = words[0] if words else ""
        if name and name not in seen:
            seen.add(name)
            yield _import(name, n)


def dynamic(config: Dynamic) -> Extractor:
    """An extractor for configured kinds, over text of the form ``kind name`` at the beginning of a line."""

    def run(source: str) -> Iterator[Row]:
        for n, line in _code_lines(source, "#"):
            words = line.strip().rstrip(";{:").split()
            if len(words) < 2:
                continue
            kind, name = words[0], words[1].strip("\"'(){};")
            if kind == config.namespace_kind:
                yield {"row": "package", "name": name, "line": n, "col": 1}
            elif kind in config.import_kinds:
                yield _import(name, n, raw=line.strip())
            elif kind in config.definition_kinds:
                yield _definition(name, definition_kind(kind) if definition_kind(kind) is not None else TYPE, n, exported=True)

    return run


EXTRACTORS: dict[str, Extractor] = {
    "python": python, "go": go, "javascript": script, "typescript": script, "tsx": script, "java": java, "rust": rust, "html": html, "css": css,
    "gomod": gomod, "gosum": gosum,
}

_ROWS = (
    "path string, language string, row string, seq int, name string, alias string, items array<string>, raw string, is_relative boolean, kind int, exported boolean, "
    "visibility string, scope string, signature string, type_hint string, decorators array<string>, branches int, params int, nesting int, loc int, context string, line int, col int"
)
_EMPTY = {
    "alias": "", "items": [], "raw": "", "is_relative": False, "kind": 0, "exported": False, "visibility": "", "scope": "", "signature": "", "type_hint": "", "decorators": [],
    "branches": 0, "params": 0, "nesting": 0, "loc": 0, "context": "",
}


def extract(sources: DataFrame, extractors: dict[str, Extractor] = EXTRACTORS) -> DataFrame:
    """A row for each import, definition, reference, local name and package of sources (path, language, content)."""
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, content in zip(frame["path"], frame["language"], frame["content"], strict=True):
                make = extractors.get(language)
                if make is not None and content:
                    rows += [_EMPTY | r | {"path": path, "language": language, "seq": i} for i, r in enumerate(make(content))]
            yield pd.DataFrame(rows, columns=names)

    return sources.select("path", "language", "content").mapInPandas(run, _ROWS)


def tables(rows: DataFrame, named: DataFrame) -> dict[str, DataFrame]:
    """The model tables from extracted rows and files (path, language, module)."""
    own = rows.join(named.select("path", "module"), "path")
    full = F.when((F.col("module") == "") | F.col("name").startswith(F.concat("module", F.lit("."))), F.col("name")).otherwise(F.concat_ws(".", "module", "name"))
    bridge = call_context(F.col("language"), F.col("name"))
    local = rows.filter("row = 'local'").groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("local_symbols"))
    package = rows.filter("row = 'package'").groupBy("path").agg(F.min_by("name", "seq").alias("package_name"))
    files = named.join(local, "path", "left").join(package, "path", "left")
    return {
        "files": files.select(
            "path", "language", "module", F.coalesce("package_name", F.lit("")).alias("package_name"), F.coalesce("local_symbols", F.array().cast("array<string>")).alias("local_symbols")
        ),
        "imports": own.filter("row = 'import'").select("path", "module", "seq", F.col("name").alias("target"), "raw", "alias", "items", "is_relative", "line", "col"),
        "definitions": own.filter("row = 'definition'").select(
            "path", "module", "seq", "name", full.alias("full_name"), "kind", "exported", "visibility", "scope", "signature", "type_hint", "decorators", "branches", "params",
            "nesting", "loc", F.lit(0).alias("complexity_score"), "line", "col",
        ),
        "references": own.filter("row = 'reference'").select(
            "path", "module", "language", "seq", "name", F.when(bridge != "", bridge).otherwise(F.col("context")).alias("context"), "line", "col"
        ),
    }
